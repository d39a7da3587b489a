r"""PII by weak supervision, DataFrame functions only.

Candidate spans come from patterns; labelers vote on each: its strict form (regex), lists
(gazetteer), the words before it (context) and its checksum or shape.  Expectation
maximisation over the counts of vote patterns estimates each labeler's reliability without
any gold labels, and a logistic span classifier is trained on the posteriors.  A labeler is
held to be better than chance, which ties the class that EM finds to the labelers' meaning.
Both run as expressions over a table of a few hundred pattern counts, whatever the number of
spans; the counts cover all documents.  The base kinds and the others have a model each.
Base spans always stay (those that their model doubts are counted); the classifier decides on
the others.

The patterns are written so that Java's matcher needs neither recursion nor repeated starts
in a run: single separators are first masked by one character of the same length (U+0001),
which turns repeated groups into character classes and leaves all positions as they are.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import materialize

# Kinds in their order; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "iban", "name")
BASE = 4

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)){3}$"
CARD = r"(?<![0-9\x01])[0-9][0-9\x01]{11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"

# The gazetteers and context words of the labelers.
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
FIRST_NAMES = ("anna", "carlos", "david", "emma", "hans", "ines", "james", "jean", "john", "juan", "julia", "karl", "laura", "maria", "marie", "michael", "paul", "peter", "robert", "sophie", "thomas")
CONTEXT = {
    "email": "mail|contact|write to|courriel|correo",
    "ip": "ip|server|host|login|address|adresse",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|mobile|fax|telefon|anruf|llama",
    "local_phone": "phone|tel|call|mobile|fax|telefon|anruf|llama",
    "national_id": "ssn|social security|national id|id no|steuer|dni",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "name": "name|dear|sincerely|signed|regards|contact",
}
#: Characters before a span that the context labeler reads.
REACH = 40
LABELERS = ("regex", "gazetteer", "context", "shape")
# Country codes of account numbers, and the strict forms of the kinds that aren't base.
COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE")
STRICT = {
    "local_phone": r"^(?:\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4})$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z0-9]+)$",
    "name": r"^[A-Za-z]+\.? [A-Z][a-z]+ [A-Z][a-z]+$",
}


#: Code points of a block of a text, so that a place in a long text is reached without reading all before it.
BLOCK = 1024
#: Entries that a fold adds to one list before it begins another; appending one by one to a long list takes quadratic time.
PART = 128


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """The text of [begin, end), from its blocks."""
    first = F.floor(begin / BLOCK).cast("int")
    n = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    return F.when(end > begin, F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(1))), ""), begin - first * BLOCK + 1, end - begin)).otherwise("")


def _push(acc: Column, one: Column) -> list[Column]:
    """The fields full and open of a fold's state with one more entry; _pushed() lists all."""
    more = F.concat(acc["open"], F.array(one))
    done = F.size(more) >= PART
    return [F.when(done, F.concat(acc["full"], F.array(more))).otherwise(acc["full"]).alias("full"), F.when(done, F.slice(more, 1, 0)).otherwise(more).alias("open")]


def _pushed(acc: Column) -> Column:
    return F.flatten(F.concat(acc["full"], F.array(acc["open"])))


def _start(kind: str) -> list[Column]:
    return [F.expr(f"cast(array() as array<array<{kind}>>)").alias("full"), F.expr(f"cast(array() as array<{kind}>)").alias("open")]


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<s,e,m>> of the matches `found` of a pattern: the pieces between them give their places."""
    kind = "struct<s:int,e:int,m:string>"

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), *_push(acc, F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))

    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    walk = F.aggregate(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), F.struct(F.lit(0).alias("at"), *_start(kind)), step, _pushed)
    return F.when(F.size(found) > 0, walk).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def _luhn(digits: Column) -> Column:
    """Of a string of digits only."""
    back = F.reverse(digits)

    def value(i):
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _account_number(m: Column) -> Column:
    """Whether the check digits of an account number are right: its letters as 10 to 35, the first four characters last, modulo 97."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))

    def step(a, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def candidates(docs: DataFrame, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., text and cand: array<struct<s,k,e,v0..v3>> of all candidate spans, k from 1 as in KINDS, sorted; votes are 1, 0 or -1 (abstains)."""
    t = docs.select(*keep, F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\x01", "\x02").alias("t"))
    dotted = F.regexp_replace("t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x01")
    joined = F.regexp_replace("t", r"(?<=[0-9])[ -](?=[0-9])", "\x01")
    t = t.withColumns({"digit": F.col("t").rlike("[0-9][0-9 ().-]*[0-9]"), "at": F.col("t").contains("@"), "plus": F.col("t").contains("+")})
    t = t.withColumns({"dotted": F.when(F.col("at"), dotted).otherwise(""), "joined": F.when(F.col("digit"), joined).otherwise("")})
    where = {  # the text that a kind is looked for in, its pattern, and what the text must have
        "email": ("dotted", EMAIL, F.col("at")),
        "ip": ("t", IP, F.col("digit")),
        "card": ("joined", CARD, F.col("digit")),
        "phone": ("t", PHONE, F.col("plus")),
        "local_phone": ("t", LOCAL_PHONE, F.col("digit")),
        "national_id": ("t", NATIONAL_ID, F.col("digit")),
        "iban": ("t", IBAN, F.col("digit")),
        "name": ("t", NAME, F.lit(True)),
    }
    t = t.withColumns({f"f_{k}": F.when(need, F.regexp_extract_all(F.col(src), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, (src, pattern, need) in where.items()})
    t = t.withColumns({k: _spans(F.col(src), F.col(f"f_{k}"), pattern) for k, (src, pattern, _) in where.items()})
    valid = {
        "ip": lambda x: x["m"].rlike(IP_PARTS),
        "card": lambda x: F.length(_digits(x["m"])).between(12, 19) & _luhn(_digits(x["m"])),
        "phone": lambda x: F.length(_digits(x["m"])).between(9, 15),
    }
    t = t.withColumns({k: F.filter(k, f) for k, f in valid.items()})
    base = F.concat(*[F.transform(k, lambda x: F.struct(x["s"], x["e"])) for k in KINDS[:BASE]])
    t = t.withColumns({"base": base, "blocks": _blocks(F.col("t"))})
    # the base spans that reach into each block
    near = F.transform(F.sequence(F.lit(0), F.size("blocks") - 1), lambda i: F.filter("base", lambda b: (b["s"] < (i + 1) * BLOCK) & (b["e"] > i * BLOCK)))
    t = t.withColumn("near", F.when((F.size("base") > 0) & (F.size("blocks") > 0), near))

    def votes(kind: str, x: Column) -> list[Column]:
        m = x["m"]
        before = F.lower(_cut(F.col("blocks"), F.greatest(F.lit(0), x["s"] - REACH), x["s"]))
        context = F.when(before.rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})"), 1).otherwise(0)
        digits = _digits(m)
        listed = {
            "email": F.when(F.regexp_extract(F.lower(m), r"\x01([a-z0-9-]+)$", 1).isin(*TLDS), 1).otherwise(0),
            "ip": F.when(m.rlike(r"^(?:0|10|127|255)\.|^192\.168\."), 0).otherwise(1),
            "card": F.when(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(0),
            "phone": F.when(m.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-8])"), 1).otherwise(0),
            "name": F.when(F.lower(F.regexp_extract(m, r" ([A-Z][a-z]+)", 1)).isin(*FIRST_NAMES), 1).otherwise(0),
            "iban": F.when(F.substring(m, 1, 2).isin(*COUNTRIES), 1).otherwise(0),
        }.get(kind, F.lit(-1))
        # a local phone number's form alone says little for it, as other figures have it too
        strict = F.when(m.rlike(STRICT[kind]), -1 if kind == "local_phone" else 1).otherwise(0) if kind in STRICT else F.lit(1)
        shape = {
            "card": F.when(F.length(digits).isin(15, 16), 1).otherwise(0),
            "phone": F.when(F.length(digits).between(10, 13), 1).otherwise(0),
            "iban": F.when(_account_number(m), 1).otherwise(0),
            "email": F.when(F.length(m) <= 64, 1).otherwise(0),
            "ip": F.when(m.rlike(r"(?:^|\.)0[0-9]"), 0).otherwise(1),
        }.get(kind, F.lit(-1))
        return [strict, listed, context, shape]

    def labelled(n: int, kind: str) -> Column:
        def one(x):
            v = [c.cast("int").alias(f"v{j}") for j, c in enumerate(votes(kind, x))]
            return F.struct(x["s"].alias("s"), F.lit(n + 1).alias("k"), x["e"].alias("e"), *v)

        found = F.col(kind)
        if n >= BASE:  # what a base span covers already is no candidate of another kind
            first, last = (lambda x: F.floor(x["s"] / BLOCK).cast("int")), (lambda x: F.floor((x["e"] - 1) / BLOCK).cast("int"))
            reached = lambda x: F.flatten(F.slice("near", first(x) + 1, last(x) - first(x) + 1))
            found = F.when(F.col("near").isNull(), found).otherwise(F.filter(found, lambda x: ~F.exists(reached(x), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
        return F.transform(found, one)

    return t.select(*keep, F.array_sort(F.concat(*[labelled(n, k) for n, k in enumerate(KINDS)])).alias("cand"))


@dataclass(frozen=True)
class SpanModel:
    """Estimated reliabilities (P(vote 1 | PII), P(vote 1 | none) per labeler), the prior, and the classifier's weights."""

    prior: float
    hit: tuple[float, ...]
    false_hit: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self, x: Column) -> Column:
        z = F.lit(self.weights[0])
        for j in range(len(LABELERS)):
            z = z + F.when(x[f"v{j}"] == 1, self.weights[1 + 2 * j]).when(x[f"v{j}"] == 0, self.weights[2 + 2 * j]).otherwise(0.0)
        return F.lit(1.0) / (F.exp(-z) + 1)


def fit(cand: DataFrame, which: str = "true", rounds: int = 25, steps: int = 400, rate: float = 2.0) -> SpanModel:
    """EM and the classifier over the counts of vote patterns of all candidate spans c in the column cand that `which` holds for."""
    n_lab = len(LABELERS)
    votes = [f"v{j}" for j in range(n_lab)]
    counts = cand.select(F.explode("cand").alias("c")).where(which).groupBy(*[F.col(f"c.{v}").alias(v) for v in votes]).agg(F.count("*").cast("double").alias("n"))
    # one row: at most 3^4 patterns
    x = ["1D", *[f"cast(v{j} = {y} as int) * 1D" for j in range(n_lab) for y in (1, 0)]]
    row = counts.select(F.struct(F.array(*votes).alias("v"), "n", F.expr(f"array({', '.join(x)})").alias("x")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    row = row.withColumn("total", F.expr("greatest(1D, aggregate(ps, 0D, (a, p) -> a + p.n))"))

    def log_odds(state: str) -> str:
        terms = "".join(f" + case get(p.v, {j}) when 1 then ln(get({state}.a, {j}) / get({state}.b, {j})) when 0 then ln((1 - get({state}.a, {j})) / (1 - get({state}.b, {j}))) else 0D end" for j in range(n_lab))
        return f"(ln({state}.prior / (1 - {state}.prior)){terms})"

    def posterior(state: str) -> str:
        return f"1D / (1D + exp(-greatest(-30D, least(30D, {log_odds(state)}))))"

    def share(j: int, y: str, least: float, most: float, ones: int) -> str:
        """Share of 1 among the votes of labeler j, weighted by y, with `ones` of five votes of 1 before any is seen."""
        return f"least({most}D, greatest({least}D, ({ones} + aggregate(q, 0D, (s, p) -> s + if(get(p.v, {j}) = 1, p.n * {y}, 0D))) / (5 + aggregate(q, 0D, (s, p) -> s + if(get(p.v, {j}) >= 0, p.n * {y}, 0D)))))"

    start = f"named_struct('prior', 0.4D, 'a', array_repeat(0.8D, {n_lab}), 'b', array_repeat(0.2D, {n_lab}))"
    a = f"array({', '.join(share(j, 'p.y', 0.55, 0.98, 4) for j in range(n_lab))})"
    b = f"array({', '.join(share(j, '(1 - p.y)', 0.02, 0.45, 1) for j in range(n_lab))})"
    prior = "greatest(0.01D, least(0.99D, aggregate(q, 0D, (s, p) -> s + p.n * p.y) / total))"
    # transform over a one-element array names the intermediate value q
    update = f"get(transform(array(transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'y', {posterior('st')}))), q -> named_struct('prior', {prior}, 'a', {a}, 'b', {b})), 0)"
    row = row.withColumn("st", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (st, i) -> {update})"))
    row = row.withColumn("soft", F.expr(f"transform(ps, p -> named_struct('x', p.x, 'n', p.n / total, 'y', {posterior('st')}))"))
    dot = "aggregate(zip_with(w, p.x, (g, h) -> g * h), 0D, (s, g) -> s + g)"
    grad = f"aggregate(soft, array_repeat(0D, {len(x)}), (acc, p) -> zip_with(acc, p.x, (g, h) -> g + h * p.n * (1D / (1D + exp(-greatest(-30D, least(30D, {dot})))) - p.y)))"
    w = F.expr(f"aggregate(sequence(1, {steps}), array_repeat(0D, {len(x)}), (w, i) -> zip_with(w, {grad}, (c, g) -> c - {rate}D * g))")
    got = row.select("st", w.alias("w")).first()
    return SpanModel(got.st.prior, tuple(got.st.a), tuple(got.st.b), tuple(got.w))


OTHERS = f"c.k > {BASE}"


def _of_kind(n: int):
    return lambda c: c["k"] == n


def _accepted(model: SpanModel, threshold: float) -> Column:
    """All base spans, and those others that the model accepts."""
    return F.filter("cand", lambda c: (c["k"] <= BASE) | (model.probability(c) >= threshold))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(kind, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_other, n_doubtful, base_sha256, spans) for each row.

    base_sha256 is the digest of the base spans, spans lists all accepted ones, both as
    kind:start:end by start, then kind; n_doubtful counts the base spans under the threshold.
    A null text counts as empty; null ids and repeated rows pass through; other columns are
    ignored; texts are never cut.  Without any candidate the models are those that EM starts with.
    """
    found = materialize(candidates(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", ("id",)), "spans")
    model, base_model = fit(found, OTHERS), fit(found, f"not {OTHERS}")
    out = found.select("id", _accepted(model, threshold).alias("all"), F.filter("cand", lambda c: c["k"] <= BASE).alias("base"))
    n = [F.size(F.filter("base", _of_kind(i + 1))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    n.append((F.size("all") - F.size("base")).cast("long").alias("n_other"))
    n.append(F.size(F.filter("base", lambda c: base_model.probability(c) < threshold)).cast("long").alias("n_doubtful"))
    return out.select(F.col("id").alias(id_col), *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with every accepted span of the text column replaced by its kind in angle brackets; overlapping spans go as one, under the first's kind.

    All columns and rows stay, repeated ones too; null texts stay null; an empty table gives an empty one.
    """
    source = docs.select(F.struct(*docs.columns).alias("src"), F.col(text_col).alias("text"))
    found = materialize(candidates(source, "text", ("src",)), "spans")  # with the rows, so that the patterns run once
    found = found.withColumn("cand", _accepted(fit(found, OTHERS), threshold)).withColumn("text", F.col("src")[text_col])
    kind = F.array(*[F.lit(f"<{k}>".upper()) for k in KINDS])
    text, blocks = F.col("text"), F.col("blocks")
    found = found.withColumn("blocks", F.when(F.size("cand") > 0, _blocks(text)))

    def step(acc, c):
        piece = F.when(c["s"] >= acc["at"], F.concat(_cut(blocks, acc["at"], c["s"]), F.element_at(kind, c["k"]))).otherwise("")
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), *_push(acc, piece))

    clean = F.aggregate("cand", F.struct(F.lit(0).alias("at"), *_start("string")), step, lambda acc: F.concat(F.array_join(_pushed(acc), ""), _cut(blocks, acc["at"], F.length(text))))
    found = found.withColumn("clean", F.when((F.size("cand") > 0) & text.isNotNull(), clean).otherwise(text))
    return found.select(*[F.col("clean").alias(c) if c == text_col else F.col("src")[c].alias(c) for c in docs.columns])
