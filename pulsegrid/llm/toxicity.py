"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed toxic; everything else is unlabelled, whatever it holds.  With
the class prior pi, the risk of a scorer f is estimated as
    pi * R_p(f, +)  +  max(0, R_u(f, -) - pi * R_p(f, -)),
and where the second term falls below zero its gradient is reversed.  Linear classifiers are
trained on the presence of words; the mean of several, each with its own feature dropout,
gives the score.

The positives are a sample of bounded size.  All unlabelled texts count: each distinct one is
reduced to those of its words that the positives have, in one pass over the texts; document
frequencies of these words select the features; texts with the same features become one row
with a weight.  The rows are dealt into groups of bounded size, each group trains on its
weights and all the positives, and the groups' classifiers are averaged.  Rows that stand for
many texts go to every group with a share of their weight, so that all groups see the same mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import materialize, small_batches, small_side
from pulsegrid.llm.textkernel import WordHasher, distinct_sets, mix, sliced, utf8

U = np.uint64


@dataclass(frozen=True)
class PUConfig:
    """max_positive bounds the expected size of the sample of labelled texts; group is the number of unlabelled texts that train one group of classifiers, in `steps` batches."""

    max_positive: int = 5_000
    group: int = 16_384
    features: int = 1_024
    least_z: float = 4.0
    least_docs: int = 4
    models: int = 5
    dropout: float = 0.8
    steps: int = 1_600
    batch: int = 512
    rate: float = 0.05
    decay: float = 2e-4
    seed: int = 7


@dataclass(frozen=True)
class PUModel:
    """weights[m, j] belongs to model m and the word with hash keys[j] (sorted)."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: float

    def score(self, features: np.ndarray) -> float:
        """Mean probability for a text with these features (numbers of keys)."""
        z = self.weights[:, features].sum(axis=1) + self.bias
        return float(np.mean(1 / (1 + np.exp(-np.clip(z, -30, 30)))))


def select_features(n_pos: int, n: np.ndarray, n_unl: int, m: np.ndarray, cfg: PUConfig) -> np.ndarray:
    """Numbers of the words whose share of the positives (n of n_pos) exceeds that of the unlabelled texts (m of n_unl) the most, by z score."""
    if not n_pos or not n_unl or not len(n):
        return np.zeros(0, np.int64)
    p, u = n / n_pos, (m + 1.0) / (n_unl + 2.0)
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / n_pos + 1 / n_unl))
    best = np.argsort(-z, kind="stable")[: cfg.features]
    return np.sort(best[z[best] >= cfg.least_z])


def _ragged(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    off = np.r_[0, np.cumsum([len(f) for f in docs])]
    return (np.concatenate(docs) if docs else np.zeros(0, np.int64)).astype(np.int64), off


def train(pos: list[np.ndarray], unl: list[np.ndarray], weight: np.ndarray, n_keys: int, prior: float, cfg: PUConfig, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of cfg.models linear classifiers for texts given as numbers of their features; unlabelled ones are drawn by their weight."""
    p_feat, p_off = _ragged(pos)
    u_feat, u_off = _ragged(unl)
    chance = np.cumsum(weight) / weight.sum()
    weights, biases = [], []
    for m in range(cfg.models):
        rng = np.random.default_rng([seed, m])
        w, b = np.zeros(n_keys), np.log(prior / (1 - prior))
        mom, vel = np.zeros(n_keys + 1), np.zeros(n_keys + 1)
        for t in range(1, cfg.steps + 1):
            ui = np.minimum(np.searchsorted(chance, rng.random(cfg.batch), "right"), len(unl) - 1)
            pi = rng.integers(0, len(pos), max(1, cfg.batch // 2))

            def drawn(rows, feat, off):
                n = off[rows + 1] - off[rows]
                starts = np.repeat(off[rows] - np.r_[0, np.cumsum(n)[:-1]], n)
                row = np.repeat(np.arange(len(rows)), n)
                f = feat[starts + np.arange(len(row))]
                keep = rng.random(len(f)) >= cfg.dropout
                return row[keep], f[keep], len(rows)

            def outputs(x):
                row, f, n = x
                return np.bincount(row, w[f], minlength=n) + b

            px, ux = drawn(pi, p_feat, p_off), drawn(ui, u_feat, u_off)
            sp, su = (1 / (1 + np.exp(-outputs(x))) for x in (px, ux))
            # logistic loss: d/df of log(1+exp(-f)) is s-1, of log(1+exp(f)) is s
            r_neg = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
            gp_pos = prior * (sp - 1) / len(sp)
            gu, gp_neg = su / len(su), -prior * sp / len(sp)
            if r_neg >= 0:
                parts = ((px, gp_pos + gp_neg), (ux, gu))
            else:  # the estimate of a risk can't be negative: step back
                parts = ((px, -gp_neg), (ux, -gu))
            g = np.zeros(n_keys + 1)
            for (row, f, _), d in parts:
                g[:-1] += np.bincount(f, d[row], minlength=n_keys)
                g[-1] += d.sum()
            g[:-1] += cfg.decay * w
            mom = 0.9 * mom + 0.1 * g
            vel = 0.999 * vel + 0.001 * g * g
            step = cfg.rate * (mom / (1 - 0.9**t)) / (np.sqrt(vel / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            b -= step[-1]
        weights.append(w)
        biases.append(b)
    return np.array(weights), np.array(biases)


def _word_sets(batches):
    import pyarrow as pa

    hasher = WordHasher("alnum")
    for b in sliced(batches, 0):
        h, off, _, _ = hasher(*utf8(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in distinct_sets(h, off)], pa.binary())], names=["words"])


def _each_word(batches):
    import pyarrow as pa

    for b in batches:
        for w in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w.as_buffer(), np.int64))], names=["word"])


def _members(keys: np.ndarray):
    """Of rows of word sets, the numbers of the words that are keys."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for w in b.column(0):
                s = np.frombuffer(w.as_buffer(), U)
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                out.append(at[keys[at] == s].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["features"])

    return run


def _known_words(keys):
    """(digest of the set of all words, numbers of those that are keys, as little-endian 32-bit integers) of each text."""

    def run(batches):
        import pyarrow as pa

        hasher, known = WordHasher("alnum"), keys.value
        for b in sliced(batches, 0):
            h, off, _, _ = hasher(*utf8(b.column(0)))
            digests, found = [], []
            for s in distinct_sets(h, off):
                digests.append(np.array([mix(s).sum(dtype=U), mix(s ^ U(0x5BD1E995)).sum(dtype=U)], U).tobytes())
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                found.append(at[known[at] == s].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["digest", "words"])

    return run


def _frequencies(size: int):
    """Per task: how many rows have each word."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(size, np.int64)
        for b in batches:
            for w in b.column(0):
                n[np.frombuffer(w.as_buffer(), "<u4")] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["word", "n"])

    return run


def _features(chosen: np.ndarray):
    """Numbers of the features in place of the numbers of the words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for w in b.column(0):
                v = np.frombuffer(w.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(chosen, v), len(chosen) - 1)
                out.append(at[chosen[at] == v].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["features"])

    return run


def _trained(pos, n_keys: int, prior: float, cfg: PUConfig):
    """Rows (group, features, weight) sorted by group: one row of classifiers a group, times the group's weight."""

    def run(batches):
        import pyarrow as pa

        group, unl, weight = None, [], []

        def out():
            total = float(np.sum(weight))
            w, b = train(pos.value, unl, np.array(weight), n_keys, prior, cfg, cfg.seed + group)
            flat = np.concatenate([w.ravel(), b]) * total
            return pa.RecordBatch.from_arrays([pa.array([total]), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["total", "flat"])

        for b in batches:
            for g, f, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if g != group:
                    if unl:
                        yield out()
                    group, unl, weight = g, [], []
                unl.append(np.frombuffer(f.as_buffer(), "<u4"))
                weight.append(n)
        if unl:
            yield out()

    return run


def _scores(model):
    def run(batches):
        import pyarrow as pa

        hasher, m = WordHasher("alnum"), PUModel(*model.value)
        blank = m.score(np.zeros(0, np.int64))
        for b in sliced(batches, 1):
            h, off, _, _ = hasher(*utf8(b.column(1)))
            out = np.full(b.num_rows, blank)
            if len(m.keys) and len(h):
                at = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
                hit = np.flatnonzero(m.keys[at] == h)
                doc = np.searchsorted(off, hit, "right") - 1
                pairs = np.unique(doc * len(m.keys) + at[hit])
                edge = np.flatnonzero(np.r_[True, np.diff(pairs // len(m.keys)) > 0, True])
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    if len(pairs):
                        out[pairs[s] // len(m.keys)] = m.score(pairs[s:e] % len(m.keys))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["id", "score"])

    return run


def held_out(col):
    """Rows whose labels aren't learned from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cfg: PUConfig = PUConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> PUModel:
    """Trains on the rows that held_out() doesn't keep back.

    An id is a confirmed positive if any of its label rows says 1; null labels say nothing.
    The prior is the share of positives among the labelled ids.  Texts with the same words
    count once among the positives and once among the unlabelled texts, whatever their number;
    null texts and ids take no part.  Without positives, texts, or words that tell them apart,
    every text's score is the prior.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    lab = lab.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n, n_pos = lab.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0))).first()
    prior = min(0.9, max(1e-4, n_pos / n)) if n else 1e-4
    nothing = PUModel(np.zeros(0, U), np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]), prior)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()).where(~held_out(F.col("id")))

    share = F.pmod(F.xxhash64("id", F.lit(cfg.seed)), F.lit(1 << 20)) < int(min(1.0, cfg.max_positive / max(n_pos, 1)) * (1 << 20))
    known = materialize(lab.where("y = 1").where(share).select("id"), "positives")
    texts = base.join(small_side(known), "id", "left_semi").select("text").distinct()  # an id's rows with one text are one positive
    positives = materialize(texts.mapInArrow(_word_sets, "words binary").distinct(), "positive-words")
    each = positives.mapInArrow(_each_word, "word long").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.least_docs)
    got = each.toArrow()  # words of at most max_positive texts, each in several of them
    keys, n_docs = got["word"].to_numpy().view(U), got["n"].to_numpy()
    order = np.argsort(keys)
    keys, n_docs = keys[order], n_docs[order]
    if not len(keys):
        return nothing

    found = base.select("text").mapInArrow(_known_words(spark.sparkContext.broadcast(keys)), "digest binary, words binary")
    found = materialize(found.groupBy("digest").agg(F.first("words").alias("words")).select("words"), "words")
    n_unl = found.count()
    counted = found.mapInArrow(_frequencies(len(keys)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    m = np.zeros(len(keys), np.int64)
    for r in counted.collect():  # at most one row for each of the positives' words
        m[r.word] = r.n
    chosen = select_features(positives.count(), n_docs, n_unl, m, cfg)
    if not len(chosen):
        return nothing

    keys = keys[chosen]
    rows = found.mapInArrow(_features(chosen), "features binary").groupBy("features").agg(F.count("*").alias("n"))
    groups = max(1, round(n_unl / cfg.group))
    # a row of many texts, of which there are n_unl / (16 groups) at most, that is some 1,000, goes to all groups
    each = F.explode(F.when(F.col("n") >= 16 * groups, F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(F.pmod(F.xxhash64("features"), F.lit(groups)).cast("int"))))
    rows = rows.select(each.alias("group"), "features", F.when(F.col("n") >= 16 * groups, F.col("n") / groups).otherwise(F.col("n").cast("double")).alias("weight"))
    own = sorted(positives.mapInArrow(_members(keys), "features binary").toArrow()["features"].to_pylist())
    shared = spark.sparkContext.broadcast([np.frombuffer(f, "<u4") for f in own])
    parts = rows.repartition(groups, "group").sortWithinPartitions("group", "features").mapInArrow(_trained(shared, len(keys), prior, cfg), "total double, flat array<double>")
    parts = materialize(parts, "classifiers")
    # the mean over the groups is taken number by number, so that no group's classifiers need come to the driver
    size = cfg.models * (len(keys) + 1)
    mean = np.zeros(size)
    total = parts.agg(F.sum("total")).first()[0]
    for r in parts.select(F.posexplode("flat").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        mean[r["at"]] = r.x / total
    cut = cfg.models * len(keys)
    return PUModel(keys, mean[:cut].reshape(cfg.models, len(keys)), mean[cut:], prior)


def score_texts(docs: DataFrame, model: PUModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row; predicted is 1 from the threshold on.

    Null and empty texts get the score of a text without known words.  Null ids (not held
    out) and repeated rows pass through; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias, model.prior))  # plain values: broadcasts are pickled by reference
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(_scores(shared), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: PUModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; decided row by row, whatever their ids.  Null texts score as empty ones."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias, model.prior))  # plain values: broadcasts are pickled by reference
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        score = _scores(shared)
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], names=["id", "text"])
            low = [x < threshold for part in score([texts]) for x in part.column(1).to_pylist()]
            yield b.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
