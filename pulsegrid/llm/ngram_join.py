"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set is its distinct k-word shingles, in one global order: rare first.  If two sets
of sizes p and q have a Jaccard similarity of at least t, they share at least
c = ceil(t * max(p, q)) shingles, so for every l they share at least l of the first
p - ceil(t*p) + l (and q - ceil(t*q) + l) ones: the l-prefixes.  Each document picks its own
l: the one for which the estimated cost of scanning the postings of its l-prefix plus that of
verifying what shares l of them is least.  A pair then needs min(l, l') common prefix
shingles before it is verified against the whole sets.

The global order needs no exact document frequencies, only the same order everywhere; it
comes from one row of counters of fixed size, filled with all shingles of all documents.

Steps, all distributed:
1. counters (2**sketch_bits); 2. prefixes, and a 128-bit digest of each set; equal sets form
one class and go on as one; 3. shingles that occur in two classes' prefixes; 4. star pairs:
each such shingle's classes against the one in which it stands first, then, in turns, those of
shingles of many classes against a few of the largest component so far; those with enough common
prefix shingles are verified and joined to components; 5. pairs of classes in different
components with enough common prefix shingles, verified.  Shingles of few classes are joined
with themselves and the pairs counted; the classes of the others are compared in blocks of
bounded size, each with the list of its shingles of that kind.  Step 5 loses nothing: only
pairs already known to be connected are left out, and no pair of copies or of linked near
copies is ever written out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.components import connected_components
from pulsegrid.llm.shared import BROADCAST_ROWS, discard, materialize, small_batches, small_side
from pulsegrid.llm.textkernel import WordHasher, distinct_sets, mix, shingle_hashes, sliced, utf8

U = np.uint64
RANK_BITS = 6
#: Classes of one prefix shingle up to which it is joined with itself, and beyond it, how many are compared in one block.
FEW, BLOCK = 16, 2048
#: Turns of star pairs after the first, at most, on shingles of more than FEW classes; another one follows while one row in MANY of these still open gives a link.
TURNS, MANY = 8, 5000
#: Classes of a shingle that all others are compared with in one turn.
HUBS = 4
#: Sets that are compared with one set in one group of rows.
SPOKES = 64
#: Rows of a class from which its result is joined apart from the others'.
HOT_CLASS = 10_000


def _sets(batch_text, hasher, k):
    raw, off = utf8(batch_text)
    words, word_off, _, _ = hasher(raw, off)
    return distinct_sets(*shingle_hashes(words, word_off, k))


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(dtype=U), mix(s ^ U(0x5BD1E995)).sum(dtype=U), len(s)], U).tobytes()


def _counter_blocks(k: int, bits: int, salts: int):
    """Per task: counts of all shingles by the top bits of their hash, as zlib-packed blocks of 65,536 counters.

    Two bytes a counter; before one could overflow, what has been counted is sent off.
    """

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        hasher, counts, most = WordHasher("space"), np.zeros(1 << bits, np.uint16), 0  # no counter exceeds most
        size = min(1 << 16, len(counts))
        salt = TaskContext.get().partitionId() % salts

        def send():
            for i in range(0, len(counts), size):
                yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(counts[i : i + size].astype(np.uint32).tobytes(), 1)], pa.binary())], names=["block", "salt", "counts"])

        for b in sliced(batches, 0):
            full = [s for s in _sets(b.column(0), hasher, k) if len(s)]
            for at in range(0, len(full), 256):
                part = np.concatenate(full[at : at + 256])
                for p in range(0, len(part), 1 << 18):
                    now = (part[p : p + (1 << 18)] >> U(64 - bits)).astype(np.int64)
                    more = int(np.bincount(now & 0xFFFF).max())
                    if most + more > 0xFFFF:
                        most = int(counts.max())
                        if most + more > 0xFFFF:
                            yield from send()
                            counts[:], most = 0, 0
                    np.add.at(counts, now, np.uint16(1))
                    most += more
        if most:
            yield from send()

    return run


def _merge_blocks(batches):
    import zlib

    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, packed in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(packed), np.uint32)
            total[block] = total[block] + c if block in total else c.copy()
    for block, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], names=["block", "salt", "counts"])


def shingle_ranks(text: DataFrame, k: int, bits: int) -> tuple[np.ndarray, float]:
    """Half-octave ranks of the shared counters (2**bits bytes whatever the input) and their mean count."""
    import zlib

    schema = "block int, salt int, counts binary"
    # merged in two levels, of about as many blocks each, by as many tasks as any other shuffle has
    salts = max(16, math.isqrt(text.rdd.getNumPartitions()))
    tasks = max(16, int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = text.mapInArrow(_counter_blocks(k, bits, salts), schema)
    merged = parts.repartition(tasks, "block", "salt").mapInArrow(_merge_blocks, schema).repartition(min(tasks, 256), "block").mapInArrow(_merge_blocks, schema)
    ranks, total = np.zeros(1 << bits, np.uint8), 0
    size = min(1 << 16, len(ranks))
    for r in merged.toLocalIterator():
        c = np.frombuffer(zlib.decompress(r.counts), np.uint32)
        ranks[r.block * size : (r.block + 1) * size] = np.minimum(63, 2 * np.log2(1.0 + c))
        total += int(c.sum(dtype=np.int64))
    return ranks, total / len(ranks)


def prefix_of(s: np.ndarray, ranks: np.ndarray, bits: int, mean: float, num: int, den: int, longest: int, verify_cost: float):
    """(l, prefix keys in the global order): the multi-match prefix of one set."""
    n = len(s)
    c = -(-num * n // den)
    rank = ranks[(s >> U(64 - bits)).astype(np.int64)]
    key = (rank.astype(U) << U(64 - RANK_BITS)) | (s >> U(RANK_BITS))
    top = min(n, n - c + min(longest, c))
    if top < n:
        key = np.partition(key, top - 1)[:top]
    key.sort()
    est = np.maximum(0.0, np.exp2((key >> U(64 - RANK_BITS)).astype(float) / 2) - 1.5 * mean - 1)
    total = np.cumsum(est)
    best, best_cost = 1, None
    for level in range(1, top - (n - c) + 1):
        scanned = total[n - c + level - 1]
        cost = scanned + verify_cost * scanned / level
        if best_cost is None or cost < best_cost:
            best, best_cost = level, cost
    return best, key[: n - c + best]


def _prefix_rows(k, num, den, bits, ranks, mean, longest, verify_cost):
    def run(batches):
        import pyarrow as pa

        hasher, table = WordHasher("space"), ranks.value
        for b in sliced(batches, 1):
            n, digest, level, flat, off = [], [], [], [], [0]
            for s in _sets(b.column(1), hasher, k):
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                lv, keys = prefix_of(s, table, bits, mean, num, den, longest, verify_cost) if len(s) else (0, s)
                level.append(lv)
                flat.append(keys.view(np.int64))
                off.append(off[-1] + len(keys))
            tokens = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(level, pa.int32()), tokens, b.column(2)], names=["id", "n", "digest", "l", "tokens", "key"])

    return run


def _set_rows(k):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher("space")
        for b in sliced(batches, 0):
            full = [s for s in _sets(b.column(0), hasher, k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in full], pa.binary()), pa.array([s.tobytes() for s in full], pa.binary())], names=["digest", "items"])

    return run


def _verified(num, den):
    """Rows (x, block, hub, node, items), sorted by the first three: the set of x comes before those it is compared with."""

    def run(batches):
        import pyarrow as pa

        of, p = None, np.zeros(0, U)
        for b in batches:
            xs, ys = [], []
            for x, block, spoke, y, items in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), strict=True):
                q = np.frombuffer(items.as_buffer(), U)
                if not spoke:
                    of, p = (x, block), q.copy()
                    continue
                if of != (x, block):
                    raise ArithmeticError("a set to compare with is missing")
                inter = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if den * inter >= num * (len(p) + len(q) - inter):
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return run


def _runs(batches, n_keys):
    """Arrow batches, sorted by their first n_keys columns, as pandas frames that hold whole groups of equal keys."""
    import pandas as pd

    kept = None
    for b in batches:
        df = b.to_pandas()
        if kept is not None and len(kept):
            df = pd.concat([kept, df], ignore_index=True)
        if not len(df):
            continue
        keys = df.iloc[:, :n_keys].to_numpy()
        cut = len(df) - 1
        while cut > 0 and (keys[cut - 1] == keys[-1]).all():
            cut -= 1
        if cut:
            yield df.iloc[:cut].reset_index(drop=True)
        kept = df.iloc[cut:].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept


def _pairs_in_blocks(num, den):
    """Pairs of different components that may link, each from the group of its first common prefix shingle alone.

    A pair with q = min(l, l') needs max(q, alpha - max(c, c') + q) common shingles in its
    q-prefixes, alpha being the intersection that links sets of these sizes: what isn't common
    there lies beyond the prefix that ends first, which leaves c - q places.
    """

    def survivors(token, left, right, same, node, comp, n, lv, tokens, levels):
        rows = left if same else np.concatenate([left, right])
        size = np.array([len(tokens[i]) for i in rows])
        row = np.repeat(np.arange(len(rows)), size)
        tok = np.concatenate([tokens[i] for i in rows]).view(U)
        lev = np.concatenate([levels[i] for i in rows])
        known, col, times = np.unique(tok, return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        here = int(place[np.searchsorted(known, token)])
        use = shared[col]
        row, col, lev = row[use], place[col[use]], lev[use]
        nl, nn, cc = lv[rows], n[rows], comp[rows]
        c = -(-num * nn // den)
        out_i, out_j, out_q = [], [], []
        for q in np.unique(nl).tolist():
            m = np.zeros((len(rows), int(shared.sum())), np.float32)
            m[row[lev <= q], col[lev <= q]] = 1
            start = 0 if same else len(left)
            other = m[start:]
            for at in range(0, len(left), 256):
                i = np.arange(at, min(at + 256, len(left)))[:, None]
                j = np.arange(start, len(rows))[None, :]
                ok = (np.minimum(nl[i], nl[j]) == q) & (cc[i] != cc[j]) & (m[i, here] > 0) & (m[j, here] > 0)
                ok &= den * np.minimum(nn[i], nn[j]) >= num * np.maximum(nn[i], nn[j])
                if same:
                    ok &= i < j
                if not ok.any():
                    continue
                mine = m[at : min(at + 256, len(left))]
                alpha = -(-num * (nn[i] + nn[j]) // (num + den))
                ok &= mine @ other.T >= np.maximum(q, alpha - np.maximum(c[i], c[j]) + q)
                ok &= mine[:, :here] @ other[:, :here].T == 0
                x, y = np.nonzero(ok)
                out_i.append(rows[at + x])
                out_j.append(rows[start + y])
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2

    def run(batches):
        import pyarrow as pa

        for df in _runs(batches, 3):
            tok, bi, bj = (df[c].to_numpy() for c in ("token", "bi", "bj"))
            edge = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), True])
            node, comp, tokens, levels = (df[c].to_numpy() for c in ("node", "comp", "tokens", "levels"))
            n, lv, blk = (df[c].to_numpy().astype(np.int64) for c in ("n", "l", "blk"))
            xs, ys = [], []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                same = bi[s] == bj[s]
                if e - s == 2:  # most groups: two classes
                    if comp[s] == comp[s + 1] or not same and blk[s] == blk[s + 1]:
                        continue
                    q, p, r = int(min(lv[s], lv[s + 1])), int(n[s]), int(n[s + 1])
                    if den * min(p, r) < num * max(p, r):
                        continue
                    both = set(tokens[s][levels[s] <= q].tolist()) & set(tokens[s + 1][levels[s + 1] <= q].tolist())
                    c = -(-num * max(p, r) // den)
                    least = max(q, -(-num * (p + r) // (num + den)) - c + q)
                    if len(both) >= least and min(both, key=lambda v: v & (1 << 64) - 1) == tok[s]:
                        xs.append(np.array([s]))
                        ys.append(np.array([s + 1]))
                    continue
                left = np.arange(s, e) if same else np.flatnonzero(blk[s:e] == bi[s]) + s
                right = left if same else np.flatnonzero(blk[s:e] == bj[s]) + s
                if len(left) and len(right):
                    i, j = survivors(np.int64(tok[s]).view(U), left, right, same, node, comp, n, lv, tokens, levels)
                    xs.append(i)
                    ys.append(j)
            if xs:
                x, y = node[np.concatenate(xs)], node[np.concatenate(ys)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return run


def _text_key(text: Column) -> Column:
    """128 bits that tell a row's text, for decisions that are taken row by row."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def hubs(rows: DataFrame, columns: list[str], orders: list[list]) -> DataFrame:
    """(token, r_comp and columns with an r_ before): the classes of each token that come first in one of the orders."""
    every = [*columns, "comp"]
    first = rows.groupBy("token").agg(*[F.min_by(F.struct(*every), F.struct(*order)).alias(f"h{i}") for i, order in enumerate(orders)])
    one = F.col("h0") if len(orders) == 1 else F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(len(orders))])))
    return first.select("token", one.alias("h")).select("token", *[F.col(f"h.{c}").alias(f"r_{c}") for c in every])


def similarity_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, class_id, component_id).

    Words are runs of other than ASCII white space, A-Z in lower case; the set holds the
    distinct k-word shingles, or the whole sequence of a text of fewer words.  Two documents
    link when den * |intersection| >= num * |union|.  component_id is the smallest id reachable
    by links, itself included; class_id the smallest id with the same set.

    Null, empty and blank texts have n_shingles 0 and are linked with nothing.  A row with a
    null id gets null class and component and takes no part.  Repeated rows give repeated
    result rows; rows that share an id but not a text are documents of their own.
    Other columns are ignored.  An empty table gives an empty result.
    """
    out = _grouped(docs, k, num, den, id_col, text_col, **how)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, sketch_bits: int = 24, longest: int = 4, verify_cost: float = 20.0) -> DataFrame:
    """(id, n, key, digest, rep, comp, component_id) of each row; the last three are null for rows without an id or without words."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranks, mean = shingle_ranks(base.select("text"), k, sketch_bits)
    shared = spark.sparkContext.broadcast(ranks)
    rows_of = _prefix_rows(k, num, den, sketch_bits, shared, mean, longest, verify_cost)
    prefix = materialize(base.select("id", "text", _text_key(F.col("text")).alias("key")).mapInArrow(rows_of, "id long, n long, digest binary, l int, tokens array<long>, key struct<a:bigint,b:bigint>"), "prefix")

    classes = prefix.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    firsts = prefix.withColumnRenamed("id", "rep").join(small_side(classes.drop("rows")), ["rep", "digest"])
    # one number for size, place and l keeps the rows that are shuffled narrow
    packed = F.shiftleft(F.col("n"), 32) + F.shiftleft(F.col("pos").cast("long"), 4) + F.col("l")
    posted = firsts.select("node", "n", "l", F.posexplode("tokens").alias("pos", "token")).select("token", "node", packed.alias("nums"))
    # as many tokens as documents: both sides shuffle, whatever the size
    often = posted.groupBy("token").agg(F.count("*").cast("int").alias("size")).where("size > 1")
    posted = posted.join(often.hint("merge"), "token")
    posted = posted.select("token", "size", "node", F.shiftright("nums", 32).alias("n"), F.shiftright("nums", 4).bitwiseAND((1 << 28) - 1).cast("int").alias("pos"), F.col("nums").bitwiseAND(15).cast("int").alias("l"))
    posted = materialize(posted.withColumn("c", F.expr(f"(n * {num} + {den - 1}) div {den}")), "posted")

    def candidates(left: DataFrame, right: DataFrame, which: str, spare: Column) -> DataFrame:
        """Pairs with at least as many common prefix shingles as they need, less spare.

        left and right have the columns token, node, n, pos, l and c, right's with an r_ before all but token.
        """
        q = F.least("l", "r_l")
        in_both = (F.col("pos") < F.col("n") - F.col("c") + q) & (F.col("r_pos") < F.col("r_n") - F.col("r_c") + q)
        fits = f"{den} * least(n, r_n) >= {num} * greatest(n, r_n) and {num + den} * (least(pos, r_pos) + least(n - pos, r_n - r_pos)) >= {num} * (n + r_n)"
        alpha = F.expr(f"((n + r_n) * {num} + {num + den - 1}) div {num + den}")
        need = F.greatest(q, alpha - F.greatest("c", "r_c") + q) - spare
        pairs = left.join(right, "token").where(which).where(in_both).where(fits).select(F.col("node").alias("x"), F.col("r_node").alias("y"), need.cast("int").alias("need"))
        return pairs.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("x", "y")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) of nodes that link; only texts that are in a pair are read into sets, and a set goes once to each block of those it is compared with."""
        pairs = materialize(pairs, "pairs")
        ends = pairs.select(F.col("x").alias("node")).distinct().unionByName(pairs.select(F.col("y").alias("node")).distinct())
        wanted = materialize(ends.distinct().join(classes, "node"), "wanted")
        degree = pairs.groupBy("x").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("blocks"))
        dealt = pairs.join(degree, "x").select("x", F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int").alias("block"), "y")
        roles = dealt.select(F.col("y").alias("node"), "x", "block", F.lit(True).alias("spoke")).unionByName(dealt.select(F.col("x").alias("node"), "x", "block", F.lit(False).alias("spoke")).distinct())
        roles = materialize(roles.join(wanted.select("node", "digest"), "node"), "roles")
        ids = small_side(wanted.select(F.col("rep").alias("id")).distinct(), 4 * BROADCAST_ROWS)
        sets = base.join(ids, "id", "left_semi").select("text").mapInArrow(_set_rows(k), "digest binary, items binary")
        # rows that share an id with another text are read as well, and repeated rows give a set twice
        sets = sets.join(small_side(roles), "digest").select("x", "block", "spoke", "node", "items")
        sets = sets.repartition("x", "block").sortWithinPartitions("x", "block", "spoke")
        links = materialize(sets.mapInArrow(_verified(num, den), "x long, y long").distinct(), "links")
        discard(pairs, wanted, roles)
        return links

    row = ["n", "node", "pos", "l", "c"]

    def stars(rows: DataFrame, orders: list[list], which: str) -> DataFrame:
        """Links of classes with those of each shingle's that come first in one of the orders."""
        return verified(candidates(rows, hubs(rows, row, orders), which, F.lit(0)).select(F.col("y").alias("x"), F.col("x").alias("y")))

    # the class in which a shingle stands first has the fewest of its own before it: of copies with edits, the original
    links = stars(posted.withColumn("comp", F.col("node")), [["pos", "n", "node"]], "node != r_node")

    def parted(rows: DataFrame, links: DataFrame) -> DataFrame:
        """rows of the shingles whose classes aren't all in one component, with comp and its weight."""
        comp = connected_components(links, "x", "y").select(F.col("id").alias("node"), F.col("component").alias("comp"))
        comp = materialize(comp.join(comp.groupBy("comp").agg(F.count("*").alias("weight")), "comp"), "components")
        labelled = rows.join(small_side(comp), "node", "left").select(rows["*"], F.coalesce("comp", "node").alias("comp"), F.coalesce("weight", F.lit(1)).alias("weight"))
        labelled = materialize(labelled, "labelled")
        split = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        mixed = materialize(labelled.join(split, "token"), "mixed")
        discard(labelled, comp)
        return mixed

    # shingles of few classes are left to the last step, which joins them whole: a row of hubs for each of them would be most of the work
    wide = materialize(posted.where(F.col("size") > FEW), "wide")
    for turn in range(1, TURNS + 1):
        still = parted(wide, links)
        # copies without their original: all against some of the largest component, which a hash picks anew in each turn, while that links many
        found = stars(still, [[-F.col("weight"), F.xxhash64(F.lit(turn), F.lit(h), "node")] for h in range(HUBS)], "comp != r_comp")
        n, left = found.count(), still.count()
        discard(still)
        if not n:
            break
        links = materialize(links.unionByName(found), "links")
        if n * MANY < left:
            break
    rows = parted(posted, links)
    discard(wide)
    discard(posted)

    many = rows.where(F.col("size") > FEW).withColumn("level", F.greatest(F.lit(1), F.col("pos") - (F.col("n") - F.col("c")) + 1).cast("tinyint"))
    lists = materialize(many.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("token", "level"))).alias("s")).select("node", F.col("s.token").alias("tokens"), F.col("s.level").alias("levels")), "lists")
    few = rows.where(F.col("size") <= FEW).join(small_side(lists.select("node", F.size("tokens").alias("others"))), "node", "left").select("token", "comp", *row, F.coalesce("others", F.lit(0)).alias("others"))
    few = materialize(few, "few")
    both = candidates(few, few.select("token", *[F.col(c).alias(f"r_{c}") for c in ("comp", "others", *row)]), "node < r_node and comp != r_comp", F.least("others", "r_others"))

    blocks = many.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("token", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "node", "comp", "n", "l", "blk").join(lists, "node")
    dealt = blocks.select("token", "bi", "bj", "node", "comp", "n", "l", "blk", "tokens", "levels").repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
    rest = verified(both.unionByName(dealt.mapInArrow(_pairs_in_blocks(num, den), "x long, y long")).distinct())
    discard(rows, lists, few)
    final = materialize(connected_components(links.unionByName(rest), "x", "y").select(F.col("id").alias("node"), F.col("component").alias("comp")), "components")

    by_class = classes.join(final, "node", "left").select("digest", "rows", "rep", F.coalesce("comp", "node").alias("comp"))
    by_class = materialize(by_class.join(by_class.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("digest", "rows", "rep", "comp", "component_id"), "results")
    # rows of large classes, and those without a set, don't go through the shuffle of the others
    narrow = prefix.select("id", "n", "key", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    hot = narrow.join(small_side(by_class.where(F.col("rows") >= HOT_CLASS)).withColumn("found", F.lit(True)), "digest", "left")
    cold = hot.where("found is null and digest is not null").select("id", "n", "key", "digest").join(by_class, "digest", "left")
    columns = ["id", "n", "key", "digest", "rep", "comp", "component_id"]
    return hot.where("found or digest is null").select(columns).unionByName(cold.select(columns))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, all columns: that of the smallest id.  Rows without words stay, and so do rows with a null id, which can't be ordered.

    The choice is made row by row: of rows that share an id, a text that is in no other's
    component stays; of rows that are equal in id and text, one stays.  See similarity_components.
    """
    rows = materialize(_grouped(docs, k, num, den, id_col, text_col, **how).where("comp is not null").select("comp", "id", "digest", "key"), "groups")
    first = rows.groupBy("comp").agg(F.min(F.struct("id", "digest", "key")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "firsts")
    lost = rows.join(small_side(first), "comp").where("id != first.id or digest != first.digest or key != first.key")
    lost = materialize(lost.select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct(), "lost")
    keyed = docs.withColumn("_key", _text_key(F.col(text_col).cast("string"))).withColumn("_id", F.col(id_col).cast("long"))
    kept = keyed.join(small_side(lost), ["_id", "_key"], "left_anti")
    again = rows.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    again = materialize(again, "again")
    if not again.isEmpty():
        twice = small_side(again)
        kept = kept.join(twice, ["_id", "_key"], "left_anti").unionByName(kept.join(twice, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]))
    return kept.select(*docs.columns)
