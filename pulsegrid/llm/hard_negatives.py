"""Hard negatives by exact search over K-means inverted lists.

Lists: centroids are fitted on a bounded sample, every row goes to the list of its nearest one,
and each list keeps its radius, the largest distance of a row from the centroid.  By
Cauchy-Schwarz no row of a list with centroid c and radius r has an inner product with q above
q.c + |q| r or below q.c - |q| r.

A search takes the lists of a query by falling upper bound, skips those whose bounds lie outside
its windows, and stops where the bound falls strictly below its k-th best score.  It runs in two
rounds for all queries at once: the first visits lists until they hold `first` rows, the second
those whose bound still reaches the k-th best score of the first.  (query, list) visits meet the
lists' rows in tiles of bounded size, dealt by a shuffle: queries are never gathered in one
place, and a list of any length is cut into blocks.

First the positives of each anchor are searched, without a window; then its negatives, one window
for each positive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import discard, materialize, small_batches

#: Rows that centroids are fitted on (expected number), and centroids at most.
SAMPLE, MAX_LISTS = 20_000, 1024
#: Centroids take no more bytes than this, as they are broadcast.
MAX_BYTES = 32 << 20
#: Rows of a list in one tile, and queries in one tile (expected number).
LIST_BLOCK, QUERY_BLOCK = 8192, 65_536
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SLOTS = "array<struct<slot:int,lo:bigint,hi:bigint,floor:bigint>>"


def fit_centroids(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm on a sample; empty clusters take the row that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    points = np.unique(rows, axis=0)
    k = min(k, len(points))
    centres = points[rng.permutation(len(points))[:k]].astype(float)
    for _ in range(rounds):
        near, far = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for c in np.flatnonzero(n == 0):
            at = int(far.argmax())
            centres[c], far[at] = rows[at], -1.0
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, an upper bound of the distance) of each row."""
    scale = max(1.0, float(np.abs(rows).max(initial=0)))  # keeps squares finite
    r, c = rows / scale, centres / scale
    near = ((c * c).sum(1)[None, :] - 2 * (r @ c.T)).argmin(1)
    return near, np.sqrt(((r - c[near]) ** 2).sum(1)) * scale * (1 + 1e-9) + 1e-6


def _vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values, lengths, offsets) of an Arrow list column."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), size, np.concatenate([[0], np.cumsum(size)])


def _matrix(flat, off, rows, dims):
    return flat[(off[rows][:, None] + np.arange(dims)[None, :]).ravel()].reshape(len(rows), dims)


def _assign(index):
    """Rows with their list and distance; vectors of a length that the sample lacks go to the list of the zero vector."""

    def run(batches):
        import pyarrow as pa

        held = index.value
        for b in batches:
            flat, size, off = _vectors(b.column(2))
            cluster, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dims in np.unique(size).tolist():
                rows = np.flatnonzero(size == dims)
                m = _matrix(flat, off, rows, dims)
                first, centres = held.get(dims, (None, None))
                if first is None:
                    cluster[rows], dist[rows] = -1, np.sqrt((m / np.abs(m).max(initial=1.0)) ** 2 @ np.ones(dims)) * np.abs(m).max(initial=1.0) * (1 + 1e-9) + 1e-6
                else:
                    near, far = nearest(m, centres)
                    cluster[rows], dist[rows] = first + near, far
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(cluster), pa.array(dist)], names=["id", "label", "v", "dims", "cluster", "dist"])

    return run


def _visits(lists, tiles: int, first: int, second: bool):
    """The tiles that each query visits.  lists: dims -> (cluster, rows, blocks, centres, radii)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat, size, off = _vectors(b.column("v"))
            slots = b.column("slots")
            flat_slots, n_slots = slots.flatten(), slots.value_lengths().to_numpy(zero_copy_only=False)
            slot_off = np.concatenate([[0], np.cumsum(n_slots)]).astype(np.int64)
            lo, hi = (flat_slots.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi"))
            lo, hi = np.where(lo <= LEAST, -np.inf, lo), np.where(hi >= MOST, np.inf, hi)  # open ends
            floor = flat_slots.field("floor").to_numpy(zero_copy_only=False).astype(float) if second else lo
            take, cluster, block = [], [], []
            for dims in np.unique(size).tolist():
                if dims not in lists.value:
                    continue
                names, rows, blocks, centres, radii = lists.value[dims]
                at = np.flatnonzero(size == dims)
                q = _matrix(flat, off, at, dims)
                mid, reach = q @ centres.T, np.sqrt((q * q).sum(1))[:, None] * radii[None, :]
                reach = reach * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))
                for i, r in enumerate(at.tolist()):
                    s = slice(slot_off[r], slot_off[r + 1])
                    if s.start == s.stop:
                        continue
                    up, down = mid[i] + reach[i], mid[i] - reach[i]
                    inside = (up[:, None] >= lo[None, s]) & (down[:, None] <= hi[None, s])
                    order = np.argsort(-up, kind="stable")
                    order = order[inside.any(1)[order]]
                    before = np.concatenate([[0], np.cumsum(rows[order])[:-1]]) if len(order) else np.zeros(0)
                    if second:
                        # down to where the bound falls strictly below every window's k-th best score, or its lower end
                        order = order[before >= first]
                        order = order[(inside[order] & (up[order][:, None] >= np.maximum(lo[None, s], floor[None, s]))).any(1)]
                    else:
                        order = order[before < first]
                    n = blocks[order]
                    take.append(np.full(int(n.sum()), r))
                    cluster.append(np.repeat(names[order], n))
                    block.append(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            for at in range(0, sum(map(len, take)), 4096):
                if at == 0:
                    take, cluster, block = np.concatenate(take), np.concatenate(cluster), np.concatenate(block)
                part = b.take(pa.array(take[at : at + 4096]))
                mixed = part.column("ask").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                deal = ((mixed >> np.uint64(33)) % np.uint64(tiles)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cluster[at : at + 4096].astype(np.int32)), pa.array(block[at : at + 4096].astype(np.int32)), pa.array(deal), *[part.column(c) for c in ("ask", "label", "v")], pa.array(np.ones(part.num_rows, bool)), part.column("slots")],
                    names=["cluster", "block", "deal", "id", "label", "v", "asks", "slots"],
                )

    return run


def best_rows(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k allowed rows of highest score, ties to the smaller id, best first."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _scan(k: int, same: bool):
    """Tiles, sorted: the rows of a list's block come before the queries that visit it."""

    def scored(ids, labels, mat, batch):
        q_flat, _, q_off = _vectors(batch.column("v"))
        asks = batch.column("id").to_numpy()
        q = _matrix(q_flat, q_off, np.arange(len(asks)), mat.shape[1])
        big = max(1.0, float(np.abs(mat).max(initial=0)), float(np.abs(q).max(initial=0)))
        exact = big * big * mat.shape[1] < 2.0**53
        if exact:
            scores = q @ mat.T
        else:  # doubles aren't exact any more
            scores = np.array([[sum(int(x) * int(y) for x, y in zip(a, c, strict=True)) for c in mat.tolist()] for a in q.tolist()], object).reshape(len(q), len(mat))
        out_a, out_s, out_i, out_v = [], [], [], []
        for i, (ask, label, slots) in enumerate(zip(asks.tolist(), batch.column("label").to_pylist(), batch.column("slots").to_pylist(), strict=True)):
            fits = ((labels == label) == same) & (ids != ask)
            if not exact and any(abs(v) > MOST // 100 for v in scores[i][fits].tolist()):
                raise ArithmeticError("a score is too large for 64 bits")
            for s in slots:
                # the k-th best score of the first round bounds a window from below; at equal scores the smaller id wins
                least = max(s["lo"], s["floor"])
                ok = fits & (scores[i] >= least) & (scores[i] <= s["hi"])
                top = best_rows(scores[i], ids, ok.astype(bool), k)
                out_a += [ask] * len(top)
                out_s += [s["slot"]] * len(top)
                out_i += ids[top].tolist()
                out_v += [int(v) for v in scores[i][top].tolist()]
        return out_a, out_s, out_i, out_v

    def run(batches):
        import pyarrow as pa

        of, parts, ready = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dims", "cluster", "block", "deal", "asks")], 1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                tile, part = tuple(key[s, :4]), b.slice(s, e - s)
                if not key[s, 4]:
                    if of != tile:
                        of, parts, ready = tile, [], None
                    flat, size, off = _vectors(part.column("v"))
                    parts.append((part.column("id").to_numpy(), np.array(part.column("label").to_pylist()), _matrix(flat, off, np.arange(part.num_rows), int(size[0]))))
                    continue
                if of != tile:  # no row was dealt to this block
                    continue
                if ready is None:
                    ready, parts = tuple(np.concatenate(x) for x in zip(*parts, strict=True)), []
                for at in range(0, part.num_rows, 256):
                    a, sl, i, v = scored(*ready, part.slice(at, 256))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(sl, pa.int32()), pa.array(i, pa.int64()), pa.array(v, pa.int64())], names=["ask", "slot", "id", "score"])

    return run


class InvertedLists:
    """K-means lists over all rows (id, label, v), v whole numbers as doubles, in the shared folder."""

    def __init__(self, rows: DataFrame, first: int = 2048):
        self.spark, self.first = rows.sparkSession, first
        self.rows = materialize(rows.select("id", "label", "v"), "vectors")
        n = self.rows.count()
        part = self.rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < max(1, -(-SAMPLE * (1 << 20) // max(n, 1)))).select("v").limit(2 * SAMPLE).toArrow()
        flat, size, off = _vectors(part["v"].combine_chunks()) if part.num_rows else (np.zeros(0), np.zeros(0, np.int64), np.zeros(1, np.int64))
        index, names = {}, 0
        for dims in np.unique(size).tolist():
            at = np.flatnonzero(size == dims)
            k = max(1, min(MAX_LISTS, round(n**0.5), len(at) // 16, MAX_BYTES // (8 * dims)))
            index[dims] = (names, fit_centroids(_matrix(flat, off, at, dims), k))
            names += len(index[dims][1])
        found = self.rows.mapInArrow(_assign(self.spark.sparkContext.broadcast(index)), "id long, label string, v array<double>, dims int, cluster int, dist double")
        self.lists = materialize(found, "lists")
        stats = self.lists.groupBy("dims", "cluster").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # a row a centroid, and one for each other length
        self.of: dict[int, tuple] = {}
        blocks = []
        for dims in sorted({r.dims for r in stats}):
            own = sorted((r for r in stats if r.dims == dims), key=lambda r: r.cluster)
            first_, centres = index.get(dims, (-1, np.zeros((1, dims))))
            n_blocks = np.array([-(-r.n // LIST_BLOCK) for r in own])
            names_ = np.array([r.cluster for r in own])
            self.of[dims] = (names_, np.array([r.n for r in own]), n_blocks, centres[names_ - first_], np.array([r.radius for r in own]))
            blocks += [(dims, r.cluster, int(x)) for r, x in zip(own, n_blocks, strict=True)]
        sizes = self.spark.createDataFrame(blocks, "dims int, cluster int, blocks int")
        self.cut = self.lists.join(F.broadcast(sizes), ["dims", "cluster"]).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")).cast("int"))
        self.shared = self.spark.sparkContext.broadcast(self.of)

    def _round(self, asks: DataFrame, tiles: int, k: int, same: bool, second: bool) -> DataFrame:
        visits = asks.mapInArrow(_visits(self.shared, tiles, self.first, second), f"cluster int, block int, deal int, id long, label string, v array<double>, asks boolean, slots {SLOTS}")
        rows = self.cut.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("cluster", "block", "deal", "id", "label", "v", F.lit(False).alias("asks"), F.lit(None).cast(SLOTS).alias("slots"))
        both = rows.unionByName(visits).withColumn("dims", F.size("v"))  # lists of the zero vector are told by the length
        both = both.repartition("cluster", "dims", "block", "deal").sortWithinPartitions("dims", "cluster", "block", "deal", "asks")
        found = both.mapInArrow(_scan(k, same), "ask long, slot int, id long, score long")
        w = Window.partitionBy("ask", "slot").orderBy(F.desc("score"), "id")
        return materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "found")

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """(ask, slot, rank, id, score): the k best rows of each window of each query.

        asks: (ask, label, v, slots), ask unique, slots an array of (slot, lo, hi).  Rows count
        whose label equals the query's (same) or differs from it, whose id isn't the query's,
        and whose score lies in [lo, hi].
        """
        asks = asks.withColumn("slots", F.transform("slots", lambda s: s.withField("floor", s.lo)))
        tiles = max(1, -(-asks.count() // QUERY_BLOCK))
        one = self._round(asks, tiles, k, same, False)
        full = one.groupBy("ask", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        floors = full.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
        again = asks.join(floors, "ask", "left")
        again = again.withColumn("slots", F.transform("slots", lambda s: s.withField("floor", F.greatest(s.lo, F.coalesce(F.try_element_at("kth", s.slot), s.lo))))).drop("kth")
        two = self._round(again, tiles, k, same, True)
        w = Window.partitionBy("ask", "slot").orderBy(F.desc("score"), "id")
        both = one.drop("rank").unionByName(two.drop("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = materialize(both.select("ask", "slot", "rank", "id", "score"), "best")
        discard(one, two)
        return out

    def close(self) -> None:
        discard(self.rows, self.lists)


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str | Column = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), x as double; a score is the integer inner product with
    the anchor, higher first, ties to the smaller id.  An anchor's positives are its first
    `positives` other rows of the same label; for each, the first `negatives` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score are returned.

    Rows with a null id or label, or a null or empty vector, or one that holds a null or
    non-finite component, take no part.  Vectors of different lengths aren't compared.  Repeated
    rows count each as positives and negatives, but never for an anchor of their own id; an
    anchor id that repeats asks once, with the least of its vectors.  Scores are exact; one
    that 64 bits can't hold a hundred times raises.  Other columns are ignored, and an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    base = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    base = base.where(sound & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # from 2**53 on doubles are whole, and floor() to a long could overflow
    base = base.select("id", "label", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))
    lists = InvertedLists(base)
    anchors = lists.rows.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select(F.col("id").alias("ask"), "a.label", "a.v")
    anchors = materialize(anchors, "anchors")
    whole = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    good = lists.search(anchors.withColumn("slots", whole), positives, True)
    windows = good.select("ask", F.struct(F.col("rank").alias("slot"), F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)").alias("lo"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("hi")).alias("s"))
    windows = windows.where("s.lo <= s.hi").groupBy("ask").agg(F.sort_array(F.collect_list("s")).alias("slots"))
    bad = lists.search(materialize(anchors.join(windows, "ask"), "asks"), negatives, False)
    out = good.select("ask", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(bad, ["ask", "slot"])
    out = materialize(out.select(F.col("ask").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(good, bad, anchors)
    lists.close()
    return out
