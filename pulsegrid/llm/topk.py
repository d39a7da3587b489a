"""Exact top-k inner products by columnar branch and bound.

Candidates are held in vertical layout: one row per dimension.  For each query, partial scores
are accumulated a block of dimensions at a time; after a block, a candidate survives only if
its partial score plus the most that the remaining dimensions can add (the product of the
remaining masses, the norms of both vectors' remaining parts) reaches the k-th best score known
so far, and the survivors are compacted.  Dimensions are taken in the order of falling query mass.

Queries are taken in blocks of bounded size that are broadcast to one scan of the candidates
each; a block's result is written before the next begins, so neither the driver nor a task
holds more than one block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import materialize, small_batches

#: Queries broadcast at once, and candidate rows taken at once in a task.
QUERY_BLOCK, ROW_BLOCK = 8192, 16384
DIM_BLOCK = 8


def branch_and_bound(columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: tuple | None):
    """The candidates that may be among the best k of one query: (scores, ids), best first.

    columns: dimensions by candidates; rest[b]: norm of each candidate from dimension block b on;
    floor: the k-th best (score, id) known already.
    """
    dims = len(q)
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), columns.dtype)
    bar = -np.inf if floor is None else floor[0]
    for b, at in enumerate(range(0, dims, DIM_BLOCK)):
        part = columns[at : at + DIM_BLOCK]
        score = score + q[at : at + DIM_BLOCK] @ (part if len(alive) == len(ids) else part[:, alive])
        if at + DIM_BLOCK >= dims or not len(alive):
            break
        if columns.dtype == object:  # beyond 2**53 bounds in doubles would need wider margins
            continue
        left = float(np.sqrt((q[at + DIM_BLOCK :].astype(float) ** 2).sum()))
        mass = left * rest[b + 1][alive] * (1 + 1e-9) + 1e-6
        if bar == -np.inf and len(alive) > k:
            # the k-th best of the least that each candidate can reach
            bar = np.partition(score - mass, len(alive) - k)[len(alive) - k]
        keep = score + mass >= bar
        if not keep.all():
            alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return score[order], ids[alive[order]]


def _scan(queries, dims: int, k: int):
    def run(batches):
        import pyarrow as pa

        q_ids, q_mat = queries.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        exact = np.float64
        for b in _matrices(batches, dims):
            ids, mat = b
            big = max(1.0, float(np.abs(mat).max(initial=0)), float(np.abs(q_mat).max(initial=0)))
            if big * big * dims >= 2.0**53:  # doubles aren't exact any more
                exact = object
            columns = np.ascontiguousarray(mat.T) if exact is np.float64 else np.array([[int(v) for v in row] for row in mat.T.tolist()], object)
            mass = np.cumsum((mat * mat)[:, ::-1], axis=1)[:, ::-1]
            rest = [np.sqrt(mass[:, at]) for at in range(0, dims, DIM_BLOCK)]
            for i, qid in enumerate(q_ids.tolist()):
                q = q_mat[i] if exact is np.float64 else np.array([int(v) for v in q_mat[i].tolist()], object)
                old = best.get(i)
                floor = None if old is None or len(old[0]) < k else (old[0][-1], old[1][-1])
                s, c = branch_and_bound(columns, rest, ids, q, qid, k, floor)
                if old is not None:
                    s, c = np.concatenate([old[0], s]), np.concatenate([old[1], c])
                    order = np.lexsort((c, -s))[:k]
                    s, c = s[order], c[order]
                best[i] = s, c
        if best:
            n = [len(best[i][0]) for i in range(len(q_ids))]
            scores = [int(v) for i in range(len(q_ids)) for v in best[i][0].tolist()]
            if scores and max(map(abs, scores)) >= 1 << 63:
                raise ArithmeticError("a score doesn't fit 64 bits")
            cand = np.concatenate([best[i][1] for i in range(len(q_ids))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(cand.astype(np.int64)), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _matrices(batches, dims: int):
    """(ids, row matrix of whole numbers) of the vectors, several thousand at once."""
    held: list = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            part = b.slice(at, ROW_BLOCK)
            col = part.column(1)
            mat = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            held.append((part.column(0).to_numpy(zero_copy_only=False), mat))
            size += part.num_rows
            if size >= ROW_BLOCK:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, size = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def top_k_inner(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best by integer inner product, ties to the smaller id.

    Components become floor(scale * x), x as double.  Vectors that are null, empty, or hold a
    null or non-finite component take no part, nor do rows with a null id.  Vectors of
    different lengths aren't compared.  A query's candidates are all rows but those of its
    own id; repeated candidate rows count each, a repeated query id asks once, with the least
    of its vectors.  Scores are exact; one that 64 bits can't hold raises.  Other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.size("v") > 0
    sound &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    # from 2**53 on doubles are whole, and floor() to a long could overflow
    base = base.select("id", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))
    asked = base.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked.withColumn("dims", F.size("v")), "queries")
    sizes = {r.dims: r["count"] for r in asked.groupBy("dims").count().collect()}
    parts: list[DataFrame] = []
    for dims, n in sorted(sizes.items()):
        blocks = -(-n * 10 // (QUERY_BLOCK * 9))
        for block in range(blocks):
            rows = asked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).select("id", "v").toArrow()
            if not rows.num_rows:
                continue
            q_ids = rows["id"].to_numpy()
            q_mat = np.array(rows["v"].combine_chunks().flatten().to_numpy(), float).reshape(-1, dims)
            held_block = spark.sparkContext.broadcast((q_ids, q_mat))
            found = base.where(F.size("v") == dims).mapInArrow(_scan(held_block, dims, k), "query_id long, vec_id long, score long")
            w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
            ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            parts.append(ranked if len(sizes) == 1 and blocks == 1 else materialize(ranked, "topk"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
