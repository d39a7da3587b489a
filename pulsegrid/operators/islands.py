"""Runs, gaps and state machines over ordered rows, as window expressions.

Every function takes the partition columns; none of them may be empty on large data, or all
rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values (frames) of one chunk: a long track is worked on in as many tasks as it has chunks.
CHUNK = 65_536


def chunked(df: DataFrame, order: str, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """df with _chunk and _own: each row is in the chunk of its order value (_own), and those within
    `before` of a chunk's begin or `after` of its end are in that chunk as well, for windows that reach over its edges."""
    if max(before, after) > chunk:
        raise ValueError("a halo can't be wider than a chunk")
    at, pos = F.floor(F.col(order) / chunk), F.pmod(F.col(order), F.lit(chunk))
    places = [F.struct(at.alias("c"), F.lit(True).alias("o"))]
    if after:
        places.append(F.when(pos < after, F.struct((at - 1).alias("c"), F.lit(False).alias("o"))))
    if before:
        places.append(F.when(pos >= chunk - before, F.struct((at + 1).alias("c"), F.lit(False).alias("o"))))
    if len(places) == 1:
        return df.withColumn("_chunk", at).withColumn("_own", F.lit(True))
    return df.withColumn("_at", F.explode(F.array_compact(F.array(*places)))).withColumn("_chunk", F.col("_at.c")).withColumn("_own", F.col("_at.o")).drop("_at")


def hysteresis(df: DataFrame, part: list[str], order: str, level: Column, enter: float, leave: float, out: str = "quiet") -> DataFrame:
    """out: true from level <= enter until level > leave; true before anything decides."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(level > leave, False).when(level <= enter, True)
    return df.withColumn(out, F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(True)))


def runs(df: DataFrame, part: list[str], order: str, flag: Column, repeats: bool = True, **extra: tuple) -> DataFrame:
    """(part..., begin, end, n, extra...): maximal runs of consecutive order values with flag true; end exclusive.

    Rows are numbered over the whole partition, and those belong together whose order value is as far
    from their number: what repeated order values make of that doesn't depend on where chunks end.
    extra are pairs (aggregate function, column) over a run's rows, of functions that can be
    applied to their own results.  Runs are found chunk by chunk; over the whole partition goes one
    row a chunk, its number of rows, for which df is read once more.  Without repeats (order values that are
    unique in a partition) only the pieces that touch a chunk's edge are joined, and df is read once.
    """
    keys = [*part, "_chunk"]
    hit = chunked(df.where(flag), order)
    numbered = hit.withColumn("_grp", F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    pieces = numbered.groupBy(*keys, "_grp").agg(F.min(order).alias("begin"), (F.max(order) + 1).alias("end"), F.count("*").alias("n"), *[f(c).alias(k) for k, (f, c) in extra.items()])
    whole = [F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n").alias("n"), *[f(k).alias(k) for k, (f, _) in extra.items()]]
    if repeats:
        counts = hit.where(F.col("_chunk").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
        ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
        ahead = ahead.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_ahead")
        placed = pieces.join(ahead, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left").withColumn("_grp", F.col("_grp") - F.coalesce("_ahead", F.lit(0)))
        return placed.groupBy(*part, "_grp").agg(*whole).drop("_grp")
    pieces = pieces.drop("_grp", "_chunk")
    edge = (F.col("begin") % CHUNK == 0) | (F.col("end") % CHUNK == 0)
    w = Window.partitionBy(*part).orderBy("begin")
    near = pieces.where(edge).withColumn("_new", F.when(F.lag("end").over(w) == F.col("begin"), 0).otherwise(1)).withColumn("_grp", F.sum("_new").over(w))
    return pieces.where(~edge).unionByName(near.groupBy(*part, "_grp").agg(*whole).drop("_grp"))


def merge_runs(df: DataFrame, part: list[str], gap: Column | float, inclusive: bool, **extra: Column) -> DataFrame:
    """Joins runs whose distance is below gap (or equal to it, if inclusive).

    n is kept for a run alone; for merged ones it is the whole span with its gaps.
    """
    w = Window.partitionBy(*part).orderBy("begin")
    far = F.col("begin") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (far > gap) if inclusive else (far >= gap)
    grouped = df.withColumn("_new", F.when(far.isNull() | new, 1).otherwise(0)).withColumn("_grp", F.sum("_new").over(w))
    more = [c.alias(k) for k, c in extra.items()]
    out = grouped.groupBy(*part, "_grp").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("parts"), F.sum("n").alias("_n"), *more)
    return out.withColumn("n", F.when(F.col("parts") > 1, F.col("end") - F.col("begin")).otherwise(F.col("_n"))).drop("_grp", "_n")


def refractory(df: DataFrame, part: list[str], order: str, distance: float, at_least: bool = False, chunk: float | None = None) -> DataFrame:
    """Greedy selection: a row stays if it is more than `distance` (or that far, if at_least) after the last that stayed.

    Rows of one position stay or go together; those without a position go.  Positions are taken
    in chunks, side by side: what a chunk keeps depends on the last position kept before it, and
    only through the first one that it lets stay, so that each chunk is reduced to a map from
    its possible first positions, those within `distance` of its begin, to its last.  The maps,
    one row a chunk, are chained per partition; then each chunk selects from where it truly starts.
    """
    import numpy as np
    import pandas as pd

    size = float(chunk or max(CHUNK, 16 * distance))
    gap = float(distance)
    keys = ", ".join(f"{p} {k}" for p, k in df.select(*part).dtypes)
    places = df.select(*part, F.col(order).cast("double").alias("_p")).where("_p is not null and not isnan(_p)").distinct()
    packed = places.groupBy(*part, F.floor(F.col("_p") / size).alias("_chunk")).agg(F.sort_array(F.collect_list("_p")).alias("_ps"))

    def following(x, after):
        """For each position of `after`, the place in x of the first one far enough behind it; differences decide, not sums, which round otherwise."""
        far = (lambda d: d >= gap) if at_least else (lambda d: d > gap)
        edge = np.r_[-np.inf, x, np.inf]
        at = np.searchsorted(x, after + gap, "left") + 1
        with np.errstate(invalid="ignore"):  # nothing before the first
            while (back := far(edge[at - 1] - after) & (at > 1)).any():
                at = at - back
            while (on := ~far(edge[at] - after) & (at <= len(x))).any():
                at = at + on
        return at - 1

    def maps(batches):
        for df in batches:
            firsts, lasts = [], []
            for c, ps in zip(df["_chunk"], df["_ps"], strict=True):
                x = np.asarray(ps, float)
                after, last = following(x, x).tolist(), x.copy()
                for i in range(len(x) - 1, -1, -1):
                    if after[i] < len(x) and after[i] > i:
                        last[i] = last[after[i]]
                    elif after[i] <= i:  # no distance at all: every position stays
                        last[i] = x[-1]
                n = min(len(x), int(np.searchsorted(x, c * size + gap, "right")) + 1)
                firsts.append(x[:n].tolist())
                lasts.append(last[:n].tolist())
            yield df[[*part, "_chunk"]].assign(firsts=firsts, lasts=lasts)

    reduced = packed.mapInPandas(maps, f"{keys}, _chunk long, firsts array<double>, lasts array<double>")

    def chain(df):
        df = df.sort_values("_chunk")
        now, out = -np.inf, []
        for firsts, lasts in zip(df["firsts"], df["lasts"], strict=True):
            out.append(now)
            i = int(following(np.asarray(firsts, float), np.array([now]))[0])
            if i < len(firsts):
                now = lasts[i]
        return df[[*part, "_chunk"]].assign(before=out)

    starts = reduced.groupBy(*part).applyInPandas(chain, f"{keys}, _chunk long, before double")

    def select(batches):
        for df in batches:
            rows = []
            for ps, before in zip(df["_ps"], df["before"], strict=True):
                x = np.asarray(ps, float)
                after, i, kept = following(x, x).tolist(), int(following(x, np.array([before]))[0]), []
                while i < len(x):
                    kept.append(float(x[i]))
                    i = max(after[i], i + 1)
                rows.append(kept)
            yield df[part].assign(_at=pd.Series(rows, index=df.index))

    same = [packed[p].eqNullSafe(starts[p]) for p in part] + [packed["_chunk"] == starts["_chunk"]]
    kept = packed.join(starts, same).select(*[packed[p] for p in part], packed["_ps"], starts["before"]).mapInPandas(select, f"{keys}, _at array<double>")
    kept = kept.select(*part, F.explode("_at").alias("_at"))
    return df.join(kept, [df[p].eqNullSafe(kept[p]) for p in part] + [df[order].cast("double") == kept["_at"]], "left_semi")
