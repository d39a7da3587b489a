"""Beat tracking by dynamic programming over chunks of a series.

The best score of a frame is its value plus the best of 0 and of the scores of lo to hi frames
before it, each less a penalty for its distance from the period.  A chunk therefore depends on
what is before it only through hi scores, and maps these to its own last hi scores: each is the
largest of a constant and of the incoming ones plus a weight.

Steps: 1. the weights of every chunk that another follows, all chunks at once; 2. the few
scores at the chunks' edges, from chunk to chunk of a track; 3. the scores of all frames, all
chunks at once, and the frame before its chunk that each is reached from; 4. the places at
which the best path crosses the edges, backwards; 5. the path within each chunk.  Steps 2 and 4
see hi rows a chunk, not the series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.shared import written

CHUNK = 32_768
#: Frames whose weights are held at once.
HELD = 4096


def penalties(period: float, tightness: float) -> tuple[int, int, np.ndarray]:
    """(lo, hi, what a distance of hi, hi - 1, ... lo frames adds to a score)."""
    lo, hi = max(1, round(0.5 * period)), max(1, round(2 * period))
    return lo, hi, -tightness * np.log(np.arange(hi, lo - 1, -1) / period) ** 2


def edge_weights(v: np.ndarray, lo: int, hi: int, added: np.ndarray) -> np.ndarray:
    """hi rows, one for each of the last hi scores: weights of the hi incoming scores, then the constant."""
    state = np.full((hi, hi + 1), -np.inf)
    state[np.arange(hi), np.arange(hi)] = 0
    for at in range(0, len(v), HELD):
        part = v[at : at + HELD]
        m = np.concatenate([state, np.empty((len(part), hi + 1))])
        for r, x in enumerate(part, hi):
            best = (m[r - hi : r - lo + 1] + added[:, None]).max(axis=0)
            best[hi] = max(best[hi], 0.0)
            m[r] = x + best
        state = m[-hi:]
    return state


def scores(v: np.ndarray, state: np.ndarray, lo: int, hi: int, added: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, distance of the frame before it on its best path or 0, and that path's place before the chunk, below 0, or 1) of each frame; missing ones are -inf."""
    best, back, leaves = np.concatenate([state, v]), np.zeros(len(v), np.int64), np.ones(len(v), np.int64)
    for i in np.flatnonzero(np.isfinite(v)).tolist():
        w = best[i : i + hi - lo + 1] + added
        j = len(w) - 1 - int(w[::-1].argmax())  # the nearest of equals
        if w[j] > 0:
            best[i + hi] += w[j]
            back[i] = k = hi - j
            leaves[i] = i - k if i < k else leaves[i - k]
    return best[hi:], back, leaves


def _dense(df) -> np.ndarray:
    v = np.full(int(df["size"].iloc[0]), -np.inf)
    v[df["i"].to_numpy()] = df["v"].to_numpy()
    return v


def of_one(name, **columns):
    """A pandas frame of one track's rows; names stay Python objects, whatever their type."""
    import pandas as pd

    n = len(next(iter(columns.values())))
    return pd.DataFrame({"track": pd.Series([name] * n, dtype=object)} | columns)


def track(series: DataFrame, period: Column, tightness: float = 100.0, chunk: int = CHUNK) -> DataFrame:
    """(track, t): the frames of the best path of each track, ending at the first of the highest scores.

    series has (track, t, v), one row a frame of a track, and period, in frames, is the same for
    a track's rows.  Frames that are missing, or whose value is null or not finite, are no
    beats; rows without a track, a frame or a positive period take no part.  Of equally good
    frames before one the nearest is taken; scores of a track's later chunks may differ in
    their last bits from those of one loop over it, and only ties within that are open.
    """
    kind = dict(series.dtypes)["track"]
    rows = series.withColumn("period", period.cast("double")).where("track is not null and t is not null and period > 0 and abs(v) < double('infinity')")
    rows = rows.withColumn("size", F.greatest(F.lit(chunk), F.ceil(2 * F.col("period")) + 1).cast("long")).withColumn("c", F.floor(F.col("t") / F.col("size")))
    rows = rows.select("track", "c", (F.col("t") - F.col("c") * F.col("size")).alias("i"), "v", "period", "size")

    def weigh(df):
        lo, hi, added = penalties(float(df["period"].iloc[0]), tightness)
        m = edge_weights(_dense(df), lo, hi, added)
        return of_one(df["track"].iloc[0], c=np.full(hi, df["c"].iloc[0]), j=np.arange(hi), w=list(m))

    def chain(batches):
        import pandas as pd

        at, state, following = None, None, []
        for df in batches:
            out = []
            for name, c, j, w in df[["track", "c", "j", "w"]].itertuples(index=False):
                hi = len(w) - 1
                if j == 0:
                    before = (name, c - 1) == at
                    state = np.array(following) if before else np.full(hi, -np.inf)
                    at, following = (name, c), []
                following.append(max(float((w[:hi] + state).max()), float(w[hi])))
                if j == hi - 1:
                    out.append((name, c + 1, following))
            yield pd.DataFrame(out, columns=["track", "c", "state"], dtype=object)

    def scored(df, incoming):
        import pandas as pd

        if df.empty:
            return pd.DataFrame(columns=["track", "c", "i", "size", "best", "back", "leaves", "edge"])
        lo, hi, added = penalties(float(df["period"].iloc[0]), tightness)
        v = _dense(df)
        best, back, leaves = scores(v, np.full(hi, -np.inf) if incoming.empty else np.asarray(incoming["state"].iloc[0], float), lo, hi, added)
        i = np.flatnonzero(np.isfinite(v))
        of = {"c": np.full(len(i), df["c"].iloc[0]), "i": i, "size": np.full(len(i), len(v))}
        return of_one(df["track"].iloc[0], **of, best=best[i], back=back[i], leaves=leaves[i], edge=i >= len(v) - hi)

    def crossings(top, edges):
        import pandas as pd

        out = []
        if len(top):
            known = {(c, i): x for c, i, x in edges[["c", "i", "leaves"]].itertuples(index=False)}
            name, c, i, size, x = top[["track", "c", "i", "size", "leaves"]].iloc[0]
            out.append((name, c, i))
            while x < 0:
                c, i = c - 1, size + x
                out.append((name, c, i))
                x = known[c, i]
        return pd.DataFrame(out, columns=["track", "c", "i"], dtype=object)

    def path(df, entered):
        out = []
        if len(entered):
            back = dict(zip(df["i"], df["back"], strict=True))
            i = int(entered["i"].iloc[0])
            first = int(df["c"].iloc[0]) * int(df["size"].iloc[0])
            while i >= 0:
                out.append(first + i)
                i = i - back[i] if back[i] else -1
        return of_one(df["track"].iloc[0] if out else None, t=np.array(out, np.int64))

    last = rows.groupBy("track").agg(F.max("c").alias("last"))
    weights = rows.join(last, "track").where("c < last").groupBy("track", "c").applyInPandas(weigh, f"track {kind}, c long, j int, w array<double>")
    states = weights.repartition("track").sortWithinPartitions("track", "c", "j").mapInPandas(chain, f"track {kind}, c long, state array<double>")
    both = rows.groupBy("track", "c").cogroup(states.groupBy("track", "c"))
    found = written(both.applyInPandas(scored, f"track {kind}, c long, i long, size long, best double, back long, leaves long, edge boolean"), "scores")
    top = found.groupBy("track").agg(F.max(F.struct("best", (-F.col("c")).alias("c"), (-F.col("i")).alias("i"), "size", "leaves")).alias("top"))
    top = top.select("track", (-F.col("top.c")).alias("c"), (-F.col("top.i")).alias("i"), "top.size", "top.leaves")
    edges = found.where("edge").select("track", "c", "i", "leaves")
    entered = top.groupBy("track").cogroup(edges.groupBy("track")).applyInPandas(crossings, f"track {kind}, c long, i long")
    return found.select("track", "c", "i", "size", "back").groupBy("track", "c").cogroup(entered.groupBy("track", "c")).applyInPandas(path, f"track {kind}, t long")
