"""Transient timing, classification, clicks and dropouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import score_above, score_below, score_within
from pulsegrid.operators import islands, spectral

KEY = ["track", "channel"]
# fixed values: the classes in the order in which ties go
CLASSES = ("kick", "snare", "hihat", "tonal_onset", "percussion")


def around(samples: DataFrame, at: DataFrame, before: int, after: int) -> DataFrame:
    """(track, channel, cand, frame, x): the samples near each candidate frame; candidates are keyed by the buckets their reach touches."""
    size = before + after
    keyed = at.select("track", "cand", F.explode(F.sequence(F.floor((F.col("cand") - before) / size), F.floor((F.col("cand") + after) / size))).alias("bucket"))
    return samples.withColumn("bucket", F.floor(F.col("frame") / size)).join(keyed, ["track", "bucket"]).where((F.col("frame") >= F.col("cand") - before) & (F.col("frame") < F.col("cand") + after)).select(*KEY, "cand", "frame", "x")


def attack(near: DataFrame, sample_rate: int) -> DataFrame:
    """(track, channel, cand, attack, start): where the energy of the next millisecond over that of the last five is largest (the last of equals), and the sign change before it."""
    k1, k5 = max(1, sample_rate // 1000), max(1, sample_rate * 5 // 1000)
    w = Window.partitionBy(*KEY, "cand").orderBy("frame")
    e = F.col("x") * F.col("x")
    rows = near.withColumn("ahead", F.sum(e).over(w.rowsBetween(0, k1 - 1))).withColumn("behind", F.coalesce(F.sum(e).over(w.rowsBetween(-k5, -1)), F.lit(0.0)))
    rows = rows.withColumn("turn", (F.lag("x").over(w) >= 0) != (F.col("x") >= 0))
    best = rows.groupBy(*KEY, "cand").agg(F.max_by("frame", F.struct(F.col("ahead") / (F.col("behind") + 1e-12), "frame")).alias("attack"), F.min("frame").alias("lo"))
    back = rows.join(best, [*KEY, "cand"]).groupBy(*KEY, "cand", "attack", "lo").agg(F.max(F.when(F.col("turn") & (F.col("frame") <= F.col("attack")), F.col("frame"))).alias("s"))
    return back.select(*KEY, "cand", "attack", F.coalesce("s", "lo").alias("start"))


def peak_and_times(near: DataFrame, start: DataFrame, sample_rate: int) -> DataFrame:
    """Per candidate: peak within 30 ms (the first of equals), rise from 10 to 90 %, decay to a tenth by the trailing 20 ms maximum; in ms."""
    rows = near.join(start, [*KEY, "cand"]).where(F.col("frame") >= F.col("start")).withColumn("a", F.abs("x"))
    early = rows.where(F.col("frame") < F.col("start") + round(0.030 * sample_rate))
    peak = early.groupBy(*KEY, "cand").agg(F.max(F.struct("a", (-F.col("frame")).alias("back"))).alias("p")).select(*KEY, "cand", F.col("p.a").alias("peak"), (-F.col("p.back")).alias("peak_frame"))
    w = Window.partitionBy(*KEY, "cand").orderBy("frame").rowsBetween(1 - max(1, round(0.020 * sample_rate)), 0)
    rows = rows.withColumn("env", F.max("a").over(w)).join(peak, [*KEY, "cand"])
    first = lambda c: F.min(F.when(c, F.col("frame")))
    g = rows.groupBy(*KEY, "cand", "peak", "peak_frame").agg(
        first(F.col("a") >= 0.1 * F.col("peak")).alias("t10"),
        first(F.col("a") >= 0.9 * F.col("peak")).alias("t90"),
        first((F.col("frame") > F.col("peak_frame")) & (F.col("env") <= F.col("peak") * 0.1)).alias("low"),
    )
    ms = 1000.0 / sample_rate
    return g.select(*KEY, "cand", "peak", "peak_frame", ((F.col("t90") - F.col("t10")) * ms).alias("attack_ms"), ((F.col("low") - F.col("peak_frame")) * ms).alias("decay_ms"))


def classified(features: DataFrame) -> DataFrame:
    """class and confidence from centroid, flatness, share_low, share_high and decay_ms; the first of equal scores, below 0.5 unclassified."""
    c, flat, low, high, decay = (F.col(n) for n in ("centroid", "flatness", "share_low", "share_high", "decay_ms"))
    mean = lambda *s: sum(s[1:], s[0]) / len(s)
    scores: dict[str, Column] = {
        "kick": mean(score_above(low, 0.5, 0.3), score_below(c, 400, 300)),
        "snare": mean(score_within(c, 800, 4000, 800), score_above(flat, 0.15, 0.2), score_within(low, 0.05, 0.5, 0.2)),
        "hihat": mean(score_above(c, 5000, 2000), score_above(high, 0.5, 0.3)),
        "tonal_onset": mean(score_below(flat, 0.1, 0.1), score_above(decay, 150, 100)),
        "percussion": mean(score_above(flat, 0.05, 0.1), score_below(decay, 200, 100), F.lit(0.5)),
    }
    ranked = F.array(*[F.struct(scores[n].alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(CLASSES)])
    top = F.array_max(ranked)
    return features.withColumn("_t", top).withColumn("class", F.when(F.col("_t.s") < 0.5, "unclassified").otherwise(F.col("_t.n"))).withColumn("confidence", F.when(F.col("_t.s") < 0.5, 1 - F.col("_t.s")).otherwise(F.col("_t.s"))).drop("_t")


def count_by_class(found: DataFrame) -> DataFrame:
    every = found.select("track").distinct().select("track", F.explode(F.array(*[F.lit(c) for c in (*CLASSES, "unclassified", "click", "dropout")])).alias("class"))
    return every.join(found.groupBy("track", "class").agg(F.count("*").alias("n")), ["track", "class"], "left").na.fill(0, ["n"])


def dropouts(samples: DataFrame, sample_rate: int, threshold_db: float = -80.0, min_ms: float = 1.0, max_ms: float = 50.0) -> DataFrame:
    """Runs at or below the threshold whose length is within bounds, inclusive."""
    runs = islands.runs(samples, KEY, "frame", F.abs("x") <= 10 ** (threshold_db / 20))
    ms = F.col("n") * 1000.0 / sample_rate
    return runs.where((ms >= min_ms) & (ms <= max_ms)).withColumn("length_ms", ms)


def _lpc(x: np.ndarray, order: int) -> np.ndarray:
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    a, e = np.zeros(order + 1), r[0]
    a[0] = 1.0
    if e <= 0:
        return a
    for i in range(1, order + 1):
        k = -(r[i] + a[1:i] @ r[i - 1 : 0 : -1]) / e
        a[1 : i + 1] = a[1 : i + 1] + k * np.r_[a[i - 1 : 0 : -1], 1.0]
        e *= 1 - k * k
        if e <= 0:
            break
    return a


def click_candidates(samples: DataFrame, window: int = 512, hop: int = 256, order: int = 12, factor: float = 6.0) -> DataFrame:
    """(track, channel, frame, ratio): prediction residuals above median + factor * MAD in the middle of each window.

    Windows overlap, but each owns a stretch of `hop` frames, so windows are independent tasks.
    """
    edge = (window - hop) // 2

    def run(batches):
        import pandas as pd

        for df in batches:
            for track, channel, g, at, xs, n in df[["track", "channel", "g", "at", "x", "n"]].itertuples(index=False):
                for t, x in zip(*spectral._cut(g, n, at, xs, window, hop, 0), strict=True):
                    e = np.abs(np.convolve(x, _lpc(x, order))[: len(x)])[order:]
                    med = np.median(e)
                    bar = med + factor * max(np.median(np.abs(e - med)), 1e-4)
                    i = np.flatnonzero(e > bar) + order
                    i = i[(i >= edge) & (i < edge + hop)]
                    if len(i):
                        yield pd.DataFrame({"track": track, "channel": channel, "frame": t * hop + i, "ratio": e[i - order] / bar})

    return spectral._grouped(samples, window, hop, 0).mapInPandas(run, "track string, channel int, frame long, ratio double")


def merged_clicks(found: DataFrame, reach: int = 2) -> DataFrame:
    """Candidates up to `reach` frames apart as one, at the highest ratio (the first of equals)."""
    w = Window.partitionBy(*KEY).orderBy("frame")
    rows = found.withColumn("new", F.when(F.col("frame") - F.lag("frame").over(w) <= reach, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return rows.groupBy(*KEY, "g").agg(F.max(F.struct("ratio", (-F.col("frame")).alias("back"))).alias("p")).select(*KEY, (-F.col("p.back")).alias("frame"), F.col("p.ratio").alias("ratio"))
