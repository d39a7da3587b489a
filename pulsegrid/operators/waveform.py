"""Waveform summaries: level-0 bins, the pyramid over them, range queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.model import BIN_FRAMES

KEY = ["track", "channel"]
BIN = ["frames", "min", "max", "ms", "abs_peak"]


def bins(samples: DataFrame, frames: int = BIN_FRAMES) -> DataFrame:
    """Level 0: min, max, mean square and absolute peak of every `frames` frames; the last may be shorter."""
    g = samples.groupBy(*KEY, F.floor(F.col("frame") / frames).alias("bin")).agg(F.count("*").alias("frames"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg(F.col("x") * F.col("x")).alias("ms"))
    return g.withColumn("abs_peak", F.greatest(-F.col("min"), F.col("max")))


def pyramid(level0: DataFrame, levels: int, exact: bool = False) -> DataFrame:
    """Levels 0 to `levels` in one pass: a bin of level L folds 2**L bins of level 0.

    As pairs are folded level by level, an odd last bin isn't promoted: a bin exists only if all
    its level-0 bins do.  exact keeps the partial ones.  The mean square is weighted by frames.
    """
    up = level0.select(*KEY, "bin", *BIN, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    g = up.groupBy(*KEY, "level", F.expr("shiftright(bin, level)").alias("bin")).agg(
        F.count("*").alias("_parts"), F.sum("frames").alias("frames"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum(F.col("ms") * F.col("frames")) / F.sum("frames")).alias("ms"), F.max("abs_peak").alias("abs_peak"),
    )
    if not exact:
        g = g.where("_parts = shiftleft(1, level)")
    return g.select(*KEY, "level", "bin", "frames", "min", "max", F.sqrt("ms").alias("rms"), "abs_peak")


def finalized(levels: DataFrame, most: int = 32) -> DataFrame:
    """Levels up to the first that has at most `most` bins."""
    size = levels.groupBy(*KEY, "level").agg(F.count("*").alias("n"))
    last = size.where(F.col("n") <= most).groupBy(*KEY).agg(F.min("level").alias("last"))
    return levels.join(last, KEY, "left").where("last is null or level <= last").drop("last")


def level_for(frames_per_bin: float, most: int) -> int:
    """The pyramid level for a display density; -1 means raw samples."""
    if frames_per_bin < BIN_FRAMES:
        return -1
    return min(most, int(math.floor(math.log2(frames_per_bin / BIN_FRAMES))))


def query(levels: DataFrame, begin: int, end: int, count: int, level: int) -> DataFrame:
    """`count` output bins over [begin, end) from one level.

    min, max and peak are those of all source bins touched; the RMS is weighted by overlap.
    Output bins that no source bin reaches are zero.
    """
    size = BIN_FRAMES << level
    out = levels.sparkSession.range(count).select(F.col("id").alias("out"), F.expr(f"{begin} + (id * {end - begin}) div {count}").alias("b"), F.expr(f"{begin} + ((id + 1) * {end - begin}) div {count}").alias("e"))
    touched = out.withColumn("bin", F.explode(F.expr(f"sequence(b div {size}, greatest(b, e - 1) div {size})")))
    source = levels.where(F.col("level") == level).where((F.col("bin") >= begin // size) & (F.col("bin") <= end // size))
    overlap = F.least(F.col("e"), F.col("bin") * size + F.col("frames")) - F.greatest(F.col("b"), F.col("bin") * size)
    hit = source.join(touched, "bin").withColumn("overlap", F.greatest(overlap, F.lit(0)).cast("double"))
    g = hit.groupBy(*KEY, "out").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sqrt(F.try_divide(F.sum(F.col("rms") * F.col("rms") * F.col("overlap")), F.sum("overlap"))).alias("rms"), F.max("abs_peak").alias("abs_peak"))
    every = levels.select(*KEY).distinct().select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("out"))
    return every.join(g, [*KEY, "out"], "left").na.fill(0.0)
