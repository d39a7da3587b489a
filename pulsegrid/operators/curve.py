"""The curve between samples, for views in which a sample is wider than a pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import islands

#: Pixels of a task of between(), so that its memory doesn't grow with the table.
TASK = 1 << 20


def point_samples(bins: DataFrame, part: list[str]) -> DataFrame:
    """(part, at, value): runs of pixels with one value, each as a point at its middle, from bins (part, pixel, min, max).

    A sample that covers several pixels gives them all its value.  The value is a key of the runs,
    so they are found chunk by chunk like all others; bins without a value part runs.
    """
    valued = bins.withColumn("value", (F.col("min") + F.col("max")) / 2)
    found = islands.runs(valued.where("value is not null and not isnan(value)"), [*part, "value"], "pixel", F.lit(True), repeats=False)
    return found.select(*part, ((F.col("begin") + F.col("end") - 1) / 2).alias("at"), "value")


def between(points: DataFrame, pixels: DataFrame, part: list[str], pixels_per_frame: float, taps: int = 4) -> DataFrame:
    """(part, pixel, value): band-limited values at each row of pixels (part, pixel), from points `pixels_per_frame` apart; 0 where no point is near.

    Pixels and the points within `taps` frames of them meet by blocks of pixels, each worked out
    alone: no point is multiplied by the pixels that it reaches before a task has its block.
    A point weighs sinc(x) sinc(x / taps): 1 at its own place, 0 at every other whole number and beyond `taps`.
    """
    if pixels_per_frame <= 0:
        return pixels.select(*part, "pixel", F.lit(0.0).alias("value"))
    reach = taps * pixels_per_frame
    size = max(islands.CHUNK // 4, int(4 * reach))
    block = lambda c: F.floor(c / size)
    rows = points.where("at is not null and value is not null")
    rows = rows.select(*part, F.explode(F.sequence(block(F.col("at") - reach), block(F.col("at") + reach))).alias("_block"), F.col("at").cast("double").alias("at"), "value", F.lit(None).cast("long").alias("pixel"))
    pixel = F.col("pixel").cast("long")
    rows = rows.unionByName(pixels.select(*part, block(pixel).alias("_block"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("value"), pixel.alias("pixel")))

    def curve(df):
        asked = np.unique(df["pixel"].dropna().to_numpy(np.int64))
        near = df[df["at"].notna()].sort_values("at")
        at, value = near["at"].to_numpy(float), near["value"].to_numpy(float)
        lo, hi = np.searchsorted(asked, at - reach, "left"), np.searchsorted(asked, at + reach, "right")
        n = hi - lo
        of = np.repeat(np.arange(len(at)), n)
        to = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
        x = (asked[to] - at[of]) / pixels_per_frame
        weight = np.where(np.abs(x) >= taps, 0.0, np.sinc(x) * np.sinc(x / taps))
        out = np.bincount(to, value[of] * weight, len(asked))
        return df[part].iloc[np.zeros(len(asked), int)].assign(pixel=asked, value=out)

    keys = ", ".join(f"{p} {k}" for p, k in pixels.select(*part).dtypes)
    tasks = max(8, -(-pixels.count() // TASK))
    return rows.repartition(tasks, *part, "_block").groupBy(*part, "_block").applyInPandas(curve, f"{keys}, pixel long, value double")
