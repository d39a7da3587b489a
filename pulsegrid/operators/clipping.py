"""Clipping: runs at the ceiling, near-clip runs, density, limiting heuristics, worst events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import ceiling_linear, db
from pulsegrid.model import ClippingConfig
from pulsegrid.operators import islands

KEY = ["track", "channel"]
# The kinds of events in the order of the reports' counts
KINDS = ("digital", "over_full_scale", "near_clip", "inter_sample_peak")


def limits(cfg: ClippingConfig) -> tuple[float, float]:
    """(ceiling threshold, near threshold), linear; the flatness tolerance lowers the ceiling."""
    ceiling = ceiling_linear(cfg.bit_depth)
    return max(0.0, ceiling - ceiling * (1 - 10 ** (-cfg.flatness_db / 20))), 10 ** (cfg.near_db / 20)


def clip_runs(samples: DataFrame, threshold: float, min_run: int, merge_gap: int) -> DataFrame:
    """(track, channel, begin, end, sample_count, peak): runs at or above the threshold, merged, then dropped if short.

    A merged run counts its gaps.
    """
    found = islands.runs(samples, KEY, "frame", F.abs("x") >= threshold, peak=(F.max, F.abs("x")))
    merged = islands.merge_runs(found, KEY, merge_gap, inclusive=True, peak=F.max("peak"))
    return merged.where(F.col("n") >= min_run).select(*KEY, "begin", "end", F.col("n").alias("sample_count"), "peak")


def events(samples: DataFrame, cfg: ClippingConfig) -> DataFrame:
    """Hard (over full scale for floats above 1, else digital) and near-clip events."""
    hard, near = limits(cfg)
    h = clip_runs(samples, hard, cfg.min_run, cfg.merge_gap).withColumn("kind", F.when(F.col("peak") > 1.0, "over_full_scale").otherwise("digital"))
    n = clip_runs(samples, near, cfg.near_run, cfg.merge_gap).withColumn("kind", F.lit("near_clip"))
    return h.unionByName(n).withColumn("peak_dbfs", db(F.col("peak")))


def totals(found: DataFrame, samples: DataFrame) -> DataFrame:
    """Per track: events per kind, hard-clipped samples and their share, largest overshoot (0 at least)."""
    hard = F.col("kind").isin("digital", "over_full_scale")
    g = found.groupBy("track").agg(
        F.count(F.when(F.col("kind") == "digital", 1)).alias("n_digital"),
        F.count(F.when(F.col("kind") == "over_full_scale", 1)).alias("n_over"),
        F.count(F.when(F.col("kind") == "near_clip", 1)).alias("n_near"),
        F.coalesce(F.sum(F.when(hard, F.col("sample_count"))), F.lit(0)).alias("clipped_samples"),
        F.greatest(F.lit(0.0), F.max("peak_dbfs")).alias("max_overshoot_db"),
    )
    n = samples.groupBy("track").agg(F.count("*").alias("samples"))
    out = n.join(g, "track", "left").na.fill(0, ["n_digital", "n_over", "n_near", "clipped_samples"]).na.fill(0.0, ["max_overshoot_db"])
    return out.withColumn("clipped_fraction", F.col("clipped_samples") / F.col("samples")).drop("samples")


def density(samples: DataFrame, cfg: ClippingConfig, frames: int = 256) -> DataFrame:
    """Share of samples at the ceiling per bin, all channels, dense up to the last bin that has any."""
    hard, _ = limits(cfg)
    channels = samples.groupBy("track").agg(F.countDistinct("channel").alias("channels"))
    hits = samples.where(F.abs("x") >= hard).groupBy("track", F.floor(F.col("frame") / frames).alias("bin")).agg(F.count("*").alias("n"))
    every = hits.groupBy("track").agg(F.max("bin").alias("last")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    full = every.join(hits, ["track", "bin"], "left").join(channels, "track")
    return full.select("track", "bin", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / (frames * F.col("channels"))).alias("density"))


def flat_top(samples: DataFrame) -> DataFrame:
    """Per channel: share of the non-silent samples (-60 dB up, steps of 0.1 dB) within 0.5 dB of the peak."""
    level = F.floor((db(F.col("x")) + 60) * 10 + 0.5)
    b = samples.withColumn("x", F.abs("x")).where("x > 0").withColumn("b", F.greatest(F.lit(0), F.least(F.lit(600), level))).groupBy(*KEY, "b").agg(F.count("*").alias("n"))
    peak = b.groupBy(*KEY).agg(F.max("b").alias("top"), F.sum("n").alias("total"))
    g = b.join(peak, KEY).groupBy(*KEY).agg((F.sum(F.when(F.col("b") >= F.col("top") - 5, F.col("n")).otherwise(0)) / F.max("total")).alias("flat_top_ratio"))
    return g.withColumn("heavy_limiting", F.col("flat_top_ratio") >= 0.3)


def plateaus(samples: DataFrame) -> DataFrame:
    """Per channel: number and mean length of runs of two or more equal samples."""
    w = Window.partitionBy(*KEY, "_chunk").orderBy("frame")
    same = islands.chunked(samples, "frame", before=1).withColumn("same", F.col("x") == F.lag("x").over(w)).where("_own")
    # a run of n samples that equal the one before is a plateau of n + 1
    runs = islands.runs(same.drop("_chunk", "_own"), KEY, "frame", F.col("same")).withColumn("n", F.col("n") + 1)
    every = samples.select(*KEY).distinct()
    g = runs.groupBy(*KEY).agg(F.count("*").alias("plateaus"), F.avg("n").alias("mean_length"))
    return every.join(g, KEY, "left").na.fill(0, ["plateaus"]).na.fill(0.0, ["mean_length"])


def worst(found: DataFrame, n: int = ClippingConfig().max_events) -> DataFrame:
    """The n events with the highest peak, first by frame, channel and kind among equals.  Counts come from totals(), over all events."""
    return found.orderBy(F.col("peak_dbfs").desc(), "begin", "channel", "kind").limit(n)


def worst_of_each(found: DataFrame, n: int) -> DataFrame:
    """The n events of each track with the highest peak, as worst() has them."""
    w = Window.partitionBy("track").orderBy(F.col("peak_dbfs").desc(), "begin", "channel", "kind")
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def with_inter_sample_peaks(found: DataFrame, peaks: DataFrame) -> DataFrame:
    """events() and the inter-sample peaks (track, channel, frame, peak) as further events of one sample each."""
    more = peaks.select(*KEY, F.col("frame").alias("begin"), (F.col("frame") + 1).alias("end"), F.lit(1).cast("long").alias("sample_count"), "peak", F.lit("inter_sample_peak").alias("kind"), db(F.col("peak")).alias("peak_dbfs"))
    return found.unionByName(more)
