"""Silence: threshold with hysteresis, digital, and perceptual; regions, summary, boundary refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import db, from_db
from pulsegrid.model import SilenceConfig
from pulsegrid.operators import islands


def _combined(states: DataFrame, mode: str) -> DataFrame:
    """(track, w, quiet, mask): channels combined per window; mask has a bit for each quiet channel."""
    both = F.bool_and("quiet") if mode == "all" else F.bool_or("quiet")
    mask = F.bit_or(F.when(F.col("quiet"), F.expr("shiftleft(1, channel)")).otherwise(0))
    return states.groupBy("track", "w").agg(both.alias("quiet"), mask.alias("mask"))


def regions(windows: DataFrame, frames: DataFrame, cfg: SilenceConfig, window_s: float, sample_rate: int) -> DataFrame:
    """Runs of quiet windows, merged over short gaps, dropped if too short, with frames and position.

    frames: (track, frame_count).
    """
    found = islands.runs(windows, ["track"], "w", F.col("quiet"), repeats=False, mask=(F.bit_or, F.col("mask")))
    merged = islands.merge_runs(found, ["track"], cfg.merge_ms / 1000 / window_s, inclusive=False, mask=F.bit_or("mask"))
    kept = merged.where((F.col("end") - F.col("begin")) * window_s * 1000 >= cfg.min_ms)
    size = round(window_s * sample_rate)
    last = windows.groupBy("track").agg((F.max("w") + 1).alias("windows"))
    out = kept.join(last, "track").join(frames, "track")
    lead, trail = F.col("begin") == 0, F.col("end") >= F.col("windows")
    return out.select(
        "track", F.col("begin").alias("w_begin"), F.col("end").alias("w_end"), "mask",
        (F.col("begin") * size).alias("frame_begin"),
        F.when(trail, F.col("frame_count")).otherwise(F.least(F.col("end") * size, F.col("frame_count"))).alias("frame_end"),
        F.when(lead & trail, "entire").when(lead, "leading").when(trail, "trailing").otherwise("internal").alias("position"),
    )


def by_threshold(series: DataFrame, cfg: SilenceConfig) -> DataFrame:
    """Windows of an RMS series by level, with hysteresis per channel."""
    level = db(F.col("rms"))
    return _combined(islands.hysteresis(series, ["track", "channel"], "w", level, cfg.threshold_db, cfg.threshold_db + cfg.hysteresis_db), cfg.mode)


def digital(series: DataFrame, cfg: SilenceConfig) -> DataFrame:
    return _combined(series.withColumn("quiet", F.col("all_zero")), cfg.mode)


def perceptual(momentary: DataFrame, cfg: SilenceConfig) -> DataFrame:
    """Windows of one momentary loudness series; no loudness at all is quiet."""
    level = F.when(F.col("lufs").isNull() | F.isnan("lufs"), float("-inf")).otherwise(F.col("lufs"))
    return islands.hysteresis(momentary, ["track"], "w", level, cfg.threshold_db, cfg.threshold_db + cfg.hysteresis_db).select("track", "w", "quiet", F.lit(1).alias("mask"))


def levels(found: DataFrame, series: DataFrame) -> DataFrame:
    """Regions with the mean (over channels) and largest window RMS inside, in dB."""
    mean = series.groupBy("track", "w").agg(F.avg("rms").alias("rms"))
    inside = found.select("track", "w_begin", F.explode(F.sequence(F.col("w_begin"), F.col("w_end") - 1)).alias("w")).join(mean, ["track", "w"])
    g = inside.groupBy("track", "w_begin").agg(db(F.avg("rms")).alias("mean_db"), db(F.max("rms")).alias("max_db"))
    return found.join(g, ["track", "w_begin"], "left")


def summary(found: DataFrame, frames: DataFrame, sample_rate: int) -> DataFrame:
    """Seconds of leading, trailing and total silence, and its fraction of the track."""
    length = (F.col("frame_end") - F.col("frame_begin")) / sample_rate
    at = lambda *names: F.max(F.when(F.col("position").isin(*names), length))
    g = found.groupBy("track").agg(at("leading", "entire").alias("leading_s"), at("trailing", "entire").alias("trailing_s"), F.sum(length).alias("total_s"), F.count("*").alias("regions"))
    out = frames.join(g, "track", "left").na.fill(0.0, ["leading_s", "trailing_s", "total_s"]).na.fill(0, ["regions"])
    return out.select("track", "regions", "leading_s", "trailing_s", "total_s", F.least(F.lit(1.0), F.try_divide(F.col("total_s"), F.col("frame_count") / sample_rate)).alias("fraction"))


def frame_silent(samples: DataFrame, threshold: Column | float, mode: str = "all") -> DataFrame:
    quiet = F.abs("x") <= threshold
    return samples.groupBy("track", "frame").agg((F.bool_and(quiet) if mode == "all" else F.bool_or(quiet)).alias("silent"))


def refine(found: DataFrame, samples: DataFrame, cfg: SilenceConfig, window: int) -> DataFrame:
    """Frame-exact bounds: one window either side of a coarse edge, begin after the last loud frame, end at the first.

    Regions are few, so they carry their edge windows as keys of an equi-join against the samples' windows.
    """
    loud = ~frame_silent_column(samples, cfg)
    edges = found.select("track", "w_begin", "frame_begin", "frame_end", F.explode(F.array(F.struct(F.lit("begin").alias("side"), F.col("frame_begin").alias("at")), F.struct(F.lit("end").alias("side"), F.col("frame_end").alias("at")))).alias("edge"))
    near = edges.select("*", F.explode(F.sequence(F.floor((F.col("edge.at") - window) / window), F.floor((F.col("edge.at") + window) / window))).alias("bucket"))
    frames = samples.groupBy("track", "frame").agg(F.max(F.when(loud, 1).otherwise(0)).alias("loud")) if cfg.mode == "all" else samples.groupBy("track", "frame").agg(F.min(F.when(loud, 1).otherwise(0)).alias("loud"))
    hit = near.join(frames.where("loud = 1").withColumn("bucket", F.floor(F.col("frame") / window)), ["track", "bucket"])
    hit = hit.where(F.abs(F.col("frame") - F.col("edge.at")) <= window)
    middle = (F.col("frame_begin") + F.col("frame_end")) / 2
    g = hit.groupBy("track", "w_begin").agg(
        F.max(F.when((F.col("edge.side") == "begin") & (F.col("frame") < middle), F.col("frame") + 1)).alias("b"),
        F.min(F.when((F.col("edge.side") == "end") & (F.col("frame") >= middle), F.col("frame"))).alias("e"),
    )
    out = found.join(g, ["track", "w_begin"], "left")
    return out.select("track", "w_begin", "w_end", F.coalesce("b", "frame_begin").alias("frame_begin"), F.coalesce("e", "frame_end").alias("frame_end"), "position")


def frame_silent_column(samples: DataFrame, cfg: SilenceConfig) -> Column:
    return F.abs(samples["x"]) <= from_db(cfg.threshold_db)


def nearest_zero_crossing(samples: DataFrame, targets: DataFrame, reach: int) -> DataFrame:
    """(track, channel, target, crossing): the sign change nearest to each target frame, the left one of two equally near."""
    chunk = max(islands.CHUNK, reach)
    w = Window.partitionBy("track", "channel", "_chunk").orderBy("frame")
    ahead = islands.chunked(samples, "frame", after=1, chunk=chunk)
    turns = ahead.withColumn("turn", (F.col("x") >= 0) != (F.lead("x").over(w) >= 0)).where("turn and _own").select("track", "channel", "frame")
    turns = islands.chunked(turns, "frame", before=reach, after=reach, chunk=chunk).select("track", "channel", "_chunk", "frame", F.col("frame").alias("turn"), F.lit(False).alias("asked"))
    asked = targets.select("track", "channel", F.col("target").alias("frame")).distinct()
    asked = islands.chunked(asked, "frame", chunk=chunk).select("track", "channel", "_chunk", "frame", F.lit(None).cast("long").alias("turn"), F.lit(True).alias("asked"))
    # one pass in each direction: rows grow with the targets, not with the crossings within their reach
    side = Window.partitionBy("track", "channel", "_chunk").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.unionByName(asked).withColumn("left", F.max("turn").over(side.orderBy("frame"))).withColumn("right", F.min("turn").over(side.orderBy(F.col("frame").desc())))
    to_left, to_right = F.col("frame") - F.col("left"), F.col("right") - F.col("frame")
    best = F.when(F.col("left").isNull() | (to_right < to_left), F.col("right")).otherwise(F.col("left"))
    near = rows.where("asked").select("track", "channel", F.col("frame").alias("target"), best.alias("crossing"))
    return near.where(F.abs(F.col("crossing") - F.col("target")) <= reach)
