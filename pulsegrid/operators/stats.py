"""Level, distribution, stereo and bit-depth statistics; one pass over the samples for each group of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import INF, db, ratio
from pulsegrid.operators import islands

KEY = ["track", "channel"]


def rms_window(sample_rate: int) -> int:
    return max(1, sample_rate // 20)


def channel_stats(samples: DataFrame, sample_rate: int) -> DataFrame:
    """Per channel: n, peak and its first frame (-1 for silence), mean, rms, variance, crest, min, max, zero crossings and their rate."""
    base = samples.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
        F.avg(F.col("x") * F.col("x")).alias("mean_square"),
        F.var_pop("x").alias("variance"),
        F.avg(F.abs("x")).alias("mean_abs"),
        F.max(F.struct(F.abs("x").alias("peak"), (-F.col("frame")).alias("back"))).alias("p"),
    )
    # sign changes inside chunks, and from one chunk's last sign to the next one's first
    w = Window.partitionBy(*KEY, "_chunk").orderBy("frame")
    signs = islands.chunked(samples.where("x <> 0"), "frame").withColumn("s", F.signum("x"))
    signs = signs.withColumn("turn", (F.col("s") != F.lag("s").over(w)).cast("long"))
    parts = signs.groupBy(*KEY, "_chunk").agg(F.sum("turn").alias("turns"), F.min_by("s", "frame").alias("first"), F.max_by("s", "frame").alias("last"))
    over = F.col("first") != F.lag("last").over(Window.partitionBy(*KEY).orderBy("_chunk"))
    cross = parts.withColumn("over", over.cast("long")).groupBy(*KEY).agg((F.coalesce(F.sum("turns"), F.lit(0)) + F.coalesce(F.sum("over"), F.lit(0))).alias("zero_crossings"))
    out = base.join(cross, KEY, "left").withColumn("zero_crossings", F.coalesce("zero_crossings", F.lit(0)))
    rms, peak = F.sqrt("mean_square"), F.col("p.peak")
    return out.select(
        *KEY, "n", "min", "max", "mean", rms.alias("rms"), F.col("variance"), F.sqrt("variance").alias("std_dev"), "mean_abs",
        peak.alias("peak"), F.when(peak > 0, -F.col("p.back")).otherwise(-1).alias("peak_frame"), db(peak).alias("peak_dbfs"),
        F.when(rms > 0, 20 * F.log10(peak / rms)).otherwise(0.0).alias("crest_db"),
        "zero_crossings", (F.col("zero_crossings") * sample_rate / F.col("n")).alias("zero_crossing_rate"),
    )


def overall_stats(channels: DataFrame) -> DataFrame:
    """Per track, from channel_stats: the peak of all channels over the root of all energy."""
    g = channels.groupBy("track").agg(F.max("peak").alias("peak"), (F.sum(F.col("rms") * F.col("rms") * F.col("n")) / F.sum("n")).alias("ms"), F.max("n").alias("frames"), F.count("*").alias("channels"))
    return g.select("track", "channels", "frames", "peak", F.sqrt("ms").alias("rms"), F.when(F.col("ms") > 0, 20 * F.log10(F.col("peak") / F.sqrt("ms"))).otherwise(0.0).alias("crest_db"))


def rms_series(samples: DataFrame, sample_rate: int) -> DataFrame:
    """50 ms windows per channel; the last may be shorter and is divided by its own length."""
    size = rms_window(sample_rate)
    return samples.groupBy(*KEY, F.floor(F.col("frame") / size).alias("w")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.bool_and(F.col("x") == 0).alias("all_zero"), F.count("*").alias("n"))


def loudness_blocks(samples: DataFrame, sample_rate: int) -> DataFrame:
    """RMS and peak of blocks of 60 RMS windows."""
    size = 60 * rms_window(sample_rate)
    return samples.groupBy(*KEY, F.floor(F.col("frame") / size).alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))


def dynamic_range(samples: DataFrame, sample_rate: int) -> DataFrame:
    """Per channel, over the loudest fifth of the blocks (one at least): mean peak level less the level of their mean square."""
    blocks = loudness_blocks(samples, sample_rate)
    w = Window.partitionBy(*KEY)
    ranked = blocks.withColumn("rank", F.row_number().over(w.orderBy(F.col("rms").desc(), "block"))).withColumn("n", F.count("*").over(w))
    top = ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    return top.groupBy(*KEY).agg(F.count("*").alias("blocks"), (F.avg(db(F.col("peak"))) - db(F.sqrt(F.avg(F.col("rms") * F.col("rms"))))).alias("dr_db"))


def histogram(samples: DataFrame, buckets: int = 1024) -> DataFrame:
    """Counts per channel over [-1, 1], clamped; buckets without samples have 0."""
    b = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col("x") + 1) * (buckets / 2)))).cast("int")
    counted = samples.groupBy(*KEY, b.alias("bucket")).agg(F.count("*").alias("n"))
    every = counted.select(*KEY).distinct().select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    full = every.join(counted, [*KEY, "bucket"], "left")
    return full.select(*KEY, "bucket", F.coalesce("n", F.lit(0)).alias("n"), ((F.col("bucket") + 0.5) * (2 / buckets) - 1).alias("centre"), F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("display"))


def paired(samples: DataFrame) -> DataFrame:
    """(track, frame, l, r): both channels of a frame by conditional aggregation, no join; frames with one channel only are left out."""
    g = samples.groupBy("track", "frame").agg(F.max(F.when(F.col("channel") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("x"))).alias("r"))
    return g.where("l is not null and r is not null")


def _correlation(n: Column, l: Column, r: Column, ll: Column, rr: Column, lr: Column) -> Column:
    cov, vl, vr = lr / n - (l / n) * (r / n), ll / n - (l / n) * (l / n), rr / n - (r / n) * (r / n)
    return F.when((vl > 0) & (vr > 0), cov / F.sqrt(vl * vr)).otherwise(0.0)


def _sums() -> list[Column]:
    l, r = F.col("l"), F.col("r")
    return [F.count("*").alias("n"), F.sum(l).alias("sl"), F.sum(r).alias("sr"), F.sum(l * l).alias("sll"), F.sum(r * r).alias("srr"), F.sum(l * r).alias("slr")]


def _corr_of_sums() -> Column:
    return _correlation(*[F.col(c) for c in ("n", "sl", "sr", "sll", "srr", "slr")])


def stereo_summary(samples: DataFrame) -> DataFrame:
    """Correlation, balance (right over left, dB) and mono compatibility (dB) of channels 0 and 1."""
    s = paired(samples).groupBy("track").agg(*_sums())
    mono, both = (F.col("sll") + 2 * F.col("slr") + F.col("srr")) / 4, (F.col("sll") + F.col("srr")) / 2
    balance = F.when((F.col("sll") == 0) & (F.col("srr") == 0), 0.0).when(F.col("sll") == 0, INF).when(F.col("srr") == 0, -INF).otherwise(10 * F.log10(ratio(F.col("srr"), F.col("sll"))))
    compat = F.when(both == 0, 0.0).when(mono <= 1e-12 * both, -INF).otherwise(10 * F.log10(ratio(mono, both)))
    return s.select("track", "n", _corr_of_sums().alias("correlation"), balance.alias("balance_db"), compat.alias("mono_compatibility_db"))


def correlation_series(samples: DataFrame, sample_rate: int) -> DataFrame:
    g = paired(samples).groupBy("track", F.floor(F.col("frame") / rms_window(sample_rate)).alias("w")).agg(*_sums())
    energy = F.sqrt(F.col("sll") * F.col("srr"))
    return g.select("track", "w", F.when(energy > 0, F.col("slr") / energy).otherwise(0.0).alias("correlation"))


def mono_sum(samples: DataFrame) -> DataFrame:
    """Sum of a frame's channels over the number of the track's channels."""
    n = samples.groupBy("track").agg((F.max("channel") + 1).alias("channels"))
    return samples.groupBy("track", "frame").agg(F.sum("x").alias("s")).join(n, "track").select("track", F.lit(0).alias("channel"), "frame", (F.col("s") / F.col("channels")).alias("x"))


def mid_side(samples: DataFrame) -> DataFrame:
    """Channel 0 is (l + r) / 2, channel 1 (l - r) / 2."""
    p = paired(samples)
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    return p.select("track", "frame", F.posexplode(F.array(mid, side)).alias("channel", "x")).select("track", "channel", "frame", "x")


def bit_depth(samples: DataFrame, container: int) -> DataFrame:
    """Effective depth of integer samples, toggle rate of the last bit and how likely that is dither."""
    v = F.round(F.col("x") * float(2 ** (container - 1))).cast("long")
    w = Window.partitionBy(*KEY, "_chunk").orderBy("frame")
    ints = islands.chunked(samples.withColumn("v", v), "frame", before=1)
    ints = ints.withColumn("toggle", (F.col("v").bitwiseAND(1) != F.lag(F.col("v").bitwiseAND(1)).over(w)).cast("double")).where("_own")
    g = ints.groupBy(*KEY).agg(F.bit_or("v").alias("bits"), F.avg("toggle").alias("toggle_rate"))
    zeros = F.bit_count(F.col("bits").bitwiseAND(-F.col("bits")) - 1)
    depth = F.when(F.col("bits") == 0, container).otherwise(container - zeros)
    distance = F.abs(F.col("toggle_rate") - 0.5) * 2
    likely = (depth == container) & (F.col("bits") != 0) & (distance < 0.3)
    return g.select(*KEY, depth.cast("int").alias("effective_bits"), "toggle_rate", F.coalesce(likely, F.lit(False)).alias("dither_likely"), F.when(likely, 1 - distance / 0.3).otherwise(0.0).alias("dither_confidence"))


def float_grid(samples: DataFrame) -> DataFrame:
    """The first of 8, 16, 20, 24 bits on whose grid all float samples lie within a hundredth of a step."""
    errors = [F.max(F.abs(F.col("x") - F.round(F.col("x") * 2.0 ** (d - 1)) / 2.0 ** (d - 1))).alias(f"e{d}") for d in (8, 16, 20, 24)]
    first = F.coalesce(*[F.when(F.col(f"e{d}") < 0.01 / 2.0 ** (d - 1), d) for d in (8, 16, 20, 24)])
    g = samples.groupBy(*KEY).agg(*errors).select(*KEY, first.cast("int").alias("grid_bits"))
    return g.withColumn("description", F.when(F.col("grid_bits").isNull(), "full float precision").otherwise(F.format_string("%d-bit values in float", "grid_bits")))
