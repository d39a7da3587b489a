"""Statistics that are kept as partial states and merged with later ones, without reading the samples again.

A state is one row for each stretch of a channel: counts, sums, the centred squares, extremes, the
first peak, sign changes with the signs at both ends, and a sparse histogram.  States of disjoint
stretches merge in any grouping; merged states are states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import db

KEY = ["track", "channel"]


def states(samples: DataFrame, stretch: int = 65_536, buckets: int = 1024) -> DataFrame:
    """The state of each stretch of `stretch` frames.  Null samples are left out; a stretch without samples has no row."""
    part = [*KEY, "part"]
    x = samples.where("x is not null").withColumn("part", F.floor(F.col("frame") / stretch))
    w = Window.partitionBy(*part).orderBy("frame")
    signs = x.where("x <> 0").withColumn("s", F.signum("x").cast("int")).withColumn("turn", (F.col("s") != F.lag("s").over(w)).cast("long"))
    signs = signs.groupBy(*part).agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"), F.min_by("s", "frame").alias("first_sign"), F.max_by("s", "frame").alias("last_sign"))
    b = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col("x") + 1) * (buckets / 2)))).cast("int")
    counts = x.groupBy(*part, b.alias("bucket")).agg(F.count("*").alias("n")).groupBy(*part).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("histogram"))
    base = x.groupBy(*part).agg(
        F.min("frame").alias("begin"), F.max("frame").alias("end"), F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("squares"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.sum(F.abs("x")).alias("magnitude"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.max(F.struct(F.abs("x").alias("level"), (-F.col("frame")).alias("back"))).alias("peak"),
    )
    out = base.join(signs, part, "left").join(counts, part).withColumn("turns", F.coalesce("turns", F.lit(0)))
    return out.drop("part")


def merged(parts: DataFrame) -> DataFrame:
    """One state for each channel, from the states of disjoint stretches."""
    ordered, whole = Window.partitionBy(*KEY).orderBy("begin"), Window.partitionBy(*KEY)
    # the sign before a stretch is the last one of any stretch before it: silent ones have none
    before = F.last("last_sign", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("over", F.coalesce((F.col("first_sign") != before).cast("long"), F.lit(0)))
    rows = rows.withColumn("all_mean", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    out = rows.groupBy(*KEY).agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n").alias("n"), F.first("all_mean").alias("mean"), F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))).alias("squares"),
        F.sum("energy").alias("energy"), F.sum("magnitude").alias("magnitude"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("peak").alias("peak"),
        F.sum(F.col("turns") + F.col("over")).alias("turns"), F.min_by("first_sign", F.when(F.col("first_sign").isNotNull(), F.col("begin"))).alias("first_sign"), F.max_by("last_sign", F.when(F.col("last_sign").isNotNull(), F.col("begin"))).alias("last_sign"),
    )
    counts = parts.select(*KEY, F.explode("histogram").alias("bucket", "k")).groupBy(*KEY, "bucket").agg(F.sum("k").alias("k")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "k"))).alias("histogram"))
    return out.join(counts, KEY)


def figures(state: DataFrame, sample_rate: int) -> DataFrame:
    """The columns of stats.channel_stats from merged states."""
    rms, variance, peak = F.sqrt(F.col("energy") / F.col("n")), F.col("squares") / F.col("n"), F.col("peak.level")
    return state.select(
        *KEY, "n", "min", "max", "mean", rms.alias("rms"), variance.alias("variance"), F.sqrt(variance).alias("std_dev"), (F.col("magnitude") / F.col("n")).alias("mean_abs"),
        peak.alias("peak"), F.when(peak > 0, -F.col("peak.back")).otherwise(-1).alias("peak_frame"), db(peak).alias("peak_dbfs"), F.when(rms > 0, 20 * F.log10(peak / rms)).otherwise(0.0).alias("crest_db"),
        F.col("turns").alias("zero_crossings"), (F.col("turns") * sample_rate / F.col("n")).alias("zero_crossing_rate"),
    )
