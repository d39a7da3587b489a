"""DC offset: means, windows, headroom, pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import INF, db
from pulsegrid.model import DcConfig

KEY = ["track", "channel"]


def series(samples: DataFrame, sample_rate: int) -> DataFrame:
    return samples.groupBy(*KEY, F.floor(F.col("frame") / sample_rate).alias("w")).agg(F.avg("x").alias("mean"))


def channels(samples: DataFrame, sample_rate: int) -> DataFrame:
    one = samples.groupBy(*KEY).agg(F.avg("x").alias("dc"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    win = series(samples, sample_rate).groupBy(*KEY).agg(F.min("mean").alias("min_window"), F.max("mean").alias("max_window"))
    size = F.abs("dc")
    headroom = F.when(size >= 1, INF).otherwise(20 * F.log10(F.try_divide(F.lit(1.0), 1 - size)))
    out = one.join(win, KEY)
    return out.select(*KEY, "dc", db(size).alias("dc_dbfs"), (F.col("dc") * 100).alias("percent"), "min_window", "max_window", headroom.alias("headroom_db"), F.greatest(F.col("hi") - F.col("dc"), F.col("dc") - F.col("lo")).alias("corrected_peak"))


def patterns(samples: DataFrame, sample_rate: int, cfg: DcConfig) -> DataFrame:
    """Per channel, from the one-second means: none (no mean reaches the threshold), sectional, drifting or constant.

    Sectional: some step between neighbours stands out from the median step by three scaled
    median deviations (half the threshold at least) and reaches the threshold; step_frames are
    where those steps are.  Drifting: the means follow their index (|r| >= 0.8) over a range of
    the threshold or more.  Medians are the upper ones.
    """
    limit = 10 ** (cfg.threshold_db / 20)
    s = series(samples, sample_rate)
    w = Window.partitionBy(*KEY).orderBy("w")
    steps = s.withColumn("step", F.abs(F.col("mean") - F.lag("mean").over(w)))
    upper = lambda a: F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int"))
    g = steps.groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("step").isNotNull(), F.struct("w", "step"))).alias("steps"),
        F.bool_or(F.abs("mean") >= limit).alias("significant"),
        (F.max("mean") - F.min("mean")).alias("spread"),
        F.coalesce(F.corr(F.col("w").cast("double"), F.col("mean")), F.lit(0.0)).alias("r"),
    )
    g = g.withColumn("med", upper(F.col("steps.step")))
    g = g.withColumn("mad", upper(F.transform("steps.step", lambda x: F.abs(x - F.col("med")))))
    bar = F.col("med") + F.greatest(3 * 1.4826 * F.col("mad"), F.lit(limit / 2))
    out = F.sort_array(F.transform(F.filter("steps", lambda x: (x["step"] > bar) & (x["step"] >= limit)), lambda x: x["w"] * sample_rate))
    g = g.withColumn("step_frames", F.when(F.col("significant"), out).otherwise(F.expr("cast(array() as array<bigint>)")))
    kind = F.when(~F.col("significant"), "none").when(F.size("step_frames") > 0, "sectional").when((F.abs("r") >= 0.8) & (F.col("spread") >= limit), "drifting").otherwise("constant")
    return g.select(*KEY, kind.alias("pattern"), "step_frames")
