"""Signals as DataFrames: (track, channel, frame, x), from chunks, tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_chunks(chunks: DataFrame) -> DataFrame:
    """One row per sample; a range of frames prunes chunks before they are exploded."""
    return chunks.select("track", "channel", "start_frame", F.posexplode("samples").alias("i", "v")).select("track", "channel", (F.col("start_frame") + F.col("i")).alias("frame"), F.col("v").cast("double").alias("x"))


def to_chunks(samples: DataFrame, frames: int = 65_536) -> DataFrame:
    rows = samples.withColumn("chunk_idx", F.floor(F.col("frame") / frames).cast("int"))
    packed = rows.groupBy("track", "channel", "chunk_idx").agg(F.min("frame").alias("start_frame"), F.sort_array(F.collect_list(F.struct("frame", F.col("x").cast("float").alias("x")))).alias("s"))
    return packed.select("track", "channel", "chunk_idx", "start_frame", F.col("s.x").alias("samples"))


def read_range(chunks: DataFrame, begin: int, end: int, frames: int = 65_536) -> DataFrame:
    """Samples of [begin, end): the chunk bounds reach the scan, the frame bounds cut what is left."""
    near = chunks.where((F.col("start_frame") > begin - frames) & (F.col("start_frame") < end))
    return from_chunks(near).where((F.col("frame") >= begin) & (F.col("frame") < end))


def events_stereo(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stereo signal: even ids are channel 0, odd ids channel 1."""
    e = read(spark, folder, "events")
    return e.select(F.lit("events").alias("track"), (F.col("event_id") % 2).cast("int").alias("channel"), F.floor(F.col("event_id") / 2).alias("frame"), (F.col("value") / 150.0 - 1.0).alias("x"))


def events_16bit(spark: SparkSession, folder: str) -> DataFrame:
    """events_stereo on the grid of 16-bit samples."""
    return events_stereo(spark, folder).withColumn("x", F.least(F.lit(32767 / 32768), F.greatest(F.lit(-1.0), F.round(F.col("x") * 32768) / 32768)))


def line_mono(spark: SparkSession, folder: str) -> DataFrame:
    """The line items as a mono signal, one track per month of shipping, ordered by all columns."""
    from pyspark.sql import Window

    li = read(spark, folder, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    w = Window.partitionBy(month).orderBy(*li.columns)
    return li.select(month.alias("track"), F.lit(0).alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.col("l_extendedprice") / 52500.0 - 1.0).alias("x"))


def embedding_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as a track of as many frames as it has components."""
    e = read(spark, folder, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("track"), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "v")).select("track", "t", F.lit(0).alias("channel"), F.col("i").cast("long").alias("frame"), F.col("v").cast("double").alias("x"))


def markers(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as timeline markers: a region where the user id is even, else a point."""
    e = read(spark, folder, "events")
    end = F.when(F.col("user_id") % 2 == 0, F.col("event_id") * 10 + F.col("user_id") % 500)
    return e.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") * 10).alias("start_frame"), end.alias("end_frame"), (F.col("event_id") % 2).cast("int").alias("channel"), F.floor(F.col("value") / 50).cast("double").alias("severity"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("label"), F.col("props").alias("data"), (F.col("event_id") % 7 == 0).alias("user_created"))


def events_gated(spark: SparkSession, folder: str) -> DataFrame:
    """events_stereo with quiet and silent stretches: of every five blocks of 400 frames two are faint and one is zero."""
    block = F.floor(F.col("frame") / 400) % 5
    return events_stereo(spark, folder).withColumn("x", F.when(block < 2, F.col("x") / 2000).when(block == 2, 0.0).otherwise(F.col("x")))
