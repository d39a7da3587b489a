"""What a view of a track needs: tiles in order, cached tiles, frame times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import view


def visible_tiles(views: DataFrame, size: int, columns: int = 256, channels: int = 2) -> DataFrame:
    """(view, level, tile, channel, rank): the tiles of each view (view, start_frame, per_pixel, width) with one more on either side, those nearest to its centre first."""
    spacing = F.element_at(F.array(*[F.lit(view.column_spacing(size, i)) for i in range(9)]), F.col("level") + 1)
    v = views.withColumn("level", view.tile_level(F.col("per_pixel"), size)).withColumn("span", (spacing * columns).cast("long")).withColumn("end", F.col("start_frame") + F.col("per_pixel") * F.col("width"))
    low, high = F.greatest(F.lit(0).cast("long"), F.floor(F.col("start_frame") / F.col("span")) - 1), F.floor(F.col("end") / F.col("span")) + 1
    tiles = v.select("*", F.explode(F.sequence(low, high)).alias("tile")).select("*", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    away = F.abs(F.col("tile") * F.col("span") + F.col("span") / 2 - (F.col("start_frame") + F.col("end")) / 2)
    w = Window.partitionBy("view").orderBy(away, "tile", "channel")
    return tiles.select("view", "level", "tile", "channel", F.row_number().over(w).alias("rank"))


def tile_lookup(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted (view, level, tile, channel, config) with hit: whether a tile of the same key and configuration is stored."""
    keys = ["level", "tile", "channel", "config"]
    return wanted.join(stored.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def kept_tiles(tiles: DataFrame, budget: int) -> DataFrame:
    """The tiles (owner, tile, used_at, bytes) that stay within each owner's budget of bytes, the most recently used first."""
    w = Window.partitionBy("owner").orderBy(F.col("used_at").desc(), "tile")
    return tiles.withColumn("held", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("held") <= budget)


def frame_times(times: DataFrame, last: int = 300) -> DataFrame:
    """(session, n, average, p99, most, latest) of the last so many frame times (session, at, ms) of each session."""
    w = Window.partitionBy("session").orderBy(F.col("at").desc())
    recent = times.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    g = recent.groupBy("session").agg(F.sort_array(F.collect_list("ms")).alias("ms"), F.min_by("ms", "back").alias("latest"))  # at most `last` values each
    n = F.size("ms")
    return g.select("session", n.alias("n"), (F.aggregate("ms", F.lit(0.0), lambda a, x: a + x) / n).alias("average"), F.get("ms", F.least(n - 1, F.floor(n * 0.99).cast("int"))).alias("p99"), F.array_max("ms").alias("most"), "latest")
