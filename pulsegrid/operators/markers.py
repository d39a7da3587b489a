"""Timeline markers: projections, visible slices, navigation, hit tests, pixel aggregation, edits, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import islands

# Kind, lane, priority, whether it is dense, whether it shows at first
KINDS = (
    ("click", 0, 5, True, True),
    ("view", 1, 1, True, True),
    ("purchase", 2, 4, False, True),
    ("signup", 3, 3, False, True),
    ("error", 4, 9, False, True),
)


# The overlay kinds with their density, lane, priority, and whether they show at first
OVERLAYS = (
    ("error", "always", "errors", 40, True),
    ("decoderEvent", "always", "errors", 39, True),
    ("defect", "aggregate", "transients", 30, True),
    ("bookmark", "always", "chapters", 20, True),
    ("loopRegion", "region", "waveform", 19, True),
    ("selection", "region", "waveform", 18, True),
    ("chapter", "region", "chapters", 15, True),
    ("cuePoint", "always", "chapters", 15, True),
    ("lyric", "thin", "lyrics", 14, True),
    ("downbeat", "thin", "beats", 13, True),
    ("beat", "thin", "beats", 12, True),
    ("onset", "aggregate", "transients", 12, False),
    ("transient", "aggregate", "transients", 11, True),
    ("clipping", "aggregate", "waveform", 10, True),
    ("silence", "region", "waveform", 9, True),
    ("dcRegion", "region", "waveform", 9, False),
)


def overlays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERLAYS, "kind string, density string, lane string, priority int, visible boolean")


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind string, lane int, priority int, dense boolean, visible boolean")


def with_kind(markers: DataFrame) -> DataFrame:
    """Markers with their kind's display columns; the registry has a handful of rows and is broadcast."""
    return markers.join(F.broadcast(kinds(markers.sparkSession)), "kind", "left")


def from_regions(regions: DataFrame, kind: str, severity: Column, label: Column) -> DataFrame:
    """Marker rows of analysis results (track, frame_begin, frame_end)."""
    w = Window.partitionBy("track").orderBy("frame_begin")
    return regions.select(
        F.format_string(f"{kind}-%s-%d", "track", F.row_number().over(w) - 1).alias("id"), F.lit(kind).alias("kind"), F.col("frame_begin").alias("start_frame"), F.col("frame_end").alias("end_frame"),
        F.lit(None).cast("int").alias("channel"), severity.cast("double").alias("severity"), label.alias("label"), F.lit(None).cast("string").alias("data"), F.lit(False).alias("user_created"),
    )


def visible(markers: DataFrame, begin: int, end: int, shown: list[str] | None = None) -> DataFrame:
    """Markers that overlap [begin, end], both ends inclusive."""
    out = markers.where((F.col("start_frame") <= end) & (F.coalesce("end_frame", "start_frame") >= begin))
    return out.where(F.col("kind").isin(shown)) if shown is not None else out


def neighbours(markers: DataFrame, at: int) -> DataFrame:
    """Per kind, the next marker after a frame and the last before it; the ends wrap around."""
    s = F.col("start_frame")
    return markers.groupBy("kind").agg(F.coalesce(F.min(F.when(s > at, s)), F.min(s)).alias("next"), F.coalesce(F.max(F.when(s < at, s)), F.max(s)).alias("previous"))


def hit(markers: DataFrame, at: int, tolerance: int) -> DataFrame:
    """The marker under a frame: by lane, distance, then priority."""
    end = F.coalesce("end_frame", "start_frame")
    distance = F.greatest(F.lit(0).cast("long"), F.col("start_frame") - at, at - end)
    near = with_kind(markers).withColumn("distance", distance).where(F.col("distance") <= tolerance)
    return near.orderBy("lane", "distance", F.col("priority").desc(), "start_frame", "id").limit(1).select("id", "kind", "distance")


def per_pixel(markers: DataFrame, frames_per_pixel: float) -> DataFrame:
    """(kind, px, n, id): markers of a pixel, represented by the most severe (the first of equals)."""
    px = F.floor(F.col("start_frame") / frames_per_pixel)
    best = F.max(F.struct(F.coalesce("severity", F.lit(float("-inf"))).alias("s"), (-F.col("start_frame")).alias("o"), F.col("id").alias("id")))
    return markers.groupBy("kind", px.alias("px")).agg(F.count("*").alias("n"), best.alias("b")).select("kind", "px", "n", F.col("b.id").alias("id"))


def pixel_spans(markers: DataFrame, frames_per_pixel: float, tolerance: float = 1.0) -> DataFrame:
    """(kind, begin, end, n): regions in pixels, joined where they come within the tolerance of all before them."""
    r = markers.where("end_frame is not null").select("kind", (F.col("start_frame") / frames_per_pixel).alias("b"), (F.col("end_frame") / frames_per_pixel).alias("e"), "id")
    w = Window.partitionBy("kind").orderBy("b", "e", "id")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = r.withColumn("new", F.when(before.isNull() | (F.col("b") > before + tolerance), 1).otherwise(0)).withColumn("g", F.sum("new").over(w))
    return g.groupBy("kind", "g").agg(F.min("b").alias("begin"), F.max("e").alias("end"), F.count("*").alias("n")).drop("g")


def curve_pixels(series: DataFrame, frames_per_value: int, frames_per_pixel: int, pixels: int) -> DataFrame:
    """(track, channel, px, min, max): envelope of the values each pixel touches."""
    lo = F.expr(f"(px * {frames_per_pixel}) div {frames_per_value}")
    hi = F.expr(f"((px + 1) * {frames_per_pixel} + {frames_per_value} - 1) div {frames_per_value}")
    px = series.sparkSession.range(pixels).select(F.col("id").alias("px")).withColumn("w", F.explode(F.sequence(lo, F.greatest(lo, hi - 1))))
    return series.join(px, "w").groupBy("track", "channel", "px").agg(F.min("v").alias("min"), F.max("v").alias("max"))


def replaced(markers: DataFrame, kind: str, new: DataFrame) -> DataFrame:
    """New analysis markers of a kind in place of the old ones; the user's own stay."""
    return markers.where((F.col("kind") != kind) | F.col("user_created")).unionByName(new.where("not user_created"))


def by_kind(markers: DataFrame) -> DataFrame:
    """Findings per kind, the most important kind first."""
    g = with_kind(markers).groupBy("kind", "priority").agg(F.count("*").alias("n"), F.min("start_frame").alias("first"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("priority").desc(), "kind")))


def csv_lines(markers: DataFrame) -> DataFrame:
    """(start_frame, id, line): RFC 4180 lines of eight columns."""
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cols = [quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("id", "kind", "start_frame", "end_frame", "channel", "severity", "label", "user_created")]
    return markers.select("start_frame", "id", F.concat_ws(",", *cols).alias("line"))


def audacity_lines(markers: DataFrame, sample_rate: int) -> DataFrame:
    """(start_frame, id, line): label-track lines; a point repeats its start."""
    at = lambda c: F.format_string("%.6f", c / F.lit(float(sample_rate)))
    label = F.regexp_replace(F.coalesce("label", "kind"), "[\t\r\n]", " ")
    return markers.select("start_frame", "id", F.concat_ws("\t", at(F.col("start_frame")), at(F.coalesce("end_frame", "start_frame")), label).alias("line"))


def as_json(markers: DataFrame) -> DataFrame:
    return markers.select("id", F.to_json(F.struct("id", "kind", "start_frame", "end_frame", "channel", "severity", "label", "user_created")).alias("json"))


# -- analysis results as markers ------------------------------------------------------------------


def _projected(rows: DataFrame, kind: Column, start: Column, end: Column | None, severity: Column | None, label: Column | None, prefix: str, order: list[str], channel: Column | None = None) -> DataFrame:
    """Marker rows, numbered per track in the given order; severity is 1 info, 2 warning, 3 error."""
    null = lambda c, t: (c if c is not None else F.lit(None)).cast(t)
    number = F.row_number().over(Window.partitionBy("track").orderBy(*order)) - 1
    return rows.select(
        "track", F.concat(F.lit(f"{prefix}:"), start.cast("string"), F.lit(":"), number.cast("string")).alias("id"), kind.alias("kind"), start.cast("long").alias("start_frame"), null(end, "long").alias("end_frame"),
        null(channel, "int").alias("channel"), null(severity, "double").alias("severity"), null(label, "string").alias("label"), F.lit(None).cast("string").alias("data"), F.lit(False).alias("user_created"),
    )


def from_beats(beats: DataFrame) -> DataFrame:
    """beats (track, frame[, bar_beat]): beats, and downbeats where the bar is known."""
    down = (F.col("bar_beat") == 0) if "bar_beat" in beats.columns else F.lit(False)
    return _projected(beats, F.when(down, "downbeat").otherwise("beat"), F.col("frame"), None, None, F.when(down, "downbeat"), "beat", ["frame"])


def from_clips(events: DataFrame) -> DataFrame:
    """Events of clipping; errors are those over full scale and between samples."""
    words = {"digital": "digital clip", "over_full_scale": "over full scale", "near_clip": "near clip", "inter_sample_peak": "inter-sample peak"}
    name = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in words.items()], F.lit("clip"))
    end = F.when(F.col("end") > F.col("begin"), F.col("end"))
    severity = F.when(F.col("kind").isin("over_full_scale", "inter_sample_peak"), 3).otherwise(2)
    return _projected(events, F.lit("clipping"), F.col("begin"), end, severity, F.concat(name, F.format_string(" %.1fdBFS", "peak_dbfs")), "clipping", ["begin", "channel", "kind"], F.col("channel"))


def from_offsets(channels: DataFrame, frames: DataFrame) -> DataFrame:
    """channels (track, channel, pattern, dc_dbfs, headroom_db) with a pattern, as regions over the whole of their track (track, frame_count)."""
    rows = channels.where("pattern <> 'none'").join(frames, "track")
    severity = F.when(F.col("headroom_db") >= 1, 2).otherwise(1)
    return _projected(rows, F.lit("dcRegion"), F.lit(0), F.col("frame_count"), severity, F.concat("pattern", F.format_string(" DC offset: %.1fdBFS", "dc_dbfs")), "dc", ["channel"], F.col("channel"))


def from_transients(found: DataFrame) -> DataFrame:
    """analyze_transients: transients without severity, clicks as warnings and dropouts as errors."""
    defect = F.col("class").isin("click", "dropout")
    severity = F.when(F.col("class") == "dropout", 3).when(F.col("class") == "click", 2)
    return _projected(found, F.when(defect, "defect").otherwise("transient"), F.col("attack"), None, severity, F.format_string("%s %.0f%%", "class", F.col("confidence") * 100), "transient", ["attack", "class"])


# -- the store -------------------------------------------------------------------------------------


def applied(markers: DataFrame, edits: DataFrame) -> DataFrame:
    """Markers after edits (seq, op, and the marker's columns): the last add, update or remove of an id decides.

    Updates of ids that aren't there and removals of those change nothing; null columns of an update keep the old value.
    """
    last = edits.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc()))).where("_rank = 1").drop("_rank", "seq")
    columns = [c for c in markers.columns if c != "id"]
    new = last.select("id", "op", *[F.col(c).alias(f"_{c}") for c in columns])
    both = markers.withColumn("_old", F.lit(True)).join(new, "id", "full").where("op is null or op = 'add' or (op = 'update' and _old)")
    value = lambda c: F.when(F.col("op") == "add", F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c))
    return both.select("id", *[value(c).alias(c) for c in columns])


def next_error(markers: DataFrame, at: DataFrame, chunk: int = islands.CHUNK) -> DataFrame:
    """For each (track, at): the next error after it (errors, and decoder events of severity 3), from the track's start again if there is none.

    Places and errors of a chunk are passed once, latest first, each place taking the error
    passed last; where none follows in the chunk, it is the first of the next chunk that has any,
    found over one row a chunk.
    """
    errors = markers.where("track is not null and start_frame is not null and (kind = 'error' or (kind = 'decoderEvent' and severity = 3))")
    errors = errors.select("track", F.col("start_frame").cast("long").alias("f"), "id", F.lit(False).alias("asked"))
    places = at.select("track", F.col("at").cast("long").alias("f"), F.lit(None).cast("string").alias("id"), F.lit(True).alias("asked"))
    rows = errors.unionByName(places).withColumn("_chunk", F.coalesce(F.floor(F.col("f") / chunk), F.lit(0)))
    error = F.when(~F.col("asked"), F.struct("f", "id"))
    # at one frame places come before errors, and of these the smallest id is passed last
    w = Window.partitionBy("track", "_chunk").orderBy(F.col("f").desc(), F.col("asked").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last(error, ignorenulls=True).over(w)).where("asked").select("track", "_chunk", F.col("f").alias("at"), "near")
    track = Window.partitionBy("track")
    heads = rows.groupBy("track", "_chunk").agg(F.min(error).alias("head"))
    heads = heads.select("track", "_chunk", F.last("head", ignorenulls=True).over(track.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"), F.min("head").over(track).alias("first"))
    found = near.join(heads, ["track", "_chunk"], "left").withColumn("e", F.coalesce(F.when(F.col("at").isNotNull(), F.coalesce("near", "later")), "first"))
    return found.select("track", "at", F.col("e.f").alias("start_frame"), "e.id")
