"""Tag sets and tag texts: merging by priority, lyrics, cue sheets, gain values, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(tag_sets: DataFrame) -> DataFrame:
    """(file, field, value, source): the first non-null value by priority, from (file, priority, source, field, value)."""
    first = F.min_by(F.struct("value", "source"), "priority")
    g = tag_sets.where("value is not null").groupBy("file", "field").agg(first.alias("v"))
    return g.select("file", "field", F.col("v.value").alias("value"), F.col("v.source").alias("source"))


def conflicts(tag_sets: DataFrame) -> DataFrame:
    """Every value of a field whose sources disagree: the winner once, and each later value that differs."""
    w = Window.partitionBy("file", "field")
    rows = tag_sets.where("value is not null").withColumn("win", F.min(F.struct("priority", "value")).over(w))
    rows = rows.withColumn("differs", F.col("value") != F.col("win.value")).withColumn("any", F.bool_or("differs").over(w))
    return rows.where("any and (differs or priority = win.priority)").select("file", "field", "priority", "source", "value", (~F.col("differs")).alias("winner"))


def filled(base: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with its empty fields taken from extra."""
    e = extra.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return base.join(e, key, "left").select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def lyrics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line): lines of timed lyrics, once per timestamp, in the order of time."""
    line = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("no", "raw"))
    stamp = r"\[([0-9]{1,3}):([0-9]{2})(?:[.:]([0-9]{1,3}))?\]"
    body = F.trim(F.regexp_replace("raw", r"^(?:\[[0-9]{1,3}:[0-9]{2}(?:[.:][0-9]{1,3})?\])+", ""))
    tags = F.regexp_extract_all(F.regexp_extract("raw", r"^((?:\[[0-9]{1,3}:[0-9]{2}(?:[.:][0-9]{1,3})?\])+)", 1), F.lit(r"\[[^\]]*\]"), F.lit(0))
    one = line.select(key, "no", body.alias("line"), F.explode(tags).alias("tag"))
    part = lambda i: F.regexp_extract("tag", stamp, i)
    frac = F.when(part(3) == "", 0.0).otherwise(F.concat(F.lit("0."), part(3)).try_cast("double"))
    return one.select(key, (part(1).try_cast("double") * 60 + part(2).try_cast("double") + frac).alias("at"), "no", "line")


def cue_points(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, track_no, at, label): tracks of a cue sheet; INDEX 01 before INDEX 00, 75 frames a second."""
    line = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("no", "raw"))
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("track_no", F.last(F.regexp_extract("raw", r"(?i)^\s*TRACK\s+([0-9]+)", 1).try_cast("int"), ignorenulls=True).over(w)).where("track_no is not null")
    title = F.nullif(F.regexp_extract("raw", r'(?i)^\s*TITLE\s+"?([^"]*)"?\s*$', 1), F.lit(""))
    idx = lambda i: F.regexp_extract("raw", r"(?i)^\s*INDEX\s+([0-9]+)\s+([0-9]+):([0-9]+):([0-9]+)", i).try_cast("int")
    at = idx(2) * 60.0 + idx(3) + idx(4) / 75.0
    g = rows.groupBy(key, "track_no").agg(F.first(title, ignorenulls=True).alias("label"), F.min(F.when(idx(1) == 1, at)).alias("i1"), F.min(F.when(idx(1) == 0, at)).alias("i0"))
    return g.where("i1 is not null or i0 is not null").select(key, "track_no", F.coalesce("i1", "i0").alias("at"), F.coalesce("label", F.format_string("Track %d", "track_no")).alias("label"))


def leading_double(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def itunes_gain(text: Column) -> Column:
    """Gain in dB from the first hexadecimal word of a normalisation text; null if it is 0 or no number."""
    word = F.regexp_extract(F.trim(text), r"^([0-9A-Fa-f]{1,8})(?:\s|$)", 1)
    v = F.conv(F.nullif(word, F.lit("")), 16, 10).try_cast("double")
    return F.when(v > 0, 10 * F.log10(1000 / v))


def number_of(text: Column, which: int) -> Column:
    """n (1) or total (2) of a text such as 3/12."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]+)(?:\s*/\s*([0-9]+))?", which), F.lit("")).try_cast("int")


def image_type(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def collected(tag_sets: DataFrame, field: str) -> DataFrame:
    """(file, values): all values of a field that may have several, in the order of priority and then of their places."""
    order = ["priority", "position"] if "position" in tag_sets.columns else ["priority", "value"]
    g = tag_sets.where((F.col("field") == field) & F.col("value").isNotNull()).groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*order, F.col("value").alias("v")))).alias("s"))
    return g.select("file", F.col("s.v").alias("values"))


def split_values(text: Column) -> Column:
    """The values of a text that NUL characters part; empty ones are left out."""
    return F.filter(F.split(text, "\x00"), lambda v: v != "")


def lyrics_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, synced, at, no, line): timed lines where a text has timestamps, else the whole text as one line at -1."""
    timed = lyrics(texts, key, text).withColumn("synced", F.lit(True))
    plain = texts.join(timed.select(key).distinct(), key, "left_anti").where(F.col(text).isNotNull())
    return timed.select(key, "synced", "at", "no", "line").unionByName(plain.select(key, F.lit(False).alias("synced"), F.lit(-1.0).alias("at"), F.lit(0).alias("no"), F.col(text).alias("line")))
