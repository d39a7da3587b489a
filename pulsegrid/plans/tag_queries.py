"""Tags of files, texts and pictures inside tags, and analysis results as markers, over bytes and rows derived from the tables."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from pulsegrid.operators import loudness, markers, reports, tags
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import MARKERS
from pulsegrid.sources import files, signals, tagparse

FIELDS = ["title", "genre", "track", "comment"]


def _tagged(spark, d):
    """A WAV file of each customer: a list of fields of fixed size, and for every third a leading tag besides."""
    field = lambda name, size, text: F.concat(F.lit(bytearray(name + struct.pack("<I", size))), F.encode(F.rpad(text, size, "\0"), "utf-8"))
    c = signals.read(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    info = F.concat(field(b"INAM", 18, F.col("c_name")), field(b"IGNR", 12, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, field(b"ITRK", 8, key)).otherwise(field(b"ICMT", 8, key)))
    size = 4 + 8 + 18 + 8 + 12 + 8 + 8
    content = F.concat(F.lit(bytearray(b"RIFF" + struct.pack("<I", size + 12) + b"WAVELIST" + struct.pack("<I", size) + b"INFO")), info)
    return c.select(F.concat(F.lit("c"), key).alias("path"), content.alias("content"))


@query("report_metadata", """SELECT 'c' || c_custkey AS file, c_name AS title, c_mktsegment AS genre, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS track, CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) END AS comment, 'riff' AS origin FROM customer""")
def _(spark, d):
    """From bytes to the report: tags parsed, merged by priority, written as JSON and read from there."""
    merged = tags.merged(tagparse.tag_sets(_tagged(spark, d)))
    out = reports.metadata(merged, FIELDS)
    return out.select("file", *[F.get_json_object("json", f"$.{f}").alias(f) for f in FIELDS], F.get_json_object("json", "$.sources[0].origin").alias("origin"))


@query("file_keys", "SELECT 'd' || doc_id AS file, sha256(text) AS content_key FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    docs = signals.read(spark, d, "documents").where("text is not null")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), files.content_key(F.encode("text", "utf-8")).alias("content_key"))


@query("lyrics_of_texts", """WITH e AS (SELECT event_id AS id, event_id % 60 AS s, user_id % 100 AS f, event_type AS t FROM events)
SELECT id, true AS synced, round(60 + s + f / 100.0, 6) AS "at", 0 AS no, t AS line FROM e WHERE id % 3 < 2
UNION ALL SELECT id, true, round(120 + s + f / 100.0, 6), 0, t FROM e WHERE id % 3 = 1
UNION ALL SELECT id, false, -1.0, 0, t || chr(10) || 'end' FROM e WHERE id % 3 = 2""")
def _(spark, d):
    """Texts with one time, with two, and with none, which stay whole."""
    e, second = signals.read(spark, d, "events"), F.format_string("%02d.%02d", F.col("event_id") % 60, F.col("user_id") % 100)
    stamp = lambda m: F.concat(F.lit(f"[{m:02d}:"), second, F.lit("]"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(stamp(1), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(stamp(1), stamp(2), "event_type")).otherwise(F.concat("event_type", F.lit("\nend")))
    out = tags.lyrics_of(e.select(F.col("event_id").alias("id"), text.alias("text")), "id", "text")
    return out.select("id", "synced", F.round("at", 6).alias("at"), "no", "line")


@query("tag_parts", "SELECT event_id AS id, list_filter([event_type, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END, props], lambda v: v <> '') AS parts FROM events WHERE props IS NOT NULL")
def _(spark, d):
    """Values that NUL characters part, an empty one among them."""
    e = signals.read(spark, d, "events").where("props is not null")
    text = F.concat("event_type", F.lit("\0"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(""), F.lit("\0"), "props")
    return e.select(F.col("event_id").alias("id"), tags.split_values(text).alias("parts"))


# The first bytes of pictures, and what they are
PICTURES = ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"RIFF....WEBP", "image/webp"), (b"??", None))


@query("picture_types", f"""WITH p AS (SELECT doc_id, CASE doc_id % 6 {' '.join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(PICTURES) if t)} END AS type, CASE WHEN doc_id % 4 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS declared FROM documents)
SELECT *, coalesce(type <> declared, false) AS mismatch FROM p""")
def _(spark, d):
    """What pictures are by their bytes, beside what their tags say."""
    heads = F.array(*[F.lit(bytearray(h)) for h, _ in PICTURES])
    data = F.concat(F.element_at(heads, (F.col("doc_id") % 6 + 1).cast("int")), F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    p = signals.read(spark, d, "documents").select("doc_id", tags.image_type(data).alias("type"), F.when(F.col("doc_id") % 4 == 0, "image/png").otherwise("image/jpeg").alias("declared"))
    return p.withColumn("mismatch", F.coalesce(F.col("type") != F.col("declared"), F.lit(False)))


@query("mask_weights", """WITH m AS (SELECT event_id AS id, event_id * 4099 % 262144 AS mask FROM events)
SELECT id, list_transform(list_filter(range(18), lambda b: (mask >> b) & 1 = 1), lambda b: CAST(CASE WHEN b = 3 THEN 0 WHEN b IN (4, 5, 9, 10) THEN 1.41 ELSE 1 END AS DOUBLE)) AS weights FROM m""")
def _(spark, d):
    """Weights of the channels that masks of 18 bits name."""
    e = signals.read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), loudness.mask_weights((F.col("event_id") * 4099 % 262144).cast("int")).alias("weights"))


@query("marker_json", f"WITH {MARKERS} SELECT id, kind, start_frame, end_frame, channel, label, user_created FROM mk")
def _(spark, d):
    """Markers written as JSON and read again."""
    out = markers.as_json(signals.markers(spark, d))
    return out.select(F.from_json("json", "id string, kind string, start_frame long, end_frame long, channel int, label string, user_created boolean").alias("j")).select("j.*")


@query("markers_of_beats", """SELECT 'u' || user_id % 8 AS track, 'beat:' || event_id * 7 || ':' || (row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1) AS id, CASE WHEN event_id % 4 = 0 THEN 'downbeat' ELSE 'beat' END AS kind, event_id * 7 AS start_frame, CASE WHEN event_id % 4 = 0 THEN 'downbeat' END AS label FROM events""")
def _(spark, d):
    """Beats whose place in the bar is known, as markers."""
    e = signals.read(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("track"), (F.col("event_id") * 7).alias("frame"), (F.col("event_id") % 4).alias("bar_beat"))
    return markers.from_beats(e).select("track", "id", "kind", "start_frame", "label")


@query("markers_of_transients", """WITH t AS (SELECT *, ['kick', 'snare', 'click', 'dropout'][event_id % 4 + 1] AS c FROM events)
SELECT 'u' || user_id % 8 AS track, 'transient:' || event_id * 7 || ':' || (row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1) AS id, CASE WHEN event_id % 4 >= 2 THEN 'defect' ELSE 'transient' END AS kind, event_id * 7 AS start_frame,
CAST(CASE event_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS DOUBLE) AS severity, c || ' ' || event_id % 101 || '%' AS label FROM t""")
def _(spark, d):
    """Classified events as transients and defects."""
    e = signals.read(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(c) for c in ("kick", "snare", "click", "dropout")]), (F.col("event_id") % 4 + 1).cast("int"))
    found = e.select(F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("track"), (F.col("event_id") * 7).alias("attack"), kind.alias("class"), ((F.col("event_id") % 101) / 100.0).alias("confidence"))
    return markers.from_transients(found).select("track", "id", "kind", "start_frame", "severity", "label")
