"""Marker, tag, file and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import exprs
from pulsegrid.operators import markers, silence, stats, tags, transport
from pulsegrid.plans.event_queries import SIL, THRESHOLD, _frames
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import EVENTS, MARKERS, r6
from pulsegrid.plans.stats_queries import SR, rounded
from pulsegrid.sources import files, signals

REG = "kd AS (SELECT * FROM (VALUES ('click', 0, 5, true, true), ('view', 1, 1, true, true), ('purchase', 2, 4, false, true), ('signup', 3, 3, false, true), ('error', 4, 9, false, true)) t(kind, lane, priority, dense, visible))"
ALL = "id, kind, start_frame, end_frame, channel, severity, label, data, user_created"


@query("marker_kinds", f"WITH {MARKERS}, {REG} SELECT id, kind, start_frame, lane, priority, dense, visible FROM mk LEFT JOIN kd USING (kind)")
def _(spark, d):
    return markers.with_kind(signals.markers(spark, d)).select("id", "kind", "start_frame", "lane", "priority", "dense", "visible")


@query("marker_visible", f"WITH {MARKERS} SELECT {ALL} FROM mk WHERE start_frame <= 20000 AND coalesce(end_frame, start_frame) >= 10000 AND kind IN ('click', 'error')")
def _(spark, d):
    return markers.visible(signals.markers(spark, d), 10_000, 20_000, ["click", "error"])


@query("marker_neighbours", f"WITH {MARKERS} SELECT kind, coalesce(min(start_frame) FILTER (start_frame > 30005), min(start_frame)) AS next, coalesce(max(start_frame) FILTER (start_frame < 30005), max(start_frame)) AS previous FROM mk GROUP BY kind")
def _(spark, d):
    return markers.neighbours(signals.markers(spark, d), 30_005)


@query("marker_hit", f"""WITH {MARKERS}, {REG}, h AS (SELECT *, greatest(0, start_frame - 30005, 30005 - coalesce(end_frame, start_frame)) AS distance FROM mk JOIN kd USING (kind))
SELECT id, kind, distance FROM h WHERE distance <= 40 ORDER BY lane, distance, priority DESC, start_frame, id LIMIT 1""")
def _(spark, d):
    return markers.hit(signals.markers(spark, d), 30_005, 40)


@query("marker_pixels", f"WITH {MARKERS} SELECT kind, CAST(floor(start_frame / 250.0) AS BIGINT) AS px, count(*) AS n, arg_max(id, (severity, -start_frame, id)) AS id FROM mk GROUP BY ALL")
def _(spark, d):
    return markers.per_pixel(signals.markers(spark, d), 250.0)


@query("marker_thinned", f"""WITH RECURSIVE {MARKERS}, o AS (SELECT kind, id, start_frame / 250.0 AS p, row_number() OVER (PARTITION BY kind ORDER BY start_frame) AS i FROM mk),
t AS (SELECT kind, id, p, i FROM o WHERE i = 1 UNION ALL SELECT n.kind, n.id, n.p, n.i FROM t JOIN o n ON n.kind = t.kind AND n.i = (SELECT min(z.i) FROM o z WHERE z.kind = t.kind AND z.p - t.p >= 8)) SELECT kind, id FROM t""")
def _(spark, d):
    from pulsegrid.operators import islands

    m = signals.markers(spark, d).withColumn("p", F.col("start_frame") / 250.0)
    return islands.refractory(m, ["kind"], "p", 8.0, at_least=True).select("kind", "id")


@query("marker_spans", f"""WITH {MARKERS}, r AS (SELECT kind, start_frame / 250.0 AS b, end_frame / 250.0 AS e, id FROM mk WHERE end_frame IS NOT NULL),
g AS (SELECT *, sum(nw) OVER (PARTITION BY kind ORDER BY b, e, id) AS g FROM (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY kind ORDER BY b, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0 OR lag(e) OVER (PARTITION BY kind ORDER BY b, e, id) IS NULL THEN 1 ELSE 0 END AS nw FROM r))
SELECT kind, {r6('min(b)', 'begin').replace(' AS begin', ' AS "begin"')}, {r6('max(e)', 'end').replace(' AS end', ' AS "end"')}, count(*) AS n FROM g GROUP BY kind, g""")
def _(spark, d):
    return rounded(markers.pixel_spans(signals.markers(spark, d), 250.0))


@query("marker_spans_all", f"""WITH {MARKERS}, r AS (SELECT kind, start_frame / 250.0 AS b, end_frame / 250.0 AS e, id FROM mk WHERE end_frame IS NOT NULL),
g AS (SELECT *, sum(nw) OVER (PARTITION BY kind ORDER BY b, e, id) AS g FROM (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY kind ORDER BY b, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0 OR lag(e) OVER (PARTITION BY kind ORDER BY b, e, id) IS NULL THEN 1 ELSE 0 END AS nw FROM r))
SELECT kind, {r6('min(b)', 'begin').replace(' AS begin', ' AS "begin"')}, {r6('max(e)', 'end').replace(' AS end', ' AS "end"')}, count(*) AS n FROM g GROUP BY kind, g""")
def _(spark, d):
    return rounded(markers.pixel_spans(signals.markers(spark, d), 250.0))


@query("curve_pixels", f"""WITH {EVENTS}, s AS (SELECT track, channel, frame // 50 AS w, sqrt(avg(x*x)) AS v FROM ev GROUP BY ALL), p AS (SELECT px, px * 170 // 50 AS lo, greatest(px * 170 // 50, ((px + 1) * 170 + 49) // 50 - 1) AS hi FROM range(20) r(px))
SELECT track, channel, px, {r6('min(v)', 'min')}, {r6('max(v)', 'max')} FROM s JOIN p ON w BETWEEN lo AND hi GROUP BY ALL""")
def _(spark, d):
    s = stats.rms_series(signals.events_stereo(spark, d), SR).select("track", "channel", "w", F.col("rms").alias("v"))
    return rounded(markers.curve_pixels(s, 50, 170, 20))


@query("marker_replaced", f"""WITH {MARKERS} SELECT {ALL} FROM mk WHERE kind <> 'click' OR user_created UNION ALL SELECT 'new-' || id, kind, start_frame + 1, end_frame, channel, severity, label, data, user_created FROM mk WHERE kind = 'click' AND severity >= 2 AND NOT user_created""")
def _(spark, d):
    m = signals.markers(spark, d)
    new = m.where("kind = 'click' and severity >= 2").withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("start_frame", F.col("start_frame") + 1)
    return markers.replaced(m, "click", new)


@query("marker_findings", f"WITH {MARKERS}, {REG} SELECT kind, priority, count(*) AS n, min(start_frame) AS first, CAST(row_number() OVER (ORDER BY priority DESC, kind) AS INTEGER) AS position FROM mk JOIN kd USING (kind) GROUP BY kind, priority")
def _(spark, d):
    return markers.by_kind(signals.markers(spark, d))


@query("marker_csv", f"""WITH {MARKERS} SELECT start_frame, id, id || ',' || kind || ',' || start_frame || ',' || coalesce(CAST(end_frame AS VARCHAR), '') || ',' || channel || ',' || severity || ',"' || replace(label, ' ', ', ""') || '",' || user_created AS line FROM mk""")
def _(spark, d):
    m = signals.markers(spark, d).withColumn("label", F.replace("label", F.lit(" "), F.lit(', "')))
    return markers.csv_lines(m)


@query("marker_audacity", f"""WITH {MARKERS} SELECT start_frame, id, printf('%.6f', start_frame / 1000.0) || chr(9) || printf('%.6f', coalesce(end_frame, start_frame) / 1000.0) || chr(9) || label AS line FROM mk""")
def _(spark, d):
    return markers.audacity_lines(signals.markers(spark, d), 1000)


@query("marker_projection", f"""WITH {THRESHOLD} SELECT 'silence-' || track || '-' || (row_number() OVER (PARTITION BY track ORDER BY frame_begin) - 1) AS id, 'silence' AS kind, frame_begin AS start_frame, frame_end AS end_frame,
    CAST(NULL AS INTEGER) AS channel, CAST(CASE WHEN position = 'internal' THEN 2 ELSE 1 END AS DOUBLE) AS severity, position || ' silence' AS label, CAST(NULL AS VARCHAR) AS data, false AS user_created FROM rg""")
def _(spark, d):
    x = signals.events_gated(spark, d)
    found = silence.regions(silence.by_threshold(stats.rms_series(x, SR), SIL), _frames(x), SIL, 0.05, SR)
    return markers.from_regions(found, "silence", F.when(F.col("position") == "internal", 2).otherwise(1), F.concat("position", F.lit(" silence")))


@query("bounds", f"WITH {MARKERS} SELECT kind, count(*) FILTER (start_frame < 30000) AS lower, count(*) FILTER (start_frame <= 30000) AS upper FROM mk GROUP BY kind")
def _(spark, d):
    s = F.col("start_frame")
    return signals.markers(spark, d).groupBy("kind").agg(F.count(F.when(s < 30000, 1)).alias("lower"), F.count(F.when(s <= 30000, 1)).alias("upper"))


@query("json_report", f"""WITH {EVENTS}, g AS (SELECT track, channel, avg(x) AS mean, max(abs(x)) AS peak FROM ev GROUP BY ALL) SELECT track, channel, '{{"mean":' || printf('%.6f', mean) || ',"peak":' || printf('%.6f', peak) || ',"none":null}}' AS json FROM g""")
def _(spark, d):
    g = signals.events_stereo(spark, d).groupBy("track", "channel").agg(F.avg("x").alias("mean"), F.max(F.abs("x")).alias("peak"))
    body = F.concat(F.lit('{"mean":'), F.format_string("%.6f", "mean"), F.lit(',"peak":'), F.format_string("%.6f", "peak"), F.lit(',"none":'), exprs.json_number(F.lit(float("nan"))), F.lit("}"))
    return g.select("track", "channel", body.alias("json"))


# -- tags -----------------------------------------------------------------------------------

TAGS = """tg AS (SELECT 'n' || c_nationkey AS file, CAST(c_custkey % 3 AS INTEGER) AS priority, 's' || c_custkey % 3 AS source, 'f' || c_custkey // 3 % 4 AS field, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3, c_custkey // 3 % 4 ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1)"""


def _tags(spark, d):
    from pyspark.sql import Window

    c = signals.read(spark, d, "customer")
    field = F.floor(F.col("c_custkey") / 3) % 4
    w = Window.partitionBy("c_nationkey", F.col("c_custkey") % 3, field).orderBy("c_custkey")
    one = c.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    text = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    return one.select(text("n", F.col("c_nationkey")).alias("file"), (F.col("c_custkey") % 3).cast("int").alias("priority"), text("s", F.col("c_custkey") % 3).alias("source"), text("f", field).alias("field"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("value"))


@query("tags_merged", f"WITH {TAGS} SELECT file, field, arg_min(value, priority) AS value, arg_min(source, priority) AS source FROM tg WHERE value IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return tags.merged(_tags(spark, d))


@query("tag_conflicts", f"""WITH {TAGS}, w AS (SELECT *, arg_min(value, priority) OVER (PARTITION BY file, field) AS win, min(priority) OVER (PARTITION BY file, field) AS wp FROM tg WHERE value IS NOT NULL), a AS (SELECT *, bool_or(value <> win) OVER (PARTITION BY file, field) AS an FROM w)
SELECT file, field, priority, source, value, value = win AS winner FROM a WHERE an AND (value <> win OR priority = wp)""")
def _(spark, d):
    return tags.conflicts(_tags(spark, d))


@query("tags_filled", "SELECT c_nationkey AS k, coalesce(min(CASE WHEN c_custkey % 2 = 0 THEN c_name END), min(c_name)) AS name, coalesce(CAST(NULL AS VARCHAR), max(c_name)) AS other FROM customer GROUP BY 1")
def _(spark, d):
    c = signals.read(spark, d, "customer").withColumn("k", F.col("c_nationkey"))
    base = c.groupBy("k").agg(F.min(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("name"), F.lit(None).cast("string").alias("other"))
    return tags.filled(base, c.groupBy("k").agg(F.min("c_name").alias("name"), F.max("c_name").alias("other")), "k", ["name", "other"])


# every event is a line of its user's lyrics: stamped once, twice, not at all, or out of range
LINES = """ln AS (SELECT user_id AS k, event_id, event_id % 5 AS kind, event_id % 60 AS m, event_id * 7 % 60 AS s, event_type AS line FROM events)"""


@query("lyrics", f"""WITH {LINES} SELECT k, CAST(m * 60 + s + 0.25 AS DOUBLE) AS "at", line, count(*) AS n FROM ln WHERE kind IN (0, 1, 2) GROUP BY ALL
UNION ALL SELECT k, CAST(m * 60 + s + 30.25 AS DOUBLE), line, count(*) FROM ln WHERE kind = 2 GROUP BY ALL""")
def _(spark, d):
    e = signals.read(spark, d, "events")
    m, s, line = F.col("event_id") % 60, F.col("event_id") * 7 % 60, F.col("event_type")
    stamp = lambda s: F.format_string("[%02d:%02d.25]", F.floor((m * 60 + s) / 60), (m * 60 + s) % 60)
    text = F.when(F.col("event_id") % 5 < 2, F.concat(stamp(s), line)).when(F.col("event_id") % 5 == 2, F.concat(stamp(s), stamp(s + 30), line)).when(F.col("event_id") % 5 == 3, F.concat(line, stamp(s))).otherwise(line)
    lines = e.groupBy(F.col("user_id").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return rounded(tags.lyrics(lines, "k", "text").groupBy("k", "at", "line").agg(F.count("*").alias("n")))


CUE = 'TRACK 01 AUDIO\n  TITLE "One"\n  INDEX 00 00:00:10\n  INDEX 01 00:02:00\nTRACK 02 AUDIO\n  INDEX 00 03:10:37\nTRACK 03 AUDIO\n'


@query("cue_sheet", """SELECT 'c' AS k, * FROM (VALUES (1, 2.0::DOUBLE, 'One'), (2, round(190 + 37 / 75, 6), 'Track 2')) t(track_no, "at", label)""")
def _(spark, d):
    return rounded(tags.cue_points(spark.createDataFrame([("c", CUE)], "k string, text string"), "k", "text"))


@query("tag_numbers", f"""WITH e AS (SELECT event_id AS id, event_id % 4 AS k, event_id % 41 - 20 AS g, event_id % 15 AS a, user_id % 20 AS b, lpad(CAST(event_id AS VARCHAR), 8, '0') AS h FROM events),
t AS (SELECT *, CASE k WHEN 0 THEN g || ' dB' WHEN 1 THEN a || '/' || b WHEN 2 THEN h || ' 00000100' ELSE 'none' END AS s FROM e)
SELECT id, s, CAST(CASE k WHEN 0 THEN g WHEN 1 THEN a WHEN 2 THEN CAST(h AS BIGINT) END AS DOUBLE) AS gain, {r6("CASE WHEN k = 2 AND CAST('0x' || h AS BIGINT) > 0 THEN 10 * log10(1000.0 / CAST('0x' || h AS BIGINT)) END", 'norm')},
CAST(CASE k WHEN 0 THEN CASE WHEN g >= 0 THEN g END WHEN 1 THEN a WHEN 2 THEN CAST(h AS BIGINT) END AS INTEGER) AS n, CAST(CASE WHEN k = 1 THEN b END AS INTEGER) AS total FROM t""")
def _(spark, d):
    """Gains, places in a sum and normalisation figures, written as tags from the events' numbers."""
    k, e = F.col("event_id") % 4, signals.read(spark, d, "events")
    text = F.when(k == 0, F.concat((F.col("event_id") % 41 - 20).cast("string"), F.lit(" dB"))).when(k == 1, F.concat((F.col("event_id") % 15).cast("string"), F.lit("/"), (F.col("user_id") % 20).cast("string")))
    text = text.when(k == 2, F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(" 00000100"))).otherwise("none")
    s = e.select(F.col("event_id").alias("id"), text.alias("s"))
    v = s.select("id", "s", tags.leading_double(F.col("s")).alias("gain"), F.when(F.col("s").rlike("^[0-9A-Fa-f]{8}"), tags.itunes_gain(F.col("s"))).alias("norm"), tags.number_of(F.col("s"), 1).alias("n"), tags.number_of(F.col("s"), 2).alias("total"))
    return rounded(v)


HEADS = (b"RIFF\0\0\0\0WAVEfmt ", b"fLaC\0\0\0\0\0\0\0\0", b"OggS\0\0\0\0\0\0\0\0", b"\0\0\0\x20ftypM4A ", b"\0\0\0\x20ftypqt  ", b"", b"ID3\x04\0\0\0\0\0\x05xxxxxfLaC\0\0\0\0\0\0\0\0", b"FORM\0\0\0\0AIFF", b"ID3\x04\0\0\x7f\x7f\x7f\x7f")


@query("container_sniff", """SELECT doc_id AS id, ['wav', 'flac', 'ogg', 'mp4', 'mp4_other', NULL, 'flac', 'aiff', NULL][doc_id % 9 + 1] AS kind, CASE doc_id % 9 WHEN 6 THEN 15 WHEN 8 THEN 268435465 ELSE 0 END AS skip, coalesce(doc_id % 9 = 8, false) AS truncated FROM documents""")
def _(spark, d):
    """Each document's bytes after the head that its number picks."""
    heads = F.array(*[F.lit(bytearray(h)) for h in HEADS])
    content = F.concat(F.element_at(heads, (F.col("doc_id") % 9 + 1).cast("int")), F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    s = signals.read(spark, d, "documents").select("doc_id", files.sniffed(content).alias("s"))
    return s.select(F.col("doc_id").alias("id"), "s.kind", "s.skip", F.coalesce(F.col("s.error").startswith("truncated"), F.lit(False)).alias("truncated"))


@query("cache_lookup", """WITH q AS (SELECT event_id AS k, event_type AS v FROM events), r AS (SELECT event_id AS k, CASE WHEN event_id % 10 = 0 THEN 'old' ELSE event_type END AS v, value FROM events WHERE event_id % 2 = 0)
SELECT q.k, q.v, r.value IS NOT NULL AS hit FROM q LEFT JOIN r ON r.k = q.k AND r.v = q.v""")
def _(spark, d):
    e = signals.read(spark, d, "events")
    want = e.select(F.col("event_id").alias("k"), F.col("event_type").alias("v"))
    have = e.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.when(F.col("event_id") % 10 == 0, "old").otherwise(F.col("event_type")).alias("v"), "value")
    hits, misses = files.cached(want, have, ["k", "v"])
    return hits.select("k", "v", F.lit(True).alias("hit")).unionByName(misses.select("k", "v", F.lit(False).alias("hit")))


@query("cache_lookup_all", """WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 10 = 0 THEN 'old' ELSE event_type END AS v FROM events WHERE event_id % 2 = 0)
SELECT q.event_id AS k, q.event_type AS v, r.k IS NOT NULL AS hit FROM events q LEFT JOIN r ON r.k = q.event_id AND r.v = q.event_type""")
def _(spark, d):
    """Every event asks; results exist for the even ids, a tenth of all under a stale version."""
    e = signals.read(spark, d, "events")
    want = e.select(F.col("event_id").alias("k"), F.col("event_type").alias("v"))
    have = e.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.when(F.col("event_id") % 10 == 0, "old").otherwise(F.col("event_type")).alias("v"), "value")
    hits, misses = files.cached(want, have, ["k", "v"])
    return hits.select("k", "v", F.lit(True).alias("hit")).unionByName(misses.select("k", "v", F.lit(False).alias("hit")))


@query("chunk_range", f"WITH {EVENTS} SELECT track, channel, frame, {r6('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x')} FROM ev WHERE frame >= 1000 AND frame < 1300")
def _(spark, d):
    return rounded(signals.read_range(signals.to_chunks(signals.events_stereo(spark, d), 512), 1000, 1300, 512))


@query("sequential_read", f"WITH {EVENTS} SELECT track, channel, frame, {r6('x', 'x')} FROM ev WHERE channel = 0 AND frame >= 700 ORDER BY frame LIMIT 50")
def _(spark, d):
    x = signals.events_stereo(spark, d).where("channel = 0 and frame >= 700")
    return rounded(x.orderBy("frame").limit(50))


# event types stand for transport commands
COMMAND = {"click": "play", "view": "pause", "purchase": "seek", "signup": "end", "error": "load"}
MOVES_SQL = "mv AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}', '{t}')" for s, c, t in transport.MOVES) + ") t(s, c, t)), cm AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{c}')" for e, c in COMMAND.items()) + ") t(event_type, cmd))"


@query("transport", f"""WITH RECURSIVE {MOVES_SQL}, o AS (SELECT user_id, event_id, cmd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events LEFT JOIN cm USING (event_type)),
st AS (SELECT user_id, event_id, i, coalesce(t, 'ready') AS state, t IS NOT NULL AS legal FROM o LEFT JOIN mv ON s = 'ready' AND c = cmd WHERE i = 1
    UNION ALL SELECT o.user_id, o.event_id, o.i, coalesce(mv.t, st.state), mv.t IS NOT NULL FROM st JOIN o ON o.user_id = st.user_id AND o.i = st.i + 1 LEFT JOIN mv ON mv.s = st.state AND mv.c = o.cmd)
SELECT user_id, event_id, state, legal FROM st""")
def _(spark, d):
    """State after each command of a user's log, and whether it was legal."""
    cmd = F.create_map(*[F.lit(v) for kv in COMMAND.items() for v in kv])
    e = signals.read(spark, d, "events").withColumn("cmd", F.try_element_at(cmd, F.col("event_type")))
    return transport.states(e, "user_id", "event_id", "cmd")
