"""Analyzers called from SQL, reproducible sums, stored results and curves between samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid.functions import surface
from pulsegrid.operators import curve, stats, sums
from pulsegrid.plans.event_queries import CLIPS, RMS
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import EVENTS, MARKERS, r6
from pulsegrid.plans.stats_queries import CHANNELS, SR, rounded
from pulsegrid.sources import shared, signals, store


def _chunks(samples, frames=1000):
    """(track, channel, start_frame, samples) of doubles."""
    g = samples.groupBy("track", "channel", F.floor(F.col("frame") / frames).alias("c")).agg(F.min("frame").alias("start_frame"), F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("s"))
    return g.select("track", "channel", "start_frame", F.col("s.x").alias("samples"))


@query("sql_levels", f"SELECT track, channel, n, min, max, mean, rms, std_dev, peak, peak_frame, zero_crossings FROM ({CHANNELS})")
def _(spark, d):
    surface.register(spark)
    return rounded(spark.sql(surface.LEVELS, chunks=_chunks(signals.events_stereo(spark, d))))


@query("sql_clip_events", f"""WITH {CLIPS} SELECT track, channel, "begin", "end", {r6('peak', 'peak')} FROM cl WHERE kind = 'near_clip'""")
def _(spark, d):
    """Near-clip events: runs of the chunks, whole runs over the chunks' edges, then those at most 3 frames apart."""
    surface.register(spark)
    whole = "SELECT track, channel, begin, `end`, peak FROM pg_joined(TABLE(SELECT * FROM pg_runs(TABLE({chunks}), pow(10D, -0.05D))) PARTITION BY (track, channel) ORDER BY (begin), 0L)"
    return rounded(spark.sql(f"SELECT track, channel, begin, `end`, peak FROM pg_joined(TABLE({whole}) PARTITION BY (track, channel) ORDER BY (begin), 3L)", chunks=_chunks(signals.events_stereo(spark, d))))


@query("sql_quiet_windows", f"""WITH {RMS}, st AS (SELECT *, CASE WHEN rms <= 0 THEN CAST('-inf' AS DOUBLE) ELSE 20*log10(rms) END AS lvl FROM se)
SELECT track, channel, w, coalesce(last_value(CASE WHEN lvl > -57 THEN false WHEN lvl <= -60 THEN true END IGNORE NULLS) OVER (PARTITION BY track, channel ORDER BY w ROWS UNBOUNDED PRECEDING), true) AS quiet FROM st""")
def _(spark, d):
    surface.register(spark)
    series = stats.rms_series(signals.events_gated(spark, d), SR)
    return spark.sql("SELECT track, channel, w, quiet FROM pg_quiet(TABLE(SELECT track, channel, w, pg_db(rms) AS level FROM {series}) PARTITION BY (track, channel) ORDER BY (w), -60D, -57D)", series=series)


@query("sql_spaced_markers", f"""WITH RECURSIVE {MARKERS}, o AS (SELECT kind, id, start_frame / 250.0 AS p, row_number() OVER (PARTITION BY kind ORDER BY start_frame) AS i FROM mk),
t AS (SELECT kind, id, p, i FROM o WHERE i = 1 UNION ALL SELECT n.kind, n.id, n.p, n.i FROM t JOIN o n ON n.kind = t.kind AND n.i = (SELECT min(z.i) FROM o z WHERE z.kind = t.kind AND z.p - t.p >= 8)) SELECT kind, id FROM t""")
def _(spark, d):
    surface.register(spark)
    return spark.sql("SELECT part AS kind, id FROM pg_spaced(TABLE(SELECT kind AS part, CAST(start_frame / 250.0 AS DOUBLE) AS at, id FROM {m}) PARTITION BY part ORDER BY (at), 8D)", m=signals.markers(spark, d))


def _fold(rows: str, into: str, name: str) -> str:
    return f"{name} AS (SELECT track, channel, {into} AS i, list_reduce(list(v ORDER BY i), lambda a, b: a + b) AS v FROM {rows} GROUP BY ALL)"


@query("sums_reproducible", f"""WITH {EVENTS}, l0 AS (SELECT track, channel, frame AS i, x AS v FROM ev), {_fold('l0', 'i // 128', 'l1')}, {_fold('l1', 'i // 128', 'l2')}, {_fold('l2', 'i // 128', 'l3')}, {_fold('l3', 'i // 128', 'l4')}, {_fold('l4', '0', 'l5')}
SELECT track, channel, v AS total FROM l5""")
def _(spark, d):
    """Bit for bit the sums of the SQL, not rounded."""
    return sums.tree_sum(signals.events_stereo(spark, d), ["track", "channel"], "frame", F.col("x"))


@query("results_stored", f"""WITH {EVENTS}, s AS (SELECT *, 'part ' || (frame // 1500) % 3 AS source FROM ev)
SELECT source, channel, CASE source WHEN 'part 1' THEN 2 ELSE 1 END AS pass, {r6('max(abs(x))', 'peak')} FROM s GROUP BY ALL""")
def _(spark, d):
    """Peaks of three sources, of which one is analyzed again; rows without a line among the snapshots and those of another version aren't read."""
    folder = f"{shared.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    x = signals.events_stereo(spark, d).withColumn("source", F.concat(F.lit("part "), (F.floor(F.col("frame") / 1500) % 3).cast("string")))
    peaks = lambda rows, n: rows.groupBy("source", "channel").agg(F.max(F.abs("x")).alias("peak")).withColumn("pass", F.lit(n))
    store.store(peaks(x, 1), folder, "peaks", 1)
    store.store(peaks(x.where("source = 'part 1'"), 2), folder, "peaks", 1)
    store.store(peaks(x, 3), folder, "peaks", 2)
    store.add_rows(peaks(x, 4), folder)
    return rounded(store.read(spark, folder, "source string, channel int, peak double, pass int", "peaks", 1))


#: Pixels a frame of the curves below, and the signal on a grid of 32 values so that neighbours share some.
WIDE = 6
PIXELS = f"{EVENTS}, px AS (SELECT track, channel, frame * {WIDE} + i AS pixel, floor(x * 16) / 16 AS v FROM ev, range({WIDE}) r(i))"
POINTS = f"""{PIXELS}, pt AS (SELECT track, channel, (min(pixel) + max(pixel)) / 2.0 AS mid, v AS value FROM (SELECT *, pixel - row_number() OVER (PARTITION BY track, channel, v ORDER BY pixel) AS g FROM px) GROUP BY track, channel, v, g)"""


def _pixels(spark, d):
    x = signals.events_stereo(spark, d).withColumn("v", F.floor(F.col("x") * 16) / 16)
    return x.select("track", "channel", "v", F.explode(F.sequence(F.col("frame") * WIDE, F.col("frame") * WIDE + WIDE - 1)).alias("pixel")).select("track", "channel", "pixel", F.col("v").alias("min"), F.col("v").alias("max"))


@query("curve_points", f"WITH {POINTS} SELECT track, channel, mid AS at, value FROM pt")
def _(spark, d):
    return curve.point_samples(_pixels(spark, d), ["track", "channel"])


@query("curve_values", f"""WITH {POINTS}, d AS (SELECT p.track, p.channel, p.pixel, value, (p.pixel - mid) / {WIDE}.0 AS t FROM px p JOIN pt ON pt.track = p.track AND pt.channel = p.channel AND mid BETWEEN p.pixel - {4 * WIDE} AND p.pixel + {4 * WIDE}),
s AS (SELECT track, channel, pixel, sum(value * CASE WHEN abs(t) >= 4 THEN 0 WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 4) / (pi() * t / 4) END) AS value FROM d GROUP BY ALL)
SELECT px.track, px.channel, px.pixel, round(coalesce(value, 0), 6) + 0.0 AS value FROM px LEFT JOIN s USING (track, channel, pixel)""")
def _(spark, d):
    bins = _pixels(spark, d)
    return rounded(curve.between(curve.point_samples(bins, ["track", "channel"]), bins, ["track", "channel"], WIDE))
