"""Silence, clipping and loudness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.model import ClippingConfig, SilenceConfig
from pulsegrid.operators import clipping, loudness, silence, stats
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import EVENTS, EVENTS_HALF, LINE, interpolation, k_weighted, r6
from pulsegrid.plans.stats_queries import SR, rounded
from pulsegrid.sources import signals

SIL = SilenceConfig()
CLIP = ClippingConfig(min_run=2, near_run=1, near_db=-1.0, flatness_db=6.0, merge_gap=3)

RMS = f"{EVENTS_HALF}, se AS (SELECT track, channel, frame // 50 AS w, sqrt(avg(x*x)) AS rms, bool_and(x = 0) AS az FROM evs GROUP BY ALL)"
FRAMES = "fr AS (SELECT track, max(frame) + 1 AS frame_count FROM evs GROUP BY ALL)"


def _regions_sql(states: str) -> str:
    """Regions of the windows (track, w, quiet, mask) that `states` defines as cb."""
    return f"""{states}, {FRAMES}, rn AS (SELECT track, min(w) AS b, max(w) + 1 AS e, bit_or(mask) AS mask FROM (SELECT *, w - row_number() OVER (PARTITION BY track ORDER BY w) AS g FROM cb WHERE quiet) GROUP BY track, g),
    mg AS (SELECT *, CASE WHEN b - max(e) OVER (PARTITION BY track ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2.0 THEN 0 ELSE 1 END AS nw FROM rn),
    gr AS (SELECT *, sum(nw) OVER (PARTITION BY track ORDER BY b) AS g FROM mg),
    rg0 AS (SELECT track, min(b) AS b, max(e) AS e, bit_or(mask) AS mask FROM gr GROUP BY track, g HAVING (max(e) - min(b)) * 50 >= 500),
    la AS (SELECT track, max(w) + 1 AS windows FROM cb GROUP BY ALL),
    rg AS (SELECT rg0.track, b AS w_begin, e AS w_end, mask, b * 50 AS frame_begin, CASE WHEN e >= windows THEN frame_count ELSE least(e * 50, frame_count) END AS frame_end,
        CASE WHEN b = 0 AND e >= windows THEN 'entire' WHEN b = 0 THEN 'leading' WHEN e >= windows THEN 'trailing' ELSE 'internal' END AS position
        FROM rg0 JOIN la USING (track) JOIN fr USING (track))"""


def _combined_sql(quiet: str) -> str:
    return f"""{RMS}, st AS (SELECT track, channel, w, {quiet} AS quiet FROM (SELECT *, CASE WHEN rms <= 0 THEN CAST('-inf' AS DOUBLE) ELSE 20*log10(rms) END AS lvl FROM se)),
    cb AS (SELECT track, w, bool_and(quiet) AS quiet, CAST(bit_or(CASE WHEN quiet THEN 1 << channel ELSE 0 END) AS INTEGER) AS mask FROM st GROUP BY ALL)"""


THRESHOLD = _regions_sql(_combined_sql("coalesce(last_value(CASE WHEN lvl > -57 THEN false WHEN lvl <= -60 THEN true END IGNORE NULLS) OVER (PARTITION BY track, channel ORDER BY w ROWS UNBOUNDED PRECEDING), true)"))


def _frames(x):
    return x.groupBy("track").agg((F.max("frame") + 1).alias("frame_count"))


def _threshold_regions(spark, d):
    x = signals.events_gated(spark, d)
    return silence.regions(silence.by_threshold(stats.rms_series(x, SR), SIL), _frames(x), SIL, 0.05, SR)


@query("silence_threshold", f"WITH {THRESHOLD} SELECT * FROM rg")
def _(spark, d):
    return _threshold_regions(spark, d)


@query("silence_digital", f"WITH {_regions_sql(_combined_sql('az')).replace('>= 500', '>= 300')} SELECT * FROM rg")
def _(spark, d):
    x = signals.events_gated(spark, d)
    cfg = SilenceConfig(min_ms=300.0)
    return silence.regions(silence.digital(stats.rms_series(x, SR), cfg), _frames(x), cfg, 0.05, SR)


@query("silence_perceptual", f"""
WITH {_regions_sql(f'''{EVENTS_HALF}, bl AS (SELECT track, b, sum(ms) AS z FROM (SELECT track, channel, frame // 100 AS b, avg(x*x) AS ms FROM evs GROUP BY ALL HAVING count(*) = 100) GROUP BY ALL),
    sw AS (SELECT track, rn - 4 AS w, z FROM (SELECT track, avg(z) OVER (PARTITION BY track ORDER BY b ROWS 3 PRECEDING) AS z, row_number() OVER (PARTITION BY track ORDER BY b) AS rn FROM bl) WHERE rn >= 4),
    lv AS (SELECT *, CASE WHEN z <= 0 THEN CAST('-inf' AS DOUBLE) ELSE -0.691 + 10*log10(z) END AS lvl FROM sw),
    cb AS (SELECT track, w, coalesce(last_value(CASE WHEN lvl > -57 THEN false WHEN lvl <= -60 THEN true END IGNORE NULLS) OVER (PARTITION BY track ORDER BY w ROWS UNBOUNDED PRECEDING), true) AS quiet, 1 AS mask FROM lv)''').replace('< 2.0', '< 1.0').replace('* 50', '* 100')}
SELECT * FROM rg""")
def _(spark, d):
    x = signals.events_gated(spark, d)
    m = loudness.momentary(loudness.blocks(x, SR, 2))
    return silence.regions(silence.perceptual(m, SIL), _frames(x), SIL, 0.1, SR)


@query("silence_levels", f"""WITH {THRESHOLD}, mn AS (SELECT track, w, avg(rms) AS rms FROM se GROUP BY ALL)
SELECT rg.track, w_begin, w_end, mask, frame_begin, frame_end, position, {r6('CASE WHEN avg(rms) > 0 THEN 20*log10(avg(rms)) END', 'mean_db')}, {r6('CASE WHEN max(rms) > 0 THEN 20*log10(max(rms)) END', 'max_db')}
FROM rg JOIN mn ON mn.track = rg.track AND mn.w >= w_begin AND mn.w < w_end GROUP BY ALL""")
def _(spark, d):
    return rounded(silence.levels(_threshold_regions(spark, d), stats.rms_series(signals.events_gated(spark, d), SR)))


@query("silence_summary", f"""WITH {THRESHOLD}, l AS (SELECT *, (frame_end - frame_begin) / {SR}.0 AS len FROM rg)
SELECT fr.track, count(len) AS regions, {r6("coalesce(max(CASE WHEN position IN ('leading', 'entire') THEN len END), 0)", 'leading_s')}, {r6("coalesce(max(CASE WHEN position IN ('trailing', 'entire') THEN len END), 0)", 'trailing_s')},
    {r6('coalesce(sum(len), 0)', 'total_s')}, {r6(f'least(1, coalesce(sum(len), 0) / (any_value(frame_count) / {SR}.0))', 'fraction')} FROM fr LEFT JOIN l USING (track) GROUP BY fr.track""")
def _(spark, d):
    return rounded(silence.summary(_threshold_regions(spark, d), _frames(signals.events_gated(spark, d)), SR))


@query("silence_refined", f"""WITH {THRESHOLD}, ld AS (SELECT track, frame FROM evs GROUP BY ALL HAVING bool_or(abs(x) > power(10, -60 / 20.0)))
SELECT rg.track, w_begin, w_end, coalesce(max(CASE WHEN abs(ld.frame - frame_begin) <= 50 AND ld.frame < (frame_begin + frame_end) / 2 THEN ld.frame + 1 END), any_value(frame_begin)) AS frame_begin,
    coalesce(min(CASE WHEN abs(ld.frame - frame_end) <= 50 AND ld.frame >= (frame_begin + frame_end) / 2 THEN ld.frame END), any_value(frame_end)) AS frame_end, position
FROM rg LEFT JOIN ld ON ld.track = rg.track GROUP BY rg.track, w_begin, w_end, position""")
def _(spark, d):
    return silence.refine(_threshold_regions(spark, d), signals.events_gated(spark, d), SIL, 50)


@query("zero_crossings_nearest", f"""
WITH {EVENTS}, tn AS (SELECT track, channel, frame FROM (SELECT *, lead(x) OVER (PARTITION BY track, channel ORDER BY frame) AS nx FROM ev) WHERE nx IS NOT NULL AND (x >= 0) <> (nx >= 0)),
tg AS (SELECT DISTINCT track, channel, frame AS target FROM ev)
SELECT tg.track, tg.channel, target, arg_min(frame, (abs(frame - target), frame)) AS crossing FROM tg JOIN tn ON tn.track = tg.track AND tn.channel = tg.channel AND abs(frame - target) <= 200 GROUP BY ALL""")
def _(spark, d):
    x = signals.events_stereo(spark, d)
    return silence.nearest_zero_crossing(x, x.select("track", "channel", F.col("frame").alias("target")), 200)


@query("zero_crossings_all", f"""
WITH {EVENTS}, tn AS (SELECT track, channel, frame, CASE WHEN nx IS NOT NULL AND (x >= 0) <> (nx >= 0) THEN frame END AS turn FROM (SELECT *, lead(x) OVER (PARTITION BY track, channel ORDER BY frame) AS nx FROM ev)),
nr AS (SELECT track, channel, frame AS target, max(turn) OVER (PARTITION BY track, channel ORDER BY frame ROWS UNBOUNDED PRECEDING) AS l, min(turn) OVER (PARTITION BY track, channel ORDER BY frame DESC ROWS UNBOUNDED PRECEDING) AS r FROM tn),
cr AS (SELECT *, CASE WHEN l IS NULL OR r - target < target - l THEN r ELSE l END AS crossing FROM nr)
SELECT track, channel, target, crossing FROM cr WHERE abs(crossing - target) <= 200""")
def _(spark, d):
    x = signals.events_stereo(spark, d)
    return silence.nearest_zero_crossing(x, x.select("track", "channel", F.col("frame").alias("target")), 200)


def _clip_sql(threshold: str, least: int, kind: str) -> str:
    return f"""SELECT track, channel, min(b) AS "begin", max(e) AS "end", CASE WHEN count(*) > 1 THEN max(e) - min(b) ELSE max(n) END AS sample_count, max(peak) AS peak, {kind} AS kind FROM (
        SELECT *, sum(nw) OVER (PARTITION BY track, channel ORDER BY b) AS g FROM (
            SELECT *, CASE WHEN b - max(e) OVER (PARTITION BY track, channel ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS nw FROM (
                SELECT track, channel, min(frame) AS b, max(frame) + 1 AS e, count(*) AS n, max(abs(x)) AS peak
                FROM (SELECT *, frame - row_number() OVER (PARTITION BY track, channel ORDER BY frame) AS i FROM ev WHERE abs(x) >= {threshold}) GROUP BY track, channel, i)))
        GROUP BY track, channel, g HAVING CASE WHEN count(*) > 1 THEN max(e) - min(b) ELSE max(n) END >= {least}"""


CLIPS = f"""{EVENTS}, cl AS (SELECT *, 20*log10(peak) AS peak_dbfs FROM (
    {_clip_sql('(1.0 - 1.0 * (1 - power(10, -6 / 20.0)))', 2, "CASE WHEN max(peak) > 1.0 THEN 'over_full_scale' ELSE 'digital' END")} UNION ALL {_clip_sql('power(10, -1.0 / 20)', 1, "'near_clip'")}))"""


@query("clip_events", f"""WITH {CLIPS} SELECT track, channel, "begin", "end", sample_count, kind, {r6('peak', 'peak')}, {r6('peak_dbfs', 'peak_dbfs')} FROM cl""")
def _(spark, d):
    return rounded(clipping.events(signals.events_stereo(spark, d), CLIP))


@query("clip_totals", f"""WITH {CLIPS}, n AS (SELECT track, count(*) AS samples FROM ev GROUP BY ALL)
SELECT n.track, count(*) FILTER (kind = 'digital') AS n_digital, count(*) FILTER (kind = 'over_full_scale') AS n_over, count(*) FILTER (kind = 'near_clip') AS n_near,
    CAST(coalesce(sum(sample_count) FILTER (kind <> 'near_clip'), 0) AS BIGINT) AS clipped_samples, {r6('coalesce(greatest(0, max(peak_dbfs)), 0)', 'max_overshoot_db')},
    {r6("coalesce(sum(sample_count) FILTER (kind <> 'near_clip'), 0) / any_value(samples)", 'clipped_fraction')} FROM n LEFT JOIN cl USING (track) GROUP BY n.track""")
def _(spark, d):
    x = signals.events_stereo(spark, d)
    return rounded(clipping.totals(clipping.events(x, CLIP), x))


@query("clip_density", f"""WITH {EVENTS}, h AS (SELECT track, frame // 256 AS bin, count(*) AS n FROM ev WHERE abs(x) >= (1.0 - 1.0 * (1 - power(10, -6 / 20.0))) GROUP BY ALL),
m AS (SELECT track, unnest(range(max(bin) + 1)) AS bin FROM h GROUP BY track)
SELECT m.track, m.bin, {r6('least(1, coalesce(n, 0) / (256 * 2))', 'density')} FROM m LEFT JOIN h USING (track, bin)""")
def _(spark, d):
    return rounded(clipping.density(signals.events_stereo(spark, d), CLIP))


@query("clip_flat_top", f"""WITH {EVENTS}, b AS (SELECT track, channel, greatest(0, least(600, floor((20*log10(abs(x)) + 60) * 10 + 0.5))) AS b, count(*) AS n FROM ev WHERE abs(x) > 0 GROUP BY ALL),
g AS (SELECT track, channel, sum(CASE WHEN b >= top - 5 THEN n ELSE 0 END) / sum(n) AS r FROM b JOIN (SELECT track, channel, max(b) AS top FROM b GROUP BY ALL) USING (track, channel) GROUP BY ALL)
SELECT track, channel, {r6('r', 'flat_top_ratio')}, r >= 0.3 AS heavy_limiting FROM g""")
def _(spark, d):
    return rounded(clipping.flat_top(signals.events_stereo(spark, d)))


@query("clip_plateaus", f"""WITH {EVENTS}, q AS (SELECT track, channel, frame, round(x * 4) / 4 AS x FROM ev),
g AS (SELECT *, sum(nw) OVER (PARTITION BY track, channel ORDER BY frame) AS g FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY track, channel ORDER BY frame) THEN 0 ELSE 1 END AS nw FROM q)),
r AS (SELECT track, channel, count(*) AS n FROM g GROUP BY track, channel, g HAVING count(*) >= 2)
SELECT track, channel, count(*) AS plateaus, {r6('avg(n)', 'mean_length')} FROM r GROUP BY ALL""")
def _(spark, d):
    return rounded(clipping.plateaus(signals.events_stereo(spark, d).withColumn("x", F.round(F.col("x") * 4) / 4)))


@query("clip_worst", f"""WITH {CLIPS} SELECT track, channel, "begin", "end", sample_count, kind, {r6('peak', 'peak')}, {r6('peak_dbfs', 'peak_dbfs')} FROM cl ORDER BY cl.peak_dbfs DESC, "begin", channel, kind LIMIT 10""")
def _(spark, d):
    return rounded(clipping.worst(clipping.events(signals.events_stereo(spark, d), CLIP), 10))


Z = f"{LINE}, bl AS (SELECT track, frame // 10 AS b, avg(x*x) AS z FROM ln GROUP BY ALL HAVING count(*) = 10)"


def _slide(name: str, k: int) -> str:
    return f"{name} AS (SELECT track, rn - {k} AS w, z FROM (SELECT track, avg(z) OVER (PARTITION BY track ORDER BY b ROWS {k - 1} PRECEDING) AS z, row_number() OVER (PARTITION BY track ORDER BY b) AS rn FROM bl) WHERE rn >= {k})"


def _z(spark, d):
    return loudness.blocks(signals.line_mono(spark, d), 100, 1)


LUFS = "-0.691 + 10*log10(z)"


@query("loudness_blocks", f"WITH {Z} SELECT track, b, {r6('z', 'z')} FROM bl")
def _(spark, d):
    return rounded(_z(spark, d))


@query("loudness_momentary", f"WITH {Z}, {_slide('mo', 4)} SELECT track, w, {r6('z', 'z')}, {r6(LUFS, 'lufs')} FROM mo")
def _(spark, d):
    return rounded(loudness.momentary(_z(spark, d)))


@query("loudness_short_term", f"WITH {Z}, {_slide('st', 30)} SELECT track, w, {r6('z', 'z')}, {r6(LUFS, 'lufs')} FROM st")
def _(spark, d):
    return rounded(loudness.short_term(_z(spark, d)))


@query("loudness_integrated", f"""WITH {Z}, {_slide('mo', 4)}, lo AS (SELECT * FROM mo WHERE z >= power(10, (-70 + 0.691) / 10)),
ba AS (SELECT track, avg(z) * power(10, -10 / 10.0) AS bar FROM lo GROUP BY ALL), g AS (SELECT track, -0.691 + 10*log10(avg(z)) AS i FROM lo JOIN ba USING (track) WHERE z >= bar GROUP BY ALL)
SELECT m.track, {r6('i', 'integrated_lufs')} FROM (SELECT DISTINCT track FROM mo) m LEFT JOIN g USING (track)""")
def _(spark, d):
    return rounded(loudness.integrated(loudness.momentary(_z(spark, d))))


@query("loudness_range", f"""WITH {Z}, {_slide('s0', 30)}, st AS (SELECT * FROM s0 WHERE w % 10 = 0 AND z >= power(10, (-70 + 0.691) / 10)), ba AS (SELECT track, avg(z) * power(10, -20 / 10.0) AS bar FROM st GROUP BY ALL),
k AS (SELECT track, z, row_number() OVER (PARTITION BY track ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM st JOIN ba USING (track) WHERE z >= bar)
SELECT track, {r6(f'max(CASE WHEN i = round(0.95 * (n - 1)) THEN {LUFS} END) - max(CASE WHEN i = round(0.10 * (n - 1)) THEN {LUFS} END)', 'lra')}, max(n) AS windows FROM k GROUP BY track""")
def _(spark, d):
    return rounded(loudness.loudness_range(_z(spark, d)))


@query("channel_weights", """WITH c AS (SELECT event_id % 8 + 1 AS n, user_id % (event_id % 8 + 1) AS c, value FROM events), w AS (SELECT n, c, value, CASE WHEN n = 5 AND c >= 3 THEN 1.41 WHEN n = 6 AND c = 3 THEN 0 WHEN n = 6 AND c >= 4 THEN 1.41 ELSE 1 END AS weight FROM c)
SELECT CAST(n AS INTEGER) AS channels, CAST(c AS INTEGER) AS channel, CAST(any_value(weight) AS DOUBLE) AS weight, round(sum(weight * value), 4) AS weighted FROM w GROUP BY n, c""")
def _(spark, d):
    """Weighted sums of the events' values, as samples of one to eight channels."""
    e = signals.read(spark, d, "events").select((F.col("event_id") % 8 + 1).cast("int").alias("channels"), "user_id", "value")
    e = e.withColumn("channel", (F.col("user_id") % F.col("channels")).cast("int"))
    weight = F.coalesce(*[F.when(F.col("channels") == n, loudness.channel_weight(n).cast("double")) for n in range(1, 9)])
    g = e.withColumn("weight", weight).groupBy("channels", "channel").agg(F.max("weight").alias("weight"), F.sum(F.col("weight") * F.col("value")).alias("weighted"))
    return rounded(g, 4)


# 800 frames are 100 ms
KW = f"""WITH RECURSIVE {EVENTS}, {k_weighted(loudness.shelf_coefficients(8000), loudness.highpass_coefficients(8000), 'ev')}"""
BLOCKS = "zb AS (SELECT track, b, sum(ms) AS z FROM (SELECT track, channel, frame // 800 AS b, avg(y * y) AS ms FROM kw_ GROUP BY ALL HAVING count(*) = 800) GROUP BY track, b)"
SLIDING = """mo AS (SELECT track, avg(z) OVER w AS z FROM zb WINDOW w AS (PARTITION BY track ORDER BY b ROWS 3 PRECEDING) QUALIFY count(*) OVER w = 4),
sh AS (SELECT track, z FROM (SELECT track, b, avg(z) OVER w AS z, count(*) OVER w AS n, row_number() OVER (PARTITION BY track ORDER BY b) - 30 AS i FROM zb WINDOW w AS (PARTITION BY track ORDER BY b ROWS 29 PRECEDING)) WHERE n = 30 AND i % 10 = 0)"""
GATE = 10 ** ((-70 + 0.691) / 10)
INTEGRATED = f"ig AS (SELECT track, -0.691 + 10 * log10(avg(z)) AS integrated_lufs FROM mo JOIN (SELECT track, avg(z) / 10 AS bar FROM mo WHERE z >= {GATE!r} GROUP BY track) USING (track) WHERE z >= {GATE!r} AND z >= bar GROUP BY track)"
RANGE = f"""rk AS (SELECT track, z, row_number() OVER (PARTITION BY track ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM sh JOIN (SELECT track, avg(z) / 100 AS bar FROM sh WHERE z >= {GATE!r} GROUP BY track) USING (track) WHERE z >= {GATE!r} AND z >= bar),
lr AS (SELECT track, max(-0.691 + 10 * log10(z)) FILTER (i = round(0.95 * (n - 1))) - max(-0.691 + 10 * log10(z)) FILTER (i = round(0.10 * (n - 1))) AS lra, max(n) AS windows FROM rk GROUP BY track)"""


@query("loudness_k_weighted", f"""{KW}, {BLOCKS}, {SLIDING}, {INTEGRATED}, {RANGE} SELECT track, {r6('integrated_lufs', 'integrated_lufs')}, {r6('lra', 'lra')}, windows FROM (SELECT DISTINCT track FROM mo) LEFT JOIN ig USING (track) LEFT JOIN lr USING (track)""")
def _(spark, d):
    """Integrated loudness and range of the K-weighted stereo signal."""
    y = loudness.k_weighted(signals.events_stereo(spark, d), 8000, chunk=1024)
    z = loudness.blocks(y, 8000, 2)
    return rounded(loudness.integrated(loudness.momentary(z)).join(loudness.loudness_range(z), "track", "left"))


UP4 = f"WITH {EVENTS}, {interpolation(4, 1, *loudness.QUALITY['best'], 'ev')}"


@query("true_peak", f"""{UP4} SELECT track, channel, {r6('max(abs(y))', 'true_peak')}, CAST(round_even(arg_max(n, abs(y)) / 4, 0) AS BIGINT) AS frame, {r6('20 * log10(max(abs(y)))', 'dbtp')} FROM up_ GROUP BY ALL""")
def _(spark, d):
    return rounded(loudness.true_peak(signals.events_stereo(spark, d), chunk=4096))


ISP = f"""{UP4}, sp_ AS (SELECT track, channel, frame // 4096 AS c, max(abs(x)) AS sample_peak FROM ev GROUP BY ALL),
isp AS (SELECT track, channel, CAST(round_even(n / 4, 0) AS BIGINT) AS frame, abs(y) AS peak, sample_peak FROM up_ JOIN sp_ USING (track, channel) WHERE abs(y) > 1 AND c = (n // 4) // 4096)"""


@query("inter_sample_peaks", f"""{ISP} SELECT track, channel, frame, {r6('peak', 'peak')}, {r6('sample_peak', 'sample_peak')} FROM isp""")
def _(spark, d):
    return rounded(loudness.inter_sample_peaks(signals.events_stereo(spark, d), threshold_db=0.0, chunk=4096))
