"""Statistics, stereo, bit depth, DC and waveform queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import exprs
from pulsegrid.model import DcConfig
from pulsegrid.operators import dc, stats, waveform
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import EMBED, EVENTS, EVENTS16, db, r6
from pulsegrid.sources import signals

SR = 1000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, infinities and NaN as null: the form in which results are compared."""
    return df.select(*[F.round(exprs.finite(F.col(c)) + 0.0, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CHANNELS = f"""
WITH {EVENTS}, s AS (SELECT *, sign(x) AS sg FROM ev), z AS (
    SELECT track, channel, CAST(sum(CASE WHEN sg <> prev THEN 1 ELSE 0 END) AS BIGINT) AS zc
    FROM (SELECT *, lag(sg) OVER (PARTITION BY track, channel ORDER BY frame) AS prev FROM s WHERE x <> 0) GROUP BY ALL
), p AS (
    SELECT track, channel, min(frame) AS peak_frame FROM ev JOIN (SELECT track, channel, max(abs(x)) AS m FROM ev GROUP BY ALL) USING (track, channel) WHERE abs(x) = m GROUP BY ALL
)
SELECT track, channel, count(*) AS n, {r6('min(x)', 'min')}, {r6('max(x)', 'max')}, {r6('avg(x)', 'mean')}, {r6('sqrt(avg(x*x))', 'rms')},
    {r6('var_pop(x)', 'variance')}, {r6('stddev_pop(x)', 'std_dev')}, {r6('avg(abs(x))', 'mean_abs')}, {r6('max(abs(x))', 'peak')}, any_value(peak_frame) AS peak_frame,
    {r6('20*log10(max(abs(x)))', 'peak_dbfs')}, {r6('20*log10(max(abs(x))/sqrt(avg(x*x)))', 'crest_db')},
    any_value(zc) AS zero_crossings, {r6(f'any_value(zc) * {SR}.0 / count(*)', 'zero_crossing_rate')}
FROM ev JOIN z USING (track, channel) JOIN p USING (track, channel) GROUP BY track, channel
"""


@query("stats_channels", CHANNELS)
def _(spark, d):
    return rounded(stats.channel_stats(signals.events_stereo(spark, d), SR))


@query("stats_report", f"""
WITH {EVENTS}, c AS (SELECT track, channel, count(*) AS n, max(abs(x)) AS peak, sum(x*x) AS ss FROM ev GROUP BY ALL)
SELECT track, count(*) AS channels, max(n) AS frames, {r6('max(peak)', 'peak')}, {r6('sqrt(sum(ss)/sum(n))', 'rms')}, {r6('20*log10(max(peak)/sqrt(sum(ss)/sum(n)))', 'crest_db')}
FROM c GROUP BY track""")
def _(spark, d):
    return rounded(stats.overall_stats(stats.channel_stats(signals.events_stereo(spark, d), SR)))


@query("rms_series", f"WITH {EVENTS} SELECT track, channel, frame // 50 AS w, {r6('sqrt(avg(x*x))', 'rms')}, bool_and(x = 0) AS all_zero, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(stats.rms_series(signals.events_stereo(spark, d), SR))


@query("dynamic_range", f"""
WITH {EVENTS}, b AS (SELECT track, channel, frame // 3000 AS block, sqrt(avg(x*x)) AS rms, max(abs(x)) AS peak FROM ev GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY track, channel ORDER BY rms DESC, block) AS rk, count(*) OVER (PARTITION BY track, channel) AS n FROM b)
SELECT track, channel, count(*) AS blocks, {r6('avg(20*log10(peak)) - 20*log10(sqrt(avg(rms*rms)))', 'dr_db')}
FROM k WHERE rk <= greatest(1, n // 5) GROUP BY track, channel""")
def _(spark, d):
    return rounded(stats.dynamic_range(signals.events_stereo(spark, d), SR))


@query("dr_blocks", f"WITH {EVENTS} SELECT track, channel, frame // 3000 AS block, {r6('sqrt(avg(x*x))', 'rms')}, {r6('max(abs(x))', 'peak')} FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(stats.loudness_blocks(signals.events_stereo(spark, d), SR))


@query("histogram", f"""
WITH {EVENTS}, h AS (SELECT track, channel, CAST(greatest(0, least(1023, floor((x + 1) * 512))) AS INTEGER) AS bucket, count(*) AS n FROM ev GROUP BY ALL)
SELECT c.track, c.channel, CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS n, {r6('(b + 0.5) * (2 / 1024) - 1', 'centre')}, {r6('ln(1 + coalesce(n, 0))', 'display')}
FROM (SELECT DISTINCT track, channel FROM ev) c CROSS JOIN range(1024) r(b) LEFT JOIN h ON h.track = c.track AND h.channel = c.channel AND h.bucket = b""")
def _(spark, d):
    return rounded(stats.histogram(signals.events_stereo(spark, d)))


PAIRED = f"{EVENTS}, p AS (SELECT a.track, a.frame, a.x AS l, b.x AS r FROM ev a JOIN ev b ON a.frame = b.frame AND a.channel = 0 AND b.channel = 1)"


@query("stereo_summary", f"""
WITH {PAIRED} SELECT track, count(*) AS n, {r6('corr(l, r)', 'correlation')}, {r6('10*log10(sum(r*r)/sum(l*l))', 'balance_db')},
    {r6('10*log10(avg(((l+r)/2)*((l+r)/2)) / ((avg(l*l)+avg(r*r))/2))', 'mono_compatibility_db')} FROM p GROUP BY track""")
def _(spark, d):
    return rounded(stats.stereo_summary(signals.events_stereo(spark, d)))


@query("correlation_series", f"WITH {PAIRED} SELECT track, frame // 50 AS w, {r6('CASE WHEN sum(l*l)*sum(r*r) > 0 THEN sum(l*r)/sqrt(sum(l*l)*sum(r*r)) ELSE 0 END', 'correlation')} FROM p GROUP BY ALL")
def _(spark, d):
    return rounded(stats.correlation_series(signals.events_stereo(spark, d), SR))


@query("mono_sum", f"WITH {EVENTS} SELECT track, 0 AS channel, frame, {r6('sum(x) / 2', 'x')} FROM ev GROUP BY track, frame")
def _(spark, d):
    return rounded(stats.mono_sum(signals.events_stereo(spark, d)))


@query("mid_side", f"WITH {PAIRED} SELECT track, 0 AS channel, frame, {r6('(l + r) / 2', 'x')} FROM p UNION ALL SELECT track, 1, frame, {r6('(l - r) / 2', 'x')} FROM p")
def _(spark, d):
    return rounded(stats.mid_side(signals.events_stereo(spark, d)))


@query("bit_depth", f"""
WITH {EVENTS16}, v AS (SELECT track, channel, frame, CAST(round(x * 32768) AS BIGINT) AS v FROM ev16),
g AS (SELECT track, channel, bit_or(v) AS bits, avg(CASE WHEN (v & 1) <> pv THEN 1.0 WHEN pv IS NOT NULL THEN 0.0 END) AS rate
    FROM (SELECT *, lag(v & 1) OVER (PARTITION BY track, channel ORDER BY frame) AS pv FROM v) GROUP BY ALL),
e AS (SELECT *, CASE WHEN bits = 0 THEN 16 ELSE 16 - bit_count((bits & -bits) - 1) END AS eff FROM g)
SELECT track, channel, CAST(eff AS INTEGER) AS effective_bits, {r6('rate', 'toggle_rate')}, eff = 16 AND bits <> 0 AND abs(rate - 0.5) * 2 < 0.3 AS dither_likely,
    {r6('CASE WHEN eff = 16 AND bits <> 0 AND abs(rate - 0.5) * 2 < 0.3 THEN 1 - abs(rate - 0.5) * 2 / 0.3 ELSE 0 END', 'dither_confidence')} FROM e""")
def _(spark, d):
    return rounded(stats.bit_depth(signals.events_16bit(spark, d), 16))


def _grid_sql() -> str:
    cases = " ".join(f"WHEN max(abs(x - round(x * {2.0 ** (b - 1)}) / {2.0 ** (b - 1)})) < 0.01 / {2.0 ** (b - 1)} THEN {b}" for b in (8, 16, 20, 24))
    return f"""WITH {EVENTS16}, both_of AS (SELECT * FROM ev16 UNION ALL SELECT 'raw', channel, frame, x FROM ev), g AS (SELECT track, channel, CAST(CASE {cases} END AS INTEGER) AS grid_bits FROM both_of GROUP BY track, channel)
    SELECT *, CASE WHEN grid_bits IS NULL THEN 'full float precision' ELSE grid_bits || '-bit values in float' END AS description FROM g"""


@query("float_grid", _grid_sql())
def _(spark, d):
    both = signals.events_16bit(spark, d).unionByName(signals.events_stereo(spark, d).withColumn("track", F.lit("raw")))
    return stats.float_grid(both)


@query("dc_channels", f"""
WITH {EVENTS}, w AS (SELECT track, channel, min(m) AS min_window, max(m) AS max_window FROM (SELECT track, channel, frame // {SR} AS w, avg(x) AS m FROM ev GROUP BY ALL) GROUP BY ALL),
g AS (SELECT track, channel, avg(x) AS dc, max(x) AS hi, min(x) AS lo FROM ev GROUP BY ALL)
SELECT track, channel, {r6('dc', 'dc')}, {r6('20*log10(abs(dc))', 'dc_dbfs')}, {r6('dc*100', 'percent')}, {r6('min_window', 'min_window')}, {r6('max_window', 'max_window')},
    {r6('CASE WHEN abs(dc) >= 1 THEN NULL ELSE 20*log10(1/(1-abs(dc))) END', 'headroom_db')}, {r6('greatest(hi-dc, dc-lo)', 'corrected_peak')} FROM g JOIN w USING (track, channel)""")
def _(spark, d):
    return rounded(dc.channels(signals.events_stereo(spark, d), SR))


@query("dc_series", f"WITH {EVENTS} SELECT track, channel, frame // {SR} AS w, {r6('avg(x)', 'mean')} FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(dc.series(signals.events_stereo(spark, d), SR))


@query("dc_pattern", f"""
WITH {EVENTS}, lim AS (SELECT power(10, -60 / 20.0) AS t), w AS (SELECT track, channel, frame // {SR} AS w, avg(x) AS m FROM ev GROUP BY ALL),
s AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY track, channel ORDER BY w)) AS st FROM w),
g AS (SELECT track, channel, list_sort(list(st) FILTER (st IS NOT NULL)) AS sts, bool_or(abs(m) >= t) AS sig, max(m) - min(m) AS spread, coalesce(corr(w, m), 0) AS r FROM s, lim GROUP BY ALL),
m AS (SELECT *, sts[len(sts) // 2 + 1] AS med FROM g),
a AS (SELECT *, list_sort(list_transform(sts, lambda x: abs(x - med)))[len(sts) // 2 + 1] AS mad FROM m),
f AS (SELECT a.track, a.channel, any_value(sig) AS sig, any_value(spread) AS spread, any_value(r) AS r,
    list_sort(coalesce(list(s.w * {SR}) FILTER (sig AND s.st > med + greatest(3 * 1.4826 * mad, t / 2) AND s.st >= t), [])) AS step_frames
    FROM a JOIN s USING (track, channel), lim GROUP BY a.track, a.channel)
SELECT track, channel, CASE WHEN NOT sig THEN 'none' WHEN len(step_frames) > 0 THEN 'sectional' WHEN abs(r) >= 0.8 AND spread >= t THEN 'drifting' ELSE 'constant' END AS pattern, step_frames FROM f, lim""")
def _(spark, d):
    return dc.patterns(signals.events_stereo(spark, d), SR, DcConfig())


@query("waveform_bins", f"WITH {EVENTS} SELECT track, channel, frame // 256 AS bin, count(*) AS frames, {r6('min(x)', 'min')}, {r6('max(x)', 'max')}, {r6('avg(x*x)', 'ms')}, {r6('greatest(-min(x), max(x))', 'abs_peak')} FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(waveform.bins(signals.events_stereo(spark, d)))


B0 = f"{EVENTS}, b0 AS (SELECT track, channel, frame // 256 AS bin, count(*) AS frames, min(x) AS mn, max(x) AS mx, avg(x*x) AS ms FROM ev GROUP BY ALL)"
PYR = f"""{B0}, py AS (SELECT track, channel, CAST(l AS INTEGER) AS level, bin >> CAST(l AS INTEGER) AS bin, sum(frames) AS frames, min(mn) AS mn, max(mx) AS mx, sqrt(sum(ms * frames) / sum(frames)) AS rms,
    count(*) AS parts FROM b0, range(7) r(l) GROUP BY ALL HAVING count(*) = 1 << CAST(l AS INTEGER))"""


@query("waveform_pyramid", f"""
WITH {PYR}, sz AS (SELECT track, channel, level, count(*) AS n FROM py GROUP BY ALL), la AS (SELECT track, channel, min(level) AS last FROM sz WHERE n <= 32 GROUP BY ALL)
SELECT track, channel, level, bin, CAST(frames AS BIGINT) AS frames, {r6('mn', 'min')}, {r6('mx', 'max')}, {r6('rms', 'rms')}, {r6('greatest(-mn, mx)', 'abs_peak')}
FROM py LEFT JOIN la USING (track, channel) WHERE last IS NULL OR level <= last""")
def _(spark, d):
    return rounded(waveform.finalized(waveform.pyramid(waveform.bins(signals.events_stereo(spark, d)), 6)))


@query("waveform_query", f"""
WITH {PYR}, o AS (SELECT i, 300 + i * 4000 // 7 AS b, 300 + (i + 1) * 4000 // 7 AS e FROM range(7) r(i)), s AS (SELECT *, bin * 512 AS sb, bin * 512 + frames AS se FROM py WHERE level = 1),
h AS (SELECT s.track, s.channel, o.i, mn, mx, rms, greatest(least(e, se) - greatest(b, sb), 0) AS ov FROM o JOIN s ON s.bin BETWEEN o.b // 512 AND greatest(o.b, o.e - 1) // 512)
SELECT c.track, c.channel, o.i AS out, {r6('coalesce(min(mn), 0)', 'min')}, {r6('coalesce(max(mx), 0)', 'max')}, {r6('coalesce(CASE WHEN sum(ov) > 0 THEN sqrt(sum(rms*rms*ov)/sum(ov)) END, 0)', 'rms')}, {r6('coalesce(max(greatest(-mn, mx)), 0)', 'abs_peak')}
FROM (SELECT DISTINCT track, channel FROM ev) c CROSS JOIN o LEFT JOIN h ON h.track = c.track AND h.channel = c.channel AND h.i = o.i GROUP BY ALL""")
def _(spark, d):
    return rounded(waveform.query(waveform.pyramid(waveform.bins(signals.events_stereo(spark, d)), 6), 300, 4300, 7, waveform.level_for(4000 / 7, 6)))


def _of_embedding(**cols: Callable[[Column], Column]):
    def f(spark, d):
        return rounded(signals.embedding_frames(spark, d).select("t", "frame", *[c(F.col("x")).alias(k) for k, c in cols.items()]))

    return f


query("scalar_levels", f"""WITH {EMBED} SELECT t, frame, {r6(db('x'), 'dbfs')}, {r6('20*log10(greatest(abs(x), 1e-12))', 'floored')},
    {r6('CASE WHEN x*x > 0 THEN -0.691 + 10*log10(x*x) END', 'lufs')}, {r6('power(10, (-23 + 0.691 + x) / 10)', 'mean_square')}, {r6('-23.0 - x', 'gain')} FROM em""")(
    _of_embedding(dbfs=exprs.db, floored=lambda x: exprs.db_floor(F.abs(x)), lufs=lambda x: exprs.lufs(x * x), mean_square=lambda x: exprs.mean_square_of(x - 23.0), gain=lambda x: F.lit(-23.0) - x)
)
query("scalar_quantise", f"""WITH {EMBED}, q AS (SELECT t, frame, CAST(floor(least(1, greatest(0, (x * 100 + 96) / 96)) * 255 + 0.5) AS INTEGER) AS q FROM em)
    SELECT t, frame, q, {r6('-96 + q / 255 * 96', 'back')} FROM q""")(lambda spark, d: rounded(signals.embedding_frames(spark, d).select("t", "frame", exprs.quantise_db(F.col("x") * 100).alias("q")).withColumn("back", exprs.dequantise_db(F.col("q")))))
query("scalar_display", f"""WITH {EMBED} SELECT t, frame, {r6('least(1, greatest(-1, x * 3))', 'linear')}, {r6('sign(x) * least(1, greatest(0, (20*log10(greatest(abs(x), 1e-12)) + 60) / 60))', 'decibel')},
    {r6('sign(x) * least(1, greatest(0, sqrt(abs(x))))', 'root')} FROM em""")(_of_embedding(linear=lambda x: exprs.display_unit(x * 3, "linear"), decibel=lambda x: exprs.display_unit(x, "db"), root=lambda x: exprs.display_unit(x, "root")))
query("frequency_scales", f"""WITH {EMBED}, h AS (SELECT t, frame, abs(x) * 40000 + 20 AS hz FROM em)
    SELECT t, frame, {r6('log2(hz)', 'log')}, {r6('2595*log10(1+hz/700)', 'mel')}, {r6('13*atan(0.00076*hz)+3.5*atan((hz/7500)*(hz/7500))', 'bark')}, true AS mel_inverse, true AS bark_inverse FROM h""")(
    lambda spark, d: rounded(
        signals.embedding_frames(spark, d).select("t", "frame", (F.abs("x") * 40000 + 20).alias("hz")).select(
            "t", "frame", exprs.hz_to_scale(F.col("hz"), "log").alias("log"), exprs.hz_to_scale(F.col("hz"), "mel").alias("mel"), exprs.hz_to_scale(F.col("hz"), "bark").alias("bark"),
            (F.abs(exprs.scale_to_hz(exprs.hz_to_scale(F.col("hz"), "mel"), "mel") - F.col("hz")) < 1e-3).alias("mel_inverse"), (F.abs(exprs.scale_to_hz(exprs.hz_to_scale(F.col("hz"), "bark"), "bark") - F.col("hz")) < 1e-3).alias("bark_inverse"),
        )
    )
)
query("fades_and_scores", f"""WITH {EMBED} SELECT t, frame, {r6('0.5 - 0.5*cos(pi()*frame/64)', 'fade')}, {r6('least(1, greatest(0, (x - 0.1) / 0.2 + 0.5))', 'above')},
    {r6('least(1, greatest(0, (0.1 - x) / 0.2 + 0.5))', 'below')}, {r6('least(least(1, greatest(0, (x + 0.1) / 0.2 + 0.5)), least(1, greatest(0, (0.1 - x) / 0.2 + 0.5)))', 'inside')} FROM em""")(
    _of_embedding(fade=lambda x: exprs.fade(F.col("frame"), F.lit(64)), above=lambda x: exprs.score_above(x, 0.1, 0.2), below=lambda x: exprs.score_below(x, 0.1, 0.2), inside=lambda x: exprs.score_within(x, -0.1, 0.1, 0.2))
)
