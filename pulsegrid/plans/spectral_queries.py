"""Spectral, beat and transient queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.model import PeakPickConfig, StftConfig, TempoConfig, TileConfig
from pulsegrid.operators import beats, spectral, transients
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import EMBED, EVENTS, EVENTS_HALF, r6
from pulsegrid.plans.stats_queries import SR, rounded
from pulsegrid.sources import signals

DFT = f"""{EMBED}, ff AS (SELECT t, k, sum(x * cos(2*pi()*k*frame/64)) AS re, -sum(x * sin(2*pi()*k*frame/64)) AS im FROM em, range(33) r(k) GROUP BY ALL)"""


def _arrays(spark, d):
    e = signals.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.col("embedding").alias("x"))


def _spectrum(spark, d):
    return spectral.transform(_arrays(spark, d), ["t"], "x")


def _mag(spark, d):
    return _spectrum(spark, d).select("t", "k", F.hypot("re", "im").alias("mag"))


@query("fft", f"WITH {DFT} SELECT t, CAST(k AS INTEGER) AS k, {r6('re', 're')}, {r6('im', 'im')} FROM ff")
def _(spark, d):
    return rounded(_spectrum(spark, d))


@query("fft_inverse", f"WITH {EMBED} SELECT t, CAST(frame AS INTEGER) AS i, {r6('x', 'x')} FROM em")
def _(spark, d):
    return rounded(spectral.inverse(_spectrum(spark, d), ["t"], 64))


@query("fft_magnitude", f"WITH {DFT} SELECT t, CAST(k AS INTEGER) AS k, {r6('sqrt(re*re+im*im)', 'magnitude')}, {r6('re*re+im*im', 'power')}, {r6('sqrt(re*re+im*im) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / 64', 'amplitude')} FROM ff")
def _(spark, d):
    m = _spectrum(spark, d).withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im")).withColumn("magnitude", F.sqrt("power"))
    return rounded(m.select("t", "k", "magnitude", "power", (F.col("magnitude") * F.when(F.col("k").isin(0, 32), 1).otherwise(2) / 64).alias("amplitude")))


WINDOWS = {
    "rect": "1.0",
    "hann": "0.5 - 0.5*cos(w)",
    "hamming": "0.54 - 0.46*cos(w)",
    "blackman": "0.42 - 0.5*cos(w) + 0.08*cos(2*w)",
    "blackman_harris": "0.35875 - 0.48829*cos(w) + 0.14128*cos(2*w) - 0.01168*cos(3*w)",
}
WIN_SQL = "wn AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, i, {e} AS v FROM (SELECT i, 2*pi()*i/64 AS w FROM range(64) r(i))" for n, e in WINDOWS.items()) + ")"


@query("windows", f"WITH {WIN_SQL} SELECT name, {r6('avg(v)', 'coherent_gain')}, {r6('sum(v*v)*count(*)/(sum(v)*sum(v))', 'noise_bandwidth')} FROM wn GROUP BY name")
def _(spark, d):
    out = None
    for n in WINDOWS:
        one = spectral.window_figures(spectral.window_table(spark, n, 64)).select(F.lit(n).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("spectral_features", f"""WITH {DFT}, b AS (SELECT t, k, CAST(k * 125 AS DOUBLE) AS f, sqrt(re*re+im*im) AS m, re*re+im*im AS p FROM ff),
c AS (SELECT *, sum(p) OVER (PARTITION BY t ORDER BY k) AS cum, sum(p) OVER (PARTITION BY t) AS al FROM b),
g AS (SELECT t, sum(m*f)/sum(m) AS c, sum(m*f*f)/sum(m) AS m2, min(f) FILTER (cum >= 0.85*al) AS r85, min(f) FILTER (cum >= 0.95*al) AS r95,
    exp(avg(ln(p+1e-12)) FILTER (k > 0)) / (avg(p+1e-12) FILTER (k > 0)) AS flat, coalesce(sum(p) FILTER (f < 150), 0)/sum(p) AS b1, coalesce(sum(p) FILTER (f >= 150 AND f < 1000), 0)/sum(p) AS b2,
    coalesce(sum(p) FILTER (f >= 1000 AND f < 5000), 0)/sum(p) AS b3, coalesce(sum(p) FILTER (f >= 5000), 0)/sum(p) AS b4 FROM c GROUP BY t)
SELECT t, {r6('c', 'centroid', 4)}, {r6('r85', 'rolloff85')}, {r6('r95', 'rolloff95')}, {r6('flat', 'flatness')}, {r6('b1', 'share_low')}, {r6('b2', 'share_lowmid')}, {r6('b3', 'share_highmid')}, {r6('b4', 'share_high')}, {r6('sqrt(greatest(0, m2 - c*c))', 'spread', 4)} FROM g""")
def _(spark, d):
    f = spectral.features(_mag(spark, d), ["t"], 125.0)
    return rounded(f.withColumn("centroid", F.round("centroid", 4)).withColumn("spread", F.round("spread", 4)))


@query("spectral_peak", f"""WITH {DFT}, b AS (SELECT t, k, 20*log10(greatest(sqrt(re*re+im*im), 1e-12)) AS l FROM ff), n AS (SELECT *, lag(l) OVER (PARTITION BY t ORDER BY k) AS a, lead(l) OVER (PARTITION BY t ORDER BY k) AS b FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN l > a AND l > b THEN 0 ELSE 1 END, CASE WHEN l > a AND l > b THEN abs(k - 12) END, CASE WHEN l > a AND l > b THEN k END, l DESC, k) AS rn FROM n WHERE abs(k - 12) <= 4),
o AS (SELECT *, CASE WHEN a - 2*l + b < 0 THEN greatest(-0.5, least(0.5, 0.5*(a - b)/(a - 2*l + b))) ELSE 0 END AS off FROM q WHERE rn = 1)
SELECT t, CAST(k AS INTEGER) AS k, round(off, 4) AS "offset", round(l - 0.25*(a - b)*off, 4) AS level FROM o""")
def _(spark, d):
    p = spectral.peak_near(_mag(spark, d), ["t"], 12.0)
    return p.select("t", "k", F.round(F.col("offset") + 0.0, 4).alias("offset"), F.round("level", 4).alias("level"))


def _framed(size: int, hop: int) -> str:
    """The samples i of each frame t of the centred frames of the events."""
    return f"""{EVENTS}, n AS (SELECT track, channel, max(frame) + 1 AS n FROM ev GROUP BY ALL), p AS (SELECT track, channel, frame + {size // 2} AS ps, x, n FROM ev JOIN n USING (track, channel)),
fr AS (SELECT track, channel, t, ps - t * {hop} AS i, x FROM (SELECT *, unnest(range(CAST(greatest(0, floor((ps - {size}) / {hop}.0) + 1) AS BIGINT), least(ps // {hop}, n // {hop}) + 1)) AS t FROM p))"""


@query("stft_frames", f"WITH {_framed(128, 32)} SELECT track, channel, t, count(*) FILTER (x <> 0) AS filled, {r6('sum(x)', 'total')}, {r6('sum(x * i)', 'moment', 3)} FROM fr GROUP BY ALL")
def _(spark, d):
    f = spectral.frames_of(signals.events_stereo(spark, d), 128, 32, True)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    moment = F.aggregate(F.transform("x", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return f.select("track", "channel", "t", F.size(F.filter("x", lambda v: v != 0)).cast("long").alias("filled"), F.round(total, 6).alias("total"), F.round(moment, 3).alias("moment"))


@query("stft", f"""WITH {_framed(128, 64)}, sp AS (SELECT track, channel, t, k, sum(x * (0.5 - 0.5*cos(2*pi()*i/128)) * cos(2*pi()*k*i/128)) AS re, sum(x * (0.5 - 0.5*cos(2*pi()*i/128)) * sin(2*pi()*k*i/128)) AS im FROM fr, range(65) r(k) GROUP BY ALL)
SELECT track, channel, t, CAST(k AS INTEGER) AS k, {r6('sqrt(re*re+im*im) * (CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END) / 64', 'mag')} FROM sp""")
def _(spark, d):
    s = spectral.stft(signals.events_stereo(spark, d), SR, StftConfig(128, 64))
    return rounded(s.select("track", "channel", "t", F.posexplode("mag").alias("k", "mag")))


@query("spectrogram_tiles")
def _(spark, d):
    return spectral.tiles(signals.events_stereo(spark, d), SR, 0, TileConfig(size=256, rows=32, columns=64))


@query("spectrogram_overview")
def _(spark, d):
    return spectral.overview(signals.events_stereo(spark, d), SR, 24, TileConfig(size=256, rows=32))


@query("frequency_rows")
def _(spark, d):
    return rounded(spectral.frequency_rows(spark, 64, 1024, 48_000, "mel", 20.0))


# The magnitudes of the embeddings' components stand for a spectrogram: frame t is a vector, bin k a component.
SPEC = f"{EMBED}, sp AS (SELECT t // 100 AS track, t % 100 AS t, frame AS k, abs(x) AS mag, x AS re, x * 0.5 AS im FROM em)"


def _spec(spark, d):
    e = signals.embedding_frames(spark, d)
    return e.select(F.floor(F.col("t") / 100).alias("track"), (F.col("t") % 100).alias("t"), F.col("frame").alias("k"), F.abs("x").alias("mag"), F.col("x").alias("re"), (F.col("x") * 0.5).alias("im"))


@query("odf_flux", f"""WITH {SPEC}, l AS (SELECT track, t, k, ln(1 + 1000*mag) AS lm FROM sp), q AS (SELECT track, t, k, greatest(0, coalesce(lm - lag(lm) OVER (PARTITION BY track, k ORDER BY t), 0)) AS d FROM l),
g AS (SELECT track, t, sum(d) AS f, sum(CASE WHEN k < 8 THEN d ELSE 0 END) AS b0, sum(CASE WHEN k >= 8 AND k < 32 THEN d ELSE 0 END) AS b1, sum(CASE WHEN k >= 32 THEN d ELSE 0 END) AS b2 FROM q GROUP BY ALL)
SELECT track, t, {r6('f', 'flux')}, CAST((CASE WHEN f > 0 AND b0 >= 0.2*f THEN 1 ELSE 0 END) + (CASE WHEN f > 0 AND b1 >= 0.2*f THEN 2 ELSE 0 END) + (CASE WHEN f > 0 AND b2 >= 0.2*f THEN 4 ELSE 0 END) AS INTEGER) AS band_mask FROM g""")
def _(spark, d):
    return rounded(beats.flux(_spec(spark, d), (8, 32)))


@query("odf_complex", f"""WITH {SPEC}, a AS (SELECT *, atan2(im, re) AS ph FROM sp), l AS (SELECT *, lag(ph) OVER w AS p1, lag(ph, 2) OVER w AS p2, lag(mag) OVER w AS m1 FROM a WINDOW w AS (PARTITION BY track, k ORDER BY t))
SELECT track, t, {r6('sum(coalesce(sqrt(power(re - m1*cos(2*p1-p2), 2) + power(im - m1*sin(2*p1-p2), 2)), 0))', 'v')} FROM l GROUP BY ALL""")
def _(spark, d):
    return rounded(beats.complex_deviation(_spec(spark, d)))


HFC = f"{SPEC}, h AS (SELECT track, t, sum(k*mag*mag) AS v FROM sp GROUP BY ALL)"


@query("odf_hfc", f"WITH {HFC} SELECT track, t, {r6('v', 'v')} FROM h")
def _(spark, d):
    return rounded(beats.high_frequency_content(_spec(spark, d)))


@query("spectral_whitening", f"WITH {SPEC} SELECT track, t, k, {r6('re', 're')}, {r6('im', 'im')}, {r6('mag / greatest(max(mag / power(0.9997, t)) OVER (PARTITION BY track, k ORDER BY t ROWS UNBOUNDED PRECEDING) * power(0.9997, t), 1e-6)', 'mag')} FROM sp")
def _(spark, d):
    return rounded(beats.whitened(_spec(spark, d)))


NORM = f"""{HFC}, na AS (SELECT track, t, v, list_sort(list(v) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) AS a FROM h), nm AS (SELECT *, a[len(a)//2 + 1] AS m FROM na),
nd AS (SELECT *, list_sort(list_transform(a, lambda x: abs(x - m))) AS dv FROM nm), nz AS (SELECT track, t, (v - m) / (1.4826 * dv[len(dv)//2 + 1] + 1e-6) AS v FROM nd)"""


def _norm(spark, d):
    return beats.normalised(beats.high_frequency_content(_spec(spark, d)), 17)


@query("odf_normalised", f"WITH {NORM} SELECT track, t, {r6('v', 'v', 4)} FROM nz")
def _(spark, d):
    return _norm(spark, d).select("track", "t", F.round("v", 4).alias("v"))


@query("odf_combined", f"WITH {HFC}, f AS (SELECT track, t, sum(mag) AS v FROM sp GROUP BY ALL) SELECT track, t, {r6('(h.v * 2 + f.v) / 3', 'v')} FROM h JOIN f USING (track, t)")
def _(spark, d):
    total = _spec(spark, d).groupBy("track", "t").agg(F.sum("mag").alias("v"))
    return rounded(beats.combined([(beats.high_frequency_content(_spec(spark, d)), 2.0), (total, 1.0)]))


PICK = f"""{NORM}, pk AS (SELECT *, max(v) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, avg(v) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mean,
    lag(v) OVER (PARTITION BY track ORDER BY t) AS a, lead(v) OVER (PARTITION BY track ORDER BY t) AS b FROM nz),
ca AS (SELECT track, t, v, CASE WHEN abs(a - 2*v + b) > 1e-12 THEN least(0.5, greatest(-0.5, 0.5*(a-b)/(a - 2*v + b))) ELSE 0 END AS off FROM pk WHERE a IS NOT NULL AND b IS NOT NULL AND v >= top AND v >= mean + 0.1)"""


@query("peak_candidates", f'WITH {PICK} SELECT track, t, round(v, 4) AS v, round(off, 4) AS "offset" FROM ca')
def _(spark, d):
    return beats.candidates(_norm(spark, d)).select("track", "t", F.round("v", 4).alias("v"), F.round(F.col("offset") + 0.0, 4).alias("offset"))


ONSETS = f"""{PICK}, oc AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t) AS i FROM ca),
    os AS (SELECT track, i, t, off, v FROM oc WHERE i = 1 UNION ALL SELECT n.track, n.i, n.t, n.off, n.v FROM os p JOIN oc n ON n.track = p.track AND n.i = (SELECT min(z.i) FROM oc z WHERE z.track = p.track AND z.t - p.t > 12))"""


def _onsets(spark, d):
    return beats.onsets(_norm(spark, d), 0.01, PeakPickConfig(refractory_s=0.12))


@query("onsets", f'WITH RECURSIVE {ONSETS} SELECT track, t, round(v, 4) AS v, round(off, 4) AS "offset", round((t + off) * 0.01, 6) AS "at" FROM os')
def _(spark, d):
    o = _onsets(spark, d)
    return o.select("track", "t", F.round("v", 4).alias("v"), F.round(F.col("offset") + 0.0, 4).alias("offset"), F.round("at", 6).alias("at"))


AC = f"{HFC}, ac AS (SELECT a.track, CAST(l AS INTEGER) AS lag, avg(a.v * b.v) AS r FROM h a JOIN h b ON a.track = b.track, range(5, 61) r(l) WHERE b.t = a.t + l GROUP BY ALL)"


@query("autocorrelation", f"WITH {AC} SELECT track, lag, {r6('r', 'r')} FROM ac")
def _(spark, d):
    return rounded(beats.autocorrelation(beats.high_frequency_content(_spec(spark, d)), 5, 60))


TEMPO = TempoConfig(min_bpm=60.0, max_bpm=240.0)
# hop 0.05 s: lags 5 to 20
SCORES = f"""{AC}, raw AS (SELECT track, lag // h AS lag, sum(r / h) AS raw FROM ac, range(1, 4) q(h) WHERE lag % h = 0 AND lag // h BETWEEN 5 AND 20 GROUP BY ALL),
tl AS (SELECT *, lag(raw) OVER (PARTITION BY track ORDER BY lag) AS a, lead(raw) OVER (PARTITION BY track ORDER BY lag) AS b FROM raw),
tb AS (SELECT track, CAST(lag AS INTEGER) AS lag, raw, 60 / ((lag + CASE WHEN abs(a - 2*raw + b) > 1e-12 THEN least(0.5, greatest(-0.5, 0.5*(a-b)/(a - 2*raw + b))) ELSE 0 END) * 0.05) AS bpm FROM tl WHERE a IS NOT NULL AND b IS NOT NULL AND raw >= a AND raw >= b),
ts AS (SELECT *, raw * exp(-0.5 * power(log2(bpm / 120) / 0.8, 2)) AS score FROM tb)"""


def _scores(spark, d):
    return beats.tempo_scores(beats.high_frequency_content(_spec(spark, d)), 0.05, TEMPO)


@query("tempo_scores", f"WITH {SCORES} SELECT track, lag, {r6('raw', 'raw')}, {r6('bpm', 'bpm', 4)}, {r6('score', 'score')} FROM ts")
def _(spark, d):
    return rounded(_scores(spark, d).withColumn("bpm", F.round("bpm", 4)))


@query("tempo", f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, lag) AS rank, max(score) OVER (PARTITION BY track) AS top, avg(score) OVER (PARTITION BY track) AS m, stddev_pop(score) OVER (PARTITION BY track) AS s FROM ts)
SELECT track, CAST(rank AS INTEGER) AS rank, {r6('bpm', 'bpm', 4)}, {r6('score', 'score')}, {r6('CASE WHEN s > 0 THEN least(1, greatest(0, (top - m) / s / 8)) ELSE 0 END', 'confidence')} FROM k WHERE rank <= 6 AND score >= 0.7 * top""")
def _(spark, d):
    return rounded(beats.tempo(_scores(spark, d), TEMPO).withColumn("bpm", F.round("bpm", 4)))


@query("tempo_series")
def _(spark, d):
    return rounded(beats.tempo_series(beats.high_frequency_content(_spec(spark, d)), 0.05, TempoConfig(min_bpm=120.0, window_s=2.5)))


# a loop over the frames as a recursion: s holds the last 20 scores, the latest first
@query("beats", f"""WITH RECURSIVE {NORM}, q AS MATERIALIZED (SELECT track, t, v, row_number() OVER (PARTITION BY track ORDER BY t) AS i FROM nz),
dp AS (SELECT track, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, list_transform(range(20), lambda x: CAST('-inf' AS DOUBLE)) AS s, CAST(0 AS BIGINT) AS back FROM q GROUP BY track
UNION ALL SELECT track, i, t, list_prepend(v + greatest(0, list_max(w)), s[1:19]), CASE WHEN list_max(w) > 0 THEN 4 + list_position(w, list_max(w)) ELSE 0 END
FROM (SELECT q.track, q.i, q.t, q.v, dp.s, list_transform(range(5, 21), lambda d: dp.s[d] - 100 * power(ln(d / 10.0), 2)) AS w FROM dp JOIN q ON q.track = dp.track AND q.i = dp.i + 1)),
dm AS MATERIALIZED (SELECT track, i, t, s[1] AS best, back FROM dp WHERE i > 0),
bt AS (SELECT track, i, t, back FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY best DESC, i) AS r FROM dm) WHERE r = 1
UNION ALL SELECT dm.track, dm.i, dm.t, dm.back FROM bt JOIN dm ON dm.track = bt.track AND dm.i = bt.i - bt.back WHERE bt.back > 0) SELECT track, t FROM bt""")
def _(spark, d):
    return beats.track_beats(_norm(spark, d), 10.0)


@query("bpm_refined", f"""WITH {PICK}, o AS (SELECT track, (t + off) * 0.05 AS ps FROM ca), dd AS (SELECT track, ps - lag(ps) OVER (PARTITION BY track ORDER BY ps) AS d FROM o),
g AS (SELECT m.track, list_sort(list(d) FILTER (d > 0.85*0.4 AND d < 1.15*0.4)) AS ds FROM (SELECT DISTINCT track FROM o) m LEFT JOIN dd USING (track) GROUP BY ALL)
SELECT track, {r6('CASE WHEN len(ds) >= 3 THEN 60 / ds[len(ds)//2 + 1] ELSE 150.0 END', 'bpm')} FROM g""")
def _(spark, d):
    c = beats.candidates(_norm(spark, d)).withColumn("at", (F.col("t") + F.col("offset")) * 0.05)
    return rounded(beats.refined_bpm(c, 150.0))


GRID = "gb AS (SELECT track, CAST(b * 10 AS DOUBLE) AS at FROM (SELECT DISTINCT track FROM ca) CROSS JOIN range(10) r(b)), co AS (SELECT track, CAST(t AS DOUBLE) AS at FROM ca)"


def _grid(spark, d):
    c = beats.candidates(_norm(spark, d)).select("track", F.col("t").cast("double").alias("at"))
    return c.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("b")).select("track", (F.col("b") * 10).cast("double").alias("at")), c


@query("beats_snapped", f"""WITH {PICK}, {GRID} SELECT gb.track, gb.at AS "at", coalesce(arg_min(co.at, (abs(co.at - gb.at), -co.at)), gb.at) AS snapped FROM gb LEFT JOIN co ON co.track = gb.track AND abs(co.at - gb.at) <= 3 GROUP BY gb.track, gb.at""")
def _(spark, d):
    g, c = _grid(spark, d)
    return beats.snapped(g, c, 3.0)


@query("band_anti_join", f'WITH {PICK}, {GRID} SELECT gb.track, gb.at AS "at" FROM gb WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.track = gb.track AND abs(co.at - gb.at) <= 1)')
def _(spark, d):
    g, c = _grid(spark, d)
    return beats.without_near(g, c, 1.0)


@query("bars", f"""WITH {PICK}, {GRID}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY "at") - 1 AS i FROM gb), f AS (SELECT track, arg_min(i, (abs("at" - 25), i)) AS k FROM n GROUP BY ALL)
SELECT track, "at", CAST(((i - k) % 4 + 4) % 4 AS INTEGER) AS bar_beat FROM n JOIN f USING (track)""")
def _(spark, d):
    return beats.bars(_grid(spark, d)[0], 25.0).withColumn("bar_beat", F.col("bar_beat").cast("int"))


@query("beats_edited", f"""WITH {PICK}, {GRID}, nu AS (SELECT track, "at" + 0.01 AS "at" FROM gb), rm AS (SELECT nu.* FROM nu WHERE abs(nu."at" - 20.0) > 0.02),
al AS (SELECT track, "at", NULL AS confidence FROM rm UNION ALL SELECT DISTINCT track, 33.0, 1.0 FROM gb), n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY "at") - 1 AS i FROM al), f AS (SELECT track, arg_min(i, (abs("at" - 25), i)) AS k FROM n GROUP BY ALL)
SELECT track, round("at", 6) AS "at", CAST(confidence AS DOUBLE) AS confidence, CAST(((i - k) % 4 + 4) % 4 AS INTEGER) AS bar_beat FROM n JOIN f USING (track)""")
def _(spark, d):
    g, _ = _grid(spark, d)
    one = g.select("track").distinct()
    out = beats.edited(g, 0.01, one.withColumn("at", F.lit(20.0)), one.withColumn("at", F.lit(33.0)), 25.0)
    return out.select("track", F.round("at", 6).alias("at"), "confidence", F.col("bar_beat").cast("int").alias("bar_beat"))


@query("phase_confidence", f"""WITH {NORM}, b AS (SELECT track, t FROM nz WHERE t % 10 = 0) SELECT n.track, {r6('CASE WHEN stddev_pop(n.v) > 0 THEN least(1, greatest(0, (avg(n.v) FILTER (b.t IS NOT NULL) - avg(n.v)) / stddev_pop(n.v) / 4)) ELSE 0 END', 'confidence')}
FROM nz n LEFT JOIN b ON b.track = n.track AND b.t = n.t GROUP BY n.track""")
def _(spark, d):
    n = _norm(spark, d)
    return rounded(beats.phase_confidence(n, n.where("t % 10 = 0")))


CAND = f"{EVENTS}, mo AS (SELECT track, 0 AS channel, frame, avg(x) AS x FROM ev GROUP BY track, frame), cd AS (SELECT track, frame AS cand FROM (SELECT *, max(abs(x)) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS top FROM mo) WHERE abs(x) = top), nr AS (SELECT m.track, m.channel, cand, frame, x FROM cd JOIN mo m ON m.track = cd.track AND frame >= cand - 20 AND frame < cand + 200)"


def _near(spark, d):
    """The samples of the mono downmix near each of its local peaks, the largest within 50 frames either way."""
    from pyspark.sql import Window

    from pulsegrid.operators import islands

    x = signals.events_stereo(spark, d).groupBy("track", "frame").agg(F.avg("x").alias("x")).select("track", F.lit(0).alias("channel"), "frame", "x")
    w = Window.partitionBy("track", "_chunk").orderBy("frame").rowsBetween(-50, 50)
    at = islands.chunked(x, "frame", before=50, after=50).withColumn("top", F.max(F.abs("x")).over(w)).where("_own and abs(x) = top").select("track", F.col("frame").alias("cand"))
    return transients.around(x, at, 20, 200)


ATTACK = f"""{CAND}, en AS (SELECT *, x*x AS ahead, coalesce(sum(x*x) OVER (PARTITION BY track, channel, cand ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS behind,
    (lag(x) OVER (PARTITION BY track, channel, cand ORDER BY frame) >= 0) <> (x >= 0) AS turn FROM nr),
bs AS (SELECT track, channel, cand, arg_max(frame, (ahead / (behind + 1e-12), frame)) AS attack, min(frame) AS lo FROM en GROUP BY ALL),
sr AS (SELECT bs.track, bs.channel, bs.cand, attack, coalesce(max(frame) FILTER (turn AND frame <= attack), any_value(lo)) AS start FROM bs JOIN en USING (track, channel, cand) GROUP BY ALL)"""


@query("transient_attack", f'WITH {ATTACK} SELECT track, channel, cand, attack, start AS "start" FROM sr')
def _(spark, d):
    return transients.attack(_near(spark, d), SR)


@query("transient_times", f"""WITH {ATTACK}, rw AS (SELECT nr.*, start, abs(x) AS a FROM nr JOIN sr USING (track, channel, cand) WHERE frame >= start),
pk AS (SELECT track, channel, cand, max(a) AS peak, arg_max(frame, (a, -frame)) AS peak_frame FROM rw WHERE frame < start + 30 GROUP BY ALL),
ev2 AS (SELECT rw.*, peak, peak_frame, max(a) OVER (PARTITION BY track, channel, cand ORDER BY frame ROWS 19 PRECEDING) AS env FROM rw JOIN pk USING (track, channel, cand))
SELECT track, channel, cand, round(ev2.peak, 6) AS peak, peak_frame, CAST(min(frame) FILTER (a >= 0.9*peak) - min(frame) FILTER (a >= 0.1*peak) AS DOUBLE) AS attack_ms, CAST(min(frame) FILTER (frame > peak_frame AND env <= 0.1*peak) - any_value(peak_frame) AS DOUBLE) AS decay_ms FROM ev2 GROUP BY track, channel, cand, ev2.peak, peak_frame""")
def _(spark, d):
    near = _near(spark, d)
    return rounded(transients.peak_and_times(near, transients.attack(near, SR), SR))


def _near_onsets(spark, d):
    """The samples of the mono downmix near each of its own onsets."""
    mono = signals.events_stereo(spark, d).groupBy("track", "frame").agg(F.avg("x").alias("x")).select("track", F.lit(0).alias("channel"), "frame", "x")
    spectra = spectral.stft(mono, SR, StftConfig(size=64, hop=16)).select("track", "t", F.posexplode("mag").alias("k", "mag"))
    found = beats.onsets(beats.normalised(beats.flux(spectra, (8, 20)).select("track", "t", F.col("flux").alias("v")), 17), 16 / SR)
    return transients.around(mono, found.select("track", F.round(F.col("at") * SR).cast("long").alias("cand")), 20, 200)


@query("transient_attack_onsets")
def _(spark, d):
    return transients.attack(_near_onsets(spark, d), SR)


@query("transient_times_onsets")
def _(spark, d):
    near = _near_onsets(spark, d)
    return rounded(transients.peak_and_times(near, transients.attack(near, SR), SR))


def _fuzzy(x: str, at: float, soft: float, above: bool = True) -> str:
    return f"least(1, greatest(0, ({x} - {at}) / {soft} + 0.5))" if above else f"least(1, greatest(0, ({at} - {x}) / {soft} + 0.5))"


def _range(x: str, lo: float, hi: float, soft: float) -> str:
    return f"least({_fuzzy(x, lo, soft)}, {_fuzzy(x, hi, soft, False)})"


FEAT = f"fe AS (SELECT t, abs(x) * 20000 AS centroid, abs(y) * 2 AS flatness, abs(z) * 3 AS share_low, 1 - least(1, abs(z) * 3) AS share_high, abs(u) * 900 AS decay_ms FROM (SELECT vec_id AS t, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS u FROM embeddings))"


def _classes(spark, d):
    e = signals.read(spark, d, "embeddings")
    v = lambda i: F.abs(F.get("embedding", i).cast("double"))
    f = e.select(F.lit("all").alias("track"), F.col("vec_id").alias("t"), (v(0) * 20000).alias("centroid"), (v(1) * 2).alias("flatness"), (v(2) * 3).alias("share_low"), (1 - F.least(F.lit(1.0), v(2) * 3)).alias("share_high"), (v(3) * 900).alias("decay_ms"))
    return transients.classified(f)


CLASSED = f"""{FEAT}, sc AS (SELECT t, [({_fuzzy('share_low', 0.5, 0.3)} + {_fuzzy('centroid', 400, 300, False)}) / 2, ({_range('centroid', 800, 4000, 800)} + {_fuzzy('flatness', 0.15, 0.2)} + {_range('share_low', 0.05, 0.5, 0.2)}) / 3,
    ({_fuzzy('centroid', 5000, 2000)} + {_fuzzy('share_high', 0.5, 0.3)}) / 2, ({_fuzzy('flatness', 0.1, 0.1, False)} + {_fuzzy('decay_ms', 150, 100)}) / 2, ({_fuzzy('flatness', 0.05, 0.1)} + {_fuzzy('decay_ms', 200, 100, False)} + 0.5) / 3] AS s FROM fe),
cc AS (SELECT t, CASE WHEN list_max(s) < 0.5 THEN 'unclassified' ELSE ['kick', 'snare', 'hihat', 'tonal_onset', 'percussion'][list_position(s, list_max(s))] END AS class, CASE WHEN list_max(s) < 0.5 THEN 1 - list_max(s) ELSE list_max(s) END AS conf FROM sc)"""


@query("transient_classes", f"WITH {CLASSED} SELECT t, class, {r6('conf', 'confidence')} FROM cc")
def _(spark, d):
    return rounded(_classes(spark, d).select("t", "class", "confidence"))


@query("transient_class_counts", f"""WITH {CLASSED} SELECT 'all' AS track, c.class, count(cc.t) AS n FROM (SELECT unnest(['kick', 'snare', 'hihat', 'tonal_onset', 'percussion', 'unclassified', 'click', 'dropout']) AS class) c LEFT JOIN cc ON cc.class = c.class GROUP BY ALL""")
def _(spark, d):
    return transients.count_by_class(_classes(spark, d))


@query("dropouts", f"""WITH {EVENTS_HALF}, q AS (SELECT *, frame - row_number() OVER (PARTITION BY track, channel ORDER BY frame) AS g FROM evs WHERE abs(x) <= power(10, -80 / 20.0))
SELECT track, channel, min(frame) AS "begin", max(frame) + 1 AS "end", count(*) AS n, CAST(count(*) AS DOUBLE) AS length_ms FROM q GROUP BY track, channel, g HAVING count(*) BETWEEN 1 AND 50""")
def _(spark, d):
    return transients.dropouts(signals.events_gated(spark, d), SR)


@query("clicks")
def _(spark, d):
    return rounded(transients.merged_clicks(transients.click_candidates(signals.events_stereo(spark, d))))


@query("clicks_merged", f"""WITH {EVENTS}, c AS (SELECT track, channel, frame, x AS ratio FROM ev WHERE x > 0.2), n AS (SELECT *, sum(nw) OVER (PARTITION BY track, channel ORDER BY frame) AS g FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track, channel ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS nw FROM c))
SELECT track, channel, arg_max(frame, (ratio, -frame)) AS frame, {r6('max(ratio)', 'ratio')} FROM n GROUP BY track, channel, g""")
def _(spark, d):
    return rounded(transients.merged_clicks(signals.events_stereo(spark, d).where("x > 0.2").withColumnRenamed("x", "ratio")))


