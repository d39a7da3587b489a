"""Queries over chunk files, WAV files and stored states; the streaming ones process files incrementally and must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.model import StftConfig
from pulsegrid.operators import loudness, partials, resampling, spectral
from pulsegrid.plans.registry import query
from pulsegrid.plans.sqlviews import EVENTS, EVENTS16, interpolation, k_weighted, r6
from pulsegrid.plans.stats_queries import CHANNELS, SR, rounded
from pulsegrid.sources import shared, signals, wav
from pulsegrid.streaming import streams

EVF = f"{EVENTS}, ef AS (SELECT track, channel, frame, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM ev)"


@query("stream_rms", f"WITH {EVF} SELECT track, channel, frame // 50 AS w, {r6('sqrt(avg(x*x))', 'rms')}, count(*) AS n FROM ef GROUP BY ALL")
def _(spark, d):
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333)
    return rounded(streams.run_to_table(streams.rms_series(streams.chunk_stream(spark, folder), 50), "complete"))


@query("stream_runs", f"""WITH {EVF}, q AS (SELECT *, frame - row_number() OVER (PARTITION BY track, channel ORDER BY frame) AS g FROM ef WHERE abs(x) >= 0.5)
SELECT track, channel, min(frame) AS "begin", max(frame) + 1 AS "end" FROM q GROUP BY track, channel, g""")
def _(spark, d):
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333, closing=True)
    return streams.run_to_table(streams.runs(streams.chunk_stream(spark, folder, late=None), 0.5), "append")


@query("stream_sliding", f"""WITH {EVF}, w AS (SELECT track, channel, k, avg(x*x) AS ms, count(*) AS n FROM ef, range(0, 4) o(k0), LATERAL (SELECT frame // 100 - k0 AS k) GROUP BY ALL)
SELECT track, channel, CAST(k * 100 AS BIGINT) AS start_ms, {r6('ms', 'ms')}, n FROM w""")
def _(spark, d):
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333)
    s = streams.run_to_table(streams.sliding_mean_square(streams.chunk_stream(spark, folder, late=None), 1000, late="1 hour"), "complete")
    return rounded(s.select("track", "channel", F.unix_millis("win.start").alias("start_ms"), "ms", "n"))


@query("stream_k_weighted", f"""WITH RECURSIVE {EVF}, {k_weighted(loudness.shelf_coefficients(8000), loudness.highpass_coefficients(8000), 'ef')} SELECT track, channel, frame, {r6('y', 'x')} FROM kw_""")
def _(spark, d):
    """The filter's state goes from chunk to chunk."""
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333)
    return rounded(streams.run_to_table(streams.k_weighted(streams.chunk_stream(spark, folder, late=None), 8000), "append"))


@query("stream_stft", f"""WITH {EVF}, n AS (SELECT track, channel, max(frame) + 1 AS n FROM ef GROUP BY ALL), tt AS (SELECT track, channel, unnest(range((n + 64 - 64) // 24 + 1)) AS t FROM n),
fr AS (SELECT tt.track, tt.channel, t, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS x FROM tt, range(64) r(i) JOIN ef ON ef.track = tt.track AND ef.channel = tt.channel AND ef.frame = t * 24 + i - 32)
SELECT track, channel, t, CAST(k AS INTEGER) AS k, {r6('sum(x * cos(2 * pi() * k * i / 64))', 're')}, {r6('-sum(x * sin(2 * pi() * k * i / 64))', 'im')} FROM fr, range(33) q(k) GROUP BY ALL""")
def _(spark, d):
    """Frames that reach over chunks, with what later ones need carried."""
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333, closing=True)
    s = streams.run_to_table(streams.stft(streams.chunk_stream(spark, folder, late=None), 1000, StftConfig(64, 24)), "append")
    return rounded(s.select("track", "channel", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("track", "channel", "t", "k", "z.re", "z.im"))


@query("stream_sessions", f"""WITH {EVF}, h AS (SELECT *, frame - lag(frame) OVER (PARTITION BY track, channel ORDER BY frame) AS d FROM ef WHERE abs(x) >= 0.9), g AS (SELECT *, sum(CASE WHEN d <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY track, channel ORDER BY frame) AS g FROM h)
SELECT track, channel, min(frame) AS "begin", max(frame) + 1 AS "end", count(*) AS hits FROM g GROUP BY track, channel, g""")
def _(spark, d):
    """Loud stretches with gaps below 6 frames, as session windows."""
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333, closing=True)
    return streams.run_to_table(streams.sessions(streams.chunk_stream(spark, folder, late=None), 1000, 0.9, 6, late="1 hour"), "append")


@query("resample_up", f"""WITH {EVENTS}, {interpolation(3, 2, *loudness.QUALITY['fast'], 'ev')} SELECT track, channel, n AS frame, {r6('y', 'x')} FROM up_""")
def _(spark, d):
    return rounded(resampling.resampled(signals.events_stereo(spark, d), 1000, 1500, "fast", chunk=1024))


@query("resample_down", f"""WITH {EVENTS}, {interpolation(160, 441, *loudness.QUALITY['good'], 'ev')} SELECT track, channel, n AS frame, {r6('y', 'x')} FROM up_""")
def _(spark, d):
    return rounded(resampling.resampled(signals.events_stereo(spark, d), 44_100, 16_000, "good", chunk=1024))


@query("stream_resample", f"""WITH {EVF}, {interpolation(160, 147, *loudness.QUALITY['fast'], 'ef')} SELECT track, channel, n AS frame, {r6('y', 'x')} FROM up_""")
def _(spark, d):
    """44.1 to 48 kHz, with the taps' history carried and drained at the end."""
    folder = streams.chunk_files(signals.events_stereo(spark, d), 333, closing=True)
    return rounded(streams.run_to_table(streams.resampled(streams.chunk_stream(spark, folder, late=None), 44_100, 48_000, "fast"), "append"))


WAVS = f"WITH {EVENTS16}, wv AS (SELECT 'w' || frame // 700 AS track, channel, frame % 700 AS frame, x FROM ev16)"


def _wav_folder(spark, d):
    """The events as 16-bit stereo files of 700 frames each, in the shared folder."""
    import uuid

    folder = f"{shared.shared_folder(spark)}/wav-{uuid.uuid4().hex}"
    x = signals.events_16bit(spark, d).withColumn("track", F.concat(F.lit("w"), F.floor(F.col("frame") / 700).cast("string"))).withColumn("frame", F.col("frame") % 700)
    wav.write_wavs(x, folder, SR).count()
    spark.dataSource.register(wav.WavSource)
    return folder


def _track(rows):
    return rows.withColumn("track", F.regexp_extract("track", r"([^/]+)\.wav$", 1))


@query("wav_ranges", f"{WAVS} SELECT track, channel, frame, {r6('x', 'x')} FROM wv")
def _(spark, d):
    """Files read in ranges of 1,000 bytes, each with the chunks of 64 frames that begin there."""
    chunks = spark.read.format("pulsegrid_wav").option("frames", 64).option("split", 1000).load(_wav_folder(spark, d))
    return rounded(_track(signals.from_chunks(chunks)))


@query("wav_range_of_frames", f"{WAVS} SELECT track, channel, count(*) AS n, {r6('sum(x)', 'total')} FROM wv WHERE frame >= 128 AND frame < 320 GROUP BY ALL")
def _(spark, d):
    """Only the chunks that hold frames of a range."""
    chunks = spark.read.format("pulsegrid_wav").option("frames", 64).option("split", 500).option("beginFrame", 128).option("endFrame", 320).load(_wav_folder(spark, d))
    return rounded(_track(signals.from_chunks(chunks)).groupBy("track", "channel").agg(F.count("*").alias("n"), F.sum("x").alias("total")))


@query("wav_stream", f"{WAVS} SELECT track, channel, frame, {r6('x', 'x')} FROM wv")
def _(spark, d):
    """The same files as a stream, each channel ended by an empty chunk."""
    stream = spark.readStream.format("pulsegrid_wav").option("frames", 64).option("closing", "true").load(_wav_folder(spark, d))
    return rounded(_track(streams.run_to_table(signals.from_chunks(stream), "append")))


@query("stats_merged", CHANNELS)
def _(spark, d):
    """Statistics of two days, whose states are stored as they come and merged from there."""
    import uuid

    folder, x = f"{shared.shared_folder(spark)}/states-{uuid.uuid4().hex}", signals.events_stereo(spark, d)
    for day in (x.where("frame < 2345"), x.where("frame >= 2345")):
        partials.states(day, 1000).write.mode("append").parquet(folder)
    return rounded(partials.figures(partials.merged(spark.read.parquet(folder)), SR))


@query("signal_points", f"""WITH {EVENTS}, rq AS (SELECT c_custkey AS request, CAST(c_custkey % 2 AS INTEGER) AS channel, c_custkey * 37 % 5000 AS frame, 60 + abs(c_acctbal) / 30 AS hz FROM customer), n AS (SELECT DISTINCT request, channel, frame, hz FROM rq),
fr AS (SELECT request, hz * 64 / 1000 AS target, i, CAST(CAST(x AS FLOAT) AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS x FROM n, range(64) r(i) JOIN ev ON ev.channel = n.channel AND ev.frame = n.frame - 32 + i),
sp AS (SELECT request, target, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2)) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / 32 AS m FROM fr, range(33) q(k) WHERE abs(k - target) <= 5 GROUP BY request, target, k),
b AS (SELECT request, target, k, 20 * log10(greatest(m, 1e-12)) AS l FROM sp), nb AS (SELECT *, lag(l) OVER w AS a, lead(l) OVER w AS b FROM b WINDOW w AS (PARTITION BY request ORDER BY k)),
q AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN l > a AND l > b THEN 0 ELSE 1 END, CASE WHEN l > a AND l > b THEN abs(k - target) END, CASE WHEN l > a AND l > b THEN k END, l DESC, k) AS rn FROM nb WHERE abs(k - target) <= 4),
o AS (SELECT *, CASE WHEN a - 2*l + b < 0 THEN greatest(-0.5, least(0.5, 0.5*(a - b)/(a - 2*l + b))) ELSE 0 END AS off FROM q WHERE rn = 1)
SELECT request, round((k + off) * 1000 / 64, 3) AS hz, round(coalesce(l - 0.25*(a - b)*off, l), 3) AS level FROM o""")
def _(spark, d):
    """Each customer asks for the peak near a frequency at a place of the event signal."""
    c = signals.read(spark, d, "customer")
    asked = c.select(F.col("c_custkey").alias("request"), F.lit("events").alias("track"), (F.col("c_custkey") % 2).cast("int").alias("channel"), (F.col("c_custkey") * 37 % 5000).alias("frame"), (F.abs("c_acctbal") / 30 + 60).cast("double").alias("hz"))
    found = spectral.points(signals.to_chunks(signals.events_stereo(spark, d), 512), asked, SR, 64, frames=512)
    return found.select("request", F.round("hz", 3).alias("hz"), F.round("level", 3).alias("level"))
