"""Stateful streams against the batch operators: order of arrival, repeats, late chunks, ends."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.model import CHUNKS, StftConfig
from pulsegrid.operators import islands, loudness, resampling, spectral
from pulsegrid.streaming import streams


def signal(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([("a", c, i, float(np.float32(v))) for c in (0, 1) for i, v in enumerate(rng.uniform(-1, 1, n - 300 * c))], "track string, channel int, frame long, x double")


def chunk_rows(samples, size=128, end=True):
    """Chunk rows of a signal, each channel's end included."""
    rows = {}
    for r in samples.collect():
        rows.setdefault((r.track, r.channel), []).append((r.frame, r.x))
    out = []
    for (track, channel), xs in rows.items():
        x = [v for _, v in sorted(xs)]
        cuts = list(range(0, len(x), size))
        out += [(track, channel, i, at, x[at : at + size]) for i, at in enumerate(cuts)]
        if end:
            out.append((track, channel, len(cuts), len(x), []))
    return out


def fed(spark, folder, batches):
    """A stream of one file for each list of chunk rows, in that order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(folder))
        new = max((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
        os.utime(f"{folder}/{new}", (1_700_000_000 + i, 1_700_000_000 + i))
    return streams.chunk_stream(spark, str(folder), files_per_batch=1, late=None)


def values(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(got, want, column):
    assert got.keys() == want.keys() and want
    a, b = (np.array([d[k][column] for k in sorted(want)], float) for d in (got, want))
    assert np.abs(a - b).max() < 1e-9


@pytest.fixture(scope="module")
def shuffled(spark):
    """The chunks in a mixed order over several files, some of them twice."""
    rows = chunk_rows(signal(spark))
    order = np.random.default_rng(1).permutation(len(rows))
    mixed = [rows[i] for i in order]
    return [mixed[:7], mixed[7:12] + mixed[:3], mixed[12:20], mixed[20:]]


def test_filter_state(spark, tmp_path, shuffled):
    got = streams.run_to_table(streams.k_weighted(fed(spark, tmp_path / "c", shuffled), 8000), "append")
    same(values(got, "channel", "frame"), values(loudness.k_weighted(signal(spark), 8000, chunk=256), "channel", "frame"), "x")


@pytest.mark.parametrize("cfg", [StftConfig(64, 24), StftConfig(96, 96, centred=False), StftConfig(2048, 512)])
def test_spectra(spark, tmp_path, shuffled, cfg):
    got = streams.run_to_table(streams.stft(fed(spark, tmp_path / "c", shuffled), 8000, cfg), "append")
    got, want = values(got, "channel", "t"), values(spectral.stft(signal(spark), 8000, cfg), "channel", "t")
    assert got.keys() == want.keys() and (want or cfg.size > 1500)
    for k, r in want.items():
        for c in ("mag", "re", "im"):
            assert np.allclose(got[k][c], r[c], atol=1e-9)


@pytest.mark.parametrize("rates", [(44_100, 48_000), (48_000, 8_000), (3, 7), (5, 5)])
def test_resampler_history(spark, tmp_path, shuffled, rates):
    got = streams.run_to_table(streams.resampled(fed(spark, tmp_path / "c", shuffled), *rates, "fast"), "append")
    same(values(got, "channel", "frame"), values(resampling.resampled(signal(spark), *rates, "fast", chunk=100), "channel", "frame"), "x")


def test_runs_of_mixed_chunks(spark, tmp_path, shuffled):
    got = streams.run_to_table(streams.runs(fed(spark, tmp_path / "c", shuffled), 0.6), "append")
    want = islands.runs(signal(spark), ["channel"], "frame", F.abs("x") >= 0.6)
    assert sorted((r.channel, r.begin, r.end) for r in got.collect()) == sorted((r.channel, r.begin, r.end) for r in want.collect())


@pytest.mark.parametrize("inclusive", [False, True])
def test_sessions_are_merged_runs(spark, tmp_path, shuffled, inclusive):
    ends = [r for b in shuffled for r in b if not r[4]]
    batches = [[r for r in b if r[4]] for b in shuffled] + [ends]  # an end that comes before its chunks would make them late
    got = streams.run_to_table(streams.sessions(fed(spark, tmp_path / "c", batches), 1000, 0.9, 5, inclusive, late="1 minute"), "append")
    found = islands.runs(signal(spark), ["channel"], "frame", F.abs("x") >= 0.9)
    want = islands.merge_runs(found, ["channel"], 5, inclusive, hits=F.sum("n"))
    assert sorted((r.channel, r.begin, r.end, r.hits) for r in got.collect()) == sorted((r.channel, r.begin, r.end, r.hits) for r in want.collect())


def test_a_late_chunk_is_dropped(spark, tmp_path):
    x = spark.createDataFrame([("a", 0, i, 1.0 if i % 1000 < 10 else 0.0) for i in range(9000)], "track string, channel int, frame long, x double")
    rows = chunk_rows(x, 1000)
    late, rest = rows[2], [r for r in rows if r[2] != 2]
    got = streams.run_to_table(streams.sessions(fed(spark, tmp_path / "c", [rest[:6], rest[6:8], [late], rest[8:]]), 1000, 0.5, 100, late="1 second"), "append")
    assert sorted(r.begin for r in got.collect()) == [i * 1000 for i in range(9) if i != 2]


def test_many_sessions_in_linear_time(spark, tmp_path):
    """Four batches of 60,000 stretches of a channel, all within the watermark; one group that holds them compares each with each."""
    folder = str(tmp_path / "c")
    chunks = spark.range(1920).selectExpr("'a' as track", "0 as channel", "cast(id as int) as chunk_idx", "id * 1000 as start_frame", "transform(sequence(0, 999), i -> cast(if(i % 8 = 0, 1, 0) as float)) as samples")
    for i in range(4):
        chunks.where(f"chunk_idx div 480 = {i}").coalesce(1).write.mode("append").parquet(folder)
    stream = streams.chunk_stream(spark, folder, files_per_batch=1, late=None)
    end = spark.createDataFrame([("a", 0, 1920, 1_920_000, [])], CHUNKS)
    end.coalesce(1).write.mode("append").parquet(folder)
    began = time.monotonic()
    got = streams.run_to_table(streams.sessions(stream, 1000, 0.9, 5, late="1 hour"), "append")
    assert got.where("begin % 8 = 0 and end = begin + 1 and hits = 1").select("begin").distinct().count() == got.count() == 240_000
    assert time.monotonic() - began < 60


def test_sessions_over_several_chunks(spark, tmp_path):
    """Stretches inside a chunk, at its edges and over whole chunks, and gaps just bridged and just not over an edge."""
    loud = {3, 4, 9, 19, 24, *range(38, 63), 68, 69, 79, 86, 87, 99}
    x = spark.createDataFrame([("a", 0, i, 1.0 if i in loud else 0.0) for i in range(105)], "track string, channel int, frame long, x double")
    for inclusive in (False, True):
        rows = chunk_rows(x, 10)
        got = streams.run_to_table(streams.sessions(fed(spark, tmp_path / f"c{inclusive}", [rows[4:7] + rows[:2], rows[2:5], rows[7:-1], rows[-1:]]), 1000, 0.5, 5, inclusive, late="1 minute"), "append")
        want = islands.merge_runs(islands.runs(x, ["channel"], "frame", F.col("x") >= 0.5), ["channel"], 5, inclusive, hits=F.sum("n"))
        assert sorted((r.begin, r.end, r.hits) for r in got.collect()) == sorted((r.begin, r.end, r.hits) for r in want.collect())


def test_chunk_files_are_written_batch_by_batch(spark):
    x = spark.range(64_000).select(F.lit("a").alias("track"), F.lit(0).alias("channel"), F.col("id").alias("frame"), F.lit(0.5).alias("x"))
    folder = streams.chunk_files(x, 100, closing=True, files_per_batch=2)
    files = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
    reach = [spark.read.parquet(f"{folder}/{f}").agg(F.min("chunk_idx"), F.max("chunk_idx")).first() for f in files]
    assert len(files) == 9 and reach[-1] == (640, 640)
    for i in range(2, 8):
        assert min(lo for lo, _ in reach[i - i % 2 :]) > max(hi for _, hi in reach[: i - i % 2])


def test_an_early_chunk_waits(spark, tmp_path):
    rows = chunk_rows(signal(spark, 600), 100, end=False)
    held = [r for r in rows if r[2] != 1]  # chunk 1 never comes
    got = streams.run_to_table(streams.k_weighted(fed(spark, tmp_path / "c", [held]), 8000), "append")
    assert {r.frame // 100 for r in got.collect()} == {0}


def test_complete_mode_keeps_the_last_result(spark, tmp_path):
    rows = chunk_rows(signal(spark), end=False)
    got = streams.run_to_table(streams.rms_series(fed(spark, tmp_path / "c", [rows[:5], rows[5:]]), 50), "complete")
    want = signal(spark).groupBy("channel", F.floor(F.col("frame") / 50).alias("w")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    same(values(got, "channel", "w"), values(want, "channel", "w"), "rms")


# -- conversion of rates ---------------------------------------------------------------------


def test_chunks_make_no_difference(spark):
    one, many = (values(resampling.resampled(signal(spark), 44_100, 48_000, chunk=c), "channel", "frame") for c in (65_536, 70))
    same(many, one, "x")
    assert max(f for _, f in one) + 1 == 1500 * 48_000 // 44_100


@pytest.mark.parametrize(("rates", "quality", "limit"), [((8_000, 12_000), "best", 1e-4), ((44_100, 48_000), "good", 1e-3), ((48_000, 44_100), "best", 1e-4)])
def test_a_sine_stays_a_sine(spark, rates, quality, limit):
    hz = rates[0] / 20
    x = spark.createDataFrame([("a", 0, i, float(np.sin(2 * np.pi * hz * i / rates[0]))) for i in range(4000)], "track string, channel int, frame long, x double")
    y = {r.frame: r.x for r in resampling.resampled(x, *rates, quality, chunk=512).collect()}
    for n in range(200, len(y) - 200):
        assert abs(y[n] - np.sin(2 * np.pi * hz * n / rates[1])) < limit


def test_resampling_of_little(spark):
    x = signal(spark)
    assert resampling.resampled(x.limit(0), 2, 3).count() == 0
    with pytest.raises(ValueError, match="rates"):
        resampling.resampled(x, 0, 3)
    with pytest.raises(ValueError, match="rates"):
        resampling.resampled(x, 1, 3, "better")


# -- long tracks -----------------------------------------------------------------------------


def test_whitening_far_into_a_track(spark):
    from pulsegrid.operators import beats

    rng = np.random.default_rng(0)
    mags = rng.uniform(0, 1, 300)
    mags[100:180] = 0
    for start in (0, 3_000_000):
        df = spark.createDataFrame([("a", start + i, 0, float(m)) for i, m in enumerate(mags)], "track string, t long, k int, mag double")
        got = [r.mag for r in beats.whitened(df).orderBy("t").collect()]
        peak = 0.0
        for m, w in zip(mags, got, strict=True):
            peak = max(m, peak * 0.9997)
            assert abs(w - m / max(peak, 1e-6)) < 1e-9


def greedy(xs, gap, at_least):
    out = []
    for x in sorted(set(xs)):
        if not out or (x - out[-1] >= gap if at_least else x - out[-1] > gap):
            out.append(x)
    return out


@pytest.mark.parametrize("at_least", [False, True])
@pytest.mark.parametrize("gap", [0.0, 0.3, 7.0, 55.0, 400.0])
def test_greedy_selection_by_chunks(spark, gap, at_least):
    rng = np.random.default_rng(int(gap))
    groups = {g: [float(v) for v in np.round(rng.uniform(-200, 2000, n), 1)] for g, n in (("a", 900), ("b", 3), (None, 50))}
    df = spark.createDataFrame([(g, v) for g, xs in groups.items() for v in xs] + [("b", None)], "g string, v double")
    got = islands.refractory(df, ["g"], "v", gap, at_least, chunk=50.0)
    for g, xs in groups.items():
        kept = sorted({r.v for r in got.collect() if r.g == g})
        assert kept == greedy(xs, gap, at_least)


def test_greedy_selection_takes_linear_time(spark):
    def run(n):
        df = spark.range(n).selectExpr("'a' as g", "cast(id * 3 % 1000003 as double) as v")
        began = time.time()
        assert islands.refractory(df, ["g"], "v", 1.0).count() > 0
        return time.time() - began

    run(1000)
    assert run(160_000) < 4 * run(40_000) + 4


def test_chunks_are_taken_as_they_come():
    """Nothing but chunks that came early is held, and those as four bytes a sample."""
    seen = []

    def batches():
        for i in (0, 1, 3):
            seen.append(i)
            yield pd.DataFrame({"chunk_idx": [i], "start_frame": [i * 100], "samples": [np.full(100, i, np.float32)]})

    place = streams.Place()
    taken = place.take(batches())
    assert next(taken)[0] == 0 and seen == [0]
    assert [at for at, _ in taken] == [100] and place.next == 2
    ((i, at, xs),) = place.state()[2]
    assert (i, at, len(xs)) == (3, 300, 400)
