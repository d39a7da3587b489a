"""Whole analyses and their reports on constructed signals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.model import ClippingConfig, SilenceConfig, TileConfig
from pulsegrid.operators import analyzers, beats, clipping, islands, loudness, reports, silence, spectral, stats, transients, transport

RATE = 8000


def signal(spark, *channels, track="t"):
    import pandas as pd

    parts = [pd.DataFrame({"track": track, "channel": np.int32(c), "frame": np.arange(len(x)), "x": np.asarray(x, float)}) for c, x in enumerate(channels)]
    return spark.createDataFrame(pd.concat(parts), "track string, channel int, frame long, x double")


def clicks(seconds, period, first=0.0, rate=RATE):
    """Short decaying bursts at a steady tempo."""
    x = np.zeros(int(seconds * rate))
    at = np.arange(first, seconds - 0.02, period)
    n = int(0.01 * rate)
    burst = np.random.default_rng(1).uniform(-1, 1, n) * np.exp(-np.arange(n) / (0.002 * rate))
    for t in at:
        i = round(t * rate)
        x[i : i + n] += burst
    return x, at


@pytest.fixture(scope="module")
def tracked(spark):
    x, at = clicks(10, 0.5, 0.25)
    cfg = analyzers.BeatConfig(size=512, hop=64, high_hz=3000.0)
    return analyzers.analyze_beats(signal(spark, x, x), RATE, cfg), at, cfg


def test_a_click_track_has_its_tempo_and_beats(tracked):
    found, at, _ = tracked
    t = found.tempo.first()
    assert t.bpm == pytest.approx(120.0, abs=0.1) and t.stable and t.confidence > 0.3
    heard = np.array([r["at"] for r in found.beats.collect()])
    late = at[2:-1]  # the series has no past at the first
    assert len(heard) > 10 and max(np.abs(heard - t).min() for t in late) < 0.005
    assert found.onsets.count() >= len(at) - 2 and {r.band_mask for r in found.onsets.collect()} <= set(range(8))


def test_beat_report(tracked):
    found, at, cfg = tracked
    got = json.loads(reports.beats(found, cfg.hop / RATE).first().json)
    assert got["schemaVersion"] == "1.0.0" and got["primaryBpm"] == pytest.approx(120.0, abs=0.1) and got["tempoIsStable"] is True
    assert len(got["beats"]) == found.beats.count() and [b["beatIndexInBar"] for b in got["beats"]] == [-1] * len(got["beats"])
    assert [o["timeSeconds"] for o in got["onsets"]] == sorted(o["timeSeconds"] for o in got["onsets"]) and got["alternatives"][0]["score"] >= got["alternatives"][-1]["score"]


def test_transients_of_a_signal(spark):
    """A kick and a hi-hat among silence, a click of one sample, and a gap in a tone."""
    rng = np.random.default_rng(2)
    rate = 22_050
    x = np.zeros(rate * 3)
    n = rate // 5
    t = np.arange(n) / rate
    x[rate // 2 : rate // 2 + n] += 0.9 * np.sin(2 * np.pi * 60 * t) * np.exp(-t * 20)
    hat = np.diff(rng.normal(0, 0.3, n + 1)) * np.exp(-t * 60)
    hat = np.diff(np.r_[0, hat])
    x[rate : rate + n] += hat
    tone = 0.3 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    tone[4000:4110] = 0  # 5 ms
    x[2 * rate :] += tone
    onsets = spark.createDataFrame([("t", rate // 2, 0.5, 1.0), ("t", rate, 1.0, 1.0)], "track string, frame long, at double, strength double")
    s = signal(spark, x)
    got = analyzers.analyze_transients(s, onsets, rate).collect()
    musical = {round(r.attack / rate, 1): r for r in got if r["class"] not in ("click", "dropout")}
    assert musical[0.5]["class"] == "kick" and musical[1.0]["class"] == "hihat" and musical[1.0].centroid > 4000
    assert [r.start - 2 * rate for r in got if r["class"] == "dropout" and r.start > 2 * rate] == [4000]
    report = json.loads(reports.transients(analyzers.analyze_transients(s, onsets, rate), rate).first().json)
    assert report["countByClass"][0] == 1 and report["countByClass"][2] == 1 and report["countByClass"][6] == sum(r["class"] == "dropout" for r in got)
    assert len(report["transients"]) == 2 and {d["classification"] for d in report["defects"]} <= {"click", "dropout"}


def test_a_click_in_a_tone_is_found_unless_an_onset_is_there(spark):
    rate = 22_050
    x = 0.3 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    x[9000] += 0.8
    s = signal(spark, x)
    none = spark.createDataFrame([], "track string, frame long, at double, strength double")
    got = [r.start for r in analyzers.analyze_transients(s, none, rate).where("class = 'click'").collect()]
    assert any(abs(f - 9000) <= 2 for f in got)
    there = spark.createDataFrame([("t", 9000, 9000 / rate, 1.0)], none.schema)
    assert not [r for r in analyzers.analyze_transients(s, there, rate).where("class = 'click'").collect() if abs(r.start - 9000) <= 2]


def test_inter_sample_peaks_do_not_depend_on_chunks(spark):
    flat = signal(spark, np.full(4096, 0.97))
    tone = np.sin(np.pi / 2 * np.arange(3000) + np.pi / 4) * 1.2  # peaks lie between the samples
    s = signal(spark, tone)
    for x in (flat, s):
        rows = [sorted((r.frame, round(r.peak, 9)) for r in loudness.inter_sample_peaks(x, chunk=c).collect()) for c in (4096, 512, 200)]
        assert rows[0] == rows[1] == rows[2]
    x = tone
    y = np.abs(loudness.resample_block(x, 4))
    assert len(rows[0]) == int((y > 1).sum()) > 100
    r = loudness.inter_sample_peaks(s, chunk=512).where("frame < 512").first()
    assert r.sample_peak == pytest.approx(np.abs(x[:512]).max())
    found = clipping.with_inter_sample_peaks(clipping.events(s, ClippingConfig()), loudness.inter_sample_peaks(s))
    assert found.where("kind = 'inter_sample_peak'").count() == len(rows[0])
    got = json.loads(reports.clips(s, RATE, ClippingConfig(max_events=5), loudness.inter_sample_peaks(s)).first().json)
    assert got["eventCount"][3] == len(rows[0]) and len(got["events"]) == 5 and got["maxOvershootDb"] == pytest.approx(20 * np.log10(y.max()), abs=1e-6)


def test_runs_and_turns_over_chunk_ends(spark, monkeypatch):
    """The same results however short the chunks are."""
    rng = np.random.default_rng(5)
    x = np.round(np.repeat(rng.normal(0, 1, 120), rng.integers(1, 9, 120)), 1)
    s = signal(spark, x)
    want = None
    for size in (7, 64, 65_536):
        monkeypatch.setattr(islands, "CHUNK", size)
        monkeypatch.setattr(islands.chunked, "__defaults__", (0, 0, size))
        got = (
            sorted(map(tuple, islands.runs(s, ["track", "channel"], "frame", F.abs("x") >= 0.5, peak=(F.max, F.abs("x"))).collect())),
            tuple(stats.channel_stats(s, RATE).first()),
            tuple(clipping.plateaus(s).first()),
            tuple(stats.bit_depth(s.withColumn("x", F.col("x") / 8), 16).first()),
            sorted(map(tuple, silence.nearest_zero_crossing(s, s.select("track", "channel", F.col("frame").alias("target")), 5).collect())),
        )
        want = want or got
        assert got == want
    edges = np.flatnonzero(np.diff(np.r_[0, (np.abs(x) >= 0.5).astype(int), 0]))
    assert [(r[2], r[3]) for r in want[0]] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    nz = np.sign(x[x != 0])
    assert stats.channel_stats(s, RATE).first().zero_crossings == int((nz[1:] != nz[:-1]).sum())


def test_frames_against_a_loop(spark):
    x = np.random.default_rng(6).normal(0, 1, 1000)
    for size, hop, centred in ((64, 16, True), (64, 64, False), (100, 3, True)):
        padded = np.r_[np.zeros(size // 2), x, np.zeros(size // 2)] if centred else x
        want = {i: padded[i * hop : i * hop + size] for i in range((len(padded) - size) // hop + 1)}
        got = {r.t: r.x for r in spectral.frames_of(signal(spark, x), size, hop, centred).collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
    assert spectral.frames_of(signal(spark, x[:10]), 64, 16, False).count() == 0


def test_click_candidates_against_a_loop(spark):
    x = np.random.default_rng(8).normal(0, 0.1, 3000)
    x[[700, 1500, 2222]] += 2
    want = set()
    for w in range((3000 - 512) // 256 + 1):
        part = x[w * 256 : w * 256 + 512]
        e = np.abs(np.convolve(part, transients._lpc(part, 12))[:512])[12:]
        bar = np.median(e) + 6 * max(np.median(np.abs(e - np.median(e))), 1e-4)
        want |= {w * 256 + i for i in (np.flatnonzero(e > bar) + 12).tolist() if 128 <= i < 384}
    assert {r.frame for r in transients.click_candidates(signal(spark, x)).collect()} == want >= {700, 1500, 2222}


def test_statistics_report(spark):
    x = np.sin(2 * np.pi * np.arange(4800) / 480)
    got = json.loads(reports.statistics(signal(spark, x, -x), 48_000).first().json, parse_constant=float)
    assert (got["channelCount"], got["frameCount"], got["sampleRate"]) == (2, 4800, 48_000) and got["crestFactorDb"] == pytest.approx(3.0103, abs=1e-3)
    one = got["channels"][0]
    assert one["peak"] == pytest.approx(1) and one["peakFrame"] == 120 and sum(one["histogram"]) == 4800 and len(one["histogram"]) == 1024
    assert got["stereo"]["correlation"] == pytest.approx(-1) and got["stereo"]["monoCompatibilityDb"] == -np.inf and len(got["rmsSeries"]) == 4
    assert json.loads(reports.statistics(signal(spark, x, track="mono"), 48_000, 16).first().json)["stereo"] is None


def test_silence_and_offset_reports(spark):
    x = np.r_[np.zeros(RATE), 0.5 * np.sin(np.arange(RATE)), np.zeros(RATE // 2)] + 0.0
    s = signal(spark, x)
    cfg = SilenceConfig()
    series = stats.rms_series(s, RATE)
    frames = s.groupBy("track").agg((F.max("frame") + 1).alias("frame_count"))
    found = silence.regions(silence.by_threshold(series, cfg), frames, cfg, 0.05, RATE)
    got = json.loads(reports.silence(found, silence.summary(found, frames, RATE), silence.levels(found, series), RATE, cfg).first().json)
    assert got["leadingSilenceSeconds"] == pytest.approx(1, abs=0.06) and [r["position"] for r in got["regions"]][0] == "leading" and got["parametersUsed"]["channelMode"] == "all"
    got = json.loads(reports.offsets(signal(spark, np.full(RATE * 3, 0.1)), RATE).first().json)
    assert got["anySignificant"] is True and got["channels"][0]["pattern"] == "constant" and got["channels"][0]["offsetPercent"] == pytest.approx(10) and got["windowSeries"] == pytest.approx([0.1] * 3)


def test_metadata_report(spark):
    tags = spark.createDataFrame([("f", "title", 'a "quoted" one', "id3v2"), ("f", "year", "1999", "id3v1")], "file string, field string, value string, source string")
    got = json.loads(reports.metadata(tags, ["title", "artist", "year"]).first().json)
    assert got["title"] == 'a "quoted" one' and got["artist"] is None and got["sources"] == [{"field": "title", "origin": "id3v2"}, {"field": "year", "origin": "id3v1"}]


def test_beat_tracking_against_a_loop(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, 90)
    period, tight = 9.0, 100.0
    best, prev = v.copy(), [-1] * len(v)
    for i in range(len(v)):
        options = [(best[i - k] - tight * np.log(k / period) ** 2, -k) for k in range(max(1, round(period / 2)), round(2 * period) + 1) if i >= k]
        if options and i >= round(period / 2) and max(options)[0] > 0:
            score, k = max(options)
            best[i], prev[i] = best[i] + score, i + k
    want, i = [], int(best.argmax())
    while i >= 0:
        want.append(i)
        i = prev[i]
    series = spark.createDataFrame(pd.DataFrame({"track": "t", "t": np.arange(len(v)), "v": v}))
    assert [r.t for r in beats.track_beats(series, period).orderBy("t").collect()] == want[::-1]
    own = series.withColumn("period", F.lit(period))
    assert [r.t for r in beats.track_beats(own).orderBy("t").collect()] == want[::-1]


def test_detections_of_frames_are_those_of_bins(spark):
    """One pass by chunks against the functions that work bin by bin; silent bins and a silent frame among them."""
    import pandas as pd

    rng = np.random.default_rng(31)
    rows = []
    for name, n in (("a", 40), ("b", 7), ("c", 1)):
        z = rng.normal(0, 1, (n, 12)) + 1j * rng.normal(0, 1, (n, 12))
        z[:, 3] = 0
        z[n // 2] = 0
        z *= np.exp(rng.normal(0, 2, (n, 1)))
        rows += [(name, t, np.abs(x).tolist(), x.real.tolist(), x.imag.tolist()) for t, x in enumerate(z)]
    frames = spark.createDataFrame(rows, "track string, t long, mag array<double>, re array<double>, im array<double>")
    white = beats.whitened(frames.select("track", "t", F.posexplode(F.arrays_zip("mag", "re", "im")).alias("k", "b")).select("track", "t", "k", "b.*"), decay=0.9)
    want = beats.flux(white, (4, 8)).join(beats.complex_deviation(white).withColumnRenamed("v", "deviation"), ["track", "t"]).join(beats.high_frequency_content(white).withColumnRenamed("v", "content"), ["track", "t"]).orderBy("track", "t").toPandas()
    assert len(want) == 48
    for chunk in (2, 5, 8, 256):
        got = beats.detections(frames.repartition(5), (4, 8), decay=0.9, chunk=chunk).orderBy("track", "t").toPandas()
        pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-12, check_dtype=False)
    assert beats.detections(frames.limit(0), (4, 8)).count() == 0


def test_beats_by_chunks_are_those_of_one_loop(spark):
    """Tracks over many chunks, one that ends early, one with a gap longer than a chunk and missing values, one that begins late."""
    import pandas as pd

    rng = np.random.default_rng(21)
    period, tight = 9.0, 100.0
    tracks = {name: rng.normal(0, 1, n) for name, n in (("a", 700), ("b", 30), ("c", 500), ("d", 420))}
    tracks["c"][[3, 40, 41, 180]] = np.nan
    tracks["c"][200:310] = np.nan
    tracks["d"][:170] = np.nan
    want, rows = {}, []
    for name, v in tracks.items():
        best, prev = np.where(np.isnan(v), -np.inf, v), [-1] * len(v)
        for i in range(len(v)):
            options = [(best[i - k] - tight * np.log(k / period) ** 2, -k) for k in range(max(1, round(period / 2)), round(2 * period) + 1) if i >= k]
            if options and np.isfinite(v[i]) and max(options)[0] > 0:
                score, k = max(options)
                best[i], prev[i] = best[i] + score, i + k
        at, i = [], int(best.argmax())
        while i >= 0:
            at.append(i)
            i = prev[i]
        want[name] = at[::-1]
        rows += [(name, i, float(x)) for i, x in enumerate(v) if i % 2 or not np.isnan(x)]  # half of the missing as not a number, half left out
    series = spark.createDataFrame(pd.DataFrame(rows, columns=["track", "t", "v"]), "track string, t long, v double")
    odd = spark.createDataFrame([(None, 1, 1.0), ("a", None, 9.0), ("e", 5, None)], series.schema)
    for chunk in (1, 40, 64, 1000):
        found = {}
        for r in beats.track_beats(series.unionByName(odd).repartition(7), period, chunk=chunk).orderBy("track", "t").collect():
            found.setdefault(r.track, []).append(r.t)
        assert found == want
    assert beats.track_beats(series.limit(0), period).count() == 0


def test_tempo_series_is_the_tempo_of_each_window(spark):
    import pandas as pd

    hop = 0.02
    v = np.zeros(1500)
    v[::25] = 1.0  # 120 BPM
    v[1000:] = 0
    v[1000::20] = 1.0  # 150 BPM in the third window
    series = spark.createDataFrame(pd.DataFrame({"track": "t", "t": np.arange(1500), "v": v}))
    got = {r.w: r for r in beats.tempo_series(series, hop).collect()}
    assert set(got) == {0, 1, 2} and not got[0].stable
    for w in got:
        alone = spark.createDataFrame(pd.DataFrame({"track": "t", "t": np.arange(500), "v": v[w * 500 : (w + 1) * 500]}))
        assert got[w].bpm == pytest.approx(beats.tempo(beats.tempo_scores(alone, hop)).where("rank = 1").first().bpm)
    assert got[0].bpm == pytest.approx(120, abs=1) and got[2].bpm == pytest.approx(150, abs=2)


def brute_tiles(x, rate, cfg, hop, fold, how):
    """Levels of display rows by plain loops, and their 8-bit steps."""
    size = cfg.size
    padded = np.r_[np.zeros(size // 2), x, np.zeros(size // 2)]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    edge = lambda r: cfg.min_hz * (rate / 2 / cfg.min_hz) ** (r / cfg.rows)
    out = {}
    for t in range((len(padded) - size) // hop + 1):
        m = np.abs(np.fft.rfft(padded[t * hop : t * hop + size] * w)) * 2 / w.sum()
        m[[0, -1]] /= 2
        level = lambda k: 20 * np.log10(max(m[k], 1e-12))  # noqa: B023,E731
        for r in range(cfg.rows):
            lo, hi = edge(r) * size / rate, edge(r + 1) * size / rate
            if hi - lo < 2:
                b = edge(r + 0.5) * size / rate
                k = min(int(b), size // 2)
                v = level(k) + (level(min(k + 1, size // 2)) - level(k)) * (b - k)
            else:
                v = max(level(k) for k in range(int(lo), min(int(np.ceil(hi)), size // 2) + 1))
            out.setdefault((t // fold, r), []).append(v)
    step = lambda v: int(np.floor(min(1, max(0, (v - cfg.floor_db) / (cfg.ceiling_db - cfg.floor_db))) * 255 + 0.5))
    return {(c // cfg.columns, c % cfg.columns, r): step(max(v) if how == "max" else np.mean(v)) for (c, r), v in out.items()}


@pytest.mark.parametrize(("level", "how"), [(0, "max"), (1, "max"), (3, "max"), (3, "mean")])
def test_tiles_against_a_loop(spark, level, how):
    x = np.random.default_rng(10).normal(0, 0.2, 1500)
    cfg = TileConfig(size=128, rows=12, columns=8, min_hz=50.0)
    hop, fold = spectral.tile_hop(cfg.size, level)
    got = {(r.tile, r.col, r.row): r.q for r in spectral.tiles(signal(spark, x), RATE, level, cfg, how).collect()}
    want = brute_tiles(x, RATE, cfg, hop, fold, how)
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) <= 1 and np.mean([got[k] == want[k] for k in want]) > 0.99


def test_overview_against_a_loop(spark):
    x = np.random.default_rng(11).normal(0, 0.2, 1000)
    cfg = TileConfig(size=128, rows=6, min_hz=50.0)
    got = {(r.col, r.row): r.q for r in spectral.overview(signal(spark, x), RATE, 5, cfg).collect()}
    for col in range(5):
        centre = int((col + 0.5) / 5 * 1000)
        part = np.r_[np.zeros(64), x, np.zeros(64)][centre : centre + 128]
        want = brute_tiles(part, RATE, cfg, 10**6, 1, "max")
        # the loop pads its input; its only frame must be the part itself
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)
        m = np.abs(np.fft.rfft(part * w)) * 2 / w.sum()
        m[[0, -1]] /= 2
        assert len(want) == 6 and all((col, r) in got for r in range(6))
        top = 20 * np.log10(m.max())
        assert max(got[col, r] for r in range(6)) <= int(np.floor((top + 96) / 96 * 255 + 0.5)) + 1


def test_transport_over_chunk_ends(spark, monkeypatch):
    monkeypatch.setattr(transport, "CHUNK", 4)
    rng = np.random.default_rng(12)
    rows = [(int(u), i, str(rng.choice(["load", "ready", "play", "pause", "seek", "end", "none"]))) for i, u in enumerate(rng.integers(0, 3, 60))]
    got = {r.i: (r.state, r.legal) for r in transport.states(spark.createDataFrame(rows, "u int, i int, c string"), "u", "i", "c").collect()}
    now = dict.fromkeys(range(3), "ready")
    moves = {(s, c): t for s, c, t in transport.MOVES}
    for u, i, c in rows:
        to = moves.get((now[u], c))
        now[u] = to or now[u]
        assert got[i] == (now[u], to is not None)
