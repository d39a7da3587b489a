"""Closed-form and sequential checks of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.model import ClippingConfig, DcConfig, SilenceConfig, StftConfig
from pulsegrid.operators import beats, clipping, dc, islands, loudness, silence, spectral, stats, transients, waveform
from pulsegrid.sources import signals


def signal(spark, *channels, track="t"):
    rows = [(track, c, i, float(v)) for c, x in enumerate(channels) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "track string, channel int, frame long, x double")


def test_sine_and_square_levels(spark):
    n = np.arange(480 * 20)
    r = {x.channel: x for x in stats.channel_stats(signal(spark, np.sin(2 * np.pi * n / 480), np.where(n // 20 % 2, 1.0, -1.0)), 48_000).collect()}
    assert r[0].rms == pytest.approx(math.sqrt(0.5), abs=1e-9) and r[0].crest_db == pytest.approx(3.0103, abs=1e-3)
    assert r[1].crest_db == pytest.approx(0.0, abs=1e-9) and r[1].peak_frame == 0


def test_silence_has_no_peak_frame(spark):
    r = stats.channel_stats(signal(spark, np.zeros(100)), 1000).first()
    assert r.peak_frame == -1 and r.peak_dbfs == float("-inf") and r.crest_db == 0 and r.zero_crossings == 0


def test_stereo_identical_and_inverted(spark):
    x = np.random.default_rng(1).normal(0, 0.1, 2000)
    a = stats.stereo_summary(signal(spark, x, x)).first()
    b = stats.stereo_summary(signal(spark, x, -x)).first()
    assert a.correlation == pytest.approx(1) and b.correlation == pytest.approx(-1) and b.mono_compatibility_db == float("-inf")


def test_effective_bits(spark):
    v = np.random.default_rng(21).integers(-(2**15), 2**15, 5000)
    assert stats.bit_depth(signal(spark, v * 256 / 2**23), 24).first().effective_bits == 16
    assert stats.float_grid(signal(spark, v / 2**15)).first().grid_bits == 16


@pytest.mark.parametrize(("x", "kind"), [
    (np.full(5000, 0.1), "constant"),
    (np.r_[np.full(5000, 0.01), np.full(5000, -0.01)], "sectional"),
    (np.linspace(-0.1, 0.1, 10_000), "drifting"),
    (np.random.default_rng(3).normal(0, 0.001, 5000), "none"),
])
def test_dc_patterns(spark, x, kind):
    assert dc.patterns(signal(spark, x), 1000, DcConfig()).first().pattern == kind


def test_silence_regions_and_refinement(spark):
    x = np.r_[np.zeros(730), np.full(1000, 0.5), np.zeros(900)]
    s = signal(spark, x, x)
    frames = s.groupBy("track").agg((F.max("frame") + 1).alias("frame_count"))
    found = silence.regions(silence.by_threshold(stats.rms_series(s, 1000), SilenceConfig()), frames, SilenceConfig(), 0.05, 1000)
    got = {r.position: (r.frame_begin, r.frame_end) for r in silence.refine(found, s, SilenceConfig(), 50).collect()}
    assert got == {"leading": (0, 730), "trailing": (1730, 2630)}


def test_hysteresis_against_a_loop(spark):
    v = np.random.default_rng(5).uniform(-70, -50, 300)
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "p string, w long, l double")
    got = [r.quiet for r in islands.hysteresis(rows, ["p"], "w", F.col("l"), -60.0, -57.0).orderBy("w").collect()]
    state, want = True, []
    for x in v:
        state = False if x > -57 else True if x <= -60 else state
        want.append(state)
    assert got == want


def test_clip_runs_merge_with_their_gap(spark):
    x = np.zeros(200)
    x[10:14] = x[20:23] = 1.0
    x[100:102] = 1.0
    r = clipping.clip_runs(signal(spark, x), 1.0, 3, 6).collect()
    assert [(e.begin, e.end, e.sample_count) for e in r] == [(10, 23, 13)]
    assert clipping.totals(clipping.events(signal(spark, x * 1.4), ClippingConfig()), signal(spark, x)).first().n_over == 1


def test_pyramid_keeps_an_impulse_and_drops_odd_bins(spark):
    x = np.zeros(256 * 5)
    x[700] = 1.0
    levels = waveform.pyramid(waveform.bins(signal(spark, x)), 2)
    got = {(r.level, r.bin): r.max for r in levels.collect()}
    assert got[0, 2] == got[1, 1] == got[2, 0] == 1.0 and (1, 2) not in got
    assert (1, 2) in {(r.level, r.bin) for r in waveform.pyramid(waveform.bins(signal(spark, x)), 2, exact=True).collect()}


def test_chunked_k_weighting_equals_one_pass(spark):
    x = np.random.default_rng(7).normal(0, 0.2, 3000)
    got = np.array([r.x for r in loudness.k_weighted(signal(spark, x), 48_000, chunk=700).orderBy("frame").collect()])

    def section(x, num, den):
        out = np.zeros(len(x))
        for i in range(len(x)):
            out[i] = sum(num[j] * x[i - j] for j in range(3) if i >= j) - sum(den[j] * out[i - j] for j in (1, 2) if i >= j)
        return out

    y = section(section(x, *loudness.shelf_coefficients(48_000)), *loudness.highpass_coefficients(48_000))
    assert np.abs(got - y).max() < 1e-9


def test_published_coefficients():
    num, den = loudness.shelf_coefficients(48_000)
    assert num == pytest.approx([1.53512485958697, -2.69169618940638, 1.19839281085285], abs=1e-8) and den[1:] == pytest.approx([-1.69065929318241, 0.73248077421585], abs=1e-8)
    assert loudness.highpass_coefficients(48_000)[1][1:] == pytest.approx([-1.99004745483398, 0.99007225036621], abs=1e-8)


def test_sine_loudness(spark):
    rate, amp = 8000, 10 ** (-23 / 20)
    x = amp * np.sin(2 * np.pi * 997 * np.arange(rate * 2) / rate)
    z = loudness.blocks(loudness.k_weighted(signal(spark, x, x), rate, chunk=4000), rate, 2)
    assert loudness.integrated(loudness.momentary(z)).first().integrated_lufs == pytest.approx(-23.0, abs=0.3)


def test_true_peak_between_samples(spark):
    x = np.sin(2 * np.pi * np.arange(4000) / 4 + np.pi / 4)
    r = loudness.true_peak(signal(spark, x), chunk=1500).first()
    assert np.abs(x).max() == pytest.approx(0.7071, abs=1e-3) and r.true_peak == pytest.approx(1.0, abs=0.02)
    whole = np.abs(loudness.resample_block(x, 4)).max()
    assert r.true_peak == pytest.approx(whole, abs=5e-3)


def test_transform_round_trip_and_parseval(spark):
    x = np.random.default_rng(9).normal(size=(3, 60))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    s = spectral.transform(df, ["id"], "x")
    back = {(r.id, r.i): r.x for r in spectral.inverse(s, ["id"], 60).collect()}
    assert all(abs(back[i, j] - x[i, j]) < 1e-9 for i in range(3) for j in range(60))
    assert spectral.supported_size(2310) and not spectral.supported_size(26)


def test_stft_places_an_impulse(spark):
    x = np.zeros(2048)
    x[1000] = 1.0
    m = {r.t: max(r.mag) for r in spectral.stft(signal(spark, x), 8000, StftConfig(256, 64)).collect()}
    assert max(m, key=m.get) == round(1000 / 64)


def test_tone_is_one_bright_row(spark):
    rate = 8000
    x = np.sin(2 * np.pi * 1000 * np.arange(4096) / rate)
    f = spectral.stft(signal(spark, x), rate, StftConfig(1024, 512))
    for axis in ("linear", "log", "mel", "bark"):
        rows = spectral.frequency_rows(spark, 64, 1024, rate, axis, 20.0)
        want = spectral.nearest_row(rows, 1000.0).first().row
        top = spectral.map_rows(f.where("t = 3"), rows).orderBy(F.col("db").desc()).first().row
        assert abs(top - want) <= 1, axis


def test_whitening_against_a_loop(spark):
    v = np.abs(np.random.default_rng(11).normal(size=300))
    s = spark.createDataFrame([("a", i, 0, float(x)) for i, x in enumerate(v)], "track string, t long, k int, mag double")
    got = [r.mag for r in beats.whitened(s).orderBy("t").collect()]
    peak, want = 0.0, []
    for x in v:
        peak = max(x, 0.9997 * peak)
        want.append(x / max(peak, 1e-6))
    assert np.allclose(got, want, atol=1e-12)


def test_tempo_of_a_pulse_train(spark):
    v = [(1.0 if i % 25 == 0 else 0.0) for i in range(600)]
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "track string, t long, v double")
    best = beats.tempo(beats.tempo_scores(s, 0.02)).where("rank = 1").first()
    assert best.bpm == pytest.approx(120, abs=1)
    found = [r.t for r in beats.track_beats(s, 25.0).orderBy("t").collect()]
    assert set(np.diff(found)) == {25} and found[0] % 25 == 0


def test_refractory_against_a_loop(spark):
    at = np.unique(np.random.default_rng(13).integers(0, 500, 120))
    df = spark.createDataFrame([("a", int(x)) for x in at], "track string, t long")
    got = sorted(r.t for r in islands.refractory(df, ["track"], "t", 7.0).collect())
    want = []
    for x in at:
        if not want or x - want[-1] > 7:
            want.append(int(x))
    assert got == want


def test_click_and_dropout(spark):
    rng = np.random.default_rng(17)
    x = np.sin(2 * np.pi * 200 * np.arange(4096) / 44_100) * 0.3 + rng.normal(0, 1e-4, 4096)
    y = x.copy()
    y[2000] += 0.8
    y[3000:3200] = 0.0
    clicks = [r.frame for r in transients.merged_clicks(transients.click_candidates(signal(spark, y))).collect()]
    assert any(abs(f - 2000) <= 2 for f in clicks)
    assert [(r.begin, r.n) for r in transients.dropouts(signal(spark, y), 44_100).where("n > 100").collect()] == [(3000, 200)]
    assert transients.dropouts(signal(spark, x), 44_100, -120.0).count() == 0


def test_chunks_round_trip(spark):
    x = np.random.default_rng(19).normal(size=1000).astype(np.float32)
    s = signal(spark, x)
    back = signals.from_chunks(signals.to_chunks(s, 128))
    assert back.join(s, ["track", "channel", "frame", "x"]).count() == 1000
