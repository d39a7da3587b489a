"""Whole analyses of a signal: beats and transients, from samples to results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp, db
from pulsegrid.model import PeakPickConfig, StftConfig, TempoConfig
from pulsegrid.operators import beats, spectral, stats, transients
from pulsegrid.sources.shared import written


@dataclass(frozen=True)
class BeatConfig:
    size: int = 2048
    hop: int = 512
    low_hz: float = 200.0
    high_hz: float = 4000.0
    picking: PeakPickConfig = PeakPickConfig()
    tempo: TempoConfig = TempoConfig()
    snap: float = 0.15


@dataclass(frozen=True)
class BeatAnalysis:
    """series (track, t, v); onsets (track, t, at, frame, strength, band_mask); tempo (track, bpm, confidence, stable, phase_confidence);
    alternatives (track, rank, bpm, score); beats (track, at, frame, confidence).  A track without a tempo has no beats."""

    series: DataFrame
    onsets: DataFrame
    tempo: DataFrame
    alternatives: DataFrame
    beats: DataFrame


def detection_series(samples: DataFrame, sample_rate: int, cfg: BeatConfig = BeatConfig()) -> tuple[DataFrame, DataFrame]:
    """(series of the combined onset detection function of the mono sum, band masks), one row a hop."""
    frames = spectral.stft(stats.mono_sum(samples), sample_rate, StftConfig(cfg.size, cfg.hop))
    bands = tuple(round(hz * cfg.size / sample_rate) for hz in (cfg.low_hz, cfg.high_hz))
    found = written(beats.detections(frames, bands), "functions")
    parts = [found.select("track", "t", F.col(c).alias("v")) for c in ("flux", "deviation", "content")]
    window = max(1, int(sample_rate / cfg.hop))
    series = beats.combined([(beats.normalised(p, window), 1.0) for p in parts])
    return series, found.select("track", "t", "band_mask")


def analyze_beats(samples: DataFrame, sample_rate: int, cfg: BeatConfig = BeatConfig()) -> BeatAnalysis:
    """Onsets, tempo and beats of each track.  Only the series, one value a hop, is worked on track by track."""
    hop_s = cfg.hop / sample_rate
    series, masks = detection_series(samples, sample_rate, cfg)
    series = written(series.join(masks, ["track", "t"]), "detection")
    values = series.select("track", "t", "v")
    onsets = beats.onsets(values, hop_s, cfg.picking).join(series.select("track", "t", "band_mask"), ["track", "t"])
    onsets = written(onsets.select("track", "t", "at", F.round(F.col("at") * sample_rate).cast("long").alias("frame"), F.col("v").alias("strength"), "band_mask"), "onsets")

    alternatives = written(beats.tempo(beats.tempo_scores(values, hop_s, cfg.tempo), cfg.tempo), "tempo")
    best = alternatives.where("rank = 1").select("track", "bpm", "confidence")
    refined = beats.refined_bpm(onsets.join(best.select("track", "bpm"), "track"), F.col("bpm")).withColumnRenamed("bpm", "refined")
    stable = beats.tempo_series(values, hop_s, cfg.tempo).groupBy("track").agg(F.bool_and("stable").alias("stable"))
    tempo = best.join(refined, "track", "left").join(stable, "track", "left").select("track", F.coalesce("refined", "bpm").alias("bpm"), "confidence", F.coalesce("stable", F.lit(True)).alias("stable"))
    tempo = written(tempo, "refined")

    period = tempo.where("bpm > 0").select("track", (60 / F.col("bpm") / hop_s).alias("period"))
    tracked = written(beats.track_beats(values.join(period, "track")), "beats")
    phase = beats.phase_confidence(values, tracked).withColumnRenamed("confidence", "phase_confidence")
    tolerance = period.select("track", (F.col("period") * hop_s * cfg.snap).alias("tolerance"))
    timed = tracked.join(values, ["track", "t"]).select("track", (F.col("t") * hop_s).alias("at"), F.col("v").alias("confidence"))
    moved = beats.snapped(timed.join(tolerance, "track"), onsets.join(tolerance, "track"), F.col("tolerance"))
    found = timed.join(moved, ["track", "at"]).select("track", F.col("snapped").alias("at"), F.round(F.col("snapped") * sample_rate).cast("long").alias("frame"), "confidence")
    tempo = tempo.join(phase, "track", "left").withColumn("phase_confidence", F.coalesce("phase_confidence", F.lit(0.0)))
    return BeatAnalysis(values, onsets, tempo, alternatives, found)


@dataclass(frozen=True)
class TransientConfig:
    search_ms: float = 20.0
    decay_ms: float = 500.0
    feature_ms: float = 30.0
    coincidence_ms: float = 5.0
    click_factor: float = 6.0


def onset_features(samples: DataFrame, at: DataFrame, sample_rate: int, window_ms: float = 30.0) -> DataFrame:
    """(track, channel, cand, centroid, ..., share_high) of the window that begins at each frame `cand`, with a periodic Hann window over the samples there are."""
    wanted = max(2, int(window_ms * 0.001 * sample_rate))
    size = wanted
    while not spectral.supported_size(size):
        size += 1
    near = transients.around(samples, at, 0, wanted)
    packed = near.groupBy("track", "channel", "cand").agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("s")).select("track", "channel", "cand", F.col("s.x").alias("x"))

    def run(batches):
        for df in batches:
            mags = []
            for x in df["x"]:
                x = np.asarray(x, float)
                mags.append(np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))), size)).tolist())
            yield df[["track", "channel", "cand"]].assign(mag=mags)

    spectra = packed.mapInPandas(run, "track string, channel int, cand long, mag array<double>")
    bins = spectra.select("track", "channel", "cand", F.posexplode("mag").alias("k", "mag"))
    return spectral.features(bins, ["track", "channel", "cand"], sample_rate / size)


def analyze_transients(samples: DataFrame, onsets: DataFrame, sample_rate: int, cfg: TransientConfig = TransientConfig()) -> DataFrame:
    """(track, start, attack, class, confidence, strength, peak_dbfs, attack_ms, decay_ms, centroid, flatness, share_*): the transient at each onset, and clicks and dropouts.

    onsets are those of analyze_beats; clicks within coincidence_ms of one are none.
    """
    mono = written(stats.mono_sum(samples), "mono")
    reach = round(cfg.search_ms * 0.001 * sample_rate)
    at = onsets.select("track", F.col("frame").alias("cand"), "strength", F.col("at"))
    timed = written(transients.attack(transients.around(mono, at, reach, reach + 1), sample_rate), "attacks")
    wide = transients.around(mono, at, reach, reach + round(cfg.decay_ms * 0.001 * sample_rate))
    times = transients.peak_and_times(wide, timed.select("track", "channel", "cand", "start"), sample_rate)
    heard = onset_features(mono, timed.select("track", F.col("attack").alias("cand")).distinct(), sample_rate, cfg.feature_ms).withColumnRenamed("cand", "attack")
    rows = timed.join(times, ["track", "channel", "cand"]).join(heard, ["track", "channel", "attack"]).join(at.select("track", "cand", "strength"), ["track", "cand"])
    found = transients.classified(rows.withColumn("decay_ms", F.coalesce("decay_ms", F.lit(cfg.decay_ms))))
    shares = ["share_low", "share_lowmid", "share_highmid", "share_high"]
    musical = found.select("track", "start", "attack", "class", "confidence", "strength", db(F.col("peak")).alias("peak_dbfs"), "attack_ms", "decay_ms", "centroid", "flatness", *shares)

    clicks = transients.merged_clicks(transients.click_candidates(mono, factor=cfg.click_factor)).withColumn("at", F.col("frame") / sample_rate)
    clicks = beats.without_near(clicks, onsets.select("track", "at"), cfg.coincidence_ms / 1000)
    clicks = clicks.join(mono.select("track", "frame", "x"), ["track", "frame"])
    none = F.lit(None).cast("double")
    clicks = clicks.select("track", F.col("frame").alias("start"), F.col("frame").alias("attack"), F.lit("click").alias("class"), clamp(F.col("ratio") / (2 * cfg.click_factor), 0.0, 1.0).alias("confidence"), F.lit(1.0).alias("strength"), db(F.abs("x")).alias("peak_dbfs"), none.alias("attack_ms"), none.alias("decay_ms"), none.alias("centroid"), none.alias("flatness"), *[none.alias(c) for c in shares])
    gaps = transients.dropouts(mono, sample_rate)
    gaps = gaps.select("track", F.col("begin").alias("start"), F.col("begin").alias("attack"), F.lit("dropout").alias("class"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("strength"), F.lit(float("-inf")).alias("peak_dbfs"), none.alias("attack_ms"), F.col("length_ms").alias("decay_ms"), none.alias("centroid"), none.alias("flatness"), *[none.alias(c) for c in shares])
    return musical.unionByName(clicks).unionByName(gaps)
