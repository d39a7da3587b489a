"""Loudness: K-weighting, gated integration, loudness range, true peak."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import db, lufs
from pulsegrid.model import LoudnessConfig
from pulsegrid.operators import islands

KEY = ["track", "channel"]


# -- K-weighting ---------------------------------------------------------------------------


def shelf_coefficients(sample_rate: float) -> tuple[list[float], list[float]]:
    """High shelf of the K curve by the bilinear transform; (numerator, denominator)."""
    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196  # fixed values: the published curve
    k = math.tan(math.pi * f0 / sample_rate)
    vh = 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    return [(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0], [1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]


def highpass_coefficients(sample_rate: float) -> tuple[list[float], list[float]]:
    f0, q = 38.13547087602444, 0.5003270373238773  # fixed values: the published curve
    k = math.tan(math.pi * f0 / sample_rate)
    a0 = 1 + k / q + k * k
    return [1.0, -2.0, 1.0], [1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]


#: Samples that a block of the filter takes in one matrix product.
STEP = 64


class _Cascade:
    """Two second-order sections as one linear system s' = A s + B x, y = C s + D x, run over blocks of STEP samples."""

    def __init__(self, first, second):
        (b0, b1, b2), (_, a1, a2) = first
        (c0, c1, c2), (_, d1, d2) = second
        self.a = np.array([[-a1, 1, 0, 0], [-a2, 0, 0, 0], [c1 - d1 * c0, 0, -d1, 1], [c2 - d2 * c0, 0, -d2, 0]])
        self.b = np.array([b1 - a1 * b0, b2 - a2 * b0, (c1 - d1 * c0) * b0, (c2 - d2 * c0) * b0])
        c = np.array([c0, 0, 1, 0])
        powers = [np.eye(4)]
        for _ in range(STEP):
            powers.append(self.a @ powers[-1])
        self.step = powers[STEP]
        self.out = np.stack([c @ p for p in powers[:STEP]])  # what the state adds to each sample
        answer = np.r_[c0 * b0, [c @ p @ self.b for p in powers[: STEP - 1]]]
        i, j = np.indices((STEP, STEP))
        self.own = np.where(i >= j, answer[np.maximum(i - j, 0)], 0.0)  # what a block's samples add to one another
        self.into = np.stack([powers[STEP - 1 - k] @ self.b for k in range(STEP)], axis=1)

    def __call__(self, x: np.ndarray, state: np.ndarray, wanted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(filtered samples, final state); the samples are left out unless wanted."""
        full = len(x) // STEP * STEP
        blocks = x[:full].reshape(-1, STEP)
        pushed, states = blocks @ self.into.T, np.empty((len(blocks) + 1, 4))
        states[0] = state
        for i, p in enumerate(pushed):
            states[i + 1] = self.step @ states[i] + p
        s, tail = states[-1], x[full:]
        ys = [(blocks @ self.own.T + states[:-1] @ self.out.T).ravel()] if wanted else []
        if wanted and len(tail):
            ys.append(self.own[: len(tail), : len(tail)] @ tail + self.out[: len(tail)] @ s)
        for v in tail.tolist():
            s = self.a @ s + self.b * v
        return np.concatenate(ys) if ys else np.zeros(0), s


def k_filter(sample_rate: float) -> _Cascade:
    return _Cascade(shelf_coefficients(sample_rate), highpass_coefficients(sample_rate))


def k_weighted(samples: DataFrame, sample_rate: int, chunk: int = 65_536) -> DataFrame:
    """The K-weighted samples, filtered chunk by chunk in parallel.

    A linear filter's answer is that to the chunk from rest plus that to the state it starts
    in.  Pass 1 computes each chunk's final state from rest; those are few rows a channel, from
    which the true starting states follow in order; pass 2 filters each chunk from its own.
    """
    cascade = k_filter(sample_rate)
    parts = samples.withColumn("chunk", F.floor(F.col("frame") / chunk).cast("int"))
    packed = parts.groupBy(*KEY, "chunk").agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("s")).select(*KEY, "chunk", F.col("s.frame").alias("frames"), F.col("s.x").alias("xs"))

    def rest(batches):
        for df in batches:
            ends = [cascade(np.asarray(x, float), np.zeros(4), wanted=False)[1].tolist() for x in df["xs"]]
            yield df[[*KEY, "chunk"]].assign(n=[len(x) for x in df["xs"]], state=ends)

    ends = packed.mapInPandas(rest, "track string, channel int, chunk int, n int, state array<double>")

    # the state after n frames without input is A^n times the one before
    def chain(df):
        df = df.sort_values("chunk")
        now, out = np.zeros(4), []
        for n, state in zip(df["n"], df["state"], strict=True):
            out.append(now.tolist())
            now = np.linalg.matrix_power(cascade.a, int(n)) @ now + np.asarray(state)
        return df[[*KEY, "chunk"]].assign(start=out)

    starts = ends.groupBy(*KEY).applyInPandas(chain, "track string, channel int, chunk int, start array<double>")

    def filtered(batches):
        for df in batches:
            ys = [cascade(np.asarray(x, float), np.asarray(s, float))[0] for x, s in zip(df["xs"], df["start"], strict=True)]
            yield df[[*KEY, "frames"]].assign(ys=ys)

    done = packed.join(starts, [*KEY, "chunk"]).mapInPandas(filtered, "track string, channel int, frames array<long>, ys array<double>")
    return done.select(*KEY, F.explode(F.arrays_zip("frames", "ys")).alias("p")).select(*KEY, F.col("p.frames").alias("frame"), F.col("p.ys").alias("x"))


# -- blocks, windows, gates ----------------------------------------------------------------


def channel_weight(channels: int) -> Column:
    """Weight by channel number for a channel count: surrounds 1.41, the LFE of six channels 0, all others 1."""
    c = F.col("channel")
    if channels == 5:
        return F.when(c >= 3, 1.41).otherwise(1.0)
    if channels == 6:
        return F.when(c == 3, 0.0).when(c >= 4, 1.41).otherwise(1.0)
    return F.lit(1.0)


def mask_weights(mask: Column) -> Column:
    """array of weights for the channels that a WAV channel mask names, in bit order: LFE 0, back and side channels 1.41."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(17)), lambda b: F.expr("1") * F.bit_get(mask, b) == 1)
    return F.transform(bits, lambda b: F.when(b == 3, 0.0).when(b.isin(4, 5, 9, 10), 1.41).otherwise(1.0))


def blocks(samples: DataFrame, sample_rate: int, channels: int) -> DataFrame:
    """(track, b, z): weighted mean square of whole 100 ms blocks; a partial last one is dropped."""
    size = round(sample_rate * 0.1)
    g = samples.groupBy(*KEY, F.floor(F.col("frame") / size).alias("b")).agg(F.avg(F.col("x") * F.col("x")).alias("ms"), F.count("*").alias("n")).where(F.col("n") == size)
    return g.groupBy("track", "b").agg(F.sum(channel_weight(channels) * F.col("ms")).alias("z"))


def sliding(z: DataFrame, k: int) -> DataFrame:
    """(track, w, z): means of k successive blocks, from the first full one on; w counts from 0."""
    w = Window.partitionBy("track").orderBy("b")
    return z.withColumn("m", F.avg("z").over(w.rowsBetween(1 - k, 0))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") >= k).select("track", (F.col("rn") - k).cast("long").alias("w"), F.col("m").alias("z"))


def momentary(z: DataFrame) -> DataFrame:
    return sliding(z, 4).withColumn("lufs", lufs(F.col("z")))


def short_term(z: DataFrame) -> DataFrame:
    return sliding(z, 30).withColumn("lufs", lufs(F.col("z")))


def _gate(level: float) -> float:
    return 10 ** ((level + 0.691) / 10)


def integrated(windows: DataFrame, cfg: LoudnessConfig = LoudnessConfig()) -> DataFrame:
    """(track, integrated_lufs): mean of the momentary windows above both gates, inclusive; null if none is."""
    loud = windows.where(F.col("z") >= _gate(cfg.absolute_gate))
    bar = loud.groupBy("track").agg((F.avg("z") * 10 ** (cfg.relative_gate / 10)).alias("bar"))
    g = loud.join(bar, "track").where("z >= bar").groupBy("track").agg(lufs(F.avg("z")).alias("integrated_lufs"))
    return windows.select("track").distinct().join(g, "track", "left")


def loudness_range(z: DataFrame, cfg: LoudnessConfig = LoudnessConfig()) -> DataFrame:
    """(track, lra): 95th less 10th percentile (nearest rank) of the gated short-term levels, one a second."""
    st = sliding(z, 30).where("w % 10 = 0")
    loud = st.where(F.col("z") >= _gate(cfg.absolute_gate))
    bar = loud.groupBy("track").agg((F.avg("z") * 10 ** (cfg.range_gate / 10)).alias("bar"))
    kept = loud.join(bar, "track").where("z >= bar")
    w = Window.partitionBy("track")
    ranked = kept.withColumn("i", F.row_number().over(w.orderBy("z")) - 1).withColumn("n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("i") == F.round(F.lit(p) * (F.col("n") - 1)), lufs(F.col("z"))))
    return ranked.groupBy("track").agg((at(0.95) - at(0.10)).alias("lra"), F.max("n").alias("windows"))


# -- resampling and true peak ---------------------------------------------------------------

# fixed values: taps, phases and stop-band attenuation of the quality levels
QUALITY = {"fast": (16, 64, 60.0), "good": (32, 128, 80.0), "best": (64, 256, 100.0)}


def polyphase(quality: str, cutoff: float = 1.0) -> np.ndarray:
    """phases + 1 rows of taps: a Kaiser-windowed sinc, each row summing to 1."""
    taps, phases, attenuation = QUALITY[quality]
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21)
    t = np.arange(taps) - taps / 2 + 1
    x = t[None, :] - np.arange(phases + 1)[:, None] / phases
    # sin(pi * v) isn't 0 in doubles: at whole positions the sample itself has to come out, or one at full scale passes for a peak above it
    v = cutoff * x
    h = cutoff * np.where((v == np.round(v)) & (v != 0), 0.0, np.sinc(v)) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (2 * x / taps) ** 2))) / np.i0(beta)
    return h / h.sum(axis=1, keepdims=True)


def resample_block(x: np.ndarray, ratio: float, quality: str = "best") -> np.ndarray:
    """x at `ratio` times its rate; the signal is 0 outside."""
    if ratio == 1:
        return x.copy()
    taps, phases, _ = QUALITY[quality]
    table = polyphase(quality, min(1.0, ratio))
    at = np.arange(int(np.floor(len(x) * ratio))) / ratio
    base = np.floor(at).astype(np.int64)
    where = (at - base) * phases
    p = np.minimum(np.floor(where).astype(np.int64), phases - 1)
    part = (where - p)[:, None]
    padded = np.r_[np.zeros(taps), x, np.zeros(taps)]
    rows = padded[(base + taps - taps // 2 + 1)[:, None] + np.arange(taps)]
    return (rows * (table[p] * (1 - part) + table[p + 1] * part)).sum(axis=1)


def _oversampled(df, n: int, c: int, oversampling: int, chunk: int, halo: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, absolute values) of chunk c of a signal of n frames, from its rows and its neighbours' within `halo`.

    Every row goes to the place that its frame says: missing and null samples are 0, and those of one frame add up.
    """
    begin = c * chunk - halo
    dense = np.zeros(chunk + 2 * halo)
    np.add.at(dense, df["frame"].to_numpy() - begin, np.nan_to_num(df["x"].to_numpy(float), nan=0.0, posinf=np.inf, neginf=-np.inf))
    y = np.abs(resample_block(dense, oversampling))
    i = np.arange(halo * oversampling, halo * oversampling + (min(n, (c + 1) * chunk) - c * chunk) * oversampling)
    return begin + i / oversampling, y[i]


def _with_halo(samples: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Rows by chunks with a halo, and the frames of their channel as n."""
    x = samples.select(*KEY, "frame", F.col("x").cast("double").alias("x"))
    n = x.groupBy(*KEY).agg((F.max("frame") + 1).alias("n"))
    parts = islands.chunked(x, "frame", halo, halo, chunk).where("_chunk >= 0")
    # a halo may reach beyond the last chunk, where nothing is asked for
    return parts.join(F.broadcast(n), KEY).where(F.col("_chunk") * chunk < F.col("n"))


def true_peak(samples: DataFrame, oversampling: int = 4, chunk: int = 65_536, halo: int = 64) -> DataFrame:
    """Per channel: oversampled peak, its frame, and dBTP.  Chunks carry a halo of their neighbours' frames and run in parallel; missing frames are 0."""

    def peaks(df):
        pos, y = _oversampled(df, int(df["n"].iloc[0]), int(df["_chunk"].iloc[0]), oversampling, chunk, halo)
        i = int(np.argmax(y))
        return df.iloc[:1][[*KEY]].assign(peak=float(y[i]), frame=int(round(pos[i])))

    found = _with_halo(samples, chunk, halo).groupBy(*KEY, "_chunk").applyInPandas(peaks, "track string, channel int, peak double, frame long")
    g = found.groupBy(*KEY).agg(F.max(F.struct("peak", (-F.col("frame")).alias("back"))).alias("p"))
    return g.select(*KEY, F.col("p.peak").alias("true_peak"), (-F.col("p.back")).alias("frame"), db(F.col("p.peak")).alias("dbtp"))


def inter_sample_peaks(samples: DataFrame, threshold_db: float = 0.0, oversampling: int = 4, chunk: int = 65_536, halo: int = 64) -> DataFrame:
    """Oversampled positions above the threshold, each with the sample peak of its processing chunk.

    Chunks carry a halo of their neighbours' frames for the interpolation, so that the positions
    and peaks don't depend on where chunks end; a chunk's sample peak is that of its own frames.
    Missing frames are 0; a chunk without frames of its own has no peaks.
    """
    limit = 10 ** (threshold_db / 20)

    def over(df):
        own = df["_own"].to_numpy()
        pos, y = _oversampled(df, int(df["n"].iloc[0]), int(df["_chunk"].iloc[0]), oversampling, chunk, halo)
        i = np.flatnonzero(y > limit) if own.any() else np.zeros(0, np.int64)
        one = df.iloc[:1][[*KEY]]
        x = np.abs(df["x"].to_numpy(float)[own])
        return one.loc[one.index.repeat(len(i))].assign(frame=np.round(pos[i]).astype(np.int64), peak=y[i], sample_peak=float(np.nanmax(x)) if np.isfinite(x).any() else None)

    return _with_halo(samples, chunk, halo).groupBy(*KEY, "_chunk").applyInPandas(over, "track string, channel int, frame long, peak double, sample_peak double")
