"""Fourier transforms, STFT, frequency mapping, tiles, point queries and spectral features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import db_floor, quantise_db, window_value
from pulsegrid.model import StftConfig, TileConfig


def supported_size(n: int) -> bool:
    """Sizes whose largest prime factor is 11 or less."""
    for p in (2, 3, 5, 7, 11):
        while n > 1 and n % p == 0:
            n //= p
    return n == 1


def window_table(spark, name: str, n: int) -> DataFrame:
    i = spark.range(n).select(F.col("id").alias("i"))
    return i.withColumn("w", window_value(name, F.col("i").cast("double"), n))


def window_figures(table: DataFrame) -> DataFrame:
    """Coherent gain, and noise bandwidth in bins."""
    return table.agg(F.avg("w").alias("coherent_gain"), (F.sum(F.col("w") * F.col("w")) * F.count("*") / (F.sum("w") * F.sum("w"))).alias("noise_bandwidth"))


def _window(name: str, n: int) -> np.ndarray:
    w = 2 * np.pi * np.arange(n) / n
    if name == "rect":
        return np.ones(n)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(w)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(w)
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(w) + 0.08 * np.cos(2 * w)
    if name == "blackman_harris":
        return 0.35875 - 0.48829 * np.cos(w) + 0.14128 * np.cos(2 * w) - 0.01168 * np.cos(3 * w)
    if name == "kaiser":
        return np.i0(8.6 * np.sqrt(np.maximum(0, 1 - (2 * np.arange(n) / n - 1) ** 2))) / np.i0(8.6)
    raise ValueError(f"unknown window: {name}")


def scaled(magnitude: np.ndarray, window: np.ndarray, scaling: str, sample_rate: float) -> np.ndarray:
    """Magnitudes of one-sided spectra as amplitude, power or power density; all but the first and last bin count twice."""
    gain = window.sum()
    two = np.full(magnitude.shape[-1], 2.0)
    two[0] = two[-1] = 1.0
    if scaling == "raw":
        return magnitude
    if scaling == "amplitude":
        return magnitude * two / gain
    if scaling == "power":
        return (magnitude * two / gain) ** 2
    if scaling == "psd":
        return magnitude**2 * two / (sample_rate * (window**2).sum())
    raise ValueError(f"unknown scaling: {scaling}")


def transform(frames: DataFrame, key: list[str], array: str, window: str = "rect") -> DataFrame:
    """(key..., k, re, im): real forward transform of an array column, exploded to bins."""
    spec = frames.select(*key, F.col(array).cast("array<double>").alias("x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spec.select(*key).schema.fields) + ", re array<double>, im array<double>"

    def run(batches):
        for df in batches:
            z = [np.fft.rfft(np.asarray(x) * _window(window, len(x))) for x in df["x"]]
            yield df[key].assign(re=[v.real.tolist() for v in z], im=[v.imag.tolist() for v in z])

    out = spec.mapInPandas(run, schema).select(*key, F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return out.select(*key, "k", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def inverse(spectrum: DataFrame, key: list[str], n: int) -> DataFrame:
    """(key..., i, x): inverse of transform(), scaled by 1/n."""
    packed = spectrum.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "re", "im"))).alias("s")).select(*key, F.col("s.re").alias("re"), F.col("s.im").alias("im"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.select(*key).schema.fields) + ", x array<double>"

    def run(batches):
        for df in batches:
            yield df[key].assign(x=[np.fft.irfft(np.asarray(a) + 1j * np.asarray(b), n).tolist() for a, b in zip(df["re"], df["im"], strict=True)])

    return packed.mapInPandas(run, schema).select(*key, F.posexplode("x").alias("i", "x"))


#: Frames of analysis that are cut from one group of samples.
FRAMES = 64


def _grouped(samples: DataFrame, size: int, hop: int, shift: int) -> DataFrame:
    """(track, channel, g, n, at, x): the samples that frames g * FRAMES and on need, unordered, at their places after the shift; n is the signal's length.

    A sample goes to one group, or to two or more where frames of several reach over it.
    """
    stride = FRAMES * hop
    n = samples.groupBy("track", "channel").agg((F.max("frame") + 1).alias("n"))
    at = F.col("frame") + shift
    first = F.greatest(F.lit(0), F.floor((at - (stride - hop) - size) / stride) + 1)
    rows = samples.select("track", "channel", F.explode(F.sequence(first, F.floor(at / stride))).alias("g"), at.alias("at"), "x")
    packed = rows.where("x is not null").groupBy("track", "channel", "g").agg(F.collect_list(F.struct("at", "x")).alias("s")).select("track", "channel", "g", "s.at", "s.x")
    return packed.join(n, ["track", "channel"])


def _cut(g: int, n: int, at, x, size: int, hop: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the whole frames of a group, one row of samples for each); zero outside the signal."""
    count = (n + 2 * shift - size) // hop + 1
    t = np.arange(g * FRAMES, min((g + 1) * FRAMES, max(count, 0)))
    if not len(t):
        return t, np.zeros((0, size))
    dense = np.zeros((len(t) - 1) * hop + size)
    place = np.asarray(at) - t[0] * hop
    inside = place < len(dense)
    dense[place[inside]] = np.asarray(x, float)[inside]
    return t, np.lib.stride_tricks.sliding_window_view(dense, size)[::hop]


def _framed(samples: DataFrame, size: int, hop: int, centred: bool, columns: str, make) -> DataFrame:
    """(track, channel, t, columns): what make gives for the matrix of each group's frames, a list of lists of values."""
    shift = size // 2 if centred else 0
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        import pandas as pd

        for df in batches:
            for track, channel, g, at, x, n in df[["track", "channel", "g", "at", "x", "n"]].itertuples(index=False):
                t, rows = _cut(g, n, at, x, size, hop, shift)
                if len(t):
                    yield pd.DataFrame({"track": track, "channel": channel, "t": t, **dict(zip(names, make(rows), strict=True))})

    return _grouped(samples, size, hop, shift).mapInPandas(run, f"track string, channel int, t long, {columns}")


def frames_of(samples: DataFrame, size: int, hop: int, centred: bool) -> DataFrame:
    """(track, channel, t, x array): frame t starts hop * t frames in (half a frame earlier if centred), zero outside the signal."""
    return _framed(samples, size, hop, centred, "x array<double>", lambda rows: [rows.tolist()])


def frame_spectra(sample_rate: int, cfg: StftConfig):
    """The function from a matrix of frames to the lists of their magnitudes, real and imaginary parts."""
    if cfg.size < 2 or cfg.hop < 1 or cfg.hop > cfg.size or not supported_size(cfg.size):
        raise ValueError("unsupported STFT size or hop")
    w = _window(cfg.window, cfg.size)

    def spectra(rows):
        z = np.fft.rfft(rows * w, axis=1)
        return [scaled(np.abs(z), w, cfg.scaling, sample_rate).tolist(), z.real.tolist(), z.imag.tolist()]

    return spectra


def stft(samples: DataFrame, sample_rate: int, cfg: StftConfig = StftConfig()) -> DataFrame:
    """(track, channel, t, mag, re, im): arrays over the bins of every whole frame."""
    return _framed(samples, cfg.size, cfg.hop, cfg.centred, "mag array<double>, re array<double>, im array<double>", frame_spectra(sample_rate, cfg))


def frame_time(t: Column, hop: int, size: int, sample_rate: int, centred: bool) -> Column:
    """Seconds of the middle of frame t."""
    return (t * hop + (0 if centred else size / 2)) / sample_rate


def bin_frequency(k: Column, size: int, sample_rate: int) -> Column:
    return k * (sample_rate / size)


# -- frequency mapping ----------------------------------------------------------------------


def _to_scale(hz, axis):
    return {"linear": lambda: hz, "log": lambda: np.log2(hz), "mel": lambda: 2595 * np.log10(1 + hz / 700), "bark": lambda: 13 * np.arctan(0.00076 * hz) + 3.5 * np.arctan((hz / 7500) ** 2)}[axis]()


def _from_scale(s, axis):
    if axis == "linear":
        return s
    if axis == "log":
        return 2.0**s
    if axis == "mel":
        return 700 * (10 ** (s / 2595) - 1)
    low, high = np.zeros_like(s), np.full_like(s, 48_000.0)
    for _ in range(40):
        mid = (low + high) / 2
        under = _to_scale(mid, "bark") < s
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def frequency_rows(spark, rows: int, size: int, sample_rate: float, axis: str, min_hz: float) -> DataFrame:
    """(row, hz, lo, hi, frac): bins each display row takes the maximum of, or (spanning under two) the two it interpolates.

    A table of `rows` rows, built on the driver and broadcast.
    """
    top = sample_rate / 2
    s0, s1 = _to_scale(np.array(min_hz if axis == "log" else max(0.0, min_hz)), axis), _to_scale(np.array(top), axis)
    edges = _from_scale(s0 + (s1 - s0) * np.arange(rows + 1) / rows, axis) * size / sample_rate
    centre = _from_scale(s0 + (s1 - s0) * (np.arange(rows) + 0.5) / rows, axis)
    out = []
    last = size // 2
    for r in range(rows):
        if edges[r + 1] - edges[r] < 2:
            b = centre[r] * size / sample_rate
            lo = min(int(math.floor(b)), last)
            out.append((r, float(centre[r]), lo, min(lo + 1, last), float(b - lo)))
        else:
            out.append((r, float(centre[r]), int(math.floor(edges[r])), min(int(math.ceil(edges[r + 1])), last), None))
    return spark.createDataFrame(out, "row int, hz double, lo int, hi int, frac double")


def map_rows(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """(key..., row, db): magnitudes in dB per display row; frames carry (track, channel, t, mag)."""
    # the rows are a constant-size table: as an array they ride along, and explode per frame
    table = rows.agg(F.array_sort(F.collect_list(F.struct("row", "lo", "hi", "frac"))).alias("r")).first().r
    literal = F.array(*[F.struct(F.lit(r.row).alias("row"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), F.lit(r.frac).cast("double").alias("frac")) for r in table])
    joined = frames.select("track", "channel", "t", "mag", F.explode(literal).alias("r")).select("track", "channel", "t", "mag", "r.*")
    level = lambda x: db_floor(x)
    inside = F.array_max(F.slice("mag", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))
    a, b = level(F.get("mag", F.col("lo"))), level(F.get("mag", F.col("hi")))
    return joined.select("track", "channel", "t", "row", F.when(F.col("frac").isNull(), level(inside)).otherwise(a + (b - a) * F.col("frac")).alias("db"))


def nearest_row(rows: DataFrame, hz: float) -> DataFrame:
    return rows.agg(F.min_by("row", F.struct(F.abs(F.col("hz") - hz), "row")).alias("row"))


def tile_hop(size: int, level: int) -> tuple[int, int]:
    """(hop, frames folded into a column) of a tile level."""
    return (size // 4, 1) if level == 0 else (size // 2, 1) if level == 1 else (size, 1 << (level - 2))


def tiles(samples: DataFrame, sample_rate: int, level: int = 0, cfg: TileConfig = TileConfig(), decimate: str = "max") -> DataFrame:
    """(track, channel, tile, col, row, q): 8-bit levels of spectrogram tiles."""
    hop, fold = tile_hop(cfg.size, level)
    frames = stft(samples, sample_rate, StftConfig(cfg.size, hop, cfg.window, True, "amplitude"))
    rows = map_rows(frames, frequency_rows(samples.sparkSession, cfg.rows, cfg.size, sample_rate, cfg.axis, cfg.min_hz))
    how = F.max if decimate == "max" else F.avg
    g = rows.groupBy("track", "channel", F.floor(F.col("t") / fold).alias("c"), "row").agg(how("db").alias("db"))
    return g.select("track", "channel", F.floor(F.col("c") / cfg.columns).alias("tile"), (F.col("c") % cfg.columns).cast("int").alias("col"), "row", quantise_db(F.col("db"), cfg.floor_db, cfg.ceiling_db).alias("q"))


def overview(samples: DataFrame, sample_rate: int, width: int, cfg: TileConfig = TileConfig(size=1024, rows=64)) -> DataFrame:
    """(track, channel, col, row, q): one frame at the centre of each of `width` equal parts of the track."""
    n = samples.groupBy("track", "channel").agg((F.max("frame") + 1).alias("n"))
    half = cfg.size // 2
    cols = n.select("track", "channel", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("t"), "n").withColumn("centre", ((F.col("t") + 0.5) / width * F.col("n")).cast("long"))
    keyed = cols.select("track", "channel", "t", "centre", F.explode(F.sequence(F.floor((F.col("centre") - half) / cfg.size), F.floor((F.col("centre") + half - 1) / cfg.size))).alias("bucket"))
    near = samples.withColumn("bucket", F.floor(F.col("frame") / cfg.size)).join(keyed, ["track", "channel", "bucket"])
    near = near.withColumn("i", (F.col("frame") - F.col("centre") + half).cast("int")).where((F.col("i") >= 0) & (F.col("i") < cfg.size))
    packed = near.groupBy("track", "channel", F.col("t").cast("long").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    full = packed.select("track", "channel", "t", F.transform(F.sequence(F.lit(0), F.lit(cfg.size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))

    def run(batches):
        w = _window(cfg.window, cfg.size)
        for df in batches:
            if len(df):
                z = np.fft.rfft(np.stack(df["x"].to_list()) * w, axis=1)
                yield df[["track", "channel", "t"]].assign(mag=scaled(np.abs(z), w, "amplitude", sample_rate).tolist())

    frames = full.mapInPandas(run, "track string, channel int, t long, mag array<double>")
    rows = map_rows(frames, frequency_rows(samples.sparkSession, cfg.rows, cfg.size, sample_rate, cfg.axis, cfg.min_hz))
    return rows.select("track", "channel", F.col("t").alias("col"), "row", quantise_db(F.col("db"), cfg.floor_db, cfg.ceiling_db).alias("q"))


def peak_near(bins: DataFrame, key: list[str], target: float | Column, reach: int = 4) -> DataFrame:
    """(key..., k, offset, level): the strict local peak nearest to bin `target` within `reach` bins, else the largest bin there; refined by a parabola through the log magnitudes.

    bins: (key..., k, mag).
    """
    w = Window.partitionBy(*key).orderBy("k")
    lg = db_floor(F.col("mag"))
    rows = bins.withColumn("l", lg).withColumn("a", F.lag("l").over(w)).withColumn("b", F.lead("l").over(w)).where(F.abs(F.col("k") - target) <= reach)
    top = (F.col("l") > F.col("a")) & (F.col("l") > F.col("b"))
    cols = F.struct("k", "l", "a", "b")
    g = rows.groupBy(*key).agg(
        F.min_by(F.when(top, cols), F.when(top, F.struct(F.abs(F.col("k") - target), "k"))).alias("near"),
        F.max_by(cols, F.struct("l", -F.col("k"))).alias("top"),
    )
    g = g.withColumn("p", F.coalesce("near", "top"))
    a, m, b = F.col("p.a"), F.col("p.l"), F.col("p.b")
    bend = a - 2 * m + b
    offset = F.coalesce(F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (a - b) / bend))), F.lit(0.0))
    return g.select(*key, F.col("p.k").alias("k"), offset.alias("offset"), F.coalesce(m - 0.25 * (a - b) * offset, m).alias("level"))


def points(chunks: DataFrame, requests: DataFrame, sample_rate: int, size: int = 2048, window: str = "hann", frames: int = 65_536, reach: int = 4) -> DataFrame:
    """(request, hz, level): the spectral peak near a frequency at a place of a signal, see peak_near.

    chunks: (track, channel, chunk_idx, samples) of `frames` frames; requests: (request, track,
    channel, frame, hz), request unique.  A request is sent to the one or two chunks that its
    `size` samples around the frame lie in, and only these slices go on to its one transform;
    what lies outside the signal is 0.  A request whose samples all lie outside gives no row.
    """
    if size > frames or not supported_size(size):
        raise ValueError("unsupported transform size")
    begin = F.col("frame") - size // 2
    asked = requests.select("request", "track", "channel", "hz", begin.alias("begin"), F.explode(F.array_distinct(F.array(F.floor(begin / frames), F.floor((begin + size - 1) / frames)).cast("array<int>"))).alias("chunk_idx"))
    offset = F.col("begin") - F.col("chunk_idx") * frames
    low = F.greatest(offset, F.lit(0)).cast("int")
    met = asked.join(chunks.select("track", "channel", "chunk_idx", "samples"), ["track", "channel", "chunk_idx"])
    slices = met.select("request", "hz", (low - offset).cast("int").alias("at"), F.slice("samples", low + 1, F.greatest(F.lit(0), (offset + size - low).cast("int"))).alias("x"))
    packed = slices.where(F.size("x") > 0).groupBy("request", "hz").agg(F.collect_list(F.struct("at", "x")).alias("s")).select("request", "hz", "s.at", "s.x")
    w, kinds = _window(window, size), dict(requests.dtypes)

    def run(batches):
        for df in batches:
            mags = []
            for at, xs in zip(df["at"], df["x"], strict=True):
                dense = np.zeros(size)
                for a, x in zip(at, xs, strict=True):
                    dense[a : a + len(x)] = x
                mags.append(scaled(np.abs(np.fft.rfft(dense * w)), w, "amplitude", sample_rate).tolist())
            yield df[["request", "hz"]].assign(mag=mags)

    bins = packed.mapInPandas(run, f"request {kinds['request']}, hz double, mag array<double>").select("request", (F.col("hz") * size / sample_rate).alias("target"), F.posexplode("mag").alias("k", "mag"))
    near = peak_near(bins.where(F.abs(F.col("k") - F.col("target")) <= reach + 1), ["request", "target"], F.col("target"), reach)
    return near.select("request", ((F.col("k") + F.col("offset")) * sample_rate / size).alias("hz"), "level")


def features(bins: DataFrame, key: list[str], hz_per_bin: float) -> DataFrame:
    """Centroid, spread, rolloffs, flatness and band shares from (key..., k, mag)."""
    f, m = F.col("k") * hz_per_bin, F.col("mag")
    p = m * m
    w = Window.partitionBy(*key)
    rows = bins.withColumn("f", f).withColumn("p", p).withColumn("cum", F.sum("p").over(w.orderBy("k"))).withColumn("all", F.sum("p").over(w))
    band = lambda lo, hi: F.try_divide(F.sum(F.when((F.col("f") >= lo) & (F.col("f") < hi), F.col("p")).otherwise(0.0)), F.sum("p"))
    g = rows.groupBy(*key).agg(
        F.try_divide(F.sum(m * F.col("f")), F.sum(m)).alias("centroid"),
        F.sum(m * F.col("f") * F.col("f")).alias("m2"),
        F.sum(m).alias("m0"),
        F.min(F.when(F.col("cum") >= 0.85 * F.col("all"), F.col("f"))).alias("rolloff85"),
        F.min(F.when(F.col("cum") >= 0.95 * F.col("all"), F.col("f"))).alias("rolloff95"),
        F.try_divide(F.exp(F.avg(F.when(F.col("k") > 0, F.ln(F.col("p") + 1e-12)))), F.avg(F.when(F.col("k") > 0, F.col("p") + 1e-12))).alias("flatness"),
        band(0, 150).alias("share_low"), band(150, 1000).alias("share_lowmid"), band(1000, 5000).alias("share_highmid"), band(5000, 1e12).alias("share_high"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("m2"), F.col("m0")) - F.col("centroid") * F.col("centroid")))
    return g.withColumn("spread", spread).drop("m2", "m0")
