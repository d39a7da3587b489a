"""Onset detection functions, peak picking, tempo, beat tracking and beat edits.

Spectra come as (track, t, k, mag[, re, im]); series as (track, t, v).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp
from pulsegrid.model import PeakPickConfig, TempoConfig
from pulsegrid.operators import islands, tracking


def whitened(spectra: DataFrame, decay: float = 0.9997, floor: float = 1e-6) -> DataFrame:
    """mag over its bin's decaying running maximum: peak_t = max(mag_t, decay * peak_{t-1}).

    In closed form ln peak_t is the running maximum of ln mag_s - s ln decay, plus t ln decay;
    in logarithms nothing underflows, however long the track is.
    """
    w = Window.partitionBy("track", "k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    slope = F.col("t") * math.log(decay)
    peak = F.exp(F.max(F.ln("mag") - slope).over(w) + slope)  # silent frames have no logarithm and raise nothing
    return spectra.withColumn("mag", F.col("mag") / F.greatest(F.coalesce(peak, F.lit(0.0)), F.lit(floor)))


def flux(spectra: DataFrame, bands: tuple[int, int], lam: float = 1000.0, share: float = 0.2) -> DataFrame:
    """(track, t, flux, band_mask): half-wave rectified log-magnitude rise, and the bands that hold a fifth of it."""
    w = Window.partitionBy("track", "k").orderBy("t")
    rows = spectra.withColumn("lm", F.ln(1 + lam * F.col("mag")))
    rows = rows.withColumn("d", F.greatest(F.lit(0.0), F.coalesce(F.col("lm") - F.lag("lm").over(w), F.lit(0.0))))
    band = F.when(F.col("k") < bands[0], 0).when(F.col("k") < bands[1], 1).otherwise(2)
    g = rows.groupBy("track", "t").agg(F.sum("d").alias("flux"), *[F.sum(F.when(band == b, F.col("d")).otherwise(0.0)).alias(f"b{b}") for b in range(3)])
    mask = sum((F.when((F.col("flux") > 0) & (F.col(f"b{b}") >= share * F.col("flux")), 1 << b).otherwise(0) for b in range(3)), F.lit(0))
    return g.select("track", "t", "flux", mask.alias("band_mask"))


def complex_deviation(spectra: DataFrame) -> DataFrame:
    """(track, t, v): distance of each bin from where its last magnitude and steady phase advance would put it."""
    w = Window.partitionBy("track", "k").orderBy("t")
    rows = spectra.withColumn("ph", F.atan2("im", "re"))
    rows = rows.withColumn("p1", F.lag("ph", 1).over(w)).withColumn("p2", F.lag("ph", 2).over(w)).withColumn("m1", F.lag("mag").over(w))
    target = 2 * F.col("p1") - F.col("p2")
    d = F.hypot(F.col("re") - F.col("m1") * F.cos(target), F.col("im") - F.col("m1") * F.sin(target))
    return rows.groupBy("track", "t").agg(F.sum(F.coalesce(d, F.lit(0.0))).alias("v"))


def high_frequency_content(spectra: DataFrame) -> DataFrame:
    return spectra.groupBy("track", "t").agg(F.sum(F.col("k") * F.col("mag") * F.col("mag")).alias("v"))


def detections(frames: DataFrame, bands: tuple[int, int], lam: float = 1000.0, share: float = 0.2, decay: float = 0.9997, floor: float = 1e-6, chunk: int = 256) -> DataFrame:
    """(track, t, flux, band_mask, deviation, content) of whole frames (track, t, mag[], re[], im[]): flux, complex_deviation and high_frequency_content after whitened, in one pass.

    Frames are taken by chunks with the two frames before them; a chunk's own maxima, one row a
    bin, are all that the running peaks need of the chunks before it.  Frames are numbered
    without gaps: one whose predecessors are missing counts as a track's first.
    """
    kind, slope = dict(frames.dtypes)["track"], math.log(decay)
    rows = frames.select("track", "t", "mag", "re", "im", F.floor(F.col("t") / chunk).alias("c"))

    def stacked(df, name):
        return np.stack([np.asarray(x, float) for x in df[name]])

    def levels(df):
        with np.errstate(divide="ignore"):
            return np.log(stacked(df, "mag")) - df["t"].to_numpy()[:, None] * slope

    def maxima(df):
        top = levels(df).max(axis=0)
        return tracking.of_one(df["track"].iloc[0], c=np.full(len(top), df["c"].iloc[0]), k=np.arange(len(top)), top=top)

    def figures(df, past):
        import pandas as pd

        df = df.sort_values("t")
        own = df["own"].to_numpy(bool) if len(df) else np.zeros(0, bool)
        if not own.any():
            return pd.DataFrame(columns=["track", "t", "flux", "band_mask", "deviation", "content"])
        t, mag, re, im = df["t"].to_numpy(), stacked(df, "mag"), stacked(df, "re"), stacked(df, "im")
        before = np.full(mag.shape[1], -np.inf)
        before[past["k"].to_numpy(int)] = past["before"].to_numpy(float)
        peak = np.exp(np.maximum(np.maximum.accumulate(levels(df), axis=0), before) + t[:, None] * slope)
        white = mag / np.maximum(peak, floor)
        n = len(t)
        one, two = np.zeros(n, bool), np.zeros(n, bool)
        one[1:], two[2:] = t[1:] == t[:-1] + 1, t[2:] == t[:-2] + 2
        rise = np.zeros_like(mag)
        rise[1:] = np.maximum(0.0, np.diff(np.log(1 + lam * white), axis=0))
        rise[~one] = 0
        total = rise.sum(axis=1)
        of = np.stack([rise[:, a:b].sum(axis=1) for a, b in ((0, bands[0]), (bands[0], bands[1]), (bands[1], None))])
        mask = (((total > 0) & (of >= share * total)) * np.array([[1], [2], [4]])).sum(axis=0)
        phase, off = np.arctan2(im, re), np.zeros(n)
        target = 2 * phase[1:-1] - phase[:-2]
        off[2:] = np.hypot(re[2:] - white[1:-1] * np.cos(target), im[2:] - white[1:-1] * np.sin(target)).sum(axis=1)
        off[~two] = 0
        content = (np.arange(mag.shape[1]) * white * white).sum(axis=1)
        return tracking.of_one(df["track"].iloc[0], t=t[own], flux=total[own], band_mask=mask[own].astype(np.int32), deviation=off[own], content=content[own])

    tops = rows.groupBy("track", "c").applyInPandas(maxima, f"track {kind}, c long, k int, top double")
    w = Window.partitionBy("track", "k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.withColumn("before", F.max("top").over(w)).where("before is not null").select("track", "c", "k", "before")
    reach = F.when(F.pmod("t", F.lit(chunk)) >= chunk - 2, F.array(F.col("c"), F.col("c") + 1)).otherwise(F.array("c"))
    near = rows.withColumn("_c", F.explode(reach)).select("track", F.col("_c").alias("c"), "t", "mag", "re", "im", (F.col("_c") == F.col("c")).alias("own"))
    both = near.groupBy("track", "c").cogroup(before.groupBy("track", "c"))
    return both.applyInPandas(figures, f"track {kind}, t long, flux double, band_mask int, deviation double, content double")


def _upper_median(a: Column) -> Column:
    return F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int"))


def normalised(series: DataFrame, window: int = 86) -> DataFrame:
    """v less the centred moving median, over 1.4826 times the median deviation (upper medians)."""
    half = window // 2
    w = Window.partitionBy("track").orderBy("t").rowsBetween(-half, half)
    rows = series.withColumn("_a", F.collect_list("v").over(w)).withColumn("_m", _upper_median(F.col("_a")))
    rows = rows.withColumn("_d", _upper_median(F.transform("_a", lambda x: F.abs(x - F.col("_m")))))
    return rows.withColumn("v", (F.col("v") - F.col("_m")) / (1.4826 * F.col("_d") + 1e-6)).drop("_a", "_m", "_d")


def combined(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of series on the same frames: a union and one grouped sum."""
    total = sum(w for _, w in parts)
    rows = None
    for s, w in parts:
        one = s.select("track", "t", (F.col("v") * (w / total)).alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("track", "t").agg(F.sum("v").alias("v"))


def candidates(series: DataFrame, cfg: PeakPickConfig = PeakPickConfig()) -> DataFrame:
    """Frames that are their neighbourhood's maximum and exceed its mean by delta, with a parabolic sub-frame offset.

    The first and last frame are none.
    """
    w = Window.partitionBy("track").orderBy("t")
    rows = series.select(
        "track", "t", "v",
        F.max("v").over(w.rowsBetween(-cfg.max_radius, cfg.max_radius)).alias("top"),
        F.avg("v").over(w.rowsBetween(-cfg.mean_radius, cfg.mean_radius)).alias("mean"),
        F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"),
    )
    bend = F.col("a") - 2 * F.col("v") + F.col("b")
    offset = F.when(F.abs(bend) > 1e-12, clamp(0.5 * (F.col("a") - F.col("b")) / bend, -0.5, 0.5)).otherwise(0.0)
    keep = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("v") >= F.col("top")) & (F.col("v") >= F.col("mean") + cfg.delta)
    return rows.where(keep).select("track", "t", "v", offset.alias("offset"))


def onsets(series: DataFrame, hop_s: float, cfg: PeakPickConfig = PeakPickConfig()) -> DataFrame:
    """Candidates more than the refractory time after the last one kept; at is in seconds."""
    kept = islands.refractory(candidates(series, cfg), ["track"], "t", cfg.refractory_s / hop_s)
    return kept.withColumn("at", (F.col("t") + F.col("offset")) * hop_s)


def autocorrelation(series: DataFrame, low: int, high: int) -> DataFrame:
    """(track, lag, r): mean product at each lag that the track is longer than; a track's series, one value a hop, is one row."""
    packed = series.where("v is not null").groupBy("track").agg(F.collect_list(F.struct("t", "v")).alias("s")).select("track", "s.t", "s.v")
    kind = dict(series.dtypes)["track"]

    def run(batches):
        import pandas as pd

        for df in batches:
            for track, t, v in df[["track", "t", "v"]].itertuples(index=False):
                t = np.asarray(t)
                x, there = np.zeros(t.max() - t.min() + 1), np.zeros(t.max() - t.min() + 1)
                x[t - t.min()], there[t - t.min()] = v, 1
                lags = [k for k in range(low, min(high, len(x) - 1) + 1) if there[: len(x) - k] @ there[k:]]
                r = [x[: len(x) - k] @ x[k:] / (there[: len(x) - k] @ there[k:]) for k in lags]
                yield pd.DataFrame({"track": track, "lag": np.asarray(lags, np.int32), "r": np.asarray(r, float)})

    return packed.mapInPandas(run, f"track {kind}, lag int, r double")


def tempo_scores(series: DataFrame, hop_s: float, cfg: TempoConfig = TempoConfig()) -> DataFrame:
    """(track, lag, raw, bpm, score): sums over three harmonics, the refined tempo and its prior-weighted score of every local maximum."""
    low, high = int(math.floor(60 / (cfg.max_bpm * hop_s))), int(math.ceil(60 / (cfg.min_bpm * hop_s)))
    low = max(1, low)
    r = autocorrelation(series, low, 3 * high)
    h = r.select("track", F.explode(F.array(*[F.struct(F.lit(i).alias("h")) for i in (1, 2, 3)])).alias("s"), F.col("lag").alias("far"), "r").select("track", (F.col("far") / F.col("s.h")).alias("lag"), F.col("s.h").alias("h"), "r").where("lag = floor(lag)")
    raw = h.where((F.col("lag") >= low) & (F.col("lag") <= high)).groupBy("track", F.col("lag").cast("int").alias("lag")).agg(F.sum(F.col("r") / F.col("h")).alias("raw"))
    w = Window.partitionBy("track").orderBy("lag")
    rows = raw.withColumn("a", F.lag("raw").over(w)).withColumn("b", F.lead("raw").over(w))
    rows = rows.where("a is not null and b is not null and raw >= a and raw >= b")
    bend = F.col("a") - 2 * F.col("raw") + F.col("b")
    offset = F.when(F.abs(bend) > 1e-12, clamp(0.5 * (F.col("a") - F.col("b")) / bend, -0.5, 0.5)).otherwise(0.0)
    bpm = 60 / ((F.col("lag") + offset) * hop_s)
    octaves = F.log2(F.col("bpm") / cfg.prior_bpm) / cfg.prior_octaves
    return rows.withColumn("bpm", bpm).withColumn("score", F.col("raw") * F.exp(-0.5 * octaves * octaves)).select("track", "lag", "raw", "bpm", "score")


def tempo(scores: DataFrame, cfg: TempoConfig = TempoConfig()) -> DataFrame:
    """(track, rank, bpm, score, confidence): the best tempo and the alternatives near it."""
    w = Window.partitionBy("track")
    spread = F.stddev_pop("score").over(w)
    z = F.when(spread > 0, (F.max("score").over(w) - F.avg("score").over(w)) / spread).otherwise(0.0)
    rows = scores.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "lag"))).withColumn("top", F.max("score").over(w)).withColumn("confidence", clamp(z / 8, 0.0, 1.0))
    return rows.where((F.col("rank") <= 1 + cfg.alternatives) & (F.col("score") >= (1 - cfg.alternative_share) * F.col("top"))).select("track", "rank", "bpm", "score", "confidence")


def tempo_series(series: DataFrame, hop_s: float, cfg: TempoConfig = TempoConfig()) -> DataFrame:
    """(track, w, bpm, stable): the best tempo of each window of at least eight frames, and whether they vary little."""
    size = max(1, int(round(cfg.window_s / hop_s)))
    part = series.select(F.concat_ws("|", "track", F.floor(F.col("t") / size).cast("string")).alias("key"), "track", F.floor(F.col("t") / size).alias("w"), (F.col("t") % size).alias("t"), "v")
    big = part.groupBy("key", "track", "w").agg(F.count("*").alias("n")).where("n >= 8")
    best = tempo(tempo_scores(part.join(big, ["key", "track", "w"], "left_semi").select(F.col("key").alias("track"), "t", "v"), hop_s, cfg), cfg).where("rank = 1")
    rows = big.join(best.select(F.col("track").alias("key"), "bpm"), "key").select("track", "w", "bpm")
    w = Window.partitionBy("track")
    cv = F.try_divide(F.stddev_pop("bpm").over(w), F.avg("bpm").over(w))
    return rows.withColumn("stable", (F.count("*").over(w) < 2) | (cv < 0.04))


def refined_bpm(found: DataFrame, bpm: float | Column) -> DataFrame:
    """(track, bpm): 60 over the upper median of the intervals within 15 % of the period, if there are three or more.

    bpm may be a column of found that is the same for all of a track's onsets.
    """
    w = Window.partitionBy("track").orderBy("at")
    bpm = bpm if isinstance(bpm, Column) else F.lit(bpm)
    period = 60 / bpm
    d = found.withColumn("d", F.col("at") - F.lag("at").over(w))
    near = F.collect_list(F.when((F.col("d") > 0.85 * period) & (F.col("d") < 1.15 * period), F.col("d")))
    g = d.groupBy("track").agg(near.alias("ds"), F.first(bpm).alias("bpm"))
    return g.select("track", F.when(F.size("ds") >= 3, 60 / _upper_median(F.col("ds"))).otherwise(F.col("bpm")).alias("bpm"))


def track_beats(series: DataFrame, period: float | None = None, tightness: float = 100.0, chunk: int = tracking.CHUNK) -> DataFrame:
    """(track, t): beats by dynamic programming over the series, chunk by chunk; period in frames, or else each track's own in a column of that name."""
    return tracking.track(series, F.col("period") if period is None else F.lit(period), tightness, chunk)


def phase_confidence(series: DataFrame, beats: DataFrame) -> DataFrame:
    """How far the series stands out at the beats, in standard deviations over 4."""
    rows = series.join(beats.select("track", "t", F.lit(True).alias("hit")), ["track", "t"], "left")
    g = rows.groupBy("track").agg(F.avg(F.when(F.col("hit"), F.col("v"))).alias("on"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return g.select("track", F.when(F.col("sd") > 0, clamp((F.col("on") - F.col("mean")) / F.col("sd") / 4, 0.0, 1.0)).otherwise(0.0).alias("confidence"))


def snapped(beats: DataFrame, found: DataFrame, tolerance: float | Column) -> DataFrame:
    """beats (track, at) moved to the nearest onset within the tolerance; the later of two equally near.

    The tolerance may be a column that both have, the same for all rows of a track.
    """
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    size = 2 * tolerance
    b = beats.select("track", "at", tolerance.alias("_tol"), F.explode(F.array(F.floor((F.col("at") - tolerance) / size), F.floor((F.col("at") + tolerance) / size))).alias("bucket")).distinct()
    o = found.select("track", F.col("at").alias("o"), F.floor(F.col("at") / size).alias("bucket"))
    near = b.join(o, ["track", "bucket"]).where(F.abs(F.col("o") - F.col("at")) <= F.col("_tol"))
    best = near.groupBy("track", "at").agg(F.min_by("o", F.struct(F.abs(F.col("o") - F.col("at")), -F.col("o"))).alias("snapped"))
    return beats.join(best, ["track", "at"], "left").select("track", "at", F.coalesce("snapped", "at").alias("snapped"))


def without_near(rows: DataFrame, others: DataFrame, tolerance: float, col: str = "at") -> DataFrame:
    """Band anti-join: rows of a track with no other within the tolerance, inclusive; bucketed to an equi-join."""
    size = 2 * tolerance
    a = rows.withColumn("_id", F.monotonically_increasing_id())
    keyed = a.select("_id", "track", col, F.explode(F.array_distinct(F.array(F.floor((F.col(col) - tolerance) / size), F.floor((F.col(col) + tolerance) / size)))).alias("_b"))
    o = others.select(F.col("track"), F.col(col).alias("_o"), F.floor(F.col(col) / size).alias("_b"))
    hit = keyed.join(o, ["track", "_b"]).where(F.abs(F.col("_o") - F.col(col)) <= tolerance).select("track", col).distinct()
    return rows.join(hit, ["track", col], "left_anti")


def bars(beats: DataFrame, downbeat: float, per_bar: int = 4) -> DataFrame:
    """(track, at, bar_beat): position in the bar, counted from the beat nearest to the downbeat (the first of equals)."""
    w = Window.partitionBy("track")
    rows = beats.withColumn("i", F.row_number().over(w.orderBy("at")) - 1)
    first = F.min(F.struct(F.abs(F.col("at") - downbeat).alias("d"), F.col("i").alias("i"))).over(w)["i"]
    return rows.select("track", "at", F.pmod(F.col("i") - first, F.lit(per_bar)).alias("bar_beat"))


def edited(beats: DataFrame, nudge: float = 0.0, remove: DataFrame | None = None, add: DataFrame | None = None, downbeat: float | None = None, per_bar: int = 4) -> DataFrame:
    """Manual edits in their order: nudge, remove (within 20 ms), add (confidence 1, not nudged), bars."""
    out = beats.withColumn("at", F.col("at") + nudge)
    if "confidence" not in out.columns:
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    if remove is not None:
        out = without_near(out, remove, 0.020)
    if add is not None:
        out = out.unionByName(add.select("track", "at", F.lit(1.0).alias("confidence")), allowMissingColumns=True)
    if downbeat is not None:
        out = out.join(bars(out.select("track", "at"), downbeat, per_bar), ["track", "at"])
    return out
