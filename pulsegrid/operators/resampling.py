"""Sample-rate conversion by a windowed sinc, chunk by chunk."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import islands
from pulsegrid.operators.loudness import KEY, QUALITY, polyphase


class Ratio:
    """target / source in lowest terms; output n lies at input position n * down / up, in whole numbers, so that nothing drifts."""

    def __init__(self, source_rate: int, target_rate: int, quality: str = "best"):
        if source_rate < 1 or target_rate < 1 or quality not in QUALITY:
            raise ValueError("rates are positive, and quality is one of " + ", ".join(QUALITY))
        g = math.gcd(source_rate, target_rate)
        self.up, self.down = target_rate // g, source_rate // g
        self.taps, self.phases, _ = QUALITY[quality]
        self.table = polyphase(quality, min(1.0, self.up / self.down))

    def base(self, n: int) -> int:
        """The input frame at or before output n."""
        return n * self.down // self.up

    def first_after(self, frame: int) -> int:
        """The first output at or after an input frame."""
        return max(0, -(-frame * self.up // self.down))

    def outputs(self, frames: int) -> int:
        """How many outputs a signal of so many frames has."""
        return frames * self.up // self.down

    def at(self, n: np.ndarray, x: np.ndarray, begin: int) -> np.ndarray:
        """The outputs n from the samples x, which begin at input frame `begin` and are 0 outside."""
        if self.up == self.down:
            inside = (n >= begin) & (n < begin + len(x))
            return np.where(inside, x[np.clip(n - begin, 0, max(0, len(x) - 1))] if len(x) else 0.0, 0.0)
        base, rest = n * self.down // self.up, n * self.down % self.up
        where = rest * self.phases / self.up
        p = np.minimum(np.floor(where).astype(np.int64), self.phases - 1)
        part = (where - p)[:, None]
        padded = np.r_[np.zeros(self.taps), x, np.zeros(self.taps)]
        first = np.clip(base - self.taps // 2 + 1 - begin + self.taps, 0, len(padded) - self.taps)
        rows = padded[first[:, None] + np.arange(self.taps)]
        return (rows * (self.table[p] * (1 - part) + self.table[p + 1] * part)).sum(axis=1)


def resampled(samples: DataFrame, source_rate: int, target_rate: int, quality: str = "best", chunk: int = 65_536) -> DataFrame:
    """(track, channel, frame, x): the signal at target_rate; floor(frames * target / source) of them.

    Below the source's rate the filter cuts off at the target's.  An output belongs to the chunk
    of the input frame at or before it; chunks carry a halo of half the filter's taps and run
    side by side, and where they end makes no difference.  Missing frames are 0.
    """
    rate = Ratio(source_rate, target_rate, quality)
    n = samples.groupBy(*KEY).agg((F.max("frame") + 1).alias("n"))
    x = samples.select(*KEY, "frame", F.col("x").cast("double").alias("x")).where("x is not null")
    parts = islands.chunked(x, "frame", rate.taps, rate.taps, chunk).where("_chunk >= 0")
    packed = parts.groupBy(*KEY, "_chunk").agg(F.collect_list(F.struct("frame", "x")).alias("s")).select(*KEY, "_chunk", "s.frame", "s.x").join(n, KEY)

    def run(batches):
        for df in batches:
            starts, out = [], []
            for c, n, frames, xs in df[["_chunk", "n", "frame", "x"]].itertuples(index=False):
                begin = c * chunk - rate.taps
                dense = np.zeros(chunk + 2 * rate.taps)
                dense[np.asarray(frames) - begin] = xs
                of = np.arange(rate.first_after(c * chunk), min(rate.first_after((c + 1) * chunk), rate.outputs(n)))
                starts.append(int(of[0]) if len(of) else 0)
                out.append(rate.at(of, dense, begin).tolist())
            yield df[KEY].assign(start=starts, ys=out)

    done = packed.mapInPandas(run, "track string, channel int, start long, ys array<double>")
    return done.select(*KEY, "start", F.posexplode("ys").alias("i", "x")).select(*KEY, (F.col("start") + F.col("i")).alias("frame"), "x")
