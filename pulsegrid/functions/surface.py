"""Analyzers and scalars that SQL can call: register(spark) names them pg_...

Table functions take signals as chunks (track, channel, start_frame, samples).  Those over chunks
work on one row at a time, wherever it lies, and give one row a chunk or a run; those over what
they give (runs, levels, points, far fewer than samples) are called with PARTITION BY and ORDER BY
and hold one row in memory, however long a partition is.  A chunk without samples gives no row.
Null and non-finite samples end a run and take no part in statistics.

    SELECT * FROM pg_joined(TABLE(SELECT * FROM pg_runs(TABLE(chunks), 0.5D)) PARTITION BY (track, channel) ORDER BY (begin), 3)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Conversions of levels and frequencies
SCALARS = {
    "pg_db": ("x DOUBLE", "CASE WHEN x <= 0 THEN -CAST('Infinity' AS DOUBLE) ELSE 20 * log10(x) END"),
    "pg_linear": ("db DOUBLE", "pow(10D, db / 20)"),
    "pg_lufs": ("mean_square DOUBLE", "CASE WHEN mean_square <= 0 THEN -CAST('Infinity' AS DOUBLE) ELSE -0.691D + 10 * log10(mean_square) END"),
    "pg_mel": ("hz DOUBLE", "2595D * log10(1 + hz / 700)"),
    "pg_gain_to": ("target DOUBLE, integrated DOUBLE", "target - integrated"),
}


@udtf(returnType="track string, channel int, begin bigint, `end` bigint, peak double")
class Runs:
    """Runs of samples at or above a level, cut at the chunks' edges; pg_joined with a gap of 0 makes them whole."""

    def eval(self, row, level: float):
        size = np.abs(np.array([np.nan if v is None else v for v in row["samples"] or ()], float))
        hit = np.r_[False, np.isfinite(size) & (size >= level), False]
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield row["track"], row["channel"], row["start_frame"] + a, row["start_frame"] + z, float(size[a:z].max())


@udtf(returnType="track string, channel int, begin bigint, `end` bigint, parts bigint, peak double")
class Joined:
    """Runs in order of begin, made one where no more than `gap` frames lie between them."""

    def __init__(self):
        self.now = None

    def eval(self, row, gap: int):
        if self.now and row["begin"] - self.now[3] <= gap:
            track, channel, begin, end, parts, peak = self.now
            self.now = track, channel, begin, max(end, row["end"]), parts + 1, max(peak, row["peak"])
            return
        if self.now:
            yield self.now
        self.now = row["track"], row["channel"], row["begin"], row["end"], 1, row["peak"]

    def terminate(self):
        if self.now:
            yield self.now


@udtf(returnType="track string, channel int, w bigint, quiet boolean")
class Quiet:
    """Windows (track, channel, w, level) in order of w: quiet from level <= enter until level > leave, and before anything decides."""

    def __init__(self):
        self.quiet = True

    def eval(self, row, enter: float, leave: float):
        level = row["level"]
        if level is not None and level == level:
            self.quiet = False if level > leave else True if level <= enter else self.quiet
        yield row["track"], row["channel"], row["w"], self.quiet


@udtf(returnType="part string, at double, id string")
class Spaced:
    """Points (part, at, id) in order of at: one stays if it is `distance` or more after the last that stayed, or at its place."""

    def __init__(self):
        self.last = None

    def eval(self, row, distance: float):
        at = row["at"]
        if at is None or at != at:
            return
        if self.last is None or at == self.last or at - self.last >= distance:
            self.last = at
            yield row["part"], at, row["id"]


@udtf(returnType="track string, channel int, begin bigint, `end` bigint, n bigint, mean double, squares double, energy double, low double, high double, peak double, peak_frame bigint, turns bigint, first_sign int, last_sign int")
class States:
    """Each chunk's statistics: they merge by sums, extremes and the signs at the edges."""

    def eval(self, row):
        x, start = np.array([np.nan if v is None else v for v in row["samples"] or ()], float), row["start_frame"]
        at = np.flatnonzero(np.isfinite(x))
        if not len(at):
            return
        x = x[at]
        mean, top, sign = float(x.mean()), int(np.abs(x).argmax()), np.sign(x[x != 0]).astype(int)
        turns = int((sign[1:] != sign[:-1]).sum())
        ends = (int(sign[0]), int(sign[-1])) if len(sign) else (None, None)
        yield (row["track"], row["channel"], start + int(at[0]), start + int(at[-1]) + 1, len(x), mean, float(((x - mean) ** 2).sum()), float((x * x).sum()), float(x.min()), float(x.max()), float(abs(x[top])), start + int(at[top]), turns, *ends)


TABLES = {"pg_runs": Runs, "pg_joined": Joined, "pg_quiet": Quiet, "pg_spaced": Spaced, "pg_states": States}

#: Levels of whole channels from the states of their chunks, as SQL over a table named by {chunks}.
LEVELS = """
WITH s AS (SELECT *, last_value(last_sign, true) OVER (PARTITION BY track, channel ORDER BY begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sign_before,
        sum(n * mean) OVER (PARTITION BY track, channel) / sum(n) OVER (PARTITION BY track, channel) AS all_mean FROM pg_states(TABLE({chunks})))
SELECT track, channel, sum(n) AS n, min(low) AS min, max(high) AS max, first(all_mean) AS mean, sqrt(sum(energy) / sum(n)) AS rms, sqrt(sum(squares + n * (mean - all_mean) * (mean - all_mean)) / sum(n)) AS std_dev,
    max(peak) AS peak, min_by(peak_frame, struct(-peak, peak_frame)) AS peak_frame, sum(turns + CASE WHEN first_sign <> sign_before THEN 1 ELSE 0 END) AS zero_crossings
FROM s GROUP BY track, channel"""


def register(spark: SparkSession) -> None:
    """Names all functions in the session, in place of earlier ones."""
    for name, (args, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
