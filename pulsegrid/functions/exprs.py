"""Column expressions: levels, loudness, windows, frequency scales, display conversions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def db(x: Column) -> Column:
    """20 log10 x, -inf from 0 down (log10 alone would give null)."""
    return F.when(x <= 0, F.lit(-INF)).otherwise(20 * F.log10(x))


def db_floor(x: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(floor)))


def from_db(d: Column | float) -> Column:
    return F.pow(F.lit(10.0), (d if isinstance(d, Column) else F.lit(float(d))) / 20)


def lufs(z: Column) -> Column:
    return F.when(z <= 0, F.lit(-INF)).otherwise(-0.691 + 10 * F.log10(z))


def mean_square_of(level: Column | float) -> Column:
    return F.pow(F.lit(10.0), ((level if isinstance(level, Column) else F.lit(float(level))) + 0.691) / 10)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), None).otherwise(x)


def clamp(x: Column, low: float, high: float | Column) -> Column:
    return F.least(high if isinstance(high, Column) else F.lit(high), F.greatest(F.lit(low), x))


def ceiling_linear(bits: int) -> float:
    """Largest positive sample of an integer container; 1 for floats."""
    return 1.0 if bits <= 0 else (2 ** (bits - 1) - 1) / 2 ** (bits - 1)


def window_value(name: str, i: Column, n: int, beta: float = 8.6) -> Column:
    """Sample i of a periodic window of n."""
    w = 2 * math.pi * i / n
    if name == "rect":
        return F.lit(1.0)
    if name == "hann":
        return 0.5 - 0.5 * F.cos(w)
    if name == "hamming":
        return 0.54 - 0.46 * F.cos(w)
    if name == "blackman":
        return 0.42 - 0.5 * F.cos(w) + 0.08 * F.cos(2 * w)
    if name == "blackman_harris":
        return 0.35875 - 0.48829 * F.cos(w) + 0.14128 * F.cos(2 * w) - 0.01168 * F.cos(3 * w)
    if name == "kaiser":
        u = 2 * i / n - 1
        return bessel_i0(beta * F.sqrt(F.greatest(F.lit(0.0), 1 - u * u))) / bessel_i0(F.lit(beta))
    raise ValueError(f"unknown window: {name}")


def bessel_i0(x: Column, terms: int = 40) -> Column:
    """Modified Bessel function of order 0, by its series."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, k):
        term = acc["term"] * (x / 2) * (x / 2) / (k * k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"])


def hz_to_scale(hz: Column, axis: str) -> Column:
    if axis == "linear":
        return hz
    if axis == "log":
        return F.log2(hz)
    if axis == "mel":
        return 2595 * F.log10(1 + hz / 700)
    if axis == "bark":
        return 13 * F.atan(0.00076 * hz) + 3.5 * F.atan((hz / 7500) * (hz / 7500))
    raise ValueError(f"unknown axis: {axis}")


def scale_to_hz(s: Column, axis: str) -> Column:
    if axis == "linear":
        return s
    if axis == "log":
        return F.pow(F.lit(2.0), s)
    if axis == "mel":
        return 700 * (F.pow(F.lit(10.0), s / 2595) - 1)
    if axis == "bark":  # no closed inverse: bisection
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(48_000.0).alias("hi"))

        def halve(acc, _):
            mid = (acc["lo"] + acc["hi"]) / 2
            low = hz_to_scale(mid, "bark") < s
            return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    raise ValueError(f"unknown axis: {axis}")


def quantise_db(level: Column, floor: float = -96.0, ceiling: float = 0.0) -> Column:
    return F.floor(clamp((level - floor) / (ceiling - floor), 0.0, 1.0) * 255 + 0.5).cast("int")


def dequantise_db(q: Column, floor: float = -96.0, ceiling: float = 0.0) -> Column:
    return floor + q / 255 * (ceiling - floor)


def display_unit(x: Column, scale: str, param: float = 2.0) -> Column:
    """Signed display height of an amplitude: linear, dB above -60, or a root."""
    size = F.abs(x)
    if scale == "linear":
        return clamp(x, -1.0, 1.0)
    if scale == "db":
        return F.signum(x) * clamp((db_floor(size) + 60) / 60, 0.0, 1.0)
    return F.signum(x) * clamp(F.pow(size, F.lit(1.0 / max(param, 1.0))), 0.0, 1.0)


def json_number(x: Column) -> Column:
    """A number in a report: nine significant digits, null for NaN, +-1e999 for infinities."""
    return F.when(F.isnull(x) | F.isnan(x), "null").when(x == INF, "1e999").when(x == -INF, "-1e999").otherwise(F.format_string("%.9g", x))


def fade(i: Column, n: Column) -> Column:
    """Cosine ramp from 0 to 1 over n frames."""
    return F.when(n <= 0, 1.0).otherwise(0.5 - 0.5 * F.cos(math.pi * clamp(ratio(i, n), 0.0, 1.0)))


def score_above(x: Column, at: float, soft: float) -> Column:
    return clamp((x - at) / soft + 0.5, 0.0, 1.0)


def score_below(x: Column, at: float, soft: float) -> Column:
    return clamp((at - x) / soft + 0.5, 0.0, 1.0)


def score_within(x: Column, low: float, high: float, soft: float) -> Column:
    return F.least(score_above(x, low, soft), score_below(x, high, soft))
