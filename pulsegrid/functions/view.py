"""Coordinates, zoom and tile choice as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp, hz_to_scale, scale_to_hz


def frame_to_pixel(frame: Column, start: Column | float, per_pixel: Column | float) -> Column:
    return (frame - start) / per_pixel


def pixel_to_frame(pixel: Column, start: Column | float, per_pixel: Column | float) -> Column:
    return start + pixel * per_pixel


def zoomed_start(pixel: Column, start: Column, per_pixel: Column, new_per_pixel: Column, frames: Column, width: Column | float) -> Column:
    """First frame of the view after a zoom that keeps the frame under a pixel there, held inside the track."""
    return clamp(pixel_to_frame(pixel, start, per_pixel) - pixel * new_per_pixel, 0.0, F.greatest(F.lit(0.0), frames - width * new_per_pixel))


def hz_to_pixel(hz: Column, axis: str, low: float, high: float, height: float) -> Column:
    """Pixel row of a frequency, from the top; a linear axis begins at 0."""
    a, b = hz_to_scale(F.lit(0.0 if axis == "linear" else low), axis), hz_to_scale(F.lit(high), axis)
    return (1 - (hz_to_scale(hz, axis) - a) / (b - a)) * height


def pixel_to_hz(pixel: Column, axis: str, low: float, high: float, height: float) -> Column:
    a, b = hz_to_scale(F.lit(0.0 if axis == "linear" else low), axis), hz_to_scale(F.lit(high), axis)
    return scale_to_hz(a + (1 - pixel / height) * (b - a), axis)


def column_spacing(size: int, level: int) -> int:
    """Frames from one tile column to the next."""
    return size // 4 if level == 0 else size // 2 if level == 1 else size << (level - 2)


def tile_level(per_pixel: Column, size: int, most: int = 8) -> Column:
    """The level whose columns are nearest to the zoom, the lower of two equally near."""
    levels = F.array(*[F.struct(F.abs(per_pixel - column_spacing(size, i)).alias("d"), F.lit(i).alias("level")) for i in range(most + 1)])
    return F.array_min(levels)["level"]


# The transform sizes, and the zooms at which they change
SIZES, BORDERS, SLACK = (2048, 8192, 16384), (80.0, 800.0), 0.25


def transform_size(per_pixel: Column, current: Column) -> Column:
    """The transform size for a zoom: it changes only a quarter beyond a border, so that small moves about one change nothing."""
    at = F.when(current == SIZES[0], 0).when(current == SIZES[2], 2).otherwise(1)
    for i, border in enumerate(BORDERS):
        at = F.when((at == i) & (per_pixel > border * (1 + SLACK)), i + 1).otherwise(at)
    for i in (2, 1):
        at = F.when((at == i) & (per_pixel < BORDERS[i - 1] * (1 - SLACK)), i - 1).otherwise(at)
    return F.element_at(F.array(*[F.lit(s) for s in SIZES]), at + 1)


def config_hash(text: Column) -> Column:
    """FNV-1a, 32 bits, over the bytes of a text that spells a configuration."""
    digits = F.hex(F.encode(text, "utf-8"))
    size = F.octet_length(F.encode(text, "utf-8"))
    octets = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("long"), F.lit(1 << 32)))
    return F.when(size > 0, folded).when(size == 0, F.lit(2166136261).cast("long"))


def duration(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def summary(seconds: Column, channels: Column, rate: Column, peak_db: Column, lufs: Column) -> Column:
    """What a track sounds like, in words; figures that are null are left out."""
    word = F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(F.concat(channels.cast("string"), F.lit("-channel")))
    first = F.concat(F.lit("Audio waveform, "), duration(seconds), F.lit(" duration, "), word, F.lit(", "), rate.cast("string"), F.lit(" Hz."))
    return F.concat_ws(" ", first, F.when(peak_db.isNotNull(), F.format_string("Peak level %.1f dBFS.", peak_db)), F.when(lufs.isNotNull(), F.format_string("Integrated loudness %.1f LUFS.", lufs)))
