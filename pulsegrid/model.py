"""Schemas and analyzer configurations."""

from __future__ import annotations

from dataclasses import dataclass

SAMPLES = "track string, channel int, frame long, x double"
CHUNKS = "track string, channel int, chunk_idx int, start_frame long, samples array<float>"
TRACKS = "track string, sample_rate int, channels int, frame_count long, codec string, bit_depth int, is_lossy boolean"
MARKERS = "id string, kind string, start_frame long, end_frame long, channel int, severity double, label string, data string, user_created boolean"

#: Frames per chunk and per level-0 waveform bin.
CHUNK_FRAMES = 65_536
BIN_FRAMES = 256


@dataclass(frozen=True)
class SilenceConfig:
    threshold_db: float = -60.0
    min_ms: float = 500.0
    merge_ms: float = 100.0
    mode: str = "all"
    hysteresis_db: float = 3.0


@dataclass(frozen=True)
class ClippingConfig:
    bit_depth: int = 0
    min_run: int = 3
    near_db: float = -0.1
    near_run: int = 3
    flatness_db: float = 0.0
    merge_gap: int = 32
    max_events: int = 10_000


@dataclass(frozen=True)
class DcConfig:
    threshold_db: float = -60.0


@dataclass(frozen=True)
class LoudnessConfig:
    oversampling: int = 4
    absolute_gate: float = -70.0
    relative_gate: float = -10.0
    range_gate: float = -20.0


@dataclass(frozen=True)
class PeakPickConfig:
    max_radius: int = 3
    mean_radius: int = 10
    delta: float = 0.1
    refractory_s: float = 0.030


@dataclass(frozen=True)
class TempoConfig:
    min_bpm: float = 40.0
    max_bpm: float = 240.0
    prior_bpm: float = 120.0
    prior_octaves: float = 0.8
    alternative_share: float = 0.3
    alternatives: int = 5
    window_s: float = 10.0


@dataclass(frozen=True)
class StftConfig:
    size: int = 2048
    hop: int = 512
    window: str = "hann"
    centred: bool = True
    scaling: str = "amplitude"


@dataclass(frozen=True)
class TileConfig:
    size: int = 4096
    rows: int = 256
    columns: int = 256
    window: str = "hann"
    axis: str = "log"
    min_hz: float = 20.0
    floor_db: float = -96.0
    ceiling_db: float = 0.0
