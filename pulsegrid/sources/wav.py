"""A data source for WAV files that are read in byte ranges, and a writer of such files.

    spark.dataSource.register(WavSource)
    spark.read.format("pulsegrid_wav").load(folder)
    spark.readStream.format("pulsegrid_wav").load(folder)

Rows are chunks: (track, channel, chunk_idx, start_frame, samples, sample_rate, bit_depth, error).
Options: path (a file or a folder, searched through), frames (of a chunk, 65,536), split (bytes
of a read task, 64 MiB), beginFrame and endFrame (only chunks with frames between them).

Planning lists files and nothing else: a task gets a byte range, reads the file's header and then
the chunks that begin in its range, so a long file is read by many tasks and a hundred short ones by
one.  Paths may have any scheme that pyarrow.fs knows.  A file that is no WAV is decoded by the
decoder of its container; where there is none, it is one row with an error.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pulsegrid.sources.files import _three_syncs, to_float

SCHEMA = "track string, channel int, chunk_idx int, start_frame long, samples array<float>, sample_rate int, bit_depth int, error string"
#: Frames are read from driver-side headers, to leave out tasks, for so many long files at most.
HEADERS = 1000
#: Tasks of a read at most: beyond that, neighbouring ranges share one, as each task costs the driver some kilobytes.
TASKS = 2000


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, inner


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files under a folder, but for hidden ones."""
    from pyarrow import fs

    where, inner = _open(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = where.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def container_of(head: bytes) -> str | None:
    """The container that a file's first bytes, after a leading tag, show."""
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav"
    if head[:4] == b"FORM" and head[8:12] == b"AIFF":
        return "aiff"
    for mark, kind in ((b"fLaC", "flac"), (b"OggS", "ogg")):
        if head[:4] == mark:
            return kind
    if head[4:8] == b"ftyp":
        return "mp4"
    return "mp3" if _three_syncs(head, 0) else None


class Layout:
    """Where a WAV's samples lie: format, first byte and end of the data, whole frames in so many bytes."""

    def __init__(self, file, size: int):
        head = file.read(10)
        skip = 0
        if head[:3] == b"ID3" and len(head) == 10:
            skip = 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9])
        file.seek(skip)
        kind = container_of(file.read(65_536))
        if kind not in DECODERS:
            raise ValueError(f"unsupported format: {kind or 'unrecognised'}")
        self.begin = None
        at, fmt = skip + 12, None
        while at + 8 <= size:
            file.seek(at)
            tag, n = struct.unpack("<4sI", file.read(8))
            if tag == b"fmt " and n >= 16:
                body = file.read(min(n, 40))
                if len(body) >= 16:
                    fmt = struct.unpack_from("<HHIIHH", body)
                    code = struct.unpack_from("<H", body, 24)[0] if fmt[0] == 0xFFFE and len(body) >= 26 else fmt[0]
            elif tag == b"data":
                self.begin, self.said = at + 8, n
                break
            at += 8 + n + (n & 1)
        if fmt is None or self.begin is None:
            raise ValueError("unsupported format: wav without format or data")
        _, self.channels, self.rate, _, _, self.bits = fmt
        self.floats = code == 3
        if code not in (1, 3) or not self.channels or to_float(b"", self.bits, self.floats) is None:
            raise ValueError(f"unsupported format: wav of code {code}, {self.bits} bits")
        self.block = self.channels * self.bits // 8
        self.end = min(size, self.begin + self.said)
        self.whole = self.begin + self.said <= size  # what the header promises is there
        self.frames = (self.end - self.begin) // self.block

    def samples(self, file, begin: int, end: int) -> np.ndarray:
        """Channels by frames of [begin, end)."""
        file.seek(self.begin + begin * self.block)
        x = to_float(file.read((end - begin) * self.block), self.bits, self.floats)
        return x[: len(x) // self.channels * self.channels].reshape(-1, self.channels).T


#: Container -> what reads its layout; others give a row with an error.
DECODERS = {"wav": Layout}


class Range(InputPartition):
    """Byte ranges of files: (path, size, begin, end); a chunk belongs to the range that its first byte is in."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.parts = parts


def _dealt(ranges: list[Range]) -> list[Range]:
    """The ranges in their order over TASKS tasks at most; ranges of one file that follow one another become one, which needs its header once."""
    if len(ranges) <= TASKS:
        return ranges
    cuts = [i * len(ranges) // TASKS for i in range(TASKS + 1)]
    out = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        parts = []
        for path, size, begin, end in (p for r in ranges[a:z] for p in r.parts):
            if parts and parts[-1][0] == path and parts[-1][3] == begin:
                begin = parts.pop()[2]
            parts.append((path, size, begin, end))
        out.append(Range(parts))
    return out


def _batch(rows, rate, depth, error=None):
    import pyarrow as pa

    n = len(rows)
    values = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.float32)
    off = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32)
    cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(values, pa.float32()))]
    cols += [pa.array([rate] * n, pa.int32()), pa.array([depth] * n, pa.int32()), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


def _failed(path, error):
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([path, *[None] * 6, error], kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Options:
    def __init__(self, options):
        get = {k.lower(): v for k, v in options.items()}
        if "path" not in get:
            raise ValueError("a path is needed")
        self.path, self.frames, self.split = get["path"], int(get.get("frames", 65_536)), int(get.get("split", 64 << 20))
        self.begin, self.end = int(get.get("beginframe", 0)), int(get["endframe"]) if "endframe" in get else None
        if self.frames < 1 or self.split < 1:
            raise ValueError("frames and split are positive")

    def wanted(self, at: int, n: int) -> bool:
        return at + n > self.begin and (self.end is None or at < self.end)

    def chunks(self, path, size, use):
        """Batches of the file's chunks that use(layout, first byte, end byte) names; an error row where use is asked of byte 0."""
        where, inner = _open(path)
        with where.open_input_file(inner) as file:
            try:
                layout = Layout(file, size)
            except (ValueError, struct.error) as e:
                if use(None, 0, 0):
                    yield _failed(path, str(e))
                return
            depth = 0 if layout.floats else layout.bits
            for i, at in enumerate(range(0, layout.frames, self.frames)):
                n = min(self.frames, layout.frames - at)
                first = layout.begin + at * layout.block
                if self.wanted(at, n) and use(layout, first, first + n * layout.block):
                    x = layout.samples(file, at, at + n)
                    yield _batch([(path, c, i, at, x[c]) for c in range(layout.channels)], layout.rate, depth)


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self):
        o, out, held, size = self.options, [], [], 0
        files = listed(o.path)
        prune = (o.begin or o.end is not None) and sum(n > o.split for _, n in files) <= HEADERS
        for path, n in files:
            if n > o.split:
                cuts = list(range(0, n, o.split))
                spans = [(c, min(c + o.split, n)) for c in cuts]
                if prune:
                    spans = self._reached(path, n, spans)
                out += [Range([(path, n, a, b)]) for a, b in spans]
                continue
            if held and size + n > o.split:
                out.append(Range(held))
                held, size = [], 0
            held.append((path, n, 0, max(n, 1)))
            size += n
        return _dealt(out + ([Range(held)] if held else [])) or [Range([])]

    def _reached(self, path, n, spans):
        """The spans in which a wanted chunk begins."""
        o = self.options
        where, inner = _open(path)
        with where.open_input_file(inner) as file:
            try:
                layout = Layout(file, n)
            except (ValueError, struct.error):
                return spans[:1]  # its error row
        low = layout.begin + o.begin // o.frames * o.frames * layout.block
        high = layout.begin + (layout.frames if o.end is None else min(o.end, layout.frames)) * layout.block
        return [(a, b) for a, b in spans if b > low and a < high] or spans[:1]

    def read(self, partition):
        for path, size, a, b in partition.parts:
            # what begins in the header's bytes belongs to the first range
            yield from self.options.chunks(path, size, lambda layout, first, end: a <= first < b if layout else a == 0)


class WavStreamReader(DataSourceStreamReader):
    """Files that grow or arrive: a chunk is given out when all its bytes are there, and a channel's last one when the data is as long as its header says; with the option closing, an empty chunk then ends each channel.

    The offset holds the bytes seen of each file.
    """

    def __init__(self, options):
        self.options = _Options(options)
        self.closing = str({k.lower(): v for k, v in options.items()}.get("closing", "false")).lower() == "true"

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        return {"files": json.dumps(dict(listed(self.options.path)))}

    def partitions(self, start, end):
        old, new = json.loads(start["files"]), json.loads(end["files"])
        parts = [Range([(path, n, old.get(path, 0), n)]) for path, n in sorted(new.items()) if n > old.get(path, 0)]
        return _dealt(parts) or [Range([])]

    def commit(self, end):
        pass

    def read(self, partition):
        o = self.options
        for path, size, a, b in partition.parts:

            def now(layout, first, end, a=a, b=b):
                if layout is None:
                    return a == 0
                whole = (end - first) // layout.block == o.frames or layout.whole
                # a chunk is due where its last byte came, or where the last bytes made a short one whole
                return whole and (a < end <= b or (layout.whole and a < layout.begin + layout.said <= b and end > a))

            seen = None
            for seen in o.chunks(path, size, now):
                yield seen
            if self.closing:
                yield from self._ends(path, size, a, b)

    def _ends(self, path, size, a, b):
        where, inner = _open(path)
        with where.open_input_file(inner) as file:
            try:
                layout = Layout(file, size)
            except (ValueError, struct.error):
                return
        if layout.whole and a < layout.begin + layout.said <= b:
            n = -(-layout.frames // self.options.frames)
            yield _batch([(path, c, n, layout.frames, np.zeros(0, np.float32)) for c in range(layout.channels)], layout.rate, 0 if layout.floats else layout.bits)


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "pulsegrid_wav"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WavReader(self.options)

    def streamReader(self, schema):
        return WavStreamReader(self.options)


def header(channels: int, rate: int, bits: int, floats: bool, data: int) -> bytes:
    """The 44 bytes before `data` bytes of samples."""
    block = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + data, b"WAVE", b"fmt ", 16, 3 if floats else 1, channels, rate, rate * block, block, bits, b"data", data)


def write_wavs(samples: DataFrame, folder: str, rate: int) -> DataFrame:
    """Writes one 16-bit file for each track, of as many channels as it has, into the folder; (track, path, frames).

    Tracks are written side by side, each by one task, which holds it: cut long ones first.
    Missing samples are 0, and what lies beyond full scale is clipped.
    """

    def run(df):
        import pandas as pd

        channels, frames = int(df["channel"].max()) + 1, int(df["frame"].max()) + 1
        x = np.zeros((frames, channels), "<i2")
        x[df["frame"].to_numpy(), df["channel"].to_numpy()] = np.clip(np.round(df["x"].fillna(0).to_numpy() * 32768), -32768, 32767)
        track = str(df["track"].iloc[0])
        path = f"{folder.rstrip('/')}/{track}.wav"
        where, inner = _open(path)
        where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(inner) as out:
            out.write(header(channels, rate, 16, False, x.nbytes))
            out.write(x.tobytes())
        return pd.DataFrame({"track": [track], "path": [path], "frames": [frames]})

    return samples.groupBy("track").applyInPandas(run, "track string, path string, frames long")
