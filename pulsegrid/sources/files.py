"""File sources: container sniffing, WAV decoding, tag parsing over binaryFile rows; result cache by keys."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The brands of audio files in MP4 containers
BRANDS = ("M4A ", "M4B ", "isom", "mp42", "3gp5")


def _three_syncs(content: bytes, begin: int) -> bool:
    """Whether three MPEG frame syncs of one version and layer follow one another, each within 4,096 bytes of the last.

    The syncs of a version and layer stand in order, so it is enough to look at three neighbours of each.
    """
    b = np.frombuffer(content, np.uint8)[begin:]
    if len(b) < 4:
        return False
    at = np.flatnonzero((b[:-1] == 0xFF) & (b[1:] & 0xE0 == 0xE0))
    kind = b[at + 1] & 0x1E
    for k in np.unique(kind):
        p = at[kind == k]
        if len(p) >= 3 and ((p[1:-1] - p[:-2] < 4096) & (p[2:] - p[1:-1] < 4096) & (p[:-2] + 4 <= len(b))).any():
            return True
    return False


def sniffed(content: Column) -> Column:
    """struct<kind, skip, error> of a file's bytes: its container after a leading ID3v2 tag of `skip` bytes, or why there is none.

    kind is wav, aiff, flac, ogg, mp4, mp4_other (no brand of audio files) or mp3, the last
    where three consistent frame syncs are found; only files that are none of the others, and
    whose tag ends within the bytes, are looked through for these in Python.
    """
    b = lambda i: F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("int").bitwiseAND(127)
    size = F.octet_length(content)
    tagged = (F.hex(F.substring(content, 1, 3)) == "494433") & (size >= 10)
    end = F.when(tagged, 10 + b(7) * 2097152 + b(8) * 16384 + b(9) * 128 + b(10)).otherwise(0)
    cut_off = tagged & (end >= size)
    skip = F.when(cut_off, 0).otherwise(end)
    at = lambda i, n: F.hex(content.substr(skip + i, F.lit(n)))
    head, form = at(1, 4), at(9, 4)
    known = (
        F.when((head == "52494646") & (form == "57415645"), "wav")
        .when((head == "464F524D") & (form == "41494646"), "aiff")
        .when(head == "664C6143", "flac")
        .when(head == "4F676753", "ogg")
        .when((at(5, 4) == "66747970") & form.isin(*[x.encode().hex().upper() for x in BRANDS]), "mp4")
        .when(at(5, 4) == "66747970", "mp4_other")
    )

    @F.pandas_udf("boolean")
    def has_syncs(contents, begins):
        return contents.combine(begins, lambda c, p: c is not None and _three_syncs(bytes(c), int(p)))

    # what needs no look is passed as null
    open_ = content.isNotNull() & known.isNull() & ~cut_off
    kind = F.coalesce(known, F.when(open_ & has_syncs(F.when(open_, content), skip), "mp3"))
    dump = F.concat(F.lit("unrecognised header: "), F.regexp_replace(F.lower(at(1, 16)), "(..)", "$1 "))
    error = F.when(content.isNull(), "no content").when(kind.isNotNull(), None).when(cut_off, "truncated: the leading tag extends past the bytes").otherwise(dump)
    return F.struct(kind.alias("kind"), end.alias("skip"), error.alias("error"))


def container(content: Column) -> Column:
    """Name of the container, see sniffed(); null if none is recognised."""
    return sniffed(content)["kind"]


def parse_wav(data: bytes) -> tuple[dict, np.ndarray] | None:
    """(format, frames x channels floats) of a PCM or float WAV; None if it isn't one."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt, pcm = 12, None, None
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if tag == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if code == 0xFFFE and len(body) >= 26:
                code = struct.unpack_from("<H", body, 24)[0]
            fmt = {"code": code, "channels": channels, "rate": rate, "bits": bits}
        elif tag == b"data":
            pcm = body
        at += 8 + size + (size & 1)
    # formats 1 and 3 are integers and floats; the others (companded, compressed) aren't samples
    if fmt is None or pcm is None or not fmt["channels"] or fmt["code"] not in (1, 3):
        return None
    x = to_float(pcm, fmt["bits"], fmt["code"] == 3)
    if x is None:
        return None
    n = len(x) // fmt["channels"]
    return fmt, x[: n * fmt["channels"]].reshape(n, fmt["channels"])


def to_float(raw: bytes, bits: int, is_float: bool) -> np.ndarray | None:
    """Samples of a PCM format as floats: no clamping, no dither."""
    width = bits // 8
    raw = raw[: len(raw) // width * width] if width else b""
    if is_float:
        return np.frombuffer(raw, {32: "<f4", 64: "<f8"}[bits]).astype(np.float32) if bits in (32, 64) else None
    if bits == 8:
        return ((np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128).astype(np.float32)
    if bits == 16:
        return (np.frombuffer(raw, "<i2") / 32768.0).astype(np.float32)
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return ((v - ((v & 0x800000) << 1)) / 8388608.0).astype(np.float32)
    if bits == 32:
        return (np.frombuffer(raw, "<i4") / 2147483648.0).astype(np.float32)
    return None


def wav_chunks(files: DataFrame, frames: int = 65_536) -> DataFrame:
    """(track, channel, chunk_idx, start_frame, samples, sample_rate, bit_depth, error) from binaryFile rows (path, content).

    Floats have bit depth 0.  A file that can't be decoded is one row with its error.
    """
    schema = "track string, channel int, chunk_idx int, start_frame long, samples array<float>, sample_rate int, bit_depth int, error string"

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                got = parse_wav(bytes(content)) if content is not None else None
                if got is None:
                    rows.append((path, None, None, None, None, None, None, "unsupported format"))
                    continue
                fmt, x = got
                depth = 0 if fmt["code"] == 3 else fmt["bits"]
                for c in range(x.shape[1]):
                    for i, at in enumerate(range(0, len(x), frames)):
                        rows.append((path, c, i, at, x[at : at + frames, c].tolist(), fmt["rate"], depth, None))
                        if len(rows) >= 64:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


def track_info(chunks: DataFrame) -> DataFrame:
    return chunks.where("error is null").groupBy("track").agg(F.max("sample_rate").alias("sample_rate"), (F.max("channel") + 1).alias("channels"), F.max(F.col("start_frame") + F.size("samples")).alias("frame_count"), F.max("bit_depth").alias("bit_depth"))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def parameter_key(params: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, params_hash): a digest of the sorted pairs, so the order of parameters doesn't matter and equal pairs don't cancel."""
    return params.groupBy(key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(name, value)))), 256).alias("params_hash"))


def cached(requests: DataFrame, results: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with their results, requests that miss): a stale version or other parameters are a miss, not an error."""
    return results.join(requests.select(*keys).distinct(), keys, "left_semi"), requests.join(results.select(*keys).distinct(), keys, "left_anti")
