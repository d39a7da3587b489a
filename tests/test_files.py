"""File sources and tag parsers on hand-built bytes."""

import struct

import numpy as np

from pulsegrid.operators import tags
from pulsegrid.sources import files, tagparse


def wav(samples: bytes, code=1, channels=1, rate=8000, bits=16, extra=b"") -> bytes:
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def binary(spark, *contents):
    return spark.createDataFrame([(f"f{i}", None if c is None else bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_wav_formats(spark):
    df = binary(spark, wav(struct.pack("<4h", 0, 32767, -32768, 16384)), wav(b"\x00\x80\xff", bits=8), wav(b"\xff\xff\x7f\x00\x00\x80", bits=24), wav(struct.pack("<2f", 1.5, -0.25), 3, 2, 44_100, 32), b"junk", None)
    out = files.wav_chunks(df, frames=2)
    got = {}
    for r in out.where("error is null").orderBy("track", "channel", "chunk_idx").collect():
        got.setdefault((r.track, r.channel), []).extend(r.samples)
    assert got["f0", 0] == [0.0, np.float32(32767 / 32768), -1.0, 0.5]
    assert got["f1", 0] == [-1.0, 0.0, np.float32(127 / 128)]
    assert got["f2", 0] == [np.float32(8388607 / 8388608), -1.0]
    assert got["f3", 0] == [1.5] and got["f3", 1] == [-0.25]
    assert {r.track for r in out.where("error is not null").collect()} == {"f4", "f5"}
    info = {r.track: r for r in files.track_info(out).collect()}
    assert (info["f0"].frame_count, info["f0"].bit_depth, info["f3"].bit_depth, info["f3"].channels) == (4, 16, 0, 2)


def test_empty_table(spark):
    assert tagparse.parse(b"") == [] and tagparse.parse(b"TAG") == []


def syncsafe(n):
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def frame(name, body, version=4):
    return name + (syncsafe(len(body)) if version == 4 else struct.pack(">I", len(body))) + b"\0\0" + body


def id3(*frames, version=4):
    body = b"".join(frames)
    return b"ID3" + bytes([version, 0, 0]) + syncsafe(len(body)) + body


def test_id3v2():
    t = tagparse.parse(id3(frame(b"TIT2", b"\x03Title"), frame(b"TPE1", b"\x01" + "Jürgen".encode("utf-16")), frame(b"TCON", b"\0(17)"), frame(b"TXXX", b"\0REPLAYGAIN_TRACK_GAIN\0-6.5 dB"), frame(b"COMM", b"\0eng\0hello"), frame(b"TIT2", b"\0later")))
    got = {(f): v for s, p, f, v in t}
    assert got == {"title": "Title", "artist": "Jürgen", "genre": "Rock", "track_gain": "-6.5 dB", "comment": "hello"}
    hostile = b"ID3\x03\0\0" + syncsafe(20) + b"TIT2" + struct.pack(">I", 2**31) + b"\0\0\0ab"
    assert any(f == "diagnostic" for _, _, f, _ in tagparse.parse(hostile))


def test_id3v1_below_id3v2(spark):
    v1 = b"TAG" + b"Old title".ljust(30, b"\0") + b"Artist one".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + bytes([17])
    sets = tagparse.tag_sets(binary(spark, id3(frame(b"TIT2", b"\0New title")) + b"\0" * 64 + v1))
    got = {r.field: (r.value, r.source) for r in tags.merged(sets).collect()}
    assert got["title"] == ("New title", "id3v2") and got["artist"] == ("Artist one", "id3v1") and got["track"] == ("7", "id3v1") and got["genre"][0] == "Rock"
    assert {(r.value, r.winner) for r in tags.conflicts(sets).where("field = 'title'").collect()} == {("New title", True), ("Old title", False)}


def test_apev2():
    item = struct.pack("<II", 3, 0) + b"Title\0abc"
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + b"\0" * 8
    assert ("apev2", 1, "title", "abc") in tagparse.parse(b"\0" * 40 + item + foot)
    assert tagparse.apev2(b"APETAGEX" + struct.pack("<IIII", 2000, 10**9, 1, 0) + b"\0" * 8) == [("apev2", 1, "diagnostic", "implausible size")]


def comments(*entries):
    return struct.pack("<I", 3) + b"ven" + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in entries)


def test_vorbis_in_flac_and_ogg():
    body = comments(b"title=A", b"noequals", b"ARTIST=B")
    f = b"fLaC" + bytes([0x84]) + len(body).to_bytes(3, "big") + body
    assert tagparse.parse(f) == [("flac", 0, "title", "A"), ("flac", 0, "artist", "B")]
    packet = b"\x03vorbis" + body

    def page(p):
        return b"OggS" + b"\0" * 22 + bytes([1, len(p)]) + p

    assert tagparse.parse(page(b"\x01vorbis") + page(packet)) == [("ogg", 0, "title", "A"), ("ogg", 0, "artist", "B")]
    assert tagparse.vorbis(body[:-3], "flac")[-1][2] == "diagnostic"


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def test_mp4():
    data = lambda v: box(b"data", b"\0" * 8 + v)
    ilst = box(b"ilst", box(b"\xa9nam", data(b"Song")) + box(b"trkn", data(struct.pack(">HHHH", 0, 3, 12, 0))) + box(b"covr", data(b"xx")))
    f = box(b"ftyp", b"M4A ") + box(b"moov", box(b"udta", box(b"meta", b"\0" * 4 + ilst)))
    assert tagparse.parse(f) == [("mp4", 0, "title", "Song"), ("mp4", 0, "track", "3/12"), ("mp4", 0, "picture", "2 bytes")]


def test_riff_info_and_cues():
    info = b"INFO" + b"INAM" + struct.pack("<I", 5) + b"Name\0\0"
    cue = struct.pack("<I", 1) + struct.pack("<IIIIII", 7, 0, 0, 0, 0, 4000)
    extra = b"LIST" + struct.pack("<I", len(info)) + info + b"cue " + struct.pack("<I", len(cue)) + cue
    assert tagparse.parse(wav(b"\0\0", extra=extra)) == [("riff", 0, "title", "Name"), ("riff", 0, "cue_point", "0.500 Cue 7")]


def test_mislabelled_latin1():
    assert tagparse.decoded("é".encode(), 0) == "é" and tagparse.decoded(b"\xe9", 0) == "é"


def test_cache_keys(spark):
    p = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "y", "2"), ("b", "x", "1"), ("c", "x", "1")], "k string, n string, v string")
    got = {r.k: r.params_hash for r in files.parameter_key(p, "k", "n", "v").collect()}
    assert got["a"] == got["b"] != got["c"]
