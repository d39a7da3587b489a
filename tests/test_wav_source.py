"""The WAV data source: byte ranges, containers, pruned frames, files that grow."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import wav
from pulsegrid.streaming import streams

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(wav.WavSource)


def put(path, x, rate=8000, tail=b""):
    """x: frames by channels of 16-bit numbers."""
    x = np.asarray(x, "<i2")
    path.write_bytes(wav.header(x.shape[1], rate, 16, False, x.nbytes) + x.tobytes() + tail)


def read(df):
    out = {}
    for r in df.orderBy("track", "channel", "start_frame").collect():
        assert r.error is None
        got = out.setdefault((r.track.rsplit("/", 1)[-1], r.channel), [])
        assert r.start_frame == len(got)
        got.extend(r.samples)
    return out


@pytest.mark.parametrize("split", [1, 997, 4096, 1 << 20])
def test_byte_ranges(spark, tmp_path, split):
    files = {f"f{n}.wav": RNG.integers(-32768, 32768, (n, 2)) for n in (0, 1, 255, 256, 257, 3000)}
    for name, x in files.items():
        put(tmp_path / name, x, tail=b"LIST\4\0\0\0abcd")
    df = spark.read.format("pulsegrid_wav").option("frames", 256).option("split", split if split > 1 else 50).load(str(tmp_path))
    got = read(df)
    for name, x in files.items():
        for c in range(2):
            assert got.get((name, c), []) == [v / 32768 for v in x[:, c].tolist()]
    assert df.rdd.getNumPartitions() == (1 if split >= 1 << 20 else df.rdd.getNumPartitions()) and (split > 5000 or df.rdd.getNumPartitions() > 3)


def test_containers_and_errors(spark, tmp_path):
    put(tmp_path / "a.wav", [[1]])
    (tmp_path / "tagged.wav").write_bytes(b"ID3\3\0\0\0\0\0\5hello" + (tmp_path / "a.wav").read_bytes())
    (tmp_path / "b.flac").write_bytes(b"fLaC" + b"\0" * 50)
    (tmp_path / "c.aiff").write_bytes(b"FORM\0\0\0\0AIFF")
    (tmp_path / "d.m4a").write_bytes(b"\0\0\0\x20ftypM4A ")
    (tmp_path / "e.txt").write_bytes(b"no sound")
    (tmp_path / "f.wav").write_bytes(b"")
    (tmp_path / "g.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 7, 1, 8000, 8000, 1, 8) + b"data\2\0\0\0ab")
    (tmp_path / "h.wav").write_bytes(b"RIFF\0\0\0\0WAVEdata\2\0\0\0ab")
    (tmp_path / "_hidden").write_bytes(b"x")
    for split in (20, 1 << 20):
        rows = spark.read.format("pulsegrid_wav").option("split", split).load(str(tmp_path)).collect()
        assert {r.track.rsplit("/", 1)[-1]: r.error for r in rows if r.error} == {
            "b.flac": "unsupported format: flac", "c.aiff": "unsupported format: aiff", "d.m4a": "unsupported format: mp4", "e.txt": "unsupported format: unrecognised", "f.wav": "unsupported format: unrecognised",
            "g.wav": "unsupported format: wav of code 7, 8 bits", "h.wav": "unsupported format: wav without format or data",
        }
        assert sorted((r.track.rsplit("/", 1)[-1], r.samples) for r in rows if not r.error) == [("a.wav", [1 / 32768]), ("tagged.wav", [1 / 32768])]
        assert len(rows) == 9
    with pytest.raises(Exception, match="missing"):
        spark.read.format("pulsegrid_wav").load(str(tmp_path / "missing")).collect()


def test_a_sparse_gigabyte(spark, tmp_path):
    path, data = tmp_path / "long.wav", 1 << 30
    with path.open("wb") as f:
        f.write(wav.header(2, 48_000, 16, False, data))
        f.truncate(44 + data)
        f.seek(44 + 4 * 200_000_000)
        f.write(struct.pack("<2h", 16384, -16384))
    reader = spark.read.format("pulsegrid_wav").option("split", 16 << 20)
    assert reader.load(str(path)).rdd.getNumPartitions() == 65
    near = reader.option("beginFrame", 199_999_000).option("endFrame", 200_001_000).load(str(path))
    assert near.rdd.getNumPartitions() <= 2
    hit = near.select("channel", "start_frame", F.posexplode("samples").alias("i", "x")).where("x != 0").collect()
    assert sorted((r.channel, r.start_frame + r.i, r.x) for r in hit) == [(0, 200_000_000, 0.5), (1, 200_000_000, -0.5)]
    began = time.time()
    all_ = spark.read.format("pulsegrid_wav").option("split", 16 << 20).load(str(path)).agg(F.sum(F.size("samples")).alias("n"), F.count("*").alias("chunks")).first()
    assert all_.n == data // 2 and all_.chunks == 2 * 4096 and time.time() - began < 120


def test_files_that_grow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    x = RNG.integers(-32768, 32768, (1000, 1))
    whole = wav.header(1, 8000, 16, False, 2000) + np.asarray(x, "<i2").tobytes()
    (folder / "x.wav").write_bytes(whole[:1001])

    def drain():
        df = spark.readStream.format("pulsegrid_wav").option("frames", 128).option("closing", "true").load(str(folder))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_idx").collect()
        return [(r.chunk_idx, r.start_frame, len(r.samples)) for r in rows], [v for r in rows for v in r.samples]

    places, got = drain()
    assert places == [(i, 128 * i, 128) for i in range(3)] and got == [v / 32768 for v in x[:384, 0].tolist()]
    assert drain()[0] == places  # nothing new
    (folder / "x.wav").write_bytes(whole)
    places, got = drain()
    assert places == [*[(i, 128 * i, 128) for i in range(7)], (7, 896, 104), (8, 1000, 0)] and got == [v / 32768 for v in x[:, 0].tolist()]


def test_a_stream_of_files_into_a_stateful_operator(spark, tmp_path):
    x = RNG.integers(-32768, 32768, (700, 1))
    put(tmp_path / "x.wav", x)
    stream = spark.readStream.format("pulsegrid_wav").option("frames", 100).option("closing", "true").load(str(tmp_path))
    got = streams.run_to_table(streams.runs(stream.select("track", "channel", "chunk_idx", "start_frame", "samples"), 0.5), "append").collect()
    loud = np.abs(x[:, 0]) >= 16384
    edges = np.flatnonzero(np.diff(np.r_[False, loud, False].astype(int))).reshape(-1, 2)
    assert sorted((r.begin, r.end) for r in got) == [tuple(e) for e in edges.tolist()]


def test_write_and_read(spark, tmp_path):
    rows = [(t, c, i, float(v)) for t in "ab" for c in (0, 1) for i, v in enumerate(RNG.integers(-32768, 32768, 90) / 32768)]
    df = spark.createDataFrame([*rows, ("c", 0, 3, 2.0), ("c", 0, 4, None)], "track string, channel int, frame long, x double")
    made = wav.write_wavs(df, f"file://{tmp_path}/made", 8000).collect()
    assert sorted((r.track, r.frames) for r in made) == [("a", 90), ("b", 90), ("c", 5)]
    got = read(spark.read.format("pulsegrid_wav").load(f"file://{tmp_path}/made"))
    for t in "ab":
        for c in (0, 1):
            assert got[f"{t}.wav", c] == [v for tt, cc, _, v in rows if (tt, cc) == (t, c)]
    assert got["c.wav", 0] == [0.0, 0.0, 0.0, 32767 / 32768, 0.0]


def test_many_short_ranges_share_tasks(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"{i}.wav").write_bytes(wav.header(1, 8000, 16, False, 400) + bytes(range(200)) * 2)
    options = {"path": str(tmp_path), "split": "100", "frames": "16"}
    read = lambda parts: [tuple(map(str, r)) for p in parts for b in wav.WavReader(options).read(p) for r in zip(*b.to_pydict().values(), strict=True)]
    every = wav.WavReader(options).partitions()
    assert len(every) == 150
    monkeypatch.setattr(wav, "TASKS", 7)
    few = wav.WavReader(options).partitions()
    assert len(few) == 7 and sum(len(p.parts) for p in few) <= 37 and read(few) == read(every)
    stream = wav.WavStreamReader(options)
    assert len(stream.partitions(stream.initialOffset(), stream.latestOffset())) == 7
