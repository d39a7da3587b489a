"""Stored statistics: states merge in any grouping, and equal one pass over all samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import partials, spectral, stats


def signal(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in (0, 1):
        x = np.round(rng.uniform(-1.1, 1.1, 900), 2) + 1000 * c * 1e-9
        x[200:330] = 0  # silent stretches of their own
        x[rng.integers(0, 900, 60)] = 0
        rows += [("a", c, i, float(v)) for i, v in enumerate(x)]
    rows += [("silent", 0, i, 0.0) for i in range(100)] + [("a", 0, 900, None)]
    return spark.createDataFrame(rows, "track string, channel int, frame long, x double")


def close(a, b):
    assert len(a) == len(b)
    for r, s in zip(a, b, strict=True):
        for k in r.asDict():
            assert r[k] == s[k] or abs(r[k] - s[k]) < 1e-9, (k, r[k], s[k])


@pytest.mark.parametrize("stretch", [1, 64, 10_000])
def test_states_equal_one_pass(spark, stretch):
    x = signal(spark)
    want = stats.channel_stats(x.where("x is not null"), 1000).orderBy("track", "channel").collect()
    close(partials.figures(partials.merged(partials.states(x, stretch)), 1000).orderBy("track", "channel").collect(), want)


def test_any_grouping_and_again(spark, tmp_path):
    x, rng = signal(spark), random.Random(2)
    cuts = [0, *sorted(rng.sample(range(1, 900), 5)), 901]
    days = [partials.merged(partials.states(x.where(f"frame >= {a} and frame < {b}"), 50)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in (3, 0, 5, 1, 4, 2):  # stored in any order
        days[i].write.mode("append").parquet(str(tmp_path / "states"))
    stored = partials.merged(spark.read.parquet(str(tmp_path / "states")))
    want = stats.channel_stats(x.where("x is not null"), 1000).orderBy("track", "channel").collect()
    close(partials.figures(stored, 1000).orderBy("track", "channel").collect(), want)
    counts = {(r.track, r.channel, r.bucket): r.k for r in stored.select("track", "channel", F.explode("histogram").alias("bucket", "k")).collect()}
    assert counts == {(r.track, r.channel, r.bucket): r.n for r in stats.histogram(x.where("x is not null")).where("n > 0").collect()}


def test_no_samples(spark):
    assert partials.merged(partials.states(signal(spark).limit(0))).count() == 0


def test_points_read_few_chunks(spark):
    n, rate = 4096, 8000
    x = spark.createDataFrame([("a", 0, i // 512, i, [float(np.sin(2 * np.pi * 1000.3 * k / rate)) for k in range(i, i + 512)]) for i in range(0, n, 512)], "track string, channel int, chunk_idx int, start_frame long, samples array<float>")
    asked = spark.createDataFrame([(1, "a", 0, 2000, 990.0), (2, "a", 0, 0, 1010.0), (3, "b", 0, 10, 5.0), (4, "a", 0, 9000, 5.0)], "request long, track string, channel int, frame long, hz double")
    got = {r.request: r for r in spectral.points(x, asked, rate, 256, frames=512).collect()}
    assert got.keys() == {1, 2} and abs(got[1].hz - 1000.3) < 1 and abs(got[1].level) < 0.5 and abs(got[2].hz - 1000.3) < 30
    with pytest.raises(ValueError, match="size"):
        spectral.points(x, asked, rate, 1024, frames=512)
