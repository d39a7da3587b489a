"""Analyzers from SQL, sums of fixed shape, the result store and curves, against the DataFrame calls and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import surface
from pulsegrid.operators import clipping, curve, islands, stats, sums
from pulsegrid.sources import store

SAMPLES = "track string, channel int, frame long, x double"


def signal(spark, n=5000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("a", c, i, float(v)) for c in (0, 1) for i, v in enumerate(np.round(rng.normal(0, 0.5, n), 2))]
    return spark.createDataFrame(rows, SAMPLES)


def chunks(samples, frames=700):
    g = samples.groupBy("track", "channel", F.floor(F.col("frame") / frames).alias("c")).agg(F.min("frame").alias("start_frame"), F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("s"))
    return g.select("track", "channel", "start_frame", F.col("s.x").alias("samples"))


def test_levels_from_sql_are_those_of_the_statistics(spark):
    surface.register(spark)
    x = signal(spark)
    got = {(r.track, r.channel): r for r in spark.sql(surface.LEVELS, chunks=chunks(x)).collect()}
    for r in stats.channel_stats(x, 1000).collect():
        mine = got[r.track, r.channel]
        for k in ("n", "min", "max", "peak", "peak_frame", "zero_crossings"):
            assert mine[k] == r[k], k
        for k in ("mean", "rms", "std_dev"):
            assert math.isclose(mine[k], r[k], rel_tol=1e-12), k


@pytest.mark.parametrize("gap", [0, 3])
def test_runs_from_sql_are_those_of_the_clip_detector(spark, gap):
    surface.register(spark)
    x = signal(spark, seed=2)
    whole = "SELECT * EXCEPT (parts) FROM pg_joined(TABLE(SELECT * FROM pg_runs(TABLE({chunks}), 0.4D)) PARTITION BY (track, channel) ORDER BY (begin), 0L)"
    got = spark.sql(f"SELECT channel, begin, `end`, peak FROM pg_joined(TABLE({whole}) PARTITION BY (track, channel) ORDER BY (begin), {gap}L)", chunks=chunks(x))
    want = clipping.clip_runs(x, 0.4, 1, gap).select("channel", "begin", "end", "peak")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_spacing_from_sql_is_the_greedy_selection(spark):
    surface.register(spark)
    rng = np.random.default_rng(3)
    at = [float(v) for v in np.sort(rng.integers(0, 4000, 900))]
    points = spark.createDataFrame([("p", v, str(i)) for i, v in enumerate(at)] + [("p", None, "none")], "part string, at double, id string")
    got = spark.sql("SELECT id FROM pg_spaced(TABLE({points}) PARTITION BY part ORDER BY (at), 7D)", points=points)
    want = islands.refractory(points, ["part"], "at", 7.0, at_least=True).select("id")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_table_functions_with_odd_chunks(spark):
    surface.register(spark)
    odd = spark.createDataFrame([("a", 0, 0, None), ("a", 0, 10, []), ("a", 0, 20, [None, float("nan"), float("inf")]), ("a", 0, 30, [0.0, 0.0]), (None, None, 40, [1.0, None, -1.0])], "track string, channel int, start_frame long, samples array<double>")
    got = sorted(map(tuple, spark.sql("SELECT channel, begin, `end`, peak FROM pg_runs(TABLE({c}), 0.5D)", c=odd).collect()), key=str)
    assert got == [(None, 40, 41, 1.0), (None, 42, 43, 1.0)]
    states = {r.begin: r for r in spark.sql("SELECT * FROM pg_states(TABLE({c}))", c=odd).collect()}
    assert set(states) == {30, 40} and states[30].first_sign is None and (states[40].n, states[40].turns, states[40].end) == (2, 1, 43)
    assert spark.sql(surface.LEVELS, chunks=odd.where("false")).count() == 0


def test_scalars_from_sql(spark):
    surface.register(spark)
    r = spark.sql("SELECT pg_db(0.1D) a, pg_db(0D) b, pg_linear(-20D) c, pg_lufs(1D) d, pg_mel(700D) e, pg_gain_to(-14D, -20D) f, pg_db(CAST(NULL AS DOUBLE)) g").first()
    assert (round(r.a, 9), r.b, round(r.c, 9), r.d, round(r.e, 6), r.f, r.g) == (-20.0, -math.inf, 0.1, -0.691, round(2595 * math.log10(2), 6), 6.0, None)


def tree(rows):
    """The sum of [(place, value)] by plain loops over the same tree."""
    for _ in range(4):
        out = {}
        for at, v in sorted(rows):
            out[at >> 7] = out[at >> 7] + v if at >> 7 in out else v
        rows = list(out.items())
    total = None
    for _, v in sorted(rows):
        total = v if total is None else total + v
    return total


def test_sums_are_bit_equal_under_any_partitioning(spark):
    rng = np.random.default_rng(5)
    at = np.unique(np.r_[np.arange(30_000), rng.integers(0, 1 << 34, 20_000)])
    x = rng.normal(0, 1, len(at)) * 10.0 ** rng.integers(-12, 12, len(at))
    rows = [("a", int(i), float(v)) for i, v in zip(at, x, strict=True)]
    df = spark.createDataFrame(rows + [("b", 3, None), ("c", None, 1.0), ("d", 9, 0.1)], "k string, i long, v double")
    want = tree([(i, v) for _, i, v in rows])
    seen = set()
    for n in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = {r.k: r.total for r in sums.tree_sum(df.repartition(n, F.rand(n)), ["k"], "i", F.col("v")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen.add(got["a"].hex())
        assert set(got) == {"a", "d"} and got["d"] == 0.1
    assert seen == {want.hex()}
    assert sums.tree_sum(df.where("false"), ["k"], "i", F.col("v")).count() == 0


def test_store_shows_whole_snapshots_only(spark, tmp_path):
    folder, schema = str(tmp_path / "store"), "source string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    seen = lambda **k: sorted(map(tuple, store.read(spark, folder, schema, "a", k.get("version", 1), k.get("params_hash", "")).collect()))
    assert seen() == []
    waiting = store.add_rows(rows(("x", 1), ("x", 2), ("y", 3)), folder)
    assert seen() == []  # written, not published: what a lost job leaves
    store.publish(spark, folder, waiting, "a", 1)
    assert seen() == [("x", 1), ("x", 2), ("y", 3)]
    early = store.read(spark, folder, schema, "a", 1)
    newer = store.store(rows(("x", 7)), folder, "a", 1)
    assert sorted(map(tuple, early.collect())) == [("x", 1), ("x", 2), ("y", 3)]  # a reader that began before the switch
    assert seen() == [("x", 7), ("y", 3)]  # both rows of x replaced, y as it was
    assert seen(version=2) == [] and seen(params_hash="p") == []
    store.store(rows(("x", 8)), folder, "a", 1, "p")
    assert seen(params_hash="p") == [("x", 8)] and seen() == [("x", 7), ("y", 3)]
    store.store(rows(("y", 9)), folder, "a", 1)
    assert [r.snapshot for r in store.superseded(spark, folder, schema).collect()] == [waiting]
    assert newer != waiting


def test_curve_against_a_loop(spark):
    rng = np.random.default_rng(6)
    frames, wide = rng.choice([0.0, 0.5, -0.25, 1.0], 40), 5
    bins = [("t", p, float(frames[p // wide]), float(frames[p // wide])) for p in range(len(frames) * wide)]
    df = spark.createDataFrame(bins + [("empty", 0, None, None)], "track string, pixel long, min double, max double")
    points = curve.point_samples(df, ["track"])
    want, begin = [], 0
    for p in range(1, len(bins) + 1):
        if p == len(bins) or bins[p][2] != bins[begin][2]:
            want.append(((begin + p - 1) / 2, bins[begin][2]))
            begin = p
    assert sorted((r.at, r.value) for r in points.collect()) == want
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    kernel = lambda v: 0.0 if abs(v) >= 4 else sinc(v) * sinc(v / 4)
    got = {(r.track, r.pixel): r.value for r in curve.between(points, df, ["track"], wide).collect()}
    assert len(got) == len(bins) + 1 and got["empty", 0] == 0
    for _, p, *_ in bins:
        assert math.isclose(got["t", p], sum(v * kernel((p - at) / wide) for at, v in want), abs_tol=1e-12)
    assert {r.value for r in curve.between(points, df, ["track"], 0).collect()} == {0.0}


def test_curve_multiplies_no_point_by_its_pixels(spark):
    """Points meet their pixels inside a task: the plan makes rows of blocks, one or two a point, and tasks of a bounded number of pixels."""
    df = spark.range(50_000).select(F.lit("t").alias("track"), F.col("id").alias("pixel"))
    points = df.where("pixel % 10 = 0").select("track", F.col("pixel").cast("double").alias("at"), F.lit(1.0).alias("value"))
    made = curve.between(points, df, ["track"], 10.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "sum(" not in plan
    assert made.where("abs(value - 1) < 0.02").count() > 49_900
