"""Operators over all rows of their input, against loops."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import silence, transients
from pulsegrid.plans import queries
from pulsegrid.sources import signals

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_every_row_is_given_to_the_operator(spark):
    q = queries.queries()
    n = signals.read(spark, SF, "events").count()
    regions = signals.markers(spark, SF).where("end_frame is not null").count()
    assert q["marker_spans_all"](spark, SF).agg(F.sum("n")).first()[0] == regions
    assert q["cache_lookup_all"](spark, SF).select("k").distinct().count() == n
    assert q["zero_crossings_all"](spark, SF).count() == n


def test_nearest_crossing_of_every_frame_against_a_loop(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.choice([-1.0, 1.0], 60), rng.integers(1, 12, 60))
    s = spark.createDataFrame([("t", 0, i, float(v)) for i, v in enumerate(x)] + [("still", 0, 0, 1.0)], "track string, channel int, frame long, x double")
    turns = [i for i in range(len(x) - 1) if (x[i] >= 0) != (x[i + 1] >= 0)]
    want = {i: min(turns, key=lambda f: (abs(f - i), f)) for i in range(len(x))}
    want = {i: f for i, f in want.items() if abs(f - i) <= 4}
    got = silence.nearest_zero_crossing(s, s.select("track", "channel", F.col("frame").alias("target")), 4).collect()
    assert {r.target: r.crossing for r in got} == want and len(got) == len(want) < len(x)


@needs_tables
def test_onsets_are_the_candidates_and_timed_as_by_a_loop(spark):
    q = queries.queries()
    rows = signals.events_stereo(spark, SF).groupBy("frame").agg(F.avg("x").alias("x")).collect()
    x = {r.frame: r.x for r in rows}
    got = q["transient_attack_onsets"](spark, SF).collect()
    assert len(got) > 5 and len({r.cand % 500 for r in got}) > 5
    for r in got:
        near = [f for f in range(r.cand - 20, r.cand + 200) if f in x]
        ratio = {f: x[f] ** 2 / (sum(x[g] ** 2 for g in range(max(near[0], f - 5), f)) + 1e-12) for f in near}
        attack = max(near, key=lambda f: (ratio[f], f))
        turns = [f for f in near[1:] if f <= attack and (x[f - 1] >= 0) != (x[f] >= 0)]
        assert (r.attack, r.start) == (attack, max(turns, default=near[0]))
    times = {r.cand: r for r in q["transient_times_onsets"](spark, SF).collect()}
    assert set(times) == {r.cand for r in got}
    for r in got:
        part = [f for f in range(r.start, r.cand + 200) if f in x]
        peak = max(part[:30], key=lambda f: (abs(x[f]), -f))
        rise = [next(f for f in part if abs(x[f]) >= k * abs(x[peak])) for k in (0.1, 0.9)]
        assert times[r.cand].peak_frame == peak and times[r.cand].attack_ms == rise[1] - rise[0]
