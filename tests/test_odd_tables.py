"""Queries against their SQL over tables with missing, repeated and null rows, and over short texts."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import norm

from pulsegrid.operators import loudness, markers
from pulsegrid.plans import queries


def same(spark, folder, name, table):
    df = queries.queries()[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    cur = c.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(k) for k in df.columns]
    mine = sorted(tuple(norm(v) for v in r) for r in df.collect())
    theirs = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert mine == theirs
    return mine


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Stretches of events with ids missing between them, some ids twice, values beyond full scale and none at all."""
    folder = str(tmp_path_factory.mktemp("odd"))
    duckdb.sql(f"""copy (select i + 500 * c - case when c = 3 then 20 else 0 end as event_id, timestamp '2024-01-01' as ts, (i * 7919 + c) % 97 as user_id,
        case when i % 97 = 5 then 'error' else 'click' end as event_type, case when i % 50 = 7 then null when i % 90 = 11 then 301.5 else round(abs(sin(i * 1.7 + c)) * 480, 2) end as value, '{{}}' as props
        from range(470) t(i), range(4) u(c) union all select 30000 + i, timestamp '2024-01-01', i % 97, 'click', 1.5 + 400 * (i % 3), '{{}}' from range(300) t(i)) to '{folder}/events.parquet'""")
    return folder


def test_inter_sample_peaks_at_missing_and_repeated_frames(spark, events):
    assert same(spark, events, "inter_sample_peaks", "events")


def test_samples_at_full_scale_are_no_peaks_above_it(spark):
    assert (loudness.polyphase("best")[[0, -1]] != 0).sum(axis=1).tolist() == [1, 1]
    rng = np.random.default_rng(3)
    x = np.where(rng.random(4000) < 0.5, 1.0, -1.0)
    assert (np.abs(loudness.resample_block(x, 4)[::4]) == 1.0).all()


def test_clipping_at_missing_and_repeated_frames(spark, events):
    assert any("inter_sample_peak" in str(r) for r in same(spark, events, "analysis_clipping", "events"))


def test_next_errors_of_places_without_track_or_far_from_errors(spark, events):
    same(spark, events, "markers_next_error", "events")
    m = spark.createDataFrame([("a", "x", "error", 100, None), ("a", "w", "error", 100, None), ("a", "y", "decoderEvent", 5_000, 3), ("a", "z", "decoderEvent", 40, 2), (None, "n", "error", 7, None)], "track string, id string, kind string, start_frame long, severity long")
    at = spark.createDataFrame([("a", 99), ("a", 100), ("a", 5_000), ("a", 90_000), ("b", 1), (None, 1)], "track string, at long")
    for chunk in (64, 65_536):
        got = {(r.track, r.at): (r.start_frame, r.id) for r in markers.next_error(m, at, chunk).collect()}
        assert got == {("a", 99): (100, "w"), ("a", 100): (5_000, "y"), ("a", 5_000): (100, "w"), ("a", 90_000): (100, "w"), ("b", 1): (None, None), (None, 1): (None, None)}


def test_next_errors_in_linear_time(spark):
    """One track of 200,000 places; a frame that looks at all that follows would pass 20,000,000,000 rows."""
    e = spark.range(200_000).select(F.lit("t").alias("track"), F.format_string("m%d", "id").alias("id"), F.lit("error").alias("kind"), (F.col("id") * 10).alias("start_frame"), F.lit(0).alias("severity"))
    begin = time.monotonic()
    found = markers.next_error(e, e.select("track", (F.col("start_frame") + 5).alias("at")))
    assert found.where("start_frame = at + 5 or (start_frame = 0 and at = 1999995)").count() == 200_000
    assert time.monotonic() - begin < 60


def test_formats_of_short_texts(spark, tmp_path):
    duckdb.sql(f"copy (select i as doc_id, case when i % 60 < 56 then repeat('é', (i // 4) % 14 // 2) || repeat('a', (i // 4) % 2) end as text from range(400) t(i)) to '{tmp_path}/documents.parquet'")
    assert len(same(spark, str(tmp_path), "file_formats", "documents")) > 250


def test_clips_of_repeated_frames_across_chunks(spark, tmp_path):
    """Every frame of both channels twice to four times over three chunks: repeats shift the numbers of all rows behind them, in later chunks too."""
    duckdb.sql(f"""copy (select i as event_id, timestamp '2024-01-01' as ts, i % 97 as user_id, 'click' as event_type, round(abs(sin(i * 1.7) * cos(i / 90.0)) * 300, 2) as value, '{{}}' as props
        from range(300000) t(i), range(4) u(c) where c < 2 + i % 3) to '{tmp_path}/events.parquet'""")
    assert len(same(spark, str(tmp_path), "clip_events", "events")) > 100
