"""Every registered signal query against its SQL on DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from pulsegrid.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    c.execute("set timezone='UTC'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    rows, cols = df.collect(), df.columns
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert cols
        return
    cur = db.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(names)
    order = [names.index(c) for c in cols]
    mine = sorted(tuple(norm(v) for v in r) for r in rows)
    theirs = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert len(mine) == len(theirs)
    close = sum(a == b for a, b in zip(mine, theirs, strict=True))
    assert close == len(mine), [x for x in zip(mine, theirs, strict=True) if x[0] != x[1]][:3]
