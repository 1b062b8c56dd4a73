"""Every query of the timetable engine against its SQL on DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from wayline import registry

registry.load()
SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None:
        return v
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(df.columns) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert len(ours) == len(theirs)
    assert [list(map(type, r)) for r in ours[:1]] == [list(map(type, r)) for r in theirs[:1]]
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
