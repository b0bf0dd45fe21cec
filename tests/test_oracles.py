"""Each query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from rasterloom.plans import blocks, files

EVERY = {**blocks.QUERIES, **files.QUERIES}
SQL = {**blocks.ORACLES, **files.ORACLES}


def plain(v):
    if v is None or isinstance(v, str | bytes | bool):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return round(float(v), 4)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, db):
    df = EVERY[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(EVERY) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert EVERY[name](spark, sf_dir).count() > 0
