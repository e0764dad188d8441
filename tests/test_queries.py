"""Every registered query that has a DuckDB form gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck, sf_dir):
    got = catalogue.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalogue.oracle_sql():
        assert got.columns
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, rows), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    differing = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differing, differing[:3]
