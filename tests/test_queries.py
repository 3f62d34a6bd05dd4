"""Every registered query with an SQL twin gives what DuckDB gives."""

import decimal
import math

import duckdb
import pytest

from tamarack.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert got
        return
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    rows = cursor.fetchall()
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)
