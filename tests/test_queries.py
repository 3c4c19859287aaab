"""Every registered query of the library against its DuckDB equivalent, over the smallest tables."""

import math

import duckdb
import pytest

from seqspark.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def normal(rows):
    cell = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in order)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in order)).collect()]
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
