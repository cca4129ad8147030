"""Every registered query against its SQL in DuckDB, row by row."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from tidewright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, expected = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-6 * max(1, abs(q))) for p, q in zip(x, y, strict=True)), (x, y)


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
