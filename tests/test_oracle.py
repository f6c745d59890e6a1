"""Every registered query against its DuckDB oracle on the smallest scale
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from clickloom.plans.catalog import QUERIES  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle_or_is_documented():
    without = sorted(set(QUERIES) - set(ORACLE))
    assert without == ["sanitized_raw_events"]


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sk, _ = digest(df.columns, srows)
    dc, dk, _ = digest(dcols, drows)
    assert sc == dc
    assert sorted(sk) == sorted(dk)


def test_entry_lists_every_catalog_query():
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", ["sanitized_raw_events"])
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "attributed_session_id" in df.columns
