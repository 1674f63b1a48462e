"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from siteweave.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float | np.floating) and np.isnan(x)):
            return ""
        if isinstance(x, bool | np.bool_):
            return str(bool(x))
        return f"{float(x):.9g}" if isinstance(x, int | float | np.number) else str(x)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


#: The crawls are held against a stepwise twin in test_sites.py.
CRAWLS = {"crawl_sim_summary", "crawl_sim_pages", "crawl_targets", "crawl_savings", "crawl_event_log"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - CRAWLS))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) and len(got)


@pytest.mark.parametrize("name", ["bfs_baseline", "public_fallback"])
def test_repeated_urls(spark, tmp_path, name):
    """Larger tables have pages with the same URL, which the smallest have not."""
    con = duckdb.connect()
    con.sql("CREATE TABLE pages AS SELECT i AS page_id, 'https://h' || (i % 2) || '.example/a/' || (i % 5) || '?n=1' AS url, repeat('x', i::INT) AS html FROM range(45) r(i)")
    con.sql(f"COPY pages TO '{tmp_path}/pages.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
