"""Every query with an oracle gives the oracle's rows on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from terrace.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(df: pd.DataFrame, kinds: dict) -> list:
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or v != v:
                out.append("")
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, (bool, str)):
                out.append(str(v))
            else:
                out.append(repr(float(v)))
        rows.append(tuple(out))
    return sorted(rows)


def test_names_match():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    if name not in SQL:
        assert got.count() > 0
        return
    want = oracle.sql(SQL[name]).df()
    have = got.toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    assert plain(have, {}) == plain(want, {})
