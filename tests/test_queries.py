"""Registered queries against DuckDB over the smallest tables; what has no SQL must give rows."""

import math

import duckdb
import pytest

from clauseflow.plans import channel_queries, oracles, queries

QUERIES = queries.QUERIES | channel_queries.QUERIES
ORACLES = oracles.ORACLES | channel_queries.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
