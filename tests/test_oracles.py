"""Every registered query against its DuckDB oracle, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import compare
from geoloom.fixtures import TABLES
from geoloom.registry import all_queries

SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = all_queries()


def views(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(key, spark, con):
    _, _, note = compare(spark, con, QUERIES[key], SMALL)
    if note == "EMPTY":  # the smallest tables hold no hit; no answer is no evidence
        _, _, note = compare(spark, views(NEXT), QUERIES[key], NEXT)
    assert note == "ok", note


def test_contract(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def test_the_check_sees_differences(spark, con):
    from dataclasses import replace

    q = QUERIES["b2_bbox_intersects"]
    _, _, note = compare(spark, con, replace(q, sql=q.sql.replace("west <= 40", "west <= 140")), SMALL)
    assert note.startswith("VALUES")
    _, _, note = compare(spark, con, replace(q, sql=q.sql + " LIMIT 5"), SMALL)
    assert note.startswith("ROWS")
