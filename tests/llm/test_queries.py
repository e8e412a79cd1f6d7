"""Every query with SQL against DuckDB, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from geoloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, con):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want)) != []


def test_contract():
    found = entry_points.queries()
    assert "pipeline" in found and set(QUERIES) <= set(found)
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(entry_points.oracle_sql()) <= set(found)
    assert [name for name, _ in corpus_pipeline.STAGES] and os.path.exists(corpus_pipeline.__file__)
