"""Progressive refinement against a dictionary of whole texts."""

import hashlib
from collections import defaultdict

import pytest

from geoloom.llm import exact_dedup as E


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        own = [i for i in ids if i is not None]
        keep = max(own) if own else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


HEAD = "h" * 300
ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, HEAD + "x"), (7, HEAD + "y"), (8, HEAD + "x"), (9, "é"), (10, "é"),
    (11, "A"), (12, "a "), (13, "long " * 300_000), (14, "long " * 300_000), (2, "a"), (15, "twice"), (15, "twice"), (None, "twice"),
    (None, "nobody"), (None, "nobody"), (16, "alone in its length, that is to say"), (-3, "minus"), (-4, "minus"),
]


@pytest.mark.parametrize("sent", [E.SENT, 0])
def test_equals_whole_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(E, "SENT", sent)
    docs = spark.createDataFrame([(t, i, 0, "x", i) for i, t in ROWS], "text string, doc_id long, length int, head string, row long").repartition(5)
    assert sorted(map(tuple, E.exact_groups(docs, digests=True).collect()), key=repr) == plain(ROWS)
    bare = {r.doc_id: r.text_sha256 for r in E.exact_groups(docs).collect()}
    assert bare[16] is None and bare[3] is None and bare[6] == bare[8] != bare[7] and bare[7] is not None


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(t, i, "x", "y") for i, t in ROWS], "text string, doc_id long, of string, digest string")
    got = E.largest_of_each(docs).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == sorted({(k, t or "") for i, t in ROWS for k in [max((j for j, u in ROWS if (u or "") == (t or "") and j is not None), default=None)]}, key=repr)
    assert got[0].asDict().keys() == {"text", "doc_id", "of", "digest"}


def test_a_large_group_and_empty_table(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) AS text")
    got = E.exact_groups(docs)
    assert got.where("kept").count() == 20_001
    assert [r.keep_id for r in got.where("group_size > 1").select("keep_id").distinct().collect()] == [29_997]
    assert E.exact_groups(docs.limit(0)).count() == 0 and E.largest_of_each(docs.limit(0)).count() == 0


def test_no_python_and_no_texts_in_a_shuffle(spark):
    plan = E.exact_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), digests=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "_text" not in plan
