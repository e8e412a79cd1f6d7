"""Each stage of the pipeline on its own input, against plain versions of its decision."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import plain as plain_overlap
from test_near_copies import plain_groups
from test_mixing import plain_targets, size
from test_token_files import plain as plain_ids

import corpus_pipeline as P
from geoloom.llm import quality
from geoloom.llm.queries import remainder

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for i, (_, stage) in enumerate(P.STAGES):
        docs = P.keep(stage(spark, docs, FOLDER))
        assert i == len(P.STAGES) - 1 or docs.columns == columns
        out.append(docs.collect())
    return out


def test_quality(spark, steps):
    before, after = steps[0], steps[1]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    m = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where(remainder("doc_id", 5) != 0))
    score = m.scores(np.stack([quality.features((r.text or "").encode()) for r in before]))
    assert sorted(after) == sorted(r for r, s in zip(before, score) if s >= quality.CUT)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stayed = {r.doc_id for r in after}
    for y, low, high in ((1, 0.98, 1.0), (0, 0.0, 0.1)):
        ids = [r.doc_id for r in before if label.get(r.doc_id) == y]
        assert low <= sum(i in stayed for i in ids) / len(ids) <= high


def test_one_of_each_group(steps):
    before, after = sorted(steps[1], key=lambda r: r.doc_id), steps[2]
    group = plain_groups([r.text for r in before])
    assert sorted(after) == [before[g] for g in sorted(set(group))]


def test_clean_of_benchmark(spark, steps):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(steps[3]) == sorted(r for r in steps[2] if plain_overlap(r.text, items)[1] == 0)
    assert len(steps[3]) < len(steps[2])


def test_mix(steps):
    before, after = steps[3], steps[4]
    total, taken = Counter(), Counter()
    for r in before:
        total[r.source] += size(r.text)
    for r in after:
        taken[r.source] += size(r.text)
    want = plain_targets(total)
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(size(r.text) for r in before if r.source == s)


def test_tokens(steps):
    start, want = 0, []
    for r in sorted(steps[4], key=lambda r: r.doc_id):
        ids = plain_ids(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in steps[5]) == sorted(want)


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run(spark, steps):
    assert sorted(map(repr, P.run(spark, FOLDER).collect())) == sorted(map(repr, steps[5]))
