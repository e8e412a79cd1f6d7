"""Neighbour votes against all cosines, and held-out accuracy."""

import zlib

import numpy as np

from geoloom.llm import quality as Q
from geoloom.llm.queries import op2

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = op2(spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    pairs = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    good, bad = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


def model(n=300, seed=0):
    rng = np.random.default_rng(seed)
    texts = [(" ".join(["word", "other", "Thing."][int(k)] for k in rng.integers(0, 3, 30))).encode() if i % 3 else ("JUNK!! " * int(rng.integers(5, 30))).encode() for i in range(n)]
    return Q._solve(np.stack([Q.features(t) for t in texts]), np.array([float(i % 3 > 0) for i in range(n)]), 16), texts


def test_votes_equal_all_cosines():
    m, texts = model()
    x = np.stack([Q.features(t) for t in [*texts[:40], b"word word JUNK!! JUNK!!", b"x", "日本".encode()]])
    v = m.embed(x)
    for i, s in enumerate(m.scores(x, block=7)):
        cosine = np.array([float(v[i] @ u) for u in m.vectors])
        w = np.maximum(np.sort(cosine)[::-1][: Q.NEIGHBOURS], 1e-6) ** Q.SHARPNESS
        labels = m.labels[np.argsort(-cosine, kind="stable")[: Q.NEIGHBOURS]]
        ties = abs(np.sort(cosine)[::-1][Q.NEIGHBOURS - 1] - np.sort(cosine)[::-1][Q.NEIGHBOURS]) < 1e-5
        assert ties or abs(s - (w * labels).sum() / w.sum()) < 1e-4


def test_odd_rows(spark):
    m, _ = model()
    rows = [(1, None), (2, ""), (3, "JUNK!! " * 20), (4, "word other Thing. " * 60000), (4, "word"), (4, "word"), (None, "word other word Thing."), (5, "\x00\x01"), (6, " ")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, t string, score double")
    got = Q.score(df, m).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {m.prior}
    left = Q.accepted(df, m)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in left.collect()) == sorted((i or 0, len(t or "")) for i, t in rows if m.scores(np.stack([Q.features((t or "").encode())]))[0] >= Q.CUT)
    assert Q.score(df.limit(0), m).count() == 0


def test_fit_on_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in range(20)] + [(3, "text again", 1), (None, "no id", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(15)] + [(3, 0, 9), (4, None, 9), (5, 7, 9), (None, 1, 9), (99, 1, 9)], "doc_id long, quality int, i int")
    m = Q.fit(docs, labels)
    assert len(m.labels) == 15 and set(m.labels) == {0.0, 1.0}
    assert len(Q.fit(docs, labels, sample=6).labels) <= 6
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
