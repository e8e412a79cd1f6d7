"""Ball hashing against all pairs, fingerprints against single bits."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import simhash_dedup as S


def plain_fingerprint(text, k=3):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """Component of each index: the smallest index reachable over pairs of at most three differing bits."""
    a, root = np.array(fps, "u8"), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def planted(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for bits in (1, 2, 3, 4):  # spread over any bits
        for _ in range(60):
            f = int(rng.integers(0, 2**64, dtype="u8"))
            out += [f, f ^ sum(1 << int(b) for b in rng.choice(64, bits, False))]
    for first, width in S.BLOCKS:  # three bits of one block
        for _ in range(20):
            f = int(rng.integers(0, 2**64, dtype="u8"))
            out += [f, f ^ sum(1 << int(b) for b in first + rng.choice(width, 3, False))]
    core = int(rng.integers(0, 2**64, dtype="u8"))  # a crowd around one fingerprint
    out += [core ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), False)) for _ in range(400)]
    chain = int(rng.integers(0, 2**64, dtype="u8"))  # a chain of links
    for i in range(0, 60, 3):
        out.append(chain := chain ^ (7 << i))
    low = int(rng.integers(0, 2**64, dtype="u8"))  # many values of one block
    out += [low ^ int(x) for x in rng.choice(1 << 21, 300, False)] + [low ^ int(x) for x in rng.integers(0, 1 << 10, 150)]
    return out + out[:50]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_equal_all_pairs(spark):
    fps = planted()
    df = spark.createDataFrame([(i, signed(f), 0) for i, f in enumerate(fps)], "doc_id long, fp long, text_hash long")
    got = {r.doc_id: r.component_id for r in S.components(df).collect()}
    assert got == dict(enumerate(plain_components(fps)))


def test_texts(spark):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "ONE two"), (6, "ä b Ä c d"), (7, "x y z " * 40000), (8, "x y z " * 40000 + "w"), (8, "One"), (8, "One"), (None, "alone here"), (None, None)]
    df = spark.createDataFrame([(i, t, "doc", 1, 2) for i, t in rows], "doc_id long, text string, fp string, component_id int, _id int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 8}
    for i, t in rows[:8]:
        assert by_id[i].fingerprint == f"{plain_fingerprint(t):016x}"
    assert by_id[1].component_id == 0 and by_id[4].component_id == 3 and by_id[7].component_id == 7
    assert {(r.component_id) for r in got if r.doc_id == 8} == {3, 7}
    first = S.first_of_each(df)
    assert first.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id, len(r.text or "")) for r in first.collect()) == sorted((i is None, i, len(t or "")) for i, t in [rows[0], rows[3], rows[5], rows[6], rows[7], rows[11]])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
    assert S.first_of_each(df).count() == 0


def test_whole_table(spark):
    got = S.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()}
    ids = sorted(texts)
    want = plain_components([plain_fingerprint(texts[i]) for i in ids])
    assert {r.doc_id: r.component_id for r in got} == {i: ids[w] for i, w in zip(ids, want)}
