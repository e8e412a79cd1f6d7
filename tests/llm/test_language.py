"""Code lengths against contexts walked byte by byte, and held-out accuracy."""

import math
import random
import zlib

import numpy as np

from geoloom.llm import language as L
from geoloom.llm.queries import op6

FOLDER = "/root/testdata/sf0.1"


def plain_bits(grown, text):
    """Code length under one language's (runs, counts), a context at a time."""
    follow: dict[bytes, dict[int, int]] = {}
    for four, n in zip(*(x.tolist() for x in grown)):
        for k in range(L.ORDER + 1):
            context = bytes(four >> 8 * j & 255 for j in range(k, 0, -1))
            f = follow.setdefault(context, {})
            f[four & 255] = f.get(four & 255, 0) + n
    data, bits = L.PAD + text, 0.0
    for i in range(L.ORDER, len(data)):
        for k in range(L.ORDER, -1, -1):
            f = follow.get(data[i - k : i])
            if f is None:
                continue
            whole = sum(f.values()) + len(f)
            if data[i] in f:
                bits += math.log2(whole / f[data[i]])
                break
            bits += math.log2(whole / len(f))
        else:
            bits += 8
    return bits


def test_code_lengths():
    rng = random.Random(0)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n)).encode()
    vocab = {"a": ["the", "of", "and"], "b": ["der", "und", "für"], "c": ["日本", "語"]}
    grown = {name: L.count(L.runs([say(w, 50) for _ in range(4)])[0]) for name, w in vocab.items()}
    m = L.Model(grown)
    texts = [say(vocab["a"], 40), b"", b"\xff\x00", say(vocab["b"], 3), say(vocab["c"], 30) + b"zzz", b"x"]
    want = np.array([[plain_bits(grown[n], t) for n in m.languages] for t in texts])
    for part in (5, 64, 1 << 19):
        assert np.allclose(m.lengths(texts, part=part)[0], want)
        bits, of, long = m.lengths(texts, 16, part)
        assert np.allclose([bits[of == i].sum(0) for i in range(len(texts))], want)
        assert [int(long[of == i].sum()) for i in range(len(texts))] == [len(t) for t in texts]
    assert m.predict([texts[0], texts[3], texts[4]])[0] == ["a", "b", "c"]


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    got = op6(spark, FOLDER).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_odd_rows(spark):
    teach = [("the of and with this " * 9, "en"), ("der und für mit dem " * 9, "de"), (None, "de"), ("no language", None), ("", "xx"), ("das ist der und " * 9, "de"), ("das ist der und " * 9, "de")]
    m = L.fit(spark.createDataFrame([(t, la, 1) for t, la in teach], "text string, lang string, l int"))
    assert m.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "with the and of"), (5, "für den und mit"), (6, "the with " * 100000), (None, "und der"), (4, "and"), (4, "and"), (7, "日本")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, lang string, letter int")
    got = L.predict(df, m).collect()
    by = {(r.doc_id, r.lang_pred): r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "en"), (None, "de")} <= set(by)
    assert L.predict(df.limit(0), m).count() == 0
    none = L.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in L.predict(df, none).collect()} == {("und", 0.0)}
