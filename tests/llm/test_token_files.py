"""Packed ids against the tokenizer's own, and exact round trips."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoloom.llm import token_files as T
from geoloom.llm.queries import op7

PATH = public_tokenizers.path(T.TOKENIZER)
OWN = Tokenizer.from_file(PATH)


def plain(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("bits", [1, 2, 5, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint32)
        data = T.pack(ids, bits)
        assert len(data) == -(-n // 64) * bits * 8
        assert (T.unpack(data, n, bits) == ids).all()
    assert T.bits_for(50257) == 16 and T.bits_for(65537) == 17 and T.bits_for(1) == 1 and T.bits_for(2) == 1


def test_file_random_access():
    rng = np.random.default_rng(0)
    docs = [(None, rng.integers(0, 999, 5, dtype=np.uint32)), (-3, rng.integers(0, 999, 0, dtype=np.uint32))]
    docs += [(i, rng.integers(0, 999, int(rng.integers(0, 400)), dtype=np.uint32)) for i in range(200)] + [(9, rng.integers(0, 999, 5000, dtype=np.uint32))]
    stream = io.BytesIO()
    stream.close, close = (lambda: None), stream.close
    w = T.Writer(stream, T.bits_for(999), block=128)
    for d in docs:
        w.add(*d)
    w.close()
    r = T.Reader(stream, len(stream.getvalue()))
    for i in random.Random(1).sample(range(len(docs)), len(docs)):
        assert (r.document(i) == docs[i][1]).all()
    n, crcs = r.digests()
    assert n.tolist() == [len(d) for _, d in docs]
    assert crcs == [zlib.crc32(d.astype("<u4").tobytes()) for _, d in docs]
    close()


def odd_texts():
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "The", "don't", "'s", "é", "日本", "1234", "!?", " ", "　", "\x1c", "\x85", "<|endoftext|>", "über", "x" * 60, "😀", "\r\n", "é"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(800)]
    return out + ["", " ", "  ", " a", "a ", " a  b ", "<|endoftext|>", "word " * 30000, "z" * 20000, "a \nb", "a\n b"]


def test_encoder_equals_tokenizer():
    texts = odd_texts()
    enc = T.Encoder(PATH)
    for part in (texts[:100], texts, texts[::-1]):
        assert [x.tolist() for x in enc.encode(part)] == [plain(t) for t in part]


def expect(rows):
    """rows: (doc_id, text) in file order."""
    out, start = [], 0
    for i, t in rows:
        ids = plain(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests(spark, tmp_path):
    rows = [(None, "no id"), *((i - 50, t) for i, t in enumerate(odd_texts()[:300])), (900, None), (901, ""), (902, "one"), (902, "one"), (902, "one"), (2**62, "last")]
    df = spark.createDataFrame([(t, "x", i, 3) for i, t in random.Random(2).sample(rows, len(rows))], "text string, t string, doc_id long, start int")
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.token_digests(df, PATH).collect()), key=lambda r: r[1])
    assert got == expect(rows)
    files = T.write(df, f"file://{tmp_path}/out", PATH, file_ids=700).orderBy("part", "sub").collect()
    assert len(files) > 5
    assert [(i, x.tolist()) for i, x in T.documents([f.path for f in files])] == [(i, plain(t)) for i, t in rows]


def test_empty(spark):
    assert T.token_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op7(spark, folder).collect()), key=lambda r: r[1])
    assert got == expect(rows)
