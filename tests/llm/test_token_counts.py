"""Counts against the tokenizers library's unigram model with the same pieces and scores."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, models, pre_tokenizers

from geoloom.llm import token_counts as C
from geoloom.llm.queries import op9

PATH = public_tokenizers.path(C.VOCABULARY)


def library(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


def own_pieces():
    m = SentencePieceProcessor(model_file=PATH)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "the", "The", "tion", "é", "日本語", "1234", "!?", "<0x0A>", "<unk>", "▁", "\x00", "über", "xyzzy", "😀", "ß", "a", "b", "aa"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(n)] + ["", " ", "  ", "▁", " a", "a ", "\n", "z" * 3000, "日" * 50]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_whole_vocabulary(byte_fallback):
    t, c = library(own_pieces(), byte_fallback), C.Counter(own_pieces(), byte_fallback)
    for text in odd_texts():
        assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_ties(byte_fallback):
    """Many ways of equal sums: whole-number scores over a small alphabet."""
    rng = random.Random(8)
    for round_ in range(40):
        pieces = {"<unk>": 0.0} | {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(0, 4)) for _ in range(12)}
        if byte_fallback:
            pieces |= {f"<0x{b:02X}>": -9.0 for b in range(256)}
        vocabulary = list(pieces.items())
        t, c = library(vocabulary, byte_fallback), C.Counter(vocabulary, byte_fallback)
        for _ in range(60):
            text = "".join(rng.choice("abbc \n") for _ in range(rng.randrange(0, 14)))
            assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids), (vocabulary, text)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (4, "the " * 60000), (5, "w" * 20000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, t string, n_tokens int")
    t = library(own_pieces(), True)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows]
    assert sorted([(r.doc_id, r.n_tokens) for r in C.token_counts(df, PATH).collect()], key=key) == sorted(want, key=key)
    assert C.token_counts(df.limit(0), PATH).count() == 0


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    t = library(own_pieces(), True)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op9(spark, folder).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
