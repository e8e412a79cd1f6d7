"""Wu-Manber search against a plain search of word windows."""

import hashlib
import random
import re

from geoloom.llm import decontaminate as D
from geoloom.llm.queries import op10


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        runs = {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1))} if v else set()
        for r in runs:
            for i in range(len(w) - len(r) + 1):
                if tuple(w[i : i + len(r)]) == r:
                    hit.update(range(i, i + len(r)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def sample(seed=3):
    rng = random.Random(seed)
    vocab = ["a", "b", "the", "of", "tion", "über", "ñu", "x9", "long" * 9, "日本", "in"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(40)]
    items += [(41, None), (42, ""), (43, "!!!"), (44, items[7][1]), (7, items[7][1]), (None, "only here null")]
    docs = [(i, say(rng.randrange(0, 120))) for i in range(60)]
    docs += [(100 + i, f"{say(8)} {t or ''} {say(3)} {(t or '').upper()}") for i, t in items if i is not None]
    docs += [(300, None), (301, ""), (302, " .,"), (303, say(60000)), (303, "tion"), (303, "tion"), (None, "So only here null."), (304, "Xa"), (305, "a")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "en", 1, ["x"]) for i, t in docs], "doc_id long, text string, t string, n_hit int, item_ids array<string>"),
        spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, t int"),
    )


def test_against_plain_search(spark):
    docs, items = sample()
    named = [("null" if i is None else str(i), t) for i, t in items]
    want = sorted((i is None, i or 0, *plain(t, named)) for i, t in docs)
    d, b = frames(spark, docs, items)
    for pass_bytes in (D.PASS_BYTES, 2000):  # one pass and several
        got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r.item_ids)) for r in D.overlaps(d, b, pass_bytes=pass_bytes).collect()]
        assert sorted(got) == want
        left = D.clean(d, b, pass_bytes=pass_bytes)
        assert left.columns == d.columns
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
        assert sorted([(r.doc_id, r.text) for r in left.collect()], key=key) == sorted([(i, t) for i, t in docs if not plain(t, named)[1]], key=key)


def test_long_windows_only(spark):
    docs, items = sample(9)
    items = [(i, t) for i, t in items if len(words(t)) >= 10 and i is not None]
    d, b = frames(spark, docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in D.overlaps(d, b).collect() if r.doc_id is not None and r.doc_id != 303}
    named = [(str(i), t) for i, t in items]
    assert got == {i: plain(t, named) for i, t in docs if i is not None and i != 303}


def test_empty_tables(spark):
    docs, items = sample()
    d, b = frames(spark, docs, items)
    assert D.overlaps(d.limit(0), b).count() == 0
    assert {r.n_hit for r in D.overlaps(d, b.limit(0)).collect()} == {0}
    assert D.clean(d, b.limit(0)).count() == len(docs)


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op10(spark, folder).collect():
        n, hit, found = plain(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == (hit > 0)


def test_one_search_at_a_time(spark, monkeypatch):
    """With several passes no search is built while an earlier one is still broadcast."""
    from pyspark import Broadcast

    context, live, most = type(spark.sparkContext), [], []
    send, gone = context.broadcast, Broadcast.destroy

    def broadcast(self, value):
        live.append(send(self, value))
        most.append(len(live))
        return live[-1]

    def destroy(self, *a):
        live[:] = [b for b in live if b is not self]
        return gone(self, *a)

    docs = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(str(i), " ".join(f"w{i + j}" for j in range(15))) for i in range(0, 60, 10)], "item_id string, text string")
    for op in (D.clean, D.overlaps):
        once = sorted(map(repr, op(docs, items).collect()))
        with monkeypatch.context() as m:
            m.setattr(context, "broadcast", broadcast)
            m.setattr(Broadcast, "destroy", destroy)
            live.clear()
            most.clear()
            got = op(docs, items, pass_bytes=150)
            assert sorted(map(repr, got.collect())) == once
            assert len(most) > 2 and max(most) == 1
