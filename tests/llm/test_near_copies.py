"""Near copies against every pair's five-word Jaccard."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as P
from geoloom.llm import near_copies as N


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_pairs(texts):
    """All pairs of five-word similarity 0.8 or more: they share one of the rarest fifth of either's shingles."""
    sets = [plain_set(t) for t in texts]
    often = Counter(x for s in sets for x in s)
    holders, out = defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) // 5 + 1]:
            holders[x].append(i)
    for own in holders.values():
        out.update(combinations(own, 2))
    return [(i, j) for i, j in out if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def plain_groups(texts):
    """The first of each text's group by links of either kind."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in [*near_pairs(texts), *enumerate(plain_components([plain_fingerprint(t) for t in texts]))]:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, words, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"new{rng.random()}"
    return out


def test_all_near_copies_go(spark):
    rng = random.Random(4)
    texts = []
    for i in range(60):  # families whose members have 1 to 6 words replaced
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(200, 600))]
        texts += [" ".join(words), *(" ".join(edited(rng, words, k)) for k in (1, 2, 5, 6))]
    crowd = [f"c{rng.randrange(5000)}" for _ in range(300)]
    texts += [" ".join(edited(rng, crowd, rng.choice((1, 3, 9)))) for _ in range(150)]
    texts += ["", "one", "ONE", "one two three", "one two three four five six"]
    pairs = near_pairs(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    stay = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert len(pairs) > 1000 and not [p for p in pairs if stay >= set(p)]
    assert stay == set(plain_groups(texts))  # nothing goes but by a chain of links, of either kind


def test_a_pair_its_band_heads_do_not_join(spark):
    """b-c are near copies; a is the head of their bands and like neither enough."""
    rng = random.Random(8)
    a = [f"w{i}" for i in range(300)]
    b = [*a[:270], *(f"x{i}" for i in range(30)), *(f"y{i}" for i in range(30))]
    c = edited(rng, b, 3)
    texts = [" ".join(t) for t in (a, b, c)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = docs.selectExpr("xxhash64(text) AS text_hash", "doc_id AS root")
    assert {r.root: r.merged for r in N.merged(docs, roots).collect()} == {0: 0, 1: 1, 2: 1}


def test_prefixes_find_what_heads_do_not(spark, monkeypatch):
    """Without any comparison with heads the exact search alone joins the same."""
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 500))]
        texts += [" ".join(words)] + [" ".join(edited(rng, words, rng.randrange(1, 9)) + [f"z{i}" for i in range(rng.randrange(30))]) for _ in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = docs.selectExpr("xxhash64(text) AS text_hash", "doc_id AS root")
    want = list(range(len(texts)))
    for i, j in sorted(near_pairs(texts)):
        a, b = sorted((want[i], want[j]))
        want = [a if r == b else r for r in want]
    for rounds in (0, 2):
        monkeypatch.setattr(N, "ROUNDS", rounds)
        assert {r.root: r.merged for r in N.merged(docs, roots).collect()} == dict(enumerate(want))


def test_all_pairs_of_the_sample(spark):
    """Every pair of different texts that are near copies, of all documents at sf0.1: both texts of none stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = sorted({r.text for r in docs.select("text").collect()})
    pairs = near_pairs(texts)
    stay = {r.text for r in P.near_dedup(spark, docs, "").collect()}
    assert len(pairs) >= 40 and not [(i, j) for i, j in pairs if texts[i] in stay and texts[j] in stay]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 7000}x{i % 11}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (4, "A b c d e f g h"), (4, "a b c d e f g h"), (5, long), (6, long + " end"), (7, " "), (None, "a b c d e f g h i"), (8, None)]
    docs = spark.createDataFrame([(t, i, 1, 2, 3, "r") for i, t in rows], "text string, doc_id long, key int, n int, root int, text_hash string")
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 5]
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0
