"""M-tree search against all products."""

import math
import random

import numpy as np

from geoloom.llm import topk_search as T


def plain(rows, every=100, k=10):
    """rows: (vec_id, vector). Every (query_id, rank, vec_id, score)."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c is None, c or 0) for m, (c, b) in enumerate(whole) if m != n)
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def got(df, **how):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in T.top_k(df, **how).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, score int, digest double").repartition(3)


def test_trees(spark):
    rng = np.random.default_rng(4)
    near = [(i, (np.eye(8)[i % 8] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(900)]
    same = [(2000 + i, [0.5] * 8) for i in range(700)]  # one vector of many rows
    long = [(5000 + 50 * i, (10.0 ** (i % 5) * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(40)]
    rows = near + same + long
    for tree, block in ((T.TREE, T.QUERY_BLOCK), (300, 4)):
        assert got(frame(spark, rows), tree=tree, query_block=block) == plain(rows)


def test_pages_rule_out(spark):
    """Far clusters are not compared."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.concatenate([rng.normal(c, 0.01, (500, 4)) for c in np.eye(4)]))
    tree = T.Tree.of(T.Tree(list(range(2000)), x).state())
    seen, add = [], T._Best.add
    for q in (0, 700, 1999):
        best = T._Best(5)
        best.add = lambda s, i, best=best: (seen.append(len(i)), add(best, s, i))
        tree.ask(x[q], best)
        want = sorted((-int(x[c] @ x[q]), c) for c in range(2000))[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids)] == want
    assert sum(seen) < 2000  # of 6000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (100, []), (200, [1.0]), (300, [-0.0001, 3.0, 9.0]), (None, [5.0, 5.0]), (7, [5.0, 5.0]), (-100, [0.25, -1e-9])]
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, rows), k=3) == plain(rows, k=3)
    random.seed(0)
    big = [(100 * i, [random.uniform(-3e4, 3e4) for _ in range(3)]) for i in range(30)] + [(1, [2.5e8, 1.0, 0.5]), (400, [1e4, 2e4, 3.0])]
    big = [(i, np.array(v, np.float32).tolist()) for i, v in big]
    assert got(frame(spark, big)) == plain(big)
    assert len(got(frame(spark, [(0, [3e38]), (1, [3e38]), (2, [1.0])]))) == 2  # cut to a long


def test_few_and_none(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(0, [1.0])])) == []
    assert got(frame(spark, [(1, [1.0]), (2, [1.0])])) == []
