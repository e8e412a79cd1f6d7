"""Targets against a plain reshare, rounding by its promises."""

import re
from collections import Counter, defaultdict

from geoloom.llm import mixing as M


def plain_targets(size_of, weights=(5, 2, 1), most=3):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = sum(size_of.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            out[s] += share * w[s]
            if out[s] >= most * size_of[s]:
                left += out[s] - most * size_of[s]
                out[s] = most * size_of[s]
                open_.discard(s)
    return out


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(spark, rows, **how):
    """rows: (doc_id, text, source). Gives the words taken by source beside the targets."""
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, source string, tree string, target double")
    got = M.mix(df, **how).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    want = plain_targets(total)
    again = M.mix(df.repartition(7), **how).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    by_target = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
        by_target[round(r.target, 6), r.source_size][0] += r.taken
        by_target[round(r.target, 6), r.source_size][1] = max(by_target[round(r.target, 6), r.source_size][1], r["size"])
    assert set(by_target) == {(round(want[s], 6), total[s]) for s in total}
    alike = Counter((round(want[s], 6), total[s]) for s in total)
    for k, (taken, largest) in by_target.items():
        assert abs(taken - k[0] * alike[k]) <= largest * alike[k] + 1e-6
    return got


def test_trees_of_any_depth(spark):
    rows = [(i, "w " * (i * 7919 % 90 + 1), None if i % 11 == 0 else f"src{0 if i % 3 == 0 else i % 9}") for i in range(3000)]
    for leaf in (20_000, 40, 5):
        check(spark, rows, leaf=leaf)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", "a"), (None, "two words", None), (4, "w " * 200000, "B"), (5, " \t\n", None), (6, "ä ö", "é"), (7, "only", "")]
    rows += [(8, "same row again", "a")] * 500  # a row that repeats
    check(spark, rows)


def test_expected_share(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(4000)]
    got = check(spark, rows, leaf=100)
    by_size = defaultdict(list)
    for r in got:
        by_size[r.source_size, r["size"]].append(r.taken / r["size"] / (r.target / r.source_size))
    assert all(abs(sum(x) / len(x) - 1) < 0.12 for x in by_size.values())  # no size is favoured


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.mixed(df).count() == 0
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in M.mix(df).collect()] == [(0.0, 0)] * 2


def test_rows_come_as_often_as_taken(spark):
    df = spark.createDataFrame([(i, "w " * (i % 30 + 1), f"s{i % 4}", i % 2, 7) for i in range(400)] + [(900, "again and again", "s1", 0, 7)] * 50, "doc_id long, text string, source string, n int, times int")
    out = M.mixed(df)
    assert out.columns == df.columns
    times = Counter(r.doc_id for r in out.collect())
    taken = Counter()
    for r in M.mix(df).collect():
        taken[r.doc_id] += r.taken // r["size"]
    assert +taken == times


def test_variants_share_their_copies(spark):
    """Rows of one id, source and text, but other languages, come each as often as the mix takes it."""
    rows = [(i, "w " * (i % 30 + 1), f"s{i % 2}", lang) for i in range(60) for lang in ("de", "en", None)]
    rows += [(900, "again and again", "s1", lang) for lang in ("de",) * 5 + ("en",) * 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    times = Counter((r.doc_id, r.lang) for r in M.mixed(df).collect())
    taken = Counter()
    for r in M.mix(df).collect():
        taken[r.doc_id] += r.taken // r["size"]
    by_id = Counter()
    for (i, _), t in times.items():
        by_id[i] += t
    assert by_id == +taken
    for i in range(60):
        own = [times[i, lang] for lang in ("de", "en", None)]
        assert max(own) - min(own) <= 1
    assert sorted(map(repr, M.mixed(df.repartition(5)).collect())) == sorted(map(repr, M.mixed(df).collect()))


def test_texts_are_shuffled_once(spark):
    """The join takes the dealing of the step before: one exchange carries the texts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = M.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    steps = [x.strip() for x in plan.split("\n\n")]
    assert len([x for x in steps if re.match(r"\(\d+\) Exchange", x) and ("valueSet" in x or re.search(r"\btext#", x))]) == 1
