"""The stream's counters against all rows and all orders, one after another; files in any order."""

import re
from collections import Counter
from itertools import permutations

from geoloom.llm import filter_audit as A


def plain_mask(text, is_copy):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), is_copy)
    return "".join(f for f, x in zip("ABCDE", fails) if x)


def plain(rows, labels):
    """``rows`` of (doc_id, text, part): the counters of each part, order and step."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    masked = [(p, plain_mask(t, i is not None and i > least[t]), labels.get(i, (0, 0))) for i, t, p in rows]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in masked}:
        for order in map("".join, permutations("ABCDE")):
            left = [(m, g) for p, m, g in masked if p == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                before = [m for p, m, _ in masked if p == part and f in m and set(m) & set(order[: step - 1])]
                only = sum(p == part and m == f for p, m, _ in masked)
                left = [x for x in left if f not in x[0]]
                out[part, order, step] = (len(left), len(gone), len(before), only, sum(g for _, (g, _) in gone), sum(t for _, (_, t) in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (9, "Same", "en"), (3, "Same", "de"), (5, "Same", "en"), (3, "Same", "de"), (3, "Same", "fr"), (1, LONG, "en"), (2, LONG + " # ", "en"), (4, LONG, None),
    (0, LONG, "en"), (7, None, "en"), (6, "", "de"), (8, "  ", "de"), (10, " \t\n", "fr"), (None, "Same", "en"), (None, LONG, "fr"), (11, "a b " * 150, "es"),
    (12, "ABC " * 300, "es"), (13, LONG.upper(), "es"), (14, "x" * 2_000_000, "es"), (15, "same", ""), (-2, "a b " * 150, "es"),
]
LABELS = {3: (1, 0), 9: (0, 1), 1: (1, 1), 4: (1, 0), 10: (1, 0)}


def tables(spark, folder, parts):
    for part in parts:
        rows = spark.createDataFrame([(t, i, "mine", 1, p) for i, t, p in part], "text string, doc_id long, key string, mask int, lang string")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    marks = [(i, g, t) for i, (g, t) in LABELS.items()] + [(3, 0, 0), (3, None, None), (None, 1, 1)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def by_key(df):
    return {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}


def test_all_orders_of_files(spark, tmp_path):
    want = plain(ROWS, LABELS)
    for n, parts in enumerate(([ROWS], [ROWS[i::5] for i in range(5)], [[r] for r in ROWS[::-1]][:8] + [ROWS[:-8]])):
        labels = tables(spark, f"{tmp_path}/{n}", parts)
        got = A.audit(spark, f"{tmp_path}/{n}/documents.parquet", labels)
        assert by_key(got) == want and got.count() == 600 * len({p or "" for _, _, p in ROWS})


def test_a_later_run_takes_back(spark, tmp_path):
    data, progress = f"{tmp_path}/documents.parquet", f"{tmp_path}/progress"
    labels = tables(spark, tmp_path, [ROWS[:1]])
    assert by_key(A.audit(spark, data, labels, progress)) == plain(ROWS[:1], LABELS)
    tables(spark, tmp_path, [ROWS[1:]])
    assert by_key(A.audit(spark, data, labels, progress)) == plain(ROWS, LABELS)
    log = A.change_log(spark, data, progress)
    assert log.where("doc_id = 9 AND delta = -1").count() == 1


def test_one_text_in_a_third_of_all_rows(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("30000 - id AS doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    rows.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    log = A.change_log(spark, f"{tmp_path}/documents.parquet")
    counts = {(r.part, r["mask"]): r.n for r in log.groupBy("part", "mask").sum("delta").toDF("part", "mask", "n").where("n <> 0").collect()}
    e = {m: sum(n for (_, k), n in counts.items() if bool(k & A.COPY) == m) for m in (False, True)}
    assert e == {True: 9_999, False: 20_001}


def test_empty_table(spark, tmp_path):
    labels = tables(spark, tmp_path, [[]])
    assert A.audit(spark, f"{tmp_path}/documents.parquet", labels).count() == 0
