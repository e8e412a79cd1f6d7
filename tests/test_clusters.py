"""K-means where rows repeat."""

from pyspark.sql import functions as F

from geoloom.operators import clusters, labels, scale
from geoloom.operators.clusters import kmeans


def test_as_many_clusters_as_different_points(spark):
    """Six values, each of 300 rows, and in another group the same six once."""
    rows = [(g, i * 10.0, (i * i) % 7.0) for g, n in ((0, 300), (1, 1)) for i in range(6) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got, centres = kmeans(df, ["g"], ["x", "y"], 6, F.lit(6))
    assert {r.g: len(r.centres) for r in centres.collect()} == {0: 6, 1: 6}
    assert {(r.g, r.x): r.n for r in got.groupBy("g", "x").agg(F.countDistinct("cluster").alias("n")).collect()} == {(g, i * 10.0): 1 for g in (0, 1) for i in range(6)}


def test_labels_of_few_valued_columns(spark):
    df = spark.range(1200).select("id", (F.col("id") % 6).alias("a"))
    got = labels.label_vector_kmeans(df, "id")
    assert got.select("auto_class").distinct().count() == 6


def above(plan, what):
    """For each leaf of ``plan`` that holds ``what``: the operators from it up to the first shuffle."""
    lines = [x for x in plan.splitlines() if x.strip()]
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if what in line and ("Scan" in line):
            path, d = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < d:
                    d = depth[j]
                    path.append(lines[j].strip(" :+-"))
                    if "Exchange" in lines[j]:
                        break
            out.append(path)
    return out


def test_no_round_shuffles_points(spark, monkeypatch):
    """Whatever meets a shuffle has been summed in its task; one group's points stay in their 8 partitions."""
    plans, cut = [], clusters.cut_lineage

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(clusters, "cut_lineage", watched)
    df = spark.range(0, 40_000, 1, 8).selectExpr("0 AS g", "CAST(id % 211 AS double) AS px", "CAST(id % 97 AS double) AS py")
    got, _ = kmeans(df, ["g"], ["px", "py"], 5, F.lit(5), rounds=3)
    seen = [path for p in plans for path in above(p, "px#") if path and "Exchange" in path[-1]]
    assert len(seen) >= 4 and all(any("HashAggregate" in x for x in path) for path in seen)
    rows = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 8 and {r["count"] for r in rows} == {5000}


def test_more_groups_than_can_be_sent(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 60 AS g", "CAST(id * 7919 % 1000 AS double) AS x")
    want = {(r.g, r.x): r.distance for r in kmeans(df, ["g"], ["x"], 3, F.lit(3))[0].collect()}
    monkeypatch.setattr(clusters, "SENT", 1000)
    monkeypatch.setattr(scale, "SENT", 1000)
    got, centres = kmeans(df, ["g"], ["x"], 3, F.lit(3))
    assert {(r.g, r.x): r.distance for r in got.collect()} == want and centres.count() == 60
