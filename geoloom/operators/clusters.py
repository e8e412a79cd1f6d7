"""K-means for every group of a table at once.

Nothing is fitted on the driver or in one task per group, and no round shuffles
points: the centres of all groups are counted, and if their size allows it they
are sent to every task, which sums its own points per (group, cluster); only those
sums are shuffled. With more groups than that the points are written once in as
many folders of groups as it takes, and each folder meets its own centres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.scale import SENT, first_per, sent
from geoloom.session import cut_lineage
from geoloom.sources.sinks import scratch_path


def standardised(df: DataFrame, keys: Sequence[str], features: Sequence[str], out: Sequence[str]) -> DataFrame:
    """``df`` with each feature less its group's mean over its population deviation; a constant one becomes 0."""
    aggs = [F.avg(c).alias(f"_m_{i}") for i, c in enumerate(features)] + [F.stddev_pop(c).alias(f"_s_{i}") for i, c in enumerate(features)]
    stats = df.groupBy(*keys).agg(*aggs)
    got = df.join(sent(stats, 16 * len(features) + 64), list(keys))
    for i, (c, o) in enumerate(zip(features, out)):
        got = got.withColumn(o, F.when(F.col(f"_s_{i}") > 0, (F.col(c) - F.col(f"_m_{i}")) / F.col(f"_s_{i}")).otherwise(0.0))
    return got.drop(*[f"_{x}_{i}" for x in "ms" for i in range(len(features))])


def _distances(points: Sequence[str], k: int) -> list[Column]:
    """Squared distance to each of up to ``k`` centres; infinite where a group has fewer."""
    def to(j: int) -> Column:
        centre = F.get("centres", F.lit(j))
        gap = [F.col(p) - F.get(centre, F.lit(i)) for i, p in enumerate(points)]
        total = gap[0] * gap[0]
        for g in gap[1:]:
            total = total + g * g
        return F.when(F.size("centres") > j, total).otherwise(float("inf"))

    return [to(j) for j in range(k)]


def assigned(points_df: DataFrame, centres: DataFrame, keys: Sequence[str], points: Sequence[str], k: int) -> DataFrame:
    """Rows with their nearest centre as ``cluster``, the lower number among equals, and its ``distance``."""
    met = points_df.join(centres, list(keys)).withColumn("_d", F.array(*_distances(points, k)))
    nearest = F.array_min("_d")
    return (met.withColumn("cluster", (F.array_position("_d", nearest) - 1).cast("int"))
            .withColumn("distance", F.sqrt(nearest)).drop("_d", "centres"))


def seeds(rows: DataFrame, keys: Sequence[str], points: Sequence[str], k: int, seed: int) -> DataFrame:
    """``keys _rn p``: up to ``k`` different points of each group, by a hash of the point, so that a group's hang on its own rows alone.

    Each task keeps the smallest hash of every slot of hashes, 8k slots a group,
    and sends nothing else. A group that fills fewer slots than it wants centres
    has few different points; those, combined in the tasks, are taken as they are.
    """
    keys = list(keys)
    # single precision, as the last bits of a scaled value hang on the order in which its group was summed
    drawn = F.xxhash64(F.lit(seed), *[(F.col(p).cast("double") + 0.0).cast("float") for p in points])
    draw = rows.select(*keys, *points, drawn.alias("_h"))
    least = cut_lineage(draw.groupBy(*keys, F.pmod("_h", F.lit(8 * k)).alias("_slot")).agg(F.min("_h").alias("_h")))
    first = first_per(least, keys, [F.asc("_h")], k, "_rn")
    full = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_full"))
    picked = sent(first.join(full, keys).where(F.col("_full") >= k).select(*keys, "_h", "_rn"), 64)
    several = [F.min(p).alias(p) for p in points]
    rich = draw.join(picked, [*keys, "_h"]).groupBy(*keys, "_rn").agg(*several)
    few = draw.join(sent(full.where(F.col("_full") < k).select(*keys), 48), keys).groupBy(*keys, "_h").agg(*several)
    poor = first_per(few, keys, [F.asc("_h")], k, "_rn")
    return rich.select(*keys, "_rn", F.array(*points).alias("p")).unionByName(poor.select(*keys, "_rn", F.array(*points).alias("p")))


def _folders(df: DataFrame, keys: Sequence[str], groups: int, row_bytes: int) -> list[tuple[DataFrame, Column]]:
    """``df``, written, in parts of whole groups whose centres can be sent; with the condition on ``keys`` that makes each part."""
    n = -(-groups * row_bytes // SENT) if groups else 1
    if n == 1:
        return [(cut_lineage(df), F.lit(True))]
    of = F.pmod(F.xxhash64(*keys), F.lit(2 * n))  # twice as many, as hashes don't share out evenly
    path = scratch_path(df.sparkSession, "points")
    df.withColumn("_folder", of).write.partitionBy("_folder").parquet(path)
    back = df.sparkSession.read.schema(df.schema.add("_folder", "long")).parquet(path)
    return [(back.where(F.col("_folder") == i).drop("_folder"), of == i) for i in range(2 * n)]


def kmeans(df: DataFrame, keys: Sequence[str], points: Sequence[str], k: int, wanted: Column, seed: int = 42,
           rounds: int = 40, tolerance: float = 5e-3) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``cluster`` and ``distance``, and ``centres`` (an array of points) by key.

    ``wanted`` is the number of clusters of a group as an expression of its row
    count ``n``, ``k`` the most that any group wants. Centres begin at different
    points (``seeds``), however often one repeats. Rounds end when no centre moves
    farther than ``tolerance`` in any group.
    """
    keys = list(keys)
    counts = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", wanted.cast("int")))
    parts = _folders(df, keys, counts.count(), 8 * k * len(points) + 64)

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def nearest(centres: DataFrame) -> list[DataFrame]:
        return [assigned(rows, F.broadcast(centres.where(own)), keys, points, k) for rows, own in parts]

    first = seeds(union([p for p, _ in parts]), keys, points, k, seed).join(counts, keys).where(F.col("_rn") <= F.col("_k"))
    centres = cut_lineage(first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "p"))).alias("c"))
                          .select(*keys, F.transform("c", lambda x: x["p"]).alias("centres")))

    def move(centres: DataFrame) -> DataFrame:
        sums = [F.avg(p).alias(p) for p in points]
        means = union([rows.groupBy(*keys, "cluster").agg(*sums) for rows in nearest(centres)])
        listed = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.array(*points).alias("p")))).alias("_m"))
        # a centre that lost all its rows stays where it was
        new = F.transform("centres", lambda c, j: F.coalesce(F.try_element_at("_m", j), c))
        return centres.join(listed, keys).withColumn("_new", new)

    moved = F.transform(F.arrays_zip(F.col("centres").alias("a"), F.col("_new").alias("b")), lambda z: F.aggregate(
        F.zip_with(z["a"], z["b"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x)))
    for _ in range(rounds):
        step = cut_lineage(move(centres).select(*keys, F.col("_new").alias("centres"), F.array_max(moved).alias("_moved")))
        (far,) = step.agg(F.max("_moved")).first()
        centres = step.drop("_moved")
        if far is None or far <= tolerance:
            break
    return union(nearest(centres)), centres
