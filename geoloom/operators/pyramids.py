"""Raster pyramids: overviews by level, so that a small-scale tile doesn't read the whole raster."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.rasters import KEY, tile_cells

BLOCK = 256  # pixels of a block's side; a level's rows are written block by block


def write_pyramid(px: DataFrame, path: str, levels: int, nearest: Sequence[str] = (), mean: Sequence[str] = ()) -> None:
    """Writes ``px`` (``raster_id r c`` and values, a pixel once) and its overviews as Parquet, a folder a level.

    A pixel of level k stands for 2^k by 2^k pixels of level 0. ``nearest``
    columns (classes) have the value of its upper left pixel, null if there is
    none; ``mean`` columns the mean of all its pixels that have a value, not a mean
    of means, for which sums and counts go from level to level. A level is made
    from the one below as it was written, four pixels combined in the task before
    the shuffle, so all levels together cost a third more than the raster; a lost
    executor costs tasks of one level.
    """
    spark = px.sparkSession
    base = px.select(KEY, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *nearest,
                     *[x for m in mean for x in (F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(f"{m}_sum"), F.col(m).isNotNull().cast("long").alias(f"{m}_n"))])
    for level in range(levels + 1):
        if level:
            low = spark.read.schema(base.schema).parquet(f"{path}/level={level - 1}")
            first = (F.col("r") % 2 == 0) & (F.col("c") % 2 == 0)
            keys = [KEY, F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")]
            level_px = low.groupBy(*keys).agg(*[F.max(F.when(first, F.col(v))).alias(v) for v in nearest],
                                              *[F.sum(f"{m}_{x}").alias(f"{m}_{x}") for m in mean for x in ("sum", "n")]).select(base.columns)
        else:
            level_px = base
        block = [F.floor(F.col(i) / BLOCK) for i in "rc"]
        level_px.sortWithinPartitions(KEY, *block).write.parquet(f"{path}/level={level}")


def read_pyramid(spark: SparkSession, path: str) -> DataFrame:
    """``level raster_id r c`` and the values of a written pyramid; a filter on ``level`` reads that folder only."""
    got = spark.read.parquet(path)
    means = [c[:-4] for c in got.columns if c.endswith("_sum") and f"{c[:-4]}_n" in got.columns]
    sums = {f"{m}_{x}" for m in means for x in ("sum", "n")}
    plain = [c for c in got.columns if c not in sums and c not in ("level", KEY, "r", "c")]
    return got.select("level", KEY, "r", "c", *plain, *[F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum") / F.col(f"{m}_n")).alias(m) for m in means])


def level_for(dx: Column, zoom: int, tile_px: int, levels: int) -> Column:
    """The coarsest level whose pixels (``dx`` degrees wide at level 0) are no wider than those of a tile."""
    tile_dx = 360.0 / 2 ** zoom / tile_px
    return F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(F.lit(tile_dx) / dx) + 1e-9))).cast("int")


def render_overviews(pyramid: DataFrame, geo: DataFrame, zoom: int, levels: int, tile_px: int = 256) -> DataFrame:
    """K17. XYZ tile pixels of every raster from the overview that suits the zoom; those outside have null values.

    ``geo`` as for ``render_tiles``. The levels in use are few and known from
    ``geo``, so only their folders are read, and of a level only the rasters that
    use it.
    """
    of = geo.withColumn("level", level_for(F.col("dx"), zoom, tile_px, levels))
    used = sorted(r.level for r in of.select("level").distinct().collect())  # at most one per level
    cells = tile_cells(of, zoom, tile_px, "level").withColumns({i: F.floor(F.col(i) / F.pow(F.lit(2.0), F.col("level"))).cast("long") for i in "rc"})
    wanted = pyramid.where(reduce(lambda a, b: a | b, [F.col("level") == v for v in used], F.lit(False)))
    return cells.join(wanted, [KEY, "level", "r", "c"], "left")
