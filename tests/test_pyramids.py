"""Overviews: exact means, nearest classes, and tiles that read one level."""

import re

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators.pyramids import read_pyramid, render_overviews, write_pyramid


def test_levels(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, (37, 50)).astype(float)
    v[rng.random(v.shape) < 0.3] = np.nan
    rows = [(7, r, c, int(r * c % 5) if (r + c) % 3 else None, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(37) for c in range(50) if (r, c) != (8, 8)]
    write_pyramid(spark.createDataFrame(rows, "raster_id int, r int, c int, kind int, v double"), f"{tmp_path}/p", 4, ["kind"], ["v"])
    kinds = {(r, c): k for _, r, c, k, _ in rows}
    for p in read_pyramid(spark, f"{tmp_path}/p").collect():
        s = 1 << p.level
        own = [x for _, r, c, _, x in rows if r // s == p.r and c // s == p.c and x is not None]
        assert p.kind == kinds.get((p.r * s, p.c * s)) and (p.v is None if not own else abs(p.v - np.mean(own)) < 1e-9)


def test_far_tiles_read_one_small_level(spark, tmp_path):
    px = spark.range(512 * 512).selectExpr("1 AS raster_id", "CAST(id DIV 512 AS INT) AS r", "CAST(id % 512 AS INT) AS c", "CAST(id % 7 AS INT) AS kind")
    write_pyramid(px, f"{tmp_path}/p", 5, ["kind"])
    pyramid = read_pyramid(spark, f"{tmp_path}/p")
    assert {r.level: r["count"] for r in pyramid.groupBy("level").count().collect()} == {k: (512 >> k) ** 2 for k in range(6)}
    geo = spark.createDataFrame([(1, 0.0, 60.0, 0.01, 0.01, 512, 512)], "raster_id int, west double, north double, dx double, dy double, height int, width int")
    tiles = render_overviews(pyramid, geo, 4, 5)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*level#\d+ = 3\)", plan)
    near = tiles.where(~F.col("outside")).select("level", "r", "c", "kind").collect()
    assert near and all(t.level == 3 and t.kind == (t.r * 8 * 512 + t.c * 8) % 7 for t in near)
