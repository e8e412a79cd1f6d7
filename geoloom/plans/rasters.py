"""Raster queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geoloom.fixtures import Tables, values_sql
from geoloom.functions.color import class_rgba, colormap_rgba, rgb_rgba
from geoloom.operators import rasters as R
from geoloom.operators.pyramids import read_pyramid, render_overviews, write_pyramid
from geoloom.registry import query
from geoloom.sources.sinks import scratch_path

# The land-cover legend (code, name, colour).
LAND_COVER = [
    (10, "Tree cover", "#006400"), (20, "Shrubland", "#ffbb22"), (30, "Grassland", "#ffff4c"),
    (40, "Cropland", "#f096ff"), (50, "Built-up", "#fa0000"), (60, "Bare / sparse vegetation", "#b4b4b4"),
    (70, "Snow and ice", "#f0f0f0"), (80, "Permanent water bodies", "#0064c8"),
    (90, "Herbaceous wetland", "#0096a0"), (95, "Mangroves", "#00cf75"), (100, "Moss and lichen", "#fae6a0"),
]
LEGEND = [(0, "Forest", "#228b22"), (1, "Cropland", "#f0e68c"), (2, "Urban", "#808080"), (3, "Water", "#1e90ff")]
LAND_COVER_SQL = values_sql(LAND_COVER) + " AS lc(code, name, color)"
LEGEND_SQL = values_sql(LEGEND) + " AS lg(class_id, name, color)"


def land_cover_dim(t: Tables):
    return t.values("code, name, color", LAND_COVER)


def legend_dim(t: Tables):
    return t.values("class_id, name, color", LEGEND)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("A7", "raster_profile", """
SELECT raster_id, max(r) + 1 AS height, max(c) + 1 AS width, count(*) AS n_pixels,
       count(*) FILTER (WHERE class_id <> -1) AS n_valid,
       min(class_id) FILTER (WHERE class_id <> -1) AS min_value,
       max(class_id) FILTER (WHERE class_id <> -1) AS max_value,
       2 AS bands, 'class_id,scalar' AS band_names, 'int' AS dtype, CAST(-1 AS DOUBLE) AS nodata, CAST(10 + raster_id AS DOUBLE) AS west, CAST(45 AS DOUBLE) AS north,
       CAST(0.02 AS DOUBLE) AS res_x, CAST(0.02 AS DOUBLE) AS res_y, round(10 + raster_id + (max(c) + 1) * 0.02::DOUBLE, 6) AS east, round(45 - (max(r) + 1) * 0.02::DOUBLE, 6) AS south,
       raster_id % 2 = 0 AS is_cog, CASE raster_id % 2 WHEN 0 THEN 'cog' ELSE 'geotiff' END AS format
FROM fx_class GROUP BY raster_id""")
def raster_profile(t: Tables):
    """Every second raster has overviews."""
    path = scratch_path(t.spark, "overviews")
    write_pyramid(t.fx_class.where("raster_id % 2 = 0"), path, 1, nearest=["class_id"])
    got = R.raster_profile(t.fx_class, "class_id", -1, ["class_id", "scalar"], _tile_geo(t), read_pyramid(t.spark, path))
    return got.withColumns({"east": F.round("east", 6), "south": F.round("south", 6)})


@query("B5", "valid_pixels", """
SELECT scene_id, count(*) AS n, round(sum(b04), 4) AS sum_b04 FROM fx_px
WHERE NOT (b08 = 0) GROUP BY scene_id""")
def valid_pixels(t: Tables):
    return (R.valid_pixels(t.fx_px, ["b04", "b08"], nodata=0.0).groupBy("scene_id")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b04"), 4).alias("sum_b04")))


@query("B6", "reflectance_checks", """
SELECT scene_id, month, CAST(0 AS BIGINT) AS n_bad, round(min(least(b04, b08)), 6) AS vmin,
       round(max(greatest(b04, b08)), 6) AS vmax,
       CASE WHEN max(greatest(b04, b08)) > 9500 THEN 'outside_dn_range' ELSE 'ok' END AS status
FROM fx_px GROUP BY scene_id, month""")
def reflectance_checks(t: Tables):
    return R.reflectance_checks(t.fx_px, ["scene_id", "month"], ["b04", "b08"], high=9500.0).select(
        "scene_id", "month", "n_bad", *r6("vmin", "vmax"), "status")


@query("C4", "decode_classes", f"""
SELECT lg.class_id, lg.name, lg.color, count(*) AS n FROM fx_class JOIN {LEGEND_SQL} USING (class_id)
GROUP BY ALL""")
def decode_classes(t: Tables):
    counts = t.fx_class.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return R.decode_classes(counts, legend_dim(t), "class_id")


@query("C5", "with_legend", f"""
SELECT raster_id, r, c, class_id, coalesce(color, '#888888') AS color,
       coalesce(name, concat('class_', class_id)) AS name
FROM fx_class LEFT JOIN {LEGEND_SQL} USING (class_id)""")
def with_legend(t: Tables):
    return R.with_legend(t.fx_class.drop("scalar"), legend_dim(t), num_classes=len(LEGEND))


@query("D1", "land_cover", f"""
WITH px AS (SELECT raster_id AS aoi_id, CASE WHEN raster_id % 2 = 0 OR class_id <> 3 THEN 2021 ELSE 2020 END AS year,
                   CASE WHEN class_id = -1 THEN 0 WHEN class_id = 7 THEN 77 ELSE (class_id + 1) * 10 END AS code
            FROM fx_class),
totals AS (SELECT aoi_id, year, count(*) AS total FROM px WHERE code <> 0 GROUP BY ALL),
pick AS (SELECT * FROM totals x WHERE year = 2021 OR NOT EXISTS
           (SELECT 1 FROM px WHERE px.aoi_id = x.aoi_id AND px.year = 2021))
SELECT px.aoi_id, px.year, px.code, count(*) AS n, any_value(total) AS total, lc.name, lc.color,
       round(CAST(count(*) AS DOUBLE) / any_value(total) * 100, 1) AS percent
FROM px JOIN pick ON px.aoi_id = pick.aoi_id AND px.year = pick.year JOIN {LAND_COVER_SQL} ON lc.code = px.code
GROUP BY px.aoi_id, px.year, px.code, lc.name, lc.color""")
def land_cover(t: Tables):
    px = t.fx_class.select(
        F.col("raster_id").alias("aoi_id"),
        F.when((F.col("raster_id") % 2 == 0) | (F.col("class_id") != 3), 2021).otherwise(2020).alias("year"),
        F.when(F.col("class_id") == -1, 0).when(F.col("class_id") == 7, 77)
        .otherwise((F.col("class_id") + 1) * 10).alias("code"))
    return R.land_cover(px, land_cover_dim(t))


HISTOGRAM = """
WITH n AS (SELECT raster_id, class_id, count(*) AS n_pixels FROM fx_class
           WHERE class_id >= 0 AND class_id < 8 GROUP BY ALL)
SELECT raster_id, class_id, n_pixels,
       CAST(row_number() OVER (PARTITION BY raster_id ORDER BY n_pixels DESC, class_id) AS INT) AS rank,
       CAST(sum(n_pixels) OVER (PARTITION BY raster_id) AS BIGINT) AS total_pixels,
       count(*) OVER (PARTITION BY raster_id) AS n_present,
       round(CAST(n_pixels AS DOUBLE) / CAST(sum(n_pixels) OVER (PARTITION BY raster_id) AS DOUBLE) * 100, 2) AS percent
FROM n"""


@query("D2", "class_histogram", HISTOGRAM + " QUALIFY rank <= 3")
def class_histogram(t: Tables):
    return R.class_histogram(t.fx_class, 8, 3)


@query("G5", "rank_classes", HISTOGRAM)
def rank_classes(t: Tables):
    return R.class_histogram(t.fx_class, 8)


@query("D3", "scalar_stats", """
SELECT raster_id, count(*) AS valid_pixels, round(avg(scalar) * 3 + 2, 3) AS mean, round(min(scalar) * 3 + 2, 3) AS min,
       round(max(scalar) * 3 + 2, 3) AS max, round(quantile_cont(scalar, 0.1) * 3 + 2, 3) AS p10,
       round(quantile_cont(scalar, 0.5) * 3 + 2, 3) AS p50, round(quantile_cont(scalar, 0.9) * 3 + 2, 3) AS p90
FROM fx_class WHERE class_id <> -1 GROUP BY raster_id""")
def scalar_stats(t: Tables):
    px = t.fx_class.withColumn("scalar", F.when(F.col("class_id") != -1, F.col("scalar")))
    return R.scalar_stats(px, "scalar", (2.0, 5.0))


def _series_inputs(t: Tables, n_aoi):
    px = t.fx_px.withColumn("aoi_id", (F.col("scene_id") % n_aoi).cast("int"))
    scenes = px.groupBy("aoi_id", "month", "scene_id").agg(F.min("cloud_cover").alias("cloud_cover"))
    aois = t.supplier.select((F.col("s_suppkey") % n_aoi).cast("int").alias("aoi_id")).distinct()
    return px.drop("cloud_cover"), scenes, aois


def _series_sql(n_aoi: int | str, months: str) -> str:
    return f"""
px AS (SELECT *, CAST(scene_id % {n_aoi} AS INT) AS aoi_id FROM fx_px),
sc AS (SELECT aoi_id, month, scene_id, min(cloud_cover) AS cloud_cover FROM px GROUP BY ALL),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY aoi_id, month ORDER BY cloud_cover, scene_id) = 1),
spine AS (SELECT aoi_id, CAST(m AS DATE) AS month FROM (SELECT DISTINCT CAST(s_suppkey % {n_aoi} AS INT) AS aoi_id FROM supplier),
          (SELECT unnest(generate_series({months}, INTERVAL 1 MONTH)) AS m)),
base AS (SELECT * FROM spine LEFT JOIN best USING (aoi_id, month))"""


_SERIES_MONTHS = "DATE '1994-01-01', DATE '2001-12-01'"
_D4 = f"""WITH {_series_sql(10, _SERIES_MONTHS)},
st AS (SELECT aoi_id, month, avg(v) AS ndvi_mean, quantile_cont(v, 0.5) AS ndvi_median, quantile_cont(v, 0.1) AS ndvi_p10,
              quantile_cont(v, 0.9) AS ndvi_p90, count(*) AS n_pixels
       FROM (SELECT px.aoi_id, px.month, (b08 - b04) / (b08 + b04) AS v FROM px JOIN base USING (aoi_id, month, scene_id)
             WHERE base.cloud_cover <= 10 AND b04 > 0 AND b08 > 0) GROUP BY ALL),
ts AS (SELECT aoi_id, month, scene_id, cloud_cover, round(ndvi_mean, 6) AS ndvi_mean, round(ndvi_median, 6) AS ndvi_median,
       round(ndvi_p10, 6) AS ndvi_p10, round(ndvi_p90, 6) AS ndvi_p90, coalesce(n_pixels, 0) AS n_pixels,
       CASE WHEN scene_id IS NULL THEN 'no_scene' WHEN cloud_cover > 10 THEN 'too_cloudy'
            WHEN n_pixels IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM base LEFT JOIN st USING (aoi_id, month))
"""


def _timeseries(t: Tables):
    px, scenes, aois = _series_inputs(t, 10)
    return R.ndvi_timeseries(px, scenes, aois, F.lit("2002-01-01").cast("date"), 96, 10.0)


@query("D4", "ndvi_timeseries", _D4 + "SELECT * FROM ts")
def ndvi_timeseries(t: Tables):
    return _timeseries(t).select("aoi_id", "month", "scene_id", "cloud_cover", "n_pixels", "status",
                                 *r6("ndvi_mean", "ndvi_median", "ndvi_p10", "ndvi_p90"))


@query("D5", "ndvi_masked", f"""WITH {_series_sql("(SELECT max(raster_id) + 1 FROM fx_class)", _SERIES_MONTHS)},
dims AS (SELECT raster_id AS aoi_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_class GROUP BY 1),
seen AS (SELECT px.aoi_id, px.month, b04, b08, k.class_id IN (0, 2) AS hit
         FROM px JOIN base USING (aoi_id, month, scene_id) LEFT JOIN dims d ON d.aoi_id = px.aoi_id
         LEFT JOIN fx_class k ON k.raster_id = px.aoi_id AND k.r = least(CAST(floor(px.r * d.h / 64) AS INT), d.h - 1)
           AND k.c = least(CAST(floor(px.c * d.w / 64) AS INT), d.w - 1)
         WHERE base.cloud_cover <= 3),
st AS (SELECT aoi_id, month, avg(v) AS ndvi_mean, quantile_cont(v, 0.5) AS ndvi_median, quantile_cont(v, 0.1) AS ndvi_p10,
              quantile_cont(v, 0.9) AS ndvi_p90, count(*) AS n_pixels
       FROM (SELECT aoi_id, month, (b08 - b04) / (b08 + b04) AS v FROM seen WHERE hit AND b04 > 0 AND b08 > 0) GROUP BY ALL),
tot AS (SELECT aoi_id, month, count(*) AS total_pixels FROM seen GROUP BY ALL)
SELECT aoi_id, month, scene_id, cloud_cover, round(ndvi_mean, 6) AS ndvi_mean, round(ndvi_median, 6) AS ndvi_median,
       round(ndvi_p10, 6) AS ndvi_p10, round(ndvi_p90, 6) AS ndvi_p90, coalesce(n_pixels, 0) AS n_pixels,
       coalesce(total_pixels, 0) AS total_pixels,
       CASE WHEN scene_id IS NULL THEN 'no_scene' WHEN cloud_cover > 3 THEN 'too_cloudy'
            WHEN n_pixels IS NULL THEN 'no_class_pixels' ELSE 'ok' END AS status
FROM base LEFT JOIN st USING (aoi_id, month) LEFT JOIN tot USING (aoi_id, month)""")
def ndvi_masked(t: Tables):
    """Every class raster is the mask of an area of its own."""
    px, scenes, aois = _series_inputs(t, t.fx_class.agg((F.max("raster_id") + 1).alias("k")).scalar())
    return R.ndvi_masked(px, t.fx_class, scenes, aois, F.lit("2002-01-01").cast("date"), [0, 2], (64, 64),
                         96, 3.0).select(
        "aoi_id", "month", "scene_id", "cloud_cover", "n_pixels", "total_pixels", "status",
        *r6("ndvi_mean", "ndvi_median", "ndvi_p10", "ndvi_p90"))


@query("D6", "timeseries_summary", _D4 + """
SELECT aoi_id, count(*) AS months_requested, count(*) FILTER (WHERE status = 'ok') AS months_with_data,
       count(*) FILTER (WHERE status = 'too_cloudy') AS months_too_cloudy,
       count(*) FILTER (WHERE status = 'no_scene') AS months_no_scene,
       CASE WHEN count(*) FILTER (WHERE status = 'ok') > 0 THEN 'ok' ELSE 'empty' END AS status
FROM ts GROUP BY aoi_id""")
def timeseries_summary(t: Tables):
    return R.timeseries_summary(_timeseries(t))


@query("F14", "ndvi", """
SELECT month, count(*) AS n, count(v) AS n_valid, round(sum(v), 4) AS total
FROM (SELECT month, CASE WHEN b08 + b04 > 0 THEN (b08 - b04) / (b08 + b04) END AS v FROM fx_px) GROUP BY month""")
def ndvi(t: Tables):
    px = t.fx_px.withColumn("v", R.ndvi(F.col("b04"), F.col("b08")))
    return px.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"),
                                   F.round(F.sum("v"), 4).alias("total"))


@query("C6", "mask_by_class", """
WITH dims AS (SELECT raster_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_class GROUP BY 1), nr AS (SELECT max(raster_id) + 1 AS k FROM dims)
SELECT p.scene_id, count(*) AS n, count(*) FILTER (WHERE k.class_id IN (0, 2)) AS n_kept
FROM fx_px p JOIN nr ON true LEFT JOIN dims d ON d.raster_id = p.scene_id % nr.k
LEFT JOIN fx_class k ON k.raster_id = d.raster_id AND k.r = least(CAST(floor(p.r * d.h / 64) AS INT), d.h - 1)
  AND k.c = least(CAST(floor(p.c * d.w / 64) AS INT), d.w - 1)
GROUP BY p.scene_id""")
def mask_by_class(t: Tables):
    rasters = t.fx_class.agg((F.max("raster_id") + 1).alias("k")).scalar()
    px = t.fx_px.withColumn("raster_id", (F.col("scene_id") % rasters).cast("int"))
    got = R.mask_by_class(px, t.fx_class, [0, 2], 64, 64)
    return got.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_class").alias("n_kept"))


@query("E6", "resample_nearest", """
WITH d AS (SELECT raster_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_class GROUP BY 1),
g AS (SELECT raster_id, h, w, CAST(i AS INT) AS r, CAST(j AS INT) AS c FROM d, range(37) a(i), range(81) b(j))
SELECT g.raster_id, g.r, g.c, k.class_id, k.scalar FROM g JOIN fx_class k ON k.raster_id = g.raster_id
  AND k.r = CAST(floor(g.r * h / 37) AS INT) AND k.c = CAST(floor(g.c * w / 81) AS INT)""")
def resample_nearest(t: Tables):
    return R.resample_nearest(t.fx_class, 37, 81)


@query("E7", "upsample", """
SELECT raster_id, CAST(r * 4 + i AS INT) AS r, CAST(c * 4 + j AS INT) AS c, class_id
FROM fx_class, range(4) a(i), range(4) b(j)""")
def upsample(t: Tables):
    return R.upsample(t.fx_class.drop("scalar"), 4)


_WINDOWS = """
dims AS (SELECT scene_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_px GROUP BY 1),
win AS (SELECT p.scene_id, CAST(floor(r / 24.0) AS INT) AS wr, CAST(floor(c / 24.0) AS INT) AS wc, count(*) AS n_pixels,
               max(b08) = 0 AS skipped
        FROM fx_px p JOIN dims d USING (scene_id)
        GROUP BY p.scene_id, 2, 3, h, w HAVING (wr + 1) * 24 <= h AND (wc + 1) * 24 <= w)"""


@query("E10", "window_grid", f"WITH {_WINDOWS} SELECT * FROM win")
def window_grid(t: Tables):
    return R.window_grid(t.fx_px, ["scene_id"], ["b08"], 24)


@query("E10", "window_status", f"""WITH {_WINDOWS}
SELECT scene_id, count(*) AS n_windows, count(*) FILTER (WHERE skipped) AS n_skipped,
       CASE WHEN count(*) = count(*) FILTER (WHERE skipped) THEN 'all_windows_empty' ELSE 'ok' END AS status
FROM win GROUP BY scene_id""")
def window_status(t: Tables):
    return R.window_status(R.window_grid(t.fx_px, ["scene_id"], ["b08"], 24), ["scene_id"])


# The weights of the sample linear scorer, one row per class.
HEAD = ((0.4, -0.1, 3.0), (-0.2, 0.2, -1.0), (0.1, 0.05, 0.5))


@query("K19", "score_windows", """
WITH cell AS (SELECT scene_id, r, c, avg(b04) AS b04, avg(b08) AS b08 FROM fx_px GROUP BY ALL),
w AS (SELECT scene_id, CAST(floor(r / 16.0) AS INT) AS wr, CAST(floor(c / 16.0) AS INT) AS wc,
             avg(b04) / 1000 AS x4, avg(b08) / 1000 AS x8 FROM cell GROUP BY ALL),
s AS (SELECT scene_id, wr, wc, i AS class_id, CASE i WHEN 0 THEN 0.4::DOUBLE * x4 - 0.1::DOUBLE * x8 + 3
        WHEN 1 THEN -0.2::DOUBLE * x4 + 0.2::DOUBLE * x8 - 1 ELSE 0.1::DOUBLE * x4 + 0.05::DOUBLE * x8 + 0.5 END AS score
      FROM w, (VALUES (0), (1), (2)) v(i))
SELECT scene_id, wr, wc, class_id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY scene_id, wr, wc ORDER BY score DESC, class_id) = 1""")
def score_windows(t: Tables):
    cell = t.fx_px.groupBy("scene_id", "r", "c").agg(F.avg("b04").alias("b04"), F.avg("b08").alias("b08"))
    got = R.score_windows_linear(cell, ["scene_id"], 16, ["b04", "b08"], [(a / 1000, b / 1000) for a, b, _ in HEAD], [k for _, _, k in HEAD])
    return got.withColumn("score", F.round("score", 6))


class GreenestPixel:
    """A model a caller brings; each worker makes it once and calls it per batch of windows."""

    def __init__(self, floor: float) -> None:
        self.floor = floor

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        index = ((pdf["b08"] - pdf["b04"]) / (pdf["b08"] + pdf["b04"])).clip(lower=self.floor)
        best = index.groupby([pdf["scene_id"], pdf["wr"], pdf["wc"]], sort=False).max()
        return best.rename("score").reset_index()


@query("U3", "user_model", """
WITH cell AS (SELECT scene_id, r, c, avg(b04) AS b04, avg(b08) AS b08 FROM fx_px GROUP BY ALL)
SELECT scene_id, CAST(floor(r / 16.0) AS INT) AS wr, CAST(floor(c / 16.0) AS INT) AS wc,
       round(max(greatest(-0.5::DOUBLE, (b08 - b04) / (b08 + b04))), 6) AS score FROM cell GROUP BY ALL""")
def user_model(t: Tables):
    cell = t.fx_px.groupBy("scene_id", "r", "c").agg(F.avg("b04").alias("b04"), F.avg("b08").alias("b08"))
    got = R.score_windows(cell, ["scene_id"], 16, "greenest", "scene_id bigint, wr int, wc int, score double", load=lambda: GreenestPixel(-0.5))
    return got.withColumn("score", F.round("score", 6))


@query("D16", "present_classes", """
SELECT raster_id, string_agg(class_id, ',' ORDER BY class_id) AS class_ids
FROM (SELECT DISTINCT raster_id, class_id FROM fx_class WHERE class_id >= 0) GROUP BY raster_id""")
def present_classes(t: Tables):
    return R.present_classes(t.fx_class).withColumn("class_ids", F.array_join("class_ids", ","))


@query("D28", "class_rows", f"""
SELECT lg.class_id, lg.name, lg.color, s.score, s.score IS NOT NULL AS present
FROM {values_sql([*LEGEND, (55, "Glacier", "#ffffff")])} AS lg(class_id, name, color) LEFT JOIN (SELECT class_id, round(avg(scalar), 6) AS score FROM fx_class
  GROUP BY 1) s USING (class_id)""")
def class_rows(t: Tables):
    """All pixels are read; the legend has one class more than the rasters."""
    scores = t.fx_class.groupBy("class_id").agg(F.round(F.avg("scalar"), 6).alias("score"))
    return R.class_rows(t.values("class_id, name, color", [*LEGEND, (55, "Glacier", "#ffffff")]), scores)


@query("D22", "band_stretch_bounds", """
SELECT scene_id, band, round(quantile_cont(v, 0.02), 6) AS lo,
       round(CASE WHEN quantile_cont(v, 0.98) - quantile_cont(v, 0.02) < 1e-9 THEN quantile_cont(v, 0.02) + 1
             ELSE quantile_cont(v, 0.98) END, 6) AS hi
FROM (SELECT scene_id, 'b04' AS band, b04 AS v FROM fx_px UNION ALL SELECT scene_id, 'b08', b08 FROM fx_px)
WHERE v <> 0 GROUP BY scene_id, band""")
def band_stretch_bounds(t: Tables):
    return R.band_stretch_bounds(t.fx_px, ["scene_id"], ["b04", "b08"]).select("scene_id", "band", *r6("lo", "hi"))


@query("D23", "regression_mean", """
SELECT raster_id, round(avg(scalar), 6) AS prediction,
       round(avg(least(1, greatest(0, (scalar - 1000) / 800))), 6) AS unit_mean FROM fx_class GROUP BY raster_id""")
def regression_mean(t: Tables):
    return R.regression_mean(t.fx_class, "scalar", 1000.0, 1800.0).select("raster_id", *r6("prediction", "unit_mean"))


@query("A22", "raster_patch", """
WITH b AS (SELECT raster_id, -5 AS r0, max(c) - 20 AS c0, CAST(floor((max(r) + 1) / 2.0) AS INT) AS r1, max(c) + 11 AS c1
           FROM fx_class GROUP BY 1),
g AS (SELECT raster_id, CAST(i AS INT) AS pr, CAST(j AS INT) AS pc, CAST(r0 + floor((i + 0.5) * (r1 - r0) / 24) AS INT) AS r,
             CAST(c0 + floor((j + 0.5) * (c1 - c0) / 24) AS INT) AS c FROM b, range(24) x(i), range(24) y(j)),
v AS (SELECT g.raster_id, pr, pc, coalesce(scalar, 0) AS v FROM g LEFT JOIN fx_class USING (raster_id, r, c)),
q AS (SELECT raster_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY 1)
SELECT raster_id, pr, pc, CAST(floor(CASE WHEN hi > lo THEN least(255, greatest(0, (v - lo) * 255 / (hi - lo))) ELSE v END) AS INT) AS level
FROM v JOIN q USING (raster_id)""")
def raster_patch(t: Tables):
    boxes = t.fx_class.groupBy("raster_id").agg(
        F.lit(-5).alias("r0"), (F.max("c") - 20).alias("c0"),
        F.floor((F.max("r") + 1) / 2).cast("int").alias("r1"), (F.max("c") + 11).alias("c1"))
    return R.raster_patch(t.fx_class, boxes, "scalar", 24)


@query("G6", "smooth_raster", """
WITH d AS (SELECT raster_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_class GROUP BY 1),
p AS (SELECT raster_id, r, c, h, w, class_id, CASE WHEN class_id = -1 THEN 0 ELSE scalar END AS v FROM fx_class JOIN d USING (raster_id)),
k0 AS (SELECT CAST(i AS INT) AS k, exp(-0.5 * (i / 1.5) * (i / 1.5)) AS g FROM range(-6, 7) t(i)),
k AS (SELECT k, g / (SELECT sum(g) FROM k0) AS g FROM k0),
hz AS (SELECT a.raster_id, a.r, a.c, a.h, a.class_id, sum(g * b.v) AS v FROM p a CROSS JOIN k JOIN p b ON b.raster_id = a.raster_id AND b.r = a.r
       AND b.c = CASE WHEN ((a.c + k) % (2 * a.w) + 2 * a.w) % (2 * a.w) < a.w THEN ((a.c + k) % (2 * a.w) + 2 * a.w) % (2 * a.w) ELSE 2 * a.w - 1 - ((a.c + k) % (2 * a.w) + 2 * a.w) % (2 * a.w) END GROUP BY ALL)
SELECT a.raster_id, a.r, a.c, CASE WHEN a.class_id = -1 THEN NULL ELSE round(sum(g * b.v), 6) END AS scalar
FROM hz a CROSS JOIN k JOIN hz b ON b.raster_id = a.raster_id AND b.c = a.c
 AND b.r = CASE WHEN ((a.r + k) % (2 * a.h) + 2 * a.h) % (2 * a.h) < a.h THEN ((a.r + k) % (2 * a.h) + 2 * a.h) % (2 * a.h) ELSE 2 * a.h - 1 - ((a.r + k) % (2 * a.h) + 2 * a.h) % (2 * a.h) END
GROUP BY a.raster_id, a.r, a.c, a.class_id""")
def smooth_raster(t: Tables):
    px = t.fx_class.withColumn("scalar", F.when(F.col("class_id") != -1, F.col("scalar")))
    return R.smooth_raster(px, ["scalar"], 1.5, block=16).select("raster_id", "r", "c", *r6("scalar"))


_CHUNKS = """ch AS (SELECT raster_id, CAST(floor(r / 8.0) * 10 + floor(c / 16.0) AS INT) AS chunk_id,
       CAST(1000 - 10 * (floor(r / 8.0) * 8) AS DOUBLE) AS top, CAST(500 + 10 * (floor(c / 16.0) * 16) AS DOUBLE) AS "left",
       r % 8 AS r, c % 16 AS c, class_id AS value FROM fx_class
     UNION ALL SELECT raster_id, CAST(floor(r / 8.0) * 10 + floor(c / 16.0) AS INT) + 1000,
       CAST(1000 - 10 * (floor(r / 8.0) * 8) - 30 AS DOUBLE), CAST(500 + 10 * (floor(c / 16.0) * 16) + 20 AS DOUBLE),
       r % 8, c % 16, class_id + 100 FROM fx_class WHERE class_id = 3)"""


@query("I1", "stitch", f"""WITH {_CHUNKS},
d AS (SELECT raster_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_class GROUP BY 1),
m AS (SELECT raster_id, CAST(r + round((1000 - top) / 10) AS INT) AS r, CAST(c + round(("left" - 500) / 10) AS INT) AS c, value, chunk_id, h, w
      FROM ch JOIN d USING (raster_id))
SELECT raster_id, r, c, arg_max(value, chunk_id) AS value, max(chunk_id) AS chunk_id FROM m
WHERE r < h AND c < w AND r >= 0 AND c >= 0 GROUP BY ALL""")
def stitch(t: Tables):
    px = t.fx_class
    br, bc = F.floor(F.col("r") / 8), F.floor(F.col("c") / 16)
    first = px.select("raster_id", (br * 10 + bc).cast("int").alias("chunk_id"),
                      (1000 - 10.0 * br * 8).alias("top"), (500 + 10.0 * bc * 16).alias("left"),
                      (F.col("r") % 8).alias("r"), (F.col("c") % 16).alias("c"), F.col("class_id").alias("value"))
    second = (first.where(F.col("value") == 3).withColumn("chunk_id", F.col("chunk_id") + 1000)
              .withColumn("top", F.col("top") - 30).withColumn("left", F.col("left") + 20)
              .withColumn("value", F.col("value") + 100))
    grid = R.raster_size(px).withColumn("top", F.lit(1000.0)).withColumn("left", F.lit(500.0))
    return R.stitch(first.unionByName(second), grid, 10.0)


PALETTE = [c for _, _, c in LEGEND]


@query("K17", "render_tiles", """
WITH g AS (SELECT raster_id, 10 + CAST(raster_id AS DOUBLE) AS west, CAST(45 AS DOUBLE) AS north, max(r) + 1 AS h, max(c) + 1 AS w
           FROM fx_class GROUP BY 1),
t AS (SELECT raster_id, west, north, h, w,
        CAST(floor((west + 180) / 360 * 1024) AS INT) AS x0, CAST(floor((west + 0.02::DOUBLE * w + 180) / 360 * 1024) AS INT) AS x1,
        CAST(floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * 1024) AS INT) AS y0,
        CAST(floor((1 - ln(tan(radians(north - 0.02::DOUBLE * h)) + 1 / cos(radians(north - 0.02::DOUBLE * h))) / pi()) / 2 * 1024) AS INT) AS y1 FROM g),
p AS (SELECT t.*, xx AS x, yy AS y, CAST(i AS INT) AS py, CAST(j AS INT) AS px,
        (xx + (j + 0.5) / 16) / 1024 * 360 - 180 AS lon,
        degrees(atan(sinh(pi() * (1 - 2 * (yy + (i + 0.5) / 16) / 1024)))) AS lat
      FROM (SELECT *, CAST(unnest(range(x0, x1 + 1)) AS INT) AS xx FROM t) t, LATERAL (SELECT CAST(unnest(range(y0, y1 + 1)) AS INT) AS yy), range(16) a(i), range(16) b(j)),
s AS (SELECT raster_id, x, y, py, px, h, w, CAST(round_even((north - 0.01::DOUBLE - lat) / 0.02::DOUBLE, 0) AS INT) AS r,
        CAST(round_even((lon - west - 0.01::DOUBLE) / 0.02::DOUBLE, 0) AS INT) AS c FROM p),
u AS (SELECT s.*, r < h AND c < w AND r >= 0 AND c >= 0 AS inside FROM s),
v AS (SELECT u.raster_id, x, y, py, px, NOT inside AS outside, class_id, scalar, CASE WHEN scalar IS NOT NULL THEN least(1, greatest(0, (scalar - 1000) / 800)) END AS q FROM u LEFT JOIN fx_class f ON inside AND f.raster_id = u.raster_id AND f.r = u.r AND f.c = u.c),
gr AS (SELECT v.*, CASE WHEN q <= 0.5 THEN floor(15 + q / 0.5::DOUBLE * 84) ELSE floor(99 + (q - 0.5) / 0.5::DOUBLE * 146) END AS g_red,
  CASE WHEN q <= 0.5 THEN floor(23 + q / 0.5::DOUBLE * 79) ELSE floor(102 + (q - 0.5) / 0.5::DOUBLE * 56) END AS g_green,
  CASE WHEN q <= 0.5 THEN floor(42 + q / 0.5::DOUBLE * 199) ELSE floor(241 + (q - 0.5) / 0.5::DOUBLE * -230) END AS g_blue FROM v)
SELECT raster_id, x, y, py, px, outside, class_id,
  CASE WHEN class_id IS NULL OR class_id < 0 THEN 0 WHEN class_id = 0 THEN 34 WHEN class_id = 1 THEN 240 WHEN class_id = 2 THEN 128 ELSE 30 END AS red,
  CASE WHEN class_id IS NULL OR class_id < 0 THEN 0 WHEN class_id = 0 THEN 139 WHEN class_id = 1 THEN 230 WHEN class_id = 2 THEN 128 ELSE 144 END AS green,
  CASE WHEN class_id IS NULL OR class_id < 0 THEN 0 WHEN class_id = 0 THEN 34 WHEN class_id = 1 THEN 140 WHEN class_id = 2 THEN 128 ELSE 255 END AS blue,
  CASE WHEN class_id IS NULL OR class_id < 0 THEN 0 ELSE 210 END AS alpha,
  CAST(coalesce(g_red, 0) AS INT) AS g_red, CAST(coalesce(g_green, 0) AS INT) AS g_green, CAST(coalesce(g_blue, 0) AS INT) AS g_blue, CASE WHEN scalar IS NULL THEN 0 ELSE 210 END AS g_alpha,
  CASE WHEN outside OR class_id IS NULL THEN 0 ELSE (class_id + 5) % 7 END AS c_red, CASE WHEN outside OR class_id IS NULL THEN 0 ELSE 200 END AS c_green,
  CASE WHEN outside OR class_id IS NULL THEN 0 ELSE CAST(floor(scalar / 10) AS INT) END AS c_blue, CASE WHEN outside OR class_id IS NULL THEN 0 ELSE 230 END AS c_alpha
FROM gr""")
def render_tiles(t: Tables):
    """Every tile pixel as a class, as a gradient of the scalar, and as three channels."""
    got = R.render_tiles(t.fx_class, _tile_geo(t), 10, 16)
    kinds = {"": class_rgba(F.col("class_id"), PALETTE), "g_": colormap_rgba(F.lit("embedding"), (F.col("scalar") - 1000) / 800),
             "c_": rgb_rgba((F.col("class_id") + 5) % 7, F.when(F.col("class_id").isNotNull(), 200), F.floor(F.col("scalar") / 10))}
    return got.select("raster_id", "x", "y", "py", "px", "outside", "class_id", *[
        rgba[n].alias(f"{k}{n}") for k, rgba in kinds.items() for n in ("red", "green", "blue", "alpha")])


def _tile_geo(t: Tables):
    """Pixels of 0.02 degrees, the rasters a degree apart."""
    return (R.raster_size(t.fx_class).withColumn("west", 10 + F.col("raster_id").cast("double"))
            .withColumn("north", F.lit(45.0)).withColumn("dx", F.lit(0.02)).withColumn("dy", F.lit(0.02)))


LEVELS = 3


def _pyramid(t: Tables):
    path = scratch_path(t.spark, "pyramid")
    write_pyramid(t.fx_class, path, LEVELS, nearest=["class_id"], mean=["scalar"])
    return read_pyramid(t.spark, path)


@query("K17", "raster_pyramid", """
SELECT CAST(k AS INT) AS level, raster_id, CAST(r // (1 << k) AS BIGINT) AS r, CAST(c // (1 << k) AS BIGINT) AS c,
  max(CASE WHEN r % (1 << k) = 0 AND c % (1 << k) = 0 THEN class_id END) AS class_id, round(avg(scalar), 6) AS scalar
FROM fx_class, range(4) v(k) GROUP BY 1, 2, 3, 4""")
def raster_pyramid(t: Tables):
    return _pyramid(t).withColumn("scalar", F.round("scalar", 6))


@query("K17", "overview_tiles", """
WITH g AS (SELECT raster_id, 10 + CAST(raster_id AS DOUBLE) AS west, CAST(45 AS DOUBLE) AS north, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_class GROUP BY 1),
t AS (SELECT raster_id, west, north, h, w,
        CAST(floor((west + 180) / 360 * 256) AS INT) AS x0, CAST(floor((west + 0.02::DOUBLE * w + 180) / 360 * 256) AS INT) AS x1,
        CAST(floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * 256) AS INT) AS y0,
        CAST(floor((1 - ln(tan(radians(north - 0.02::DOUBLE * h)) + 1 / cos(radians(north - 0.02::DOUBLE * h))) / pi()) / 2 * 256) AS INT) AS y1 FROM g),
p AS (SELECT t.*, xx AS x, yy AS y, CAST(i AS INT) AS py, CAST(j AS INT) AS px, (xx + (j + 0.5) / 16) / 256 * 360 - 180 AS lon,
        degrees(atan(sinh(pi() * (1 - 2 * (yy + (i + 0.5) / 16) / 256)))) AS lat
      FROM (SELECT *, CAST(unnest(range(x0, x1 + 1)) AS INT) AS xx FROM t) t, LATERAL (SELECT CAST(unnest(range(y0, y1 + 1)) AS INT) AS yy), range(16) a(i), range(16) b(j)),
s AS (SELECT raster_id, x, y, py, px, h, w, CAST(round_even((north - 0.01::DOUBLE - lat) / 0.02::DOUBLE, 0) AS INT) AS r,
        CAST(round_even((lon - west - 0.01::DOUBLE) / 0.02::DOUBLE, 0) AS INT) AS c FROM p),
u AS (SELECT *, r < h AND c < w AND r >= 0 AND c >= 0 AS inside FROM s),
o AS (SELECT raster_id, r // 4 AS r4, c // 4 AS c4, max(CASE WHEN r % 4 = 0 AND c % 4 = 0 THEN class_id END) AS class_id, avg(scalar) AS scalar FROM fx_class GROUP BY 1, 2, 3)
SELECT u.raster_id, x, y, py, px, CAST(2 AS INT) AS level, NOT inside AS outside, class_id, round(scalar, 6) AS scalar
FROM u LEFT JOIN o ON inside AND o.raster_id = u.raster_id AND r4 = r // 4 AND c4 = c // 4""")
def overview_tiles(t: Tables):
    """At zoom 8 a tile's pixel is 0.088 degrees, four and a half of the raster's: level 2."""
    got = render_overviews(_pyramid(t), _tile_geo(t), 8, LEVELS, 16)
    return got.select("raster_id", "x", "y", "py", "px", "level", "outside", "class_id", F.round("scalar", 6).alias("scalar"))
