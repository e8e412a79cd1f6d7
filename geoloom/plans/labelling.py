"""Labelling, metric and monitoring queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.fixtures import Tables, values_sql
from geoloom.operators import labels as L
from geoloom.operators import metrics as Q
from geoloom.operators import monitoring as N
from geoloom.operators import vectorize as V
from geoloom.operators.polygons import neighbors_within
from geoloom.plans.polygons import _CELLS, _dem
from geoloom.plans.rasters import r6
from geoloom.plans.scenes import _WEATHER, environment
from geoloom.registry import query


def features(t: Tables):
    """Point features with an area and a review flag."""
    return t.fx_point.withColumn("area_m2", F.round(F.col("confidence") * 1000, 3)).withColumn(
        "needs_review", L.needs_review(F.col("confidence")))


_FT = "ft AS (SELECT *, round(confidence * 1000, 3) AS area_m2, confidence < 0.6::DOUBLE AS needs_review FROM fx_point)"


@query("B4", "needs_review", f"""WITH {_FT} SELECT pid, needs_review, confidence < 0.3::DOUBLE AS review_zero_shot,
  confidence < 0.6::DOUBLE OR needs_review AS target FROM ft""")
def needs_review(t: Tables):
    return L.review_targets(features(t)).select(
        "pid", "needs_review", L.needs_review(F.col("confidence"), 0.3).alias("review_zero_shot"), "target")


@query("B13", "confidence_filter", f"WITH {_FT} SELECT count(*) AS n_features, count(*) FILTER (WHERE needs_review) AS n_review FROM ft WHERE coalesce(confidence, 0) >= 0.45::DOUBLE")
def confidence_filter(t: Tables):
    return L.filter_totals(L.confidence_filter(features(t), 0.45))


@query("D9", "cluster_stats", """SELECT scene_id AS cluster, count(*) AS n, round(avg(b04), 6) AS b04_mean, round(stddev_pop(b04), 6) AS b04_std,
  round(avg(b08), 6) AS b08_mean, round(stddev_pop(b08), 6) AS b08_std FROM fx_px GROUP BY 1""")
def cluster_stats(t: Tables):
    return L.cluster_stats(t.fx_px.withColumnRenamed("scene_id", "cluster"), ["cluster"], ["b04", "b08"]).select(
        "cluster", "n", *r6("b04_mean", "b04_std", "b08_mean", "b08_std"))


_LAND = values_sql([(1, "Forest", "#228b22"), (2, "Cropland", "#f0e68c"), (3, "Grassland", "#90ee90"), (4, "Urban", "#808080"),
                    (5, "Water", "#1e90ff"), (6, "Barren", "#d2b48c"), (7, "Wetland", "#5f9ea0"), (8, "Snow/Ice", "#e0f0ff")]) + " AS ld(class_id, class_name, color)"


@query("F16", "spectral_class", f"""
WITH a AS (SELECT CAST(scene_id % 7 AS INT) AS raster_id, scene_id, CAST(month(month) AS INT) AS mo, avg(b04) AS b04, avg(cloud_cover) AS cc, avg(b08) AS b08
   FROM fx_px GROUP BY ALL),
m AS (SELECT raster_id, scene_id, mo, b04 * 0.9::DOUBLE AS blue, b04 + cc * 30 AS green, b04 AS red, b08 * (0.2::DOUBLE + mo / 10.0::DOUBLE) AS nir FROM a),
p AS (SELECT raster_id, quantile_cont((blue + green + red + nir) / 4, 0.75) AS p75 FROM m GROUP BY 1),
x AS (SELECT raster_id, scene_id, mo, 4 AS bands, CASE WHEN (nir - red) / (nir + red + 1e-8) > 0.5 THEN 'Forest' WHEN (nir - red) / (nir + red + 1e-8) > 0.3 THEN 'Cropland'
  WHEN (nir - red) / (nir + red + 1e-8) > 0.15 THEN 'Grassland' WHEN nir < green * 0.8 THEN 'Water'
  WHEN (blue + green + red + nir) / 4 > p75 THEN 'Urban' ELSE 'Barren' END AS class_name FROM m JOIN p USING (raster_id)
UNION ALL SELECT raster_id, scene_id, mo, 3, CASE WHEN g > r AND g > b AND (r + g + b) / 3 > 50 THEN 'Forest' WHEN (r + g + b) / 3 < 30 THEN 'Water'
  WHEN r > 150 AND g > 150 AND b > 150 THEN 'Urban' WHEN r > g THEN 'Barren' ELSE 'Grassland' END
  FROM (SELECT *, blue / 15 - 60 AS r, green / 20 - mo * 15 AS g, red / 25 - 20 AS b FROM m)
UNION ALL SELECT raster_id, scene_id, mo, 2, list_extract(['Forest', 'Cropland', 'Grassland', 'Urban', 'Water', 'Barren', 'Wetland', 'Snow/Ice'], CAST(scene_id % 8 AS INT) + 1) FROM m
UNION ALL SELECT raster_id, scene_id, mo, 1, CASE WHEN v > 0.6 THEN 'Forest' WHEN v > 0.3 THEN 'Cropland' WHEN v > 0.1 THEN 'Grassland' WHEN v > -0.1 THEN 'Barren' ELSE 'Water' END
  FROM (SELECT *, (nir - red) / (nir + red + 1e-8) AS v FROM m))
SELECT raster_id, scene_id, mo, bands, class_id, class_name, color FROM x JOIN {_LAND} USING (class_name)""")
def spectral_class(t: Tables):
    m = t.fx_px.groupBy((F.col("scene_id") % 7).cast("int").alias("raster_id"), "scene_id", F.month("month").alias("mo")).agg(
        (F.avg("b04") * 0.9).alias("blue"), (F.avg("b04") + F.avg("cloud_cover") * 30).alias("green"), F.avg("b04").alias("red"),
        F.avg("b08").alias("_n")).withColumn("nir", F.col("_n") * (0.2 + F.col("mo") / 10))
    index = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red") + 1e-8)
    m = m.withColumns({"cr": F.col("blue") / 15 - 60, "cg": F.col("green") / 20 - F.col("mo") * 15, "cb": F.col("red") / 25 - 20, "v": index})
    out = None
    for means in (["blue", "green", "red", "nir"], ["cr", "cg", "cb"], ["red", "nir"], ["v"]):
        got = L.spectral_class(m, ["raster_id"], means, "scene_id").select(
            "raster_id", "scene_id", "mo", F.lit(len(means)).alias("bands"), "class_id", "class_name", "color")
        out = got if out is None else out.unionByName(got)
    return out


@query("F15", "confidence_from_distance", """
WITH p AS (SELECT raster_id, quantile_cont(abs(scalar - 1000), 0.95) AS p95 FROM fx_class GROUP BY 1)
SELECT raster_id, r, c, round(least(1, greatest(0.1::DOUBLE, 1 - abs(scalar - 1000) / (p95 + 1e-8))), 6) AS confidence FROM fx_class JOIN p USING (raster_id)""")
def confidence_from_distance(t: Tables):
    px = t.fx_class.withColumn("distance", F.abs(F.col("scalar") - 1000))
    return L.confidence_from_distance(px, ["raster_id"]).select("raster_id", "r", "c", *r6("confidence"))


@query("D10", "class_summary", f"""WITH {_FT}, s AS (SELECT class_name, grouping(class_name) = 1 AS is_total, sum(area_m2) AS a, count(*) AS count,
  round(avg(confidence), 3) AS avg_confidence, count(*) FILTER (WHERE needs_review) AS needs_review_count FROM ft GROUP BY ROLLUP (class_name))
SELECT class_name, is_total, round(a, 1) AS area_m2, count, avg_confidence, needs_review_count,
  round(a / greatest((SELECT sum(area_m2) FROM ft), 1) * 100, 1) AS percentage FROM s""")
def class_summary(t: Tables):
    return L.class_summary(features(t))


@query("D11", "segment_means", """SELECT raster_id, segment_id, round(avg(red), 6) AS red, round(avg(scalar), 6) AS green, count(*) AS n
FROM (SELECT *, r * 10 AS red, CAST(floor(r / 6.0) * 10 + floor(c / 9.0) AS INT) AS segment_id FROM fx_class) GROUP BY 1, 2 HAVING count(*) >= 11""")
def segment_means(t: Tables):
    return L.segment_means(_segments(t), ["raster_id", "segment_id"], ["red", "green"], 11).select(
        "raster_id", "segment_id", "n", *r6("red", "green"))


def _segments(t: Tables):
    return t.fx_class.select("raster_id", (F.floor(F.col("r") / 6) * 10 + F.floor(F.col("c") / 9)).cast("int").alias("segment_id"),
                             (F.col("r") * 10).alias("red"), F.col("scalar").alias("green"), (F.col("c") * 5).alias("blue"))


def centre_faults(df, keys, points):
    """Per group: rows, clusters, rows with a nearer centre than their own, and centres off the mean of their rows.

    The centres are worked out anew, as the means of the rows of each cluster.
    """
    means = df.groupBy(*keys, "cluster").agg(F.array(*[F.avg(p) for p in points]).alias("m"))
    listed = means.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "m")).alias("_ms"))
    point = F.array(*[F.col(p) for p in points])

    def gap(m):
        return F.sqrt(F.aggregate(F.zip_with(point, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    own = F.aggregate(F.transform("_ms", lambda x: F.when(x["cluster"] == F.col("cluster"), gap(x["m"])).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    least = F.array_min(F.transform("_ms", lambda x: gap(x["m"])))
    return df.join(listed, list(keys)).withColumn("_own", own).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_labelled"), F.count_if(F.col("_own") > least + 0.05).alias("not_nearest"),
        (F.count_distinct("cluster") > 1).alias("divided"))


@query("K16", "label_segments", """WITH sg AS (SELECT raster_id, CAST(floor(r / 6.0) * 10 + floor(c / 9.0) AS INT) AS segment_id, count(*) AS n FROM fx_class GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT raster_id, count(*) AS n_labelled, CAST(0 AS BIGINT) AS not_nearest, count(*) > 1 AS divided, CAST(sum(n) * 100 AS DOUBLE) AS area_m2, true AS classes_match FROM sg GROUP BY 1""")
def label_segments(t: Tables):
    from geoloom.operators.clusters import standardised

    classes, bands = ["Forest", "Urban", "Water"], ["red", "green", "blue"]
    got = L.label_segments(_segments(t), bands, classes, 5, 100.0)
    scaled = standardised(got, ["raster_id"], bands, ["s0", "s1", "s2"])
    match = F.bool_and(F.col("class_name") == F.get(F.array(*[F.lit(c) for c in classes]), F.col("cluster") % 3)).alias("classes_match")
    return centre_faults(scaled, ["raster_id"], ["s0", "s1", "s2"]).join(
        got.groupBy("raster_id").agg(F.sum("area_m2").alias("area_m2"), match), "raster_id")


@query("D27", "tag_counts", "SELECT coalesce(nullif(class_name, 'BUILDING'), '(untagged)') AS tag, count(*) AS n FROM fx_point GROUP BY 1")
def tag_counts(t: Tables):
    return L.tag_counts(t.fx_point.withColumn("tag", F.nullif("class_name", F.lit("BUILDING"))))


@query("I2", "candidate_classes", "SELECT DISTINCT coalesce(nullif(class_name, 'BUILDING'), 'unknown') AS class_name FROM fx_point")
def candidate_classes(t: Tables):
    return L.candidate_classes(t.fx_point.withColumn("class_name", F.nullif("class_name", F.lit("BUILDING"))))


@query("H2", "largest_first", f"WITH {_FT} SELECT pid, area_m2 FROM ft ORDER BY area_m2 DESC, pid")
def largest_first(t: Tables):
    return L.largest_first(features(t)).select("pid", "area_m2")


@query("D26", "stratified_labels", """SELECT raster_id, class_id, r, c FROM fx_class WHERE class_id >= 0
QUALIFY row_number() OVER (PARTITION BY raster_id, class_id ORDER BY md5(concat('5|', raster_id, '|', r, '|', c)), r, c) <= 20""")
def stratified_labels(t: Tables):
    return L.stratified_labels(t.fx_class, 20, 5).select("raster_id", "class_id", "r", "c")


def _band_raster(t: Tables):
    """One pixel per cell of the 64 x 64 grid, as three rasters by line number."""
    part = (F.col("scene_id") % 3).cast("int")
    return t.fx_px.groupBy(part.alias("raster_id"), "r", "c").agg(
        (F.avg("b04") * 0.9).alias("b02"), F.avg("b04").alias("b03"), (F.avg("b04") * 1.1).alias("b04"), F.avg("b08").alias("b08"))


@query("K9", "label_raster_kmeans", """WITH p AS (SELECT CAST(scene_id % 3 AS INT) AS raster_id, r, c, avg(b04) AS a, avg(b08) AS b FROM fx_px GROUP BY ALL),
v AS (SELECT raster_id, count(*) AS n FROM p WHERE NOT (a = 0 AND b = 0) GROUP BY 1)
SELECT raster_id, n AS n_valid, 'ok' AS status, 4 AS n_classes, n AS n_labelled, CAST(0 AS BIGINT) AS not_nearest, true AS divided, true AS in_range, true AS known_classes FROM v""")
def label_raster_kmeans(t: Tables):
    from geoloom.operators.clusters import standardised
    from geoloom.session import cut_lineage

    bands = ["b02", "b03", "b04", "b08"]
    got, status = L.label_raster_kmeans(_band_raster(t), bands, 4)
    got = cut_lineage(got)
    scaled = standardised(got.select("raster_id", "r", "c", "cluster", "_x", "_y", *bands), ["raster_id"], bands, ["s0", "s1", "s2", "s3"])
    faults = centre_faults(scaled, ["raster_id"], ["s0", "s1", "s2", "s3", "_x", "_y"])
    facts = got.groupBy("raster_id").agg(
        (F.min("confidence").between(0.1, 1) & F.max("confidence").between(0.9, 1)).alias("in_range"),
        F.bool_and(F.concat_ws("|", "class_id", "class_name", "color").isin(*[f"{a}|{b}|{c}" for a, b, c in L.SPECTRAL])).alias("known_classes"))
    return status.join(faults, "raster_id").join(facts, "raster_id")


@query("K10", "label_vector_kmeans", """SELECT count(*) AS n_labelled, CAST(0 AS BIGINT) AS not_nearest, true AS divided, count(*) AS n_named, true AS review_matches
FROM fx_point""")
def label_vector_kmeans(t: Tables):
    from geoloom.operators.clusters import standardised

    points = t.fx_point
    got = L.label_vector_kmeans(points, "pid", 6)
    cluster = F.regexp_extract("auto_class", "^Cluster ([1-6])$", 1)
    both = points.select("pid", "lon", "lat", F.col("confidence").alias("x")).join(
        got.select("pid", "auto_class", "auto_color", "confidence", "needs_review", (cluster.cast("int") - 1).alias("cluster")), "pid").withColumn("_all", F.lit(0))
    scaled = standardised(both, ["_all"], ["lon", "lat", "x"], ["s0", "s1", "s2"])
    facts = both.groupBy("_all").agg(
        F.count_if(F.col("auto_color") == F.get(F.array(*[F.lit(c) for c in L.CLUSTER_COLORS]), F.col("cluster"))).alias("n_named"),
        # the flag is set before the confidence is rounded
        F.bool_and((F.col("needs_review") == (F.col("confidence") < 0.6)) | (F.abs(F.col("confidence") - 0.6) < 0.001)).alias("review_matches"))
    return centre_faults(scaled, ["_all"], ["s0", "s1", "s2"]).join(facts, "_all").drop("_all")


@query("K11", "label_by_category", f"""WITH v AS (SELECT class_name, dense_rank() OVER (ORDER BY class_name) - 1 AS i FROM (SELECT DISTINCT class_name FROM fx_point))
SELECT pid, class_name AS auto_class, color AS auto_color, CAST(0.8 AS DOUBLE) AS confidence, false AS needs_review
FROM fx_point JOIN v USING (class_name) JOIN {values_sql(list(enumerate(L.CLUSTER_COLORS)))} k(i, color) ON k.i = v.i % 8""")
def label_by_category(t: Tables):
    return L.label_vector_kmeans(t.fx_point.select("pid", "class_name"), "pid")


def _belt_sql() -> str:
    rows = []
    for low, shares in L.BELTS:
        for wet in (False, True):
            got = dict(shares)
            if wet:
                got["Water"] = got.get("Water", 5) + 15
                got["Urban"] = got.get("Urban", 5) + 5
            total = sum(got.values())
            rows += [(low, wet, k, float(v) / total * 100) for k, v in got.items()]
    return values_sql(rows)


_COVER = f"""lc AS (SELECT scene_id, (north + south) / 2 AS lat, CASE WHEN abs((north + south) / 2) > 60 THEN 60 WHEN abs((north + south) / 2) > 40 THEN 40
    WHEN abs((north + south) / 2) > 23 THEN 23 ELSE -1 END AS low, abs((east + west) / 2) > 170 OR ((east + west) / 2 > -130 AND (east + west) / 2 < -115
    AND (north + south) / 2 > 30 AND (north + south) / 2 < 50) AS wet FROM fx_scene),
cv AS (SELECT scene_id, lat, name, round(pct, 1) AS percent FROM lc JOIN {_belt_sql()} b(low, wet, name, pct) ON b.low = lc.low AND b.wet = lc.wet)"""


@query("F18", "latitude_cover", f"WITH {_COVER} SELECT scene_id, name, percent FROM cv")
def latitude_cover(t: Tables):
    return t.fx_scene.select("scene_id", F.explode(L.latitude_cover("west", "south", "east", "north")).alias("name", "percent"))


def _r2(x: str) -> str:
    """Two places, half up on the shortest text of the number."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE)"


@query("F17", "suitability", f"""WITH {_COVER}, w AS (SELECT scene_id, abs(any_value(lat)) AS a, coalesce(max(percent) FILTER (WHERE name = 'Barren'), 0) AS barren,
  coalesce(max(percent) FILTER (WHERE name = 'Grassland'), 0) AS grass, coalesce(max(percent) FILTER (WHERE name = 'Cropland'), 0) AS crop,
  coalesce(max(percent) FILTER (WHERE name = 'Urban'), 0) AS urban, coalesce(max(percent) FILTER (WHERE name = 'Forest'), 0) AS forest,
  coalesce(max(percent) FILTER (WHERE name = 'Water'), 0) AS water FROM cv GROUP BY 1)
SELECT scene_id, {_r2("least(1, greatest(0, 1 - abs(a - 25) / 50) + barren / 200)")} AS solar_energy,
  {_r2("least(1, 0.3::DOUBLE + a / 100 + grass / 150)")} AS wind_energy,
  {_r2("least(1, greatest(0, 1 - abs(a - 40) / 40) * 0.6::DOUBLE + crop / 100 * 0.4::DOUBLE)")} AS agriculture,
  {_r2("least(1, greatest(0.1::DOUBLE, 0.5::DOUBLE + urban / 100 * 0.3::DOUBLE - forest / 100 * 0.2::DOUBLE - water / 100 * 0.3::DOUBLE))")} AS construction FROM w""")
def suitability(t: Tables):
    lat = (F.col("north") + F.col("south")) / 2
    return t.fx_scene.select("scene_id", L.suitability(lat, L.latitude_cover("west", "south", "east", "north")).alias("s")).select("scene_id", "s.*")


_NEAR = """nb AS (SELECT a.pid, b.pid AS neighbor, b.class_name AS ncls FROM fx_point a JOIN fx_point b ON a.pid <> b.pid
  AND sqrt(pow((b.lon - a.lon) * 111 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111, 2)) <= 600
  QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY sqrt(pow((b.lon - a.lon) * 111 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111, 2)), b.pid) <= 5),
vt AS (SELECT pid, ncls, count(*) AS v, sum(count(*)) OVER (PARTITION BY pid) AS tot FROM nb GROUP BY pid, ncls),
tp AS (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY pid ORDER BY v DESC, ncls) = 1)"""
# evidence: the raster that a point's site lies in (some have none), the elevation cell, the last weather reading
_EVID = f"""nr AS (SELECT max(raster_id) + 2 AS k FROM fx_class), {_CELLS}, {_WEATHER},
ev AS (SELECT p.pid, d.elevation IS NOT NULL AS has_e, w.temperature IS NOT NULL AS has_w, EXISTS (SELECT 1 FROM fx_class f WHERE f.raster_id = p.pid % nr.k AND f.scalar > 0) AS has_p
  FROM fx_point p JOIN nr ON true LEFT JOIN dem d ON d.cx = CAST(floor(lon / 5) AS BIGINT) AND d.cy = CAST(floor(lat / 5) AS BIGINT)
  JOIN a ON a.pid = p.pid LEFT JOIN w ON w.cx = a.cx AND w.cy = a.cy)"""
_VALID = f"""WITH {_FT}, {_NEAR}, {_EVID},
vl AS (SELECT ft.pid, ft.class_name, confidence < 0.6::DOUBLE AS target, coalesce(v * 2 > tot AND ncls <> ft.class_name, false) AS chg, ncls, tot,
    concat_ws(',', CASE WHEN has_p THEN 'patch' END, CASE WHEN has_e THEN 'elevation' END, CASE WHEN has_w THEN 'weather' END, CASE WHEN tot > 0 THEN 'neighbors' END) AS ev
  FROM ft JOIN ev USING (pid) LEFT JOIN tp USING (pid)),
va AS (SELECT pid, target, CASE WHEN target THEN CASE WHEN chg THEN 'relabel' ELSE 'accept' END END AS action,
    CASE WHEN target THEN CASE WHEN chg THEN ncls ELSE class_name END END AS validated_class, CASE WHEN target THEN ev END AS evidence FROM vl)"""


def _validated(t: Tables):
    """Patches (A22) of the sites' rasters, elevation (C16) and weather (C15) as evidence."""
    from geoloom.operators.polygons import elevation_for
    from geoloom.operators.rasters import raster_patch

    f = features(t)
    near = neighbors_within(t.fx_point, 600.0, 5).select("pid", "neighbor")
    boxes = t.fx_class.groupBy("raster_id").agg(F.lit(0).alias("r0"), F.lit(0).alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"))
    cropped = raster_patch(t.fx_class, boxes, "scalar", 24).groupBy("raster_id").agg(F.max("level").alias("top")).where("top > 0")
    rasters = t.fx_class.agg((F.max("raster_id") + 2).alias("k")).scalar()
    patch = t.fx_point.select("pid", (F.col("pid") % rasters).cast("int").alias("raster_id")).join(cropped, "raster_id")
    high = elevation_for(t.fx_point.select("pid", "lon", "lat"), _dem(t), 5.0).where(F.col("elevation").isNotNull() & ~F.isnan("elevation"))
    weather = environment(t).where("temperature IS NOT NULL")
    return L.validate_features(f, near, {"patch": patch, "elevation": high, "weather": weather})


@query("K18", "validate_features", _VALID + " SELECT pid, target, action, validated_class, evidence FROM va")
def validate_features(t: Tables):
    return _validated(t).select("pid", "target", "action", "validated_class", F.array_join("evidence", ",").alias("evidence"))


@query("D12", "validation_summary", _VALID + """ SELECT action, count(*) AS n, count(*) FILTER (WHERE target) AS validated,
  count(*) FILTER (WHERE NOT target) AS skipped FROM va GROUP BY action""")
def validation_summary(t: Tables):
    return L.validation_summary(_validated(t))


_CONF = "cf AS (SELECT ref, pred, count(*) AS n FROM fx_refpred WHERE ref <> 0 GROUP BY ALL)"
_TOTALS = """ct AS (SELECT class_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(ref_n) AS BIGINT) AS ref_n, CAST(sum(pred_n) AS BIGINT) AS pred_n FROM (
  SELECT ref AS class_id, CASE WHEN ref = pred THEN n ELSE 0 END AS tp, n AS ref_n, 0 AS pred_n FROM cf UNION ALL SELECT pred, 0, 0, n FROM cf) GROUP BY class_id)"""


@query("D13", "confusion_matrix", f"WITH {_CONF} SELECT ref, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE pred = {i}), 0) AS BIGINT) AS pred_{i}" for i in range(10)) + " FROM cf GROUP BY ref")
def confusion_matrix(t: Tables):
    return Q.confusion_matrix(Q.confusion(t.fx_refpred), range(10))


_IOU = f"""{_CONF}, {_TOTALS}, io AS (SELECT *, CASE WHEN ref_n + pred_n - tp > 0 THEN CAST(tp AS DOUBLE) / (ref_n + pred_n - tp) ELSE 0 END AS iou FROM ct)"""


@query("D14", "iou_metrics", f"""WITH {_IOU} SELECT class_id, tp, ref_n, pred_n, round(iou, 6) AS iou, round((SELECT avg(iou) FROM io WHERE ref_n > 0), 6) AS miou,
  round((SELECT CAST(sum(tp) AS DOUBLE) / sum(ref_n) FROM io), 6) AS accuracy FROM io""")
def iou_metrics(t: Tables):
    return Q.iou_metrics(Q.confusion(t.fx_refpred)).select("class_id", "tp", "ref_n", "pred_n", *r6("iou", "miou", "accuracy"))


_PRF = """pf AS (SELECT class_id, ref_n AS support, CAST(tp AS DOUBLE) / greatest(pred_n, 1e-9) AS p, CAST(tp AS DOUBLE) / greatest(ref_n, 1e-9) AS r, tp FROM ct)
SELECT class_id, support, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1,
 round((SELECT avg(2 * p * r / greatest(p + r, 1e-9)) FROM pf), 6) AS macro_f1, round((SELECT CAST(sum(tp) AS DOUBLE) / sum(support) FROM pf), 6) AS accuracy FROM pf"""


@query("D15", "prf_metrics", f"WITH {_CONF}, {_TOTALS}, {_PRF}")
def prf_metrics(t: Tables):
    return _prf(t.fx_refpred)


def _prf(pred):
    return Q.prf_metrics(Q.confusion(pred)).select("class_id", "support", *r6("precision", "recall", "f1", "macro_f1", "accuracy"))


@query("H1", "stable_sample", "SELECT uid, ref, pred FROM fx_refpred ORDER BY md5(concat('3|', uid)), uid LIMIT 200")
def stable_sample(t: Tables):
    return Q.stable_sample(t.fx_refpred, "uid", 200, 3)


@query("H4", "worst_best_classes", f"""WITH {_IOU}, s AS (SELECT class_id, round(iou, 6) AS iou FROM io WHERE ref_n > 0)
(SELECT *, 'worst' AS side FROM s ORDER BY iou, class_id LIMIT 3) UNION ALL (SELECT *, 'best' AS side FROM s ORDER BY iou DESC, class_id LIMIT 3)""")
def worst_best(t: Tables):
    return Q.worst_best_classes(Q.iou_metrics(Q.confusion(t.fx_refpred)).withColumn("iou", F.round("iou", 6)), 3)


_ANCHORS = [(1, 34, 139, 34), (2, 240, 230, 140), (3, 128, 128, 128), (4, 30, 144, 255)]


@query("K20", "eval_labels", f"""WITH pt AS (SELECT pid, lon, lat, CAST(pid % 5 AS INT) AS ref FROM fx_point ORDER BY md5(concat('9|', pid)), pid LIMIT 300),
z AS (SELECT pow(2, greatest(2, ceil(log2((max(raster_id) + 1) * 20 / 16.0)))) AS n FROM fx_class),
tile AS (SELECT CAST(floor(c / 16.0) AS INT) AS x, CAST(floor((raster_id * 20 + r) / 16.0) AS INT) AS y, c % 16 AS px, (raster_id * 20 + r) % 16 AS py,
  (r * 12) % 256 AS red, (c * 5) % 256 AS green, CAST(floor(scalar) AS INT) % 256 AS blue FROM fx_class),
f AS (SELECT pid, ref, (lon + 180) / 360 * n AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * n AS fy FROM pt JOIN z ON true),
p AS (SELECT pid, ref, CAST(floor(fx) AS INT) AS x, CAST(floor(fy) AS INT) AS y, CAST(floor((fx - floor(fx)) * 16) AS INT) AS px, CAST(floor((fy - floor(fy)) * 16) AS INT) AS py FROM f),
s AS (SELECT pid, ref, red, k FROM (SELECT * FROM p LEFT JOIN tile USING (x, y, px, py)), {values_sql(_ANCHORS)} a(k, ar, ag, ab)
  QUALIFY row_number() OVER (PARTITION BY pid ORDER BY pow(red - ar, 2) + pow(green - ag, 2) + pow(blue - ab, 2), k) = 1),
pr AS (SELECT ref, CASE WHEN red IS NOT NULL THEN k END AS pred FROM s),
cf AS (SELECT ref, pred, count(*) AS n FROM pr WHERE ref <> 0 AND pred IS NOT NULL GROUP BY ALL), {_TOTALS},
io AS (SELECT *, CASE WHEN ref_n + pred_n - tp > 0 THEN CAST(tp AS DOUBLE) / (ref_n + pred_n - tp) ELSE 0 END AS iou FROM ct),
rs AS (WITH {_PRF})
SELECT rs.*, round(iou, 6) AS iou, round((SELECT avg(iou) FROM io WHERE ref_n > 0), 6) AS miou, (SELECT count(*) FROM pr) AS n_sampled, (SELECT count(*) FROM pr WHERE pred IS NULL) AS n_unmapped
FROM rs JOIN io USING (class_id)""")
def eval_labels(t: Tables):
    row = F.col("raster_id") * 20 + F.col("r")
    tiles = t.fx_class.select(
        F.floor(F.col("c") / 16).cast("int").alias("x"), F.floor(row / 16).cast("int").alias("y"), (F.col("c") % 16).alias("px"), (row % 16).alias("py"),
        ((F.col("r") * 12) % 256).alias("red"), ((F.col("c") * 5) % 256).alias("green"), (F.floor("scalar").cast("int") % 256).alias("blue"))
    (last,) = t.fx_class.agg(F.max("raster_id")).first()
    zoom = max(2, math.ceil(math.log2((last + 1) * 20 / 16)))
    points = t.fx_point.select("pid", "lon", "lat", (F.col("pid") % 5).cast("int").alias("ref"))
    got = Q.eval_labels(points, tiles, _ANCHORS, 300, zoom, 16, 9)
    return got.select("class_id", "support", *r6("precision", "recall", "f1", "macro_f1", "accuracy", "iou", "miou"), "n_sampled", "n_unmapped")


@query("G3", "failure_streaks", """
WITH a AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS island FROM fx_outcome),
b AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY job_id, island ORDER BY ts, event_id) AS pos FROM a)
SELECT job_id, count(*) AS n_events, count(*) FILTER (WHERE NOT ok AND pos >= 3) > 0 AS tripped,
  arg_min(event_id, ts) FILTER (WHERE NOT ok AND pos >= 3) AS trip_event_id FROM b GROUP BY job_id""")
def failure_streaks(t: Tables):
    return N.failure_streaks(t.fx_outcome, 3)


@query("G4", "failure_rate_trip", """
WITH a AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER w AS f, count(*) OVER w AS n FROM fx_outcome WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, count(*) AS n_events, count(*) FILTER (WHERE f >= 5 AND f / n > 0.25) > 0 AS tripped,
  arg_min(event_id, ts) FILTER (WHERE f >= 5 AND f / n > 0.25) AS trip_event_id FROM a GROUP BY job_id""")
def failure_rate_trip(t: Tables):
    return N.failure_rate_trip(t.fx_outcome, 5, 0.25)


@query("D24", "job_progress", """
WITH s AS (SELECT job_id, count(*) AS done, count(*) FILTER (WHERE NOT ok) AS failed, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS el FROM fx_outcome GROUP BY 1),
j AS (SELECT job_id, done + job_id % 6 AS total, done, failed, el FROM s)
SELECT job_id, total, done, failed, el AS elapsed_ms, CASE WHEN total > done THEN CAST(floor((total - done) * (CAST(el AS DOUBLE) / done) / 2) AS BIGINT) END AS remaining_ms FROM j""")
def job_progress(t: Tables):
    jobs = t.fx_outcome.groupBy("job_id").agg((F.count(F.lit(1)) + F.first("job_id") % 6).alias("total"))
    return N.job_progress(t.fx_outcome, jobs)
