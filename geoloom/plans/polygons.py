"""Polygon, geometry and vectorization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.fixtures import Tables
from geoloom.functions import geo as X
from geoloom.operators import polygons as P
from geoloom.operators import vectorize as V
from geoloom.plans.rasters import LEGEND_SQL, legend_dim, r6
from geoloom.registry import query
from geoloom.session import cut_lineage

_EDGES = """e AS (SELECT poly_id, vtx, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM fx_ring
      WINDOW w AS (PARTITION BY poly_id ORDER BY vtx)),
ed AS (SELECT * FROM e WHERE lon2 IS NOT NULL)"""
_BOX = """bx AS (SELECT poly_id, avg(lon) AS centroid_lon, avg(lat) AS centroid_lat, min(lon) AS west, min(lat) AS south,
       max(lon) AS east, max(lat) AS north, count(*) AS vertex_count FROM fx_ring GROUP BY 1)"""
_HAV = """2 * 6371.0088::DOUBLE * asin(sqrt(least(1, pow(sin(radians(lat2 - lat1) / 2), 2)
     + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"""


@query("G1", "ring_edges", f"""WITH {_EDGES} SELECT poly_id, vtx, round(lon1, 6) AS lon1, round(lat1, 6) AS lat1,
  round(lon2, 6) AS lon2, round(lat2, 6) AS lat2 FROM ed""")
def ring_edges(t: Tables):
    return P.ring_edges(t.fx_ring).select("poly_id", "vtx", *r6("lon1", "lat1", "lon2", "lat2"))


@query("F2", "haversine_km", f"""WITH {_EDGES} SELECT poly_id, vtx, round({_HAV}, 6) AS km FROM ed""")
def haversine(t: Tables):
    return P.ring_edges(t.fx_ring).select("poly_id", "vtx", F.round(
        X.haversine_km("lat1", "lon1", "lat2", "lon2"), 6).alias("km"))


@query("F3", "ring_area_km2", f"""WITH {_EDGES}, {_BOX}
SELECT poly_id, round(any_value(cos(radians(centroid_lat))) * 111.32::DOUBLE * 110.574::DOUBLE * abs(sum(lon1 * lat2 - lon2 * lat1)) / 2, 4) AS area_km2
FROM ed JOIN bx USING (poly_id) GROUP BY poly_id""")
def ring_area(t: Tables):
    return P.polygon_stats(t.fx_ring).select("poly_id", "area_km2")


@query("F5", "ring_centroid_bbox", f"""WITH {_BOX} SELECT poly_id, round(centroid_lon, 6) AS centroid_lon, round(centroid_lat, 6) AS centroid_lat,
  round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, vertex_count FROM bx""")
def ring_centroid(t: Tables):
    return P.vertex_measures(t.fx_ring).select("poly_id", "vertex_count", *r6(
        "centroid_lon", "centroid_lat", "west", "south", "east", "north"))


@query("F6", "geodesic_area_m2", f"""WITH {_EDGES},
q AS (SELECT *, 0.0066943799901413165::DOUBLE AS e2, sin(radians(lat1)) AS s1, sin(radians(lat2)) AS s2 FROM ed),
a AS (SELECT *, (1 - e2) * (s1 / (1 - e2 * s1 * s1) + atanh(sqrt(e2) * s1) / sqrt(e2)) AS q1,
   (1 - e2) * (s2 / (1 - e2 * s2 * s2) + atanh(sqrt(e2) * s2) / sqrt(e2)) AS q2, (1 - e2) * (1 / (1 - e2) + atanh(sqrt(e2)) / sqrt(e2)) AS qp FROM q)
SELECT poly_id, round(abs(sum(radians(lon2 - lon1) * (q1 + q2) / qp / 2)) * 6371.0071809::DOUBLE * 6371.0071809::DOUBLE, 4) AS area_km2
FROM a GROUP BY poly_id""")
def geodesic_area(t: Tables):
    return P.ring_measures(P.ring_edges(t.fx_ring)).select("poly_id", F.round(F.col("geodesic_m2") / 1e6, 4).alias("area_km2"))


_GRID_PTS = f"""{_EDGES}, {_BOX},
pt AS (SELECT poly_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, south + (north - south) / 11 * i AS lat, west + (east - west) / 11 * j AS lon
       FROM bx, range(12) a(i), range(12) b(j)),
ins AS (SELECT pt.poly_id, i, j, any_value(lat) AS lat, any_value(lon) AS lon FROM pt JOIN ed USING (poly_id)
        WHERE (lat1 > lat) <> (lat2 > lat) AND lon < (lon1 - lon2) * (lat - lat2) / (lat1 - lat2 + 1e-20) + lon2
        GROUP BY pt.poly_id, i, j HAVING count(*) % 2 = 1)"""


@query("E11", "sample_grid", f"WITH {_GRID_PTS} SELECT poly_id, i, j, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ins")
def sample_grid(t: Tables):
    return P.sample_grid(t.fx_ring, 12).select("poly_id", "i", "j", *r6("lat", "lon"))


def _dem(t: Tables):
    """A 5-degree elevation grid from the class rasters; some cells are missing, some are NaN."""
    cell = (F.col("raster_id") * 1000 + F.col("r") * 50 + F.col("c")) % 2592
    lost = F.max((F.col("class_id") == -1).cast("int")) == 1
    return t.fx_class.groupBy((cell % 72 - 36).cast("bigint").alias("cx"), (F.floor(cell / 72) - 18).alias("cy")).agg(
        F.when(lost, F.lit(float("nan"))).otherwise(F.avg(F.when(F.col("class_id") != 7, F.col("scalar")))).alias("elevation"))


_CELLS = """dm AS (SELECT (raster_id * 1000 + r * 50 + c) % 2592 AS cell, class_id, scalar FROM fx_class),
dem AS (SELECT CAST(cell % 72 - 36 AS BIGINT) AS cx, CAST(floor(cell / 72.0) - 18 AS BIGINT) AS cy,
    CASE WHEN min(class_id) = -1 THEN NULL ELSE avg(scalar) FILTER (WHERE class_id <> 7) END AS elevation FROM dm GROUP BY cell)"""
_DEM = f"""{_CELLS},
el AS (SELECT poly_id, i, j, round(elevation, 6) AS elevation FROM ins LEFT JOIN dem ON cx = CAST(floor(lon / 5) AS BIGINT) AND cy = CAST(floor(lat / 5) AS BIGINT))"""
_ELEV = """es AS (SELECT poly_id, count(*) AS sample_count, min(elevation) AS min_m, max(elevation) AS max_m, round(avg(elevation), 6) AS mean_m,
     median(elevation) AS median_m, round(max(elevation) - min(elevation), 6) AS range_m FROM el GROUP BY poly_id)"""


@query("C16", "elevation_for", f"WITH {_GRID_PTS}, {_DEM} SELECT * FROM el")
def elevation_for(t: Tables):
    got = P.elevation_for(P.sample_grid(t.fx_ring, 12), _dem(t), 5.0)
    return got.select("poly_id", "i", "j", F.round(F.nanvl("elevation", F.lit(None).cast("double")), 6).alias("elevation"))


def _elevation(t: Tables):
    got = P.elevation_stats(P.elevation_for(P.sample_grid(t.fx_ring, 12), _dem(t), 5.0))
    return got.select("poly_id", "sample_count", *r6("min_m", "max_m", "median_m", "mean_m", "range_m"))


@query("D7", "elevation_stats", f"WITH {_GRID_PTS}, {_DEM}, {_ELEV} SELECT * FROM es")
def elevation_stats(t: Tables):
    return _elevation(t)


@query("D8", "polygon_stats", f"""WITH {_GRID_PTS}, {_DEM}, {_ELEV},
m AS (SELECT poly_id, round(sum({_HAV}), 4) AS perimeter_km, abs(sum(lon1 * lat2 - lon2 * lat1)) / 2 AS a FROM ed GROUP BY 1)
SELECT poly_id, round(centroid_lon, 6) AS centroid_lon, round(centroid_lat, 6) AS centroid_lat, round(west, 6) AS west, round(south, 6) AS south,
  round(east, 6) AS east, round(north, 6) AS north, vertex_count, perimeter_km,
  round(a * 111.32::DOUBLE * cos(radians(centroid_lat)) * 110.574::DOUBLE, 4) AS area_km2, 'ok' AS status,
  sample_count, min_m, max_m, mean_m, median_m, range_m FROM bx JOIN m USING (poly_id) LEFT JOIN es USING (poly_id)""")
def polygon_stats(t: Tables):
    got = P.polygon_stats(t.fx_ring, _elevation(t))
    for c in ("centroid_lon", "centroid_lat", "west", "south", "east", "north"):
        got = got.withColumn(c, F.round(c, 6))
    return got


@query("C8", "points_in_polygons", f"""WITH {_EDGES}
SELECT pid, poly_id FROM fx_point p JOIN ed ON (lat1 > p.lat) <> (lat2 > p.lat)
  AND p.lon < (lon1 - lon2) * (p.lat - lat2) / (lat1 - lat2 + 1e-20) + lon2
GROUP BY pid, poly_id HAVING count(*) % 2 = 1""")
def points_in_polygons(t: Tables):
    return P.points_in_polygons(t.fx_point, t.fx_ring)


@query("C7", "neighbors_within", """
SELECT a.pid, CAST(row_number() OVER (PARTITION BY a.pid ORDER BY d, b.pid) AS INT) AS rank, b.pid AS neighbor, round(d, 6) AS distance_km
FROM (SELECT a.pid, b.pid AS bpid, sqrt(pow((b.lon - a.lon) * 111 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111, 2)) AS d
      FROM fx_point a JOIN fx_point b ON a.pid <> b.pid) x JOIN fx_point a ON a.pid = x.pid JOIN fx_point b ON b.pid = x.bpid
WHERE d <= 400 QUALIFY rank <= 5""")
def neighbors_within(t: Tables):
    return P.neighbors_within(t.fx_point, 400.0, 5).select("pid", "rank", "neighbor", *r6("distance_km"))


@query("F1", "bbox_area_km2", """
SELECT box_id, round(abs(east - west) * 111.32::DOUBLE * cos(radians((north + south) / 2)) * abs(north - south) * 110.574::DOUBLE, 4) AS area_km2 FROM fx_box""")
def bbox_area(t: Tables):
    return t.fx_box.select("box_id", F.round(X.bbox_area_km2("west", "south", "east", "north"), 4).alias("area_km2"))


@query("F4", "great_circle_km", """
WITH h AS (SELECT scene_id, pow(sin(radians(45 - south) / 2), 2) + cos(radians(south)) * cos(radians(45.0::DOUBLE)) * pow(sin(radians(10 - west) / 2), 2) AS h FROM fx_scene)
SELECT scene_id, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h))) AS km FROM h""")
def great_circle(t: Tables):
    return t.fx_scene.select("scene_id", X.great_circle_km("south", "west", 45.0, 10.0).alias("km"))


@query("B2", "bbox_intersects", "SELECT scene_id, west <= 40 AND east >= -20 AND south <= 70 AND north >= 30 AS hit FROM fx_scene")
def bbox_intersects(t: Tables):
    return t.fx_scene.select("scene_id", X.bbox_intersects(
        ("west", "south", "east", "north"), (-20.0, 30.0, 40.0, 70.0)).alias("hit"))


@query("B3", "bbox_contains", "SELECT scene_id, west >= -20 AND east <= 40 AND south >= 30 AND north <= 70 AS inside FROM fx_scene")
def bbox_contains(t: Tables):
    return t.fx_scene.select("scene_id", X.bbox_contains(
        (-20.0, 30.0, 40.0, 70.0), ("west", "south", "east", "north")).alias("inside"))


@query("E4", "utm_round_trip", """SELECT pid, CAST(least(60, greatest(1, floor((lon + 180) / 6) + 1)) AS INT) AS zone, lat < 0 AS south,
  round(lon, 6) AS lon, round(lat, 6) AS lat, true AS in_zone FROM fx_point""")
def utm_round_trip(t: Tables):
    p = t.fx_point.withColumn("u", X.to_utm("lon", "lat"))
    back = X.from_utm("u.x", "u.y", "u.zone", "u.south")
    return (p.withColumn("b", back).select("pid", F.col("u.zone").alias("zone"), F.col("u.south").alias("south"),
            F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"), F.col("u.x").between(1e5, 9e5).alias("in_zone")))


@query("E5", "lonlat_to_rc", """
WITH a AS (SELECT pid, CAST(round_even((lon + 170) / 0.7::DOUBLE, 0) AS INT) AS c, CAST(round_even((80 - lat) / 0.3::DOUBLE, 0) AS INT) AS r FROM fx_point)
SELECT pid, least(greatest(r, 0), 499) AS r, least(greatest(c, 0), 479) AS c, c < 0 OR c >= 480 OR r < 0 OR r >= 500 AS outside FROM a""")
def lonlat_to_rc(t: Tables):
    return t.fx_point.select("pid", X.lonlat_to_rc("lon", "lat", -170.0, 80.0, 0.7, 0.3, 500, 480).alias("a")).select("pid", "a.*")


_TILE = """f AS (SELECT pid, (lon + 180) / 360 * 128 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 128 AS fy FROM fx_point),
tl AS (SELECT pid, CAST(floor(fx) AS INT) AS x, CAST(floor(fy) AS INT) AS y, CAST(floor((fx - floor(fx)) * 256) AS INT) AS px,
        CAST(floor((fy - floor(fy)) * 256) AS INT) AS py FROM f)"""


@query("E9", "lonlat_to_tile", f"WITH {_TILE} SELECT * FROM tl")
def lonlat_to_tile(t: Tables):
    return t.fx_point.select("pid", X.lonlat_to_tile("lon", "lat", 7).alias("t")).select("pid", "t.*")


@query("E8", "tile_bounds", f"""WITH {_TILE} SELECT pid, round(x / 128.0::DOUBLE * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 128.0::DOUBLE)))), 6) AS south,
 round((x + 1) / 128.0::DOUBLE * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 128.0::DOUBLE)))), 6) AS north FROM tl""")
def tile_bounds(t: Tables):
    at = lonlat_to_tile(t).withColumn("b", X.tile_bounds(F.lit(7), "x", "y"))
    return at.select("pid", *[F.round(f"b.{k}", 6).alias(k) for k in ("west", "south", "east", "north")])


@query("E1", "tile_positions", """
WITH d AS (SELECT p_partkey, p_size * 60 AS dim FROM part),
s AS (SELECT p_partkey, dim, CASE WHEN dim <= 448 THEN 0 ELSE unnest(range(0, greatest(dim - 448, 0) + 1, 224)) END AS start FROM d)
SELECT DISTINCT p_partkey, CAST(start AS INT) AS start FROM s UNION SELECT p_partkey, CAST(dim - 448 AS INT) FROM d WHERE dim > 448""")
def tile_positions(t: Tables):
    return t.part.select("p_partkey", F.explode(X.tile_positions(F.col("p_size") * 60, 448, 0.5)).alias("start"))


@query("F19", "window_weight", """
SELECT raster_id, r, c, round(least(1, greatest(0.1::DOUBLE, cos((r * 2 / 49.0::DOUBLE - 1) * pi() / 2) * cos((c * 2 / 49.0::DOUBLE - 1) * pi() / 2))), 6) AS w FROM fx_class""")
def window_weight(t: Tables):
    return t.fx_class.select("raster_id", "r", "c", F.round(X.window_weight("r", "c", 50), 6).alias("w"))


_REGIONS = """RECURSIVE cell AS (SELECT raster_id, r, c, class_id, CAST(r AS BIGINT) * 2147483648 + c AS id FROM fx_class WHERE class_id >= 0),
reach(raster_id, r, c, class_id, src) AS (
  SELECT raster_id, r, c, class_id, id FROM cell
  UNION SELECT n.raster_id, n.r, n.c, n.class_id, x.src FROM reach x JOIN (SELECT 1 AS dr, 0 AS dc UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1) d ON true
  JOIN cell n ON n.raster_id = x.raster_id AND n.class_id = x.class_id AND n.r = x.r + d.dr AND n.c = x.c + d.dc WHERE x.src < n.id),
reg AS (SELECT cell.raster_id, cell.r, cell.c, cell.class_id, min(src) AS region FROM cell JOIN reach USING (raster_id, r, c) GROUP BY ALL)"""


@query("K14", "connected_regions", f"WITH {_REGIONS} SELECT raster_id, r, c, class_id, region FROM reg")
def connected_regions(t: Tables):
    # blocks smaller than a raster, so that regions are joined over their borders
    return V.connected_regions(t.fx_class, block=32).select("raster_id", "r", "c", "class_id", "region")


@query("K14", "region_table", f"""WITH {_REGIONS} SELECT raster_id, region, any_value(class_id) AS class_id, count(*) AS pixel_count, min(r) AS r_min, min(c) AS c_min,
  max(r) AS r_max, max(c) AS c_max, CAST(count(*) * 100 AS DOUBLE) AS area_m2 FROM reg GROUP BY raster_id, region HAVING count(*) >= 4""")
def region_table(t: Tables):
    return V.region_table(V.connected_regions(t.fx_class), 10.0)


@query("K14", "region_features", f"""WITH {_REGIONS} SELECT raster_id, region, class_id, name AS class_name, coalesce(any_value(color), '#888888') AS color,
  CAST(count(*) * 100 AS DOUBLE) AS area_m2, count(*) AS pixel_count FROM reg LEFT JOIN {LEGEND_SQL} USING (class_id) WHERE class_id < 4
GROUP BY raster_id, region, class_id, name HAVING count(*) >= 4""")
def region_features(t: Tables):
    table = V.region_table(V.connected_regions(t.fx_class), 10.0)
    return V.region_features(table, legend_dim(t), 4)


@query("K14", "region_outlines", f"""WITH {_REGIONS},
s AS (SELECT g.raster_id, region, g.r, g.c, (SELECT count(*) FROM cell n WHERE n.raster_id = g.raster_id AND n.class_id = g.class_id
        AND abs(n.r - g.r) + abs(n.c - g.c) = 1) AS same FROM reg g)
SELECT raster_id, region, CAST(sum(4 - same) AS BIGINT) AS perimeter, CAST(count(*) AS BIGINT) AS area FROM s GROUP BY raster_id, region HAVING count(*) >= 4""")
def region_outlines(t: Tables):
    regions = V.connected_regions(t.fx_class)
    shape = V.outline(regions, V.region_table(regions, 1.0), 1.0)
    edges = P.ring_edges(shape).join(shape.where("vtx = 0").select("poly_id", "raster_id", "region"), "poly_id")
    return edges.groupBy("raster_id", "region").agg(
        F.sum(F.abs(F.col("lon2") - F.col("lon1")) + F.abs(F.col("lat2") - F.col("lat1"))).cast("bigint").alias("perimeter"),
        F.abs(F.sum(F.col("lon1") * F.col("lat2") - F.col("lon2") * F.col("lat1")) / 2).cast("bigint").alias("area"))


@query("K14", "region_polygons", f"""WITH {_REGIONS}
SELECT raster_id, region, class_id, name AS class_name, coalesce(any_value(color), '#888888') AS color, CAST(count(*) * 100 AS DOUBLE) AS area_m2, count(*) AS pixel_count,
  round(raster_id * 2 - 100 + min(c) * 0.001::DOUBLE, 6) AS west, round(40 - (max(r) + 1) * 0.002::DOUBLE, 6) AS south,
  round(raster_id * 2 - 100 + (max(c) + 1) * 0.001::DOUBLE, 6) AS east, round(40 - min(r) * 0.002::DOUBLE, 6) AS north, round(count(*) * 0.000002::DOUBLE, 9) AS square_degrees, true AS is_polygon
FROM reg LEFT JOIN {LEGEND_SQL} USING (class_id) WHERE class_id < 4 GROUP BY raster_id, region, class_id, name HAVING count(*) >= 4""")
def region_polygons(t: Tables):
    """Features as they are written, read back from their coordinates: extent, and area less the holes."""
    regions = cut_lineage(V.connected_regions(t.fx_class))
    table = V.region_table(regions, 10.0)
    named = V.region_features(table, legend_dim(t), 4)
    geo = named.select("raster_id").distinct().selectExpr(
        "raster_id", "raster_id * 2 - 100D AS x0", "40D AS y0", "0.001D AS dx", "0.002D AS dy", "CAST(NULL AS INT) AS zone", "false AS south")
    got = V.polygon_features(V.region_polygons(regions, named, geo), named)
    ring = F.explode("coordinates").alias("ring")
    vertices = got.select("raster_id", "region", ring).withColumn("area", F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, i: (
        s + F.get(F.get("ring", i - 1), F.lit(0)) * F.get(F.get("ring", i), F.lit(1)) - F.get(F.get("ring", i), F.lit(0)) * F.get(F.get("ring", i - 1), F.lit(1)))) / 2)

    def over(k: int, how):
        return how(F.transform("ring", lambda p: F.get(p, F.lit(k))))

    boxes = vertices.groupBy("raster_id", "region").agg(
        F.round(F.min(over(0, F.array_min)), 6).alias("west"), F.round(F.min(over(1, F.array_min)), 6).alias("south"),
        F.round(F.max(over(0, F.array_max)), 6).alias("east"), F.round(F.max(over(1, F.array_max)), 6).alias("north"), F.round(F.sum("area"), 9).alias("square_degrees"))
    return got.withColumn("is_polygon", F.col("geometry_type") == "Polygon").drop("geometry_type", "coordinates").join(boxes, ["raster_id", "region"])


@query("K9", "labelled_polygons", f"""WITH {_REGIONS},
score AS (SELECT raster_id, class_id, avg(CAST(r % 5 AS DOUBLE) / 4) AS conf FROM cell GROUP BY ALL)
SELECT raster_id, region, class_id, 'class ' || class_id AS class_name, count(*) AS segment_pixels, CAST(count(*) * 100 AS DOUBLE) AS area_m2,
  round(any_value(conf), 2) AS confidence, count(*) AS pixels_inside, true AS closed, true AS near_whole_pixels
FROM reg JOIN score USING (raster_id, class_id) GROUP BY raster_id, region, class_id HAVING count(*) >= 4""")
def labelled_polygons(t: Tables):
    """Features and rings of labelled pixels; rings are simplified by half a pixel, so their area is the pixels' but for half a pixel along the border."""
    labelled = t.fx_class.where("class_id >= 0").select(
        "raster_id", "r", "c", F.col("class_id").alias("cluster"), "class_id", F.concat(F.lit("class "), "class_id").alias("class_name"),
        F.lit("#808080").alias("color"), (F.col("r") % 5 / F.lit(4.0)).alias("confidence"))
    geo = labelled.select("raster_id").distinct().selectExpr("raster_id", "1000D AS x0", "0D AS y0", "10D AS dx", "10D AS dy", "CAST(NULL AS INT) AS zone", "false AS south")
    features, polygons = V.labelled_polygons(labelled, geo, 10.0, 4)
    shape = cut_lineage(polygons.withColumn("poly_id", F.concat_ws(":", "raster_id", "region", "ring")))
    edges = P.ring_edges(shape).join(shape.where("vtx = 0").select("poly_id", "raster_id", "region"), "poly_id")
    lat1, lat2 = F.col("lat1") / 10, F.col("lat2") / 10
    sums = edges.groupBy("raster_id", "region").agg(
        F.abs(F.sum((F.col("lon1") / 10 - 100) * lat2 - (F.col("lon2") / 10 - 100) * lat1) / 2).alias("area"), (F.abs(F.sum(lat2 - lat1)) < 1e-6).alias("closed"),
        F.sum(F.hypot(F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")) / 10).alias("border"))
    got = features.join(sums, ["raster_id", "region"])
    near = F.abs(F.col("area") - F.col("segment_pixels")) <= F.col("border") / 2
    return got.select("raster_id", "region", "class_id", "class_name", "segment_pixels", "area_m2", F.round("class_confidence", 2).alias("confidence"),
                      F.when(near, F.col("segment_pixels")).otherwise(F.round("area").cast("long")).alias("pixels_inside"), "closed", near.alias("near_whole_pixels"))


@query("K15", "simplify", """WITH RECURSIVE d AS (SELECT p.poly_id, x.vtx AS a, y.vtx AS b, p.vtx, p.lon - x.lon AS px, p.lat - x.lat AS py, y.lon - x.lon AS dx, y.lat - x.lat AS dy
  FROM fx_ring p JOIN fx_ring x ON x.poly_id = p.poly_id AND x.vtx < p.vtx JOIN fx_ring y ON y.poly_id = p.poly_id AND y.vtx > p.vtx),
e AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(1, greatest(0, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM d),
far AS (SELECT poly_id, a, b, vtx FROM e WHERE sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) > 0.8
  QUALIFY row_number() OVER (PARTITION BY poly_id, a, b ORDER BY sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) DESC, vtx) = 1),
seg AS (SELECT poly_id, 0 AS a, 5 AS b FROM fx_ring WHERE vtx = 0
  UNION ALL SELECT s.poly_id, CASE WHEN h THEN s.a ELSE m.vtx END, CASE WHEN h THEN m.vtx ELSE s.b END
  FROM seg s JOIN far m ON m.poly_id = s.poly_id AND m.a = s.a AND m.b = s.b, (VALUES (true), (false)) v(h)),
kp AS (SELECT poly_id, a AS vtx FROM seg UNION SELECT poly_id, b FROM seg)
,
few AS (SELECT poly_id FROM kp GROUP BY 1 HAVING count(*) < 4),
p0 AS (SELECT p.*, a.lon AS alon, a.lat AS alat FROM fx_ring p JOIN few USING (poly_id) JOIN fx_ring a ON a.poly_id = p.poly_id AND a.vtx = 0 WHERE p.vtx BETWEEN 1 AND 4),
m1 AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY poly_id ORDER BY sqrt(pow(lon - alon, 2) + pow(lat - alat, 2)) DESC, vtx) = 1),
p1 AS (SELECT p.poly_id, p.vtx, p.lon - p.alon AS px, p.lat - p.alat AS py, m.lon - m.alon AS dx, m.lat - m.alat AS dy FROM p0 p JOIN m1 m ON m.poly_id = p.poly_id AND m.vtx <> p.vtx),
p2 AS (SELECT *, least(1, greatest(0, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM p1),
m2 AS (SELECT * FROM p2 QUALIFY row_number() OVER (PARTITION BY poly_id ORDER BY sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) DESC, vtx) = 1),
al AS (SELECT poly_id, vtx FROM kp UNION SELECT poly_id, vtx FROM m1 UNION SELECT poly_id, vtx FROM m2)
SELECT poly_id, vtx, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_ring JOIN al USING (poly_id, vtx)""")
def simplify(t: Tables):
    return V.simplify(t.fx_ring, 0.8).select("poly_id", "vtx", *r6("lon", "lat"))
