"""Colour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.fixtures import Tables, values_sql
from geoloom.functions import color as C
from geoloom.operators import rasters as R
from geoloom.plans.rasters import LEGEND, LEGEND_SQL, PALETTE, legend_dim
from geoloom.registry import query

_STOPS = [(i, p0, p1, *C.rgb_of(c0), *C.rgb_of(c1)) for i, ((c0, p0), (c1, p1)) in enumerate(zip(C.DEFAULT_STOPS, C.DEFAULT_STOPS[1:]))]
_STOPS_SQL = values_sql(_STOPS) + " AS st(i, p0, p1, r0, g0, b0, r1, g1, b1)"


def _mix(x: str) -> str:
    return ", ".join(f"CAST(floor({c}0 + ({x} - p0) / (p1 - p0) * ({c}1 - {c}0)) AS INT) AS {n}"
                     for c, n in (("r", "red"), ("g", "green"), ("b", "blue")))


@query("J1", "hex_to_rgb", f"""SELECT raster_id, r, c, CAST(concat('0x', substr(color, 2, 2)) AS INT) AS red, CAST(concat('0x', substr(color, 4, 2)) AS INT) AS green,
  CAST(concat('0x', substr(color, 6, 2)) AS INT) AS blue FROM (SELECT raster_id, r, c, coalesce(color, '#888888') AS color FROM fx_class LEFT JOIN {LEGEND_SQL} USING (class_id))""")
def hex_to_rgb(t: Tables):
    px = R.with_legend(t.fx_class, legend_dim(t))
    return px.select("raster_id", "r", "c", C.hex_to_rgb(F.col("color")).alias("x")).select("raster_id", "r", "c", "x.*")


@query("J2", "gradient", f"""WITH v AS (SELECT raster_id, r, c, class_id, least(1, greatest(0, (scalar - 1000) / 800)) AS x FROM fx_class),
m AS (SELECT raster_id, r, c, {_mix('x')}, 210 AS alpha FROM v, {_STOPS_SQL} WHERE class_id <> -1 AND x >= p0 AND x <= p1
  QUALIFY row_number() OVER (PARTITION BY raster_id, r, c ORDER BY i) = 1)
SELECT raster_id, r, c, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(alpha, 0) AS alpha
FROM v LEFT JOIN m USING (raster_id, r, c)""")
def gradient(t: Tables):
    x = F.when(F.col("class_id") != -1, (F.col("scalar") - 1000) / 800)
    return t.fx_class.select("raster_id", "r", "c", C.gradient(x).alias("x")).select("raster_id", "r", "c", "x.*")


@query("J3", "class_color", f"""SELECT raster_id, r, c, CASE WHEN class_id < 0 THEN 0 ELSE CAST(concat('0x', substr(color, 2, 2)) AS INT) END AS red,
  CASE WHEN class_id < 0 THEN 0 ELSE CAST(concat('0x', substr(color, 4, 2)) AS INT) END AS green, CASE WHEN class_id < 0 THEN 0 ELSE CAST(concat('0x', substr(color, 6, 2)) AS INT) END AS blue,
  CASE WHEN class_id < 0 THEN 0 ELSE 210 END AS alpha FROM fx_class LEFT JOIN {values_sql([(a, d) for a, _, d in LEGEND])} lg(k, color) ON k = least(class_id, 3)""")
def class_color(t: Tables):
    return t.fx_class.select("raster_id", "r", "c", C.class_rgba(F.col("class_id"), PALETTE).alias("x")).select("raster_id", "r", "c", "x.*")


@query("J4", "stretch", """WITH b AS (SELECT scene_id, quantile_cont(b08, 0.02) AS lo, quantile_cont(b08, 0.98) AS hi FROM fx_px WHERE b08 <> 0 GROUP BY 1),
p AS (SELECT scene_id, CAST(floor(least(1, greatest(0, (b08 - lo) / greatest(1e-9, hi - lo))) * 255) AS INT) AS level FROM fx_px JOIN b USING (scene_id))
SELECT scene_id, level, count(*) AS n FROM p GROUP BY ALL""")
def stretch(t: Tables):
    px = t.fx_px
    b = R.band_stretch_bounds(px, ["scene_id"], ["b08"]).drop("band")
    got = px.join(b, "scene_id").select("scene_id", C.stretch(F.col("b08"), F.col("lo"), F.col("hi")).alias("level"))
    return got.groupBy("scene_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("J4", "stretch_uint8", """WITH p AS (SELECT scene_id, r, c, month, CASE WHEN scene_id % 4 = 0 THEN b04 / 6000 ELSE b04 END AS a, CASE WHEN scene_id % 4 = 0 THEN b08 / 12000 ELSE b08 END AS b FROM fx_px),
m AS (SELECT scene_id, max(greatest(a, b)) AS top FROM p GROUP BY 1), l AS (SELECT scene_id, a AS v FROM p WHERE a > 0 UNION ALL SELECT scene_id, b FROM p WHERE b > 0),
k AS (SELECT scene_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM l GROUP BY 1),
o AS (SELECT scene_id, CASE WHEN top <= 1 THEN floor(a * 255) ELSE floor(least(255, greatest(0, (a - lo) / (hi - lo + 1e-8) * 255))) END AS x,
  CASE WHEN top <= 1 THEN floor(b * 255) ELSE floor(least(255, greatest(0, (b - lo) / (hi - lo + 1e-8) * 255))) END AS y FROM p JOIN m USING (scene_id) JOIN k USING (scene_id))
SELECT scene_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS n FROM o GROUP BY ALL""")
def stretch_uint8(t: Tables):
    small = F.col("scene_id") % 4 == 0
    px = t.fx_px.select("scene_id", F.when(small, F.col("b04") / 6000).otherwise(F.col("b04")).alias("x"), F.when(small, F.col("b08") / 12000).otherwise(F.col("b08")).alias("y"))
    return R.stretch_uint8(px, ["scene_id"], ["x", "y"]).groupBy("scene_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("J5", "fade_to_white", "SELECT pid, " + ", ".join(f"CAST(floor({v} * confidence + 255 * (1 - confidence)) AS INT) AS {n}" for v, n in ((34, "red"), (139, "green"), (200, "blue"))) + " FROM fx_point")
def fade_to_white(t: Tables):
    return t.fx_point.select("pid", *[C.fade_to_white(F.lit(v), F.col("confidence")).alias(n) for v, n in ((34, "red"), (139, "green"), (200, "blue"))])


_MAPS = list(C.COLORMAPS)
_MAP_STOPS = values_sql([(m, i, p0, p1, *C.rgb_of(c0), *C.rgb_of(c1)) for m, (_, stops) in C.COLORMAPS.items()
                         for i, ((c0, p0), (c1, p1)) in enumerate(zip(stops, stops[1:]))]) + " AS st(map, i, p0, p1, r0, g0, b0, r1, g1, b1)"
_MAP_LABELS = values_sql([(m, label, ", ".join(f"{c} {p}" for c, p in stops)) for m, (label, stops) in C.COLORMAPS.items()]) + " AS ml(map, label, stops)"


@query("J6", "legend", f"""WITH h AS (SELECT p_brand, CAST(count(DISTINCT p_size) AS INT) AS n, list_extract({_MAPS}, CAST(sum(p_size) % 7 AS INT) + 1) AS map, CAST(substr(p_brand, length(p_brand), 1) AS INT) AS last, sum(p_size) AS total FROM part GROUP BY 1),
k AS (SELECT p_brand, n, map, last, CAST(unnest(range(n)) AS INT) AS idx FROM h WHERE last <> 5), x AS (SELECT *, idx / greatest(1, n - 1) AS x FROM k),
m AS (SELECT p_brand, idx, n, last, {_mix('x')} FROM x JOIN {_MAP_STOPS} USING (map) WHERE x >= p0 AND x <= p1 QUALIFY row_number() OVER (PARTITION BY p_brand, idx ORDER BY i) = 1)
SELECT p_brand, 'classification' AS kind, idx AS index, CASE WHEN last % 2 = 0 AND idx < 4 THEN list_extract({[d for _, _, d in LEGEND]}, idx + 1)
  ELSE lower(printf('#%02x%02x%02x', red, green, blue)) END AS color, NULL::VARCHAR AS label, NULL::VARCHAR AS stops, NULL::VARCHAR AS units, NULL::DOUBLE AS value FROM m
UNION ALL SELECT p_brand, 'regression', NULL, NULL, label, stops, '%', CAST(total AS DOUBLE) FROM h JOIN {_MAP_LABELS} USING (map) WHERE last = 5""")
def legend(t: Tables):
    """A row per class of a classification head, and one with label, stops, units and value of a regression head."""
    heads = t.part.groupBy("p_brand").agg(F.count_distinct("p_size").cast("int").alias("num_classes"), F.sum("p_size").alias("total"))
    heads = heads.withColumns({"map": F.get(F.array(*[F.lit(m) for m in _MAPS]), (F.col("total") % 7).cast("int")), "last": F.substring("p_brand", -1, 1).cast("int")})
    classes = heads.where("last <> 5").withColumn("published", F.when(F.col("last") % 2 == 0, F.array(*[F.lit(c) for c in PALETTE])))
    named = C.class_legend(classes, "map", "num_classes", "published")
    rest = C.regression_legend(heads.where("last = 5").withColumns({"units": F.lit("%"), "value": F.col("total").cast("double")}), "map")
    empty = {c: F.lit(None).cast(k) for c, k in (("label", "string"), ("stops", "string"), ("units", "string"), ("value", "double"))}
    a = named.withColumns({"kind": F.lit("classification"), **empty}).select("p_brand", "kind", "index", "color", "label", "stops", "units", "value")
    b = rest.withColumns({"kind": F.lit("regression"), "index": F.lit(None).cast("int"), "color": F.lit(None).cast("string")}).select(a.columns)
    return a.unionByName(b)


# Names that are default tags, custom tags and others; the colours are written out as the labelling page has them.
_TAGGED = "tg AS (SELECT p_partkey, CASE p_size % 12 WHEN 0 THEN 'Forest' WHEN 1 THEN 'Cropland' WHEN 2 THEN 'Urban' WHEN 3 THEN 'Water' WHEN 4 THEN 'Grassland' WHEN 5 THEN 'Barren' WHEN 6 THEN 'Wetland' WHEN 7 THEN 'Snow/Ice' WHEN 8 THEN 'Solar' WHEN 9 THEN 'Road' ELSE p_name END AS name FROM part)"


@query("J7", "tag_color", f"""WITH {_TAGGED},
h AS (SELECT p_partkey, name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM tg)
SELECT p_partkey, h AS hash, CASE name WHEN 'Forest' THEN '#228b22' WHEN 'Cropland' THEN '#f0e68c' WHEN 'Urban' THEN '#808080' WHEN 'Water' THEN '#1e90ff'
  WHEN 'Grassland' THEN '#90ee90' WHEN 'Barren' THEN '#d2b48c' WHEN 'Wetland' THEN '#5f9ea0' WHEN 'Snow/Ice' THEN '#f0f8ff' WHEN 'Solar' THEN '#e11d48' WHEN 'Road' THEN '#7c3aed'
  ELSE list_extract(['#e11d48', '#7c3aed', '#0891b2', '#16a34a', '#ea580c', '#db2777', '#0ea5e9', '#65a30d'], CAST(h % 8 AS INT) + 1) END AS color FROM h""")
def tag_color(t: Tables):
    size = F.col("p_size") % 12
    tags = [*C.TAG_COLORS, "Solar", "Road"]
    name = F.coalesce(F.get(F.array(*[F.lit(x) for x in tags]), size), F.col("p_name"))
    return t.part.select("p_partkey", name.alias("n")).select(
        "p_partkey", C.tag_hash(F.col("n")).alias("hash"), C.tag_color(F.col("n"), ["Solar", "Road"]).alias("color"))
