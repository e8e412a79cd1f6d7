"""Source, sink, registry, dispatch and report queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.fixtures import Tables, values_sql
from geoloom.functions import sqlfuncs, text as X
from geoloom.functions import vector as VF
from geoloom.functions.geo import bbox_area_km2
from geoloom.operators import catalog as K
from geoloom.operators import grids as G
from geoloom.operators import rasters as R
from geoloom.plans import rasters as PR
from geoloom.plans import vectors as PV
from geoloom.plans.rasters import LEGEND_SQL, legend_dim, r6
from geoloom.registry import query
from geoloom.sources import files as S
from geoloom.sources import sinks as W
from geoloom.tools import check_calls

_EXT = values_sql(list(S.EXTENSIONS.items())) + " AS ex(ext, fmt)"
_FMT = f"""fm AS (SELECT f.*, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS e, CASE WHEN fmt = 'parquet' AND file_id % 24 = 4 THEN 'geoparquet' ELSE coalesce(fmt, 'unknown') END AS format
   FROM fx_file f LEFT JOIN {_EXT} ON ext = lower(regexp_extract(name, '\\.([^./]+)$', 1)))"""


@query("A1", "detect_format", f"WITH {_FMT} SELECT file_id, format FROM fm")
def detect_format(t: Tables):
    return t.fx_file.select("file_id", S.detect_format(F.col("name"), F.col("file_id") % 24 == 4).alias("format"))


_MAGIC = values_sql([(p, ",".join(f)) for p, f in S.MAGIC]) + " AS mg(prefix, fmts)"
_SNIFF = f"""sn AS (SELECT f.file_id, coalesce(fmts, CASE WHEN length(head_hex) >= 8 AND regexp_matches(head_hex, '^(?:20|09|0D|0A)*(?:7B|5B)') THEN 'geojson' ELSE '' END) AS sniffed
   FROM fx_file f LEFT JOIN {_MAGIC} ON starts_with(head_hex, prefix) AND length(head_hex) >= 8)"""


@query("A2", "sniff_magic", f"WITH {_SNIFF} SELECT file_id, sniffed FROM sn")
def sniff_magic(t: Tables):
    return t.fx_file.select("file_id", F.array_join(S.sniff_magic(F.col("head_hex")), ",").alias("sniffed"))


@query("A3", "quarantine_mismatch", f"""WITH {_SNIFF}, fm AS (SELECT f.*, coalesce(fmt, 'unknown') AS format, ext FROM fx_file f LEFT JOIN {_EXT} ON ext = lower(regexp_extract(name, '\\.([^./]+)$', 1)))
SELECT file_id, CASE WHEN contains(name, '/') THEN 'unsafe_name' WHEN format = 'unknown' THEN 'unsupported_format' WHEN size * 100000 > 524288000 THEN 'too_large'
  WHEN sniffed <> '' AND NOT list_contains(string_split(sniffed, ','), format) AND ext <> 'csv' THEN 'format_mismatch' ELSE 'ok' END AS status FROM fm JOIN sn USING (file_id)""")
def quarantine(t: Tables):
    files = t.fx_file.withColumn("size", F.col("size").cast("bigint") * 100000)
    return S.quarantine_mismatch(files).select("file_id", "status")


@query("A4", "read_points_csv", "SELECT pid, class_name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_point")
def read_points_csv(t: Tables):
    path = W.scratch_path(t.spark, "points")
    t.fx_point.select("pid", "class_name", F.col("lat").alias("Latitude"), F.col("lon").alias("lng")).write.csv(path, header=True)
    return S.read_points_csv(t.spark, path).select(F.col("pid").cast("bigint").alias("pid"), "class_name", *r6("lon", "lat"))


def _geojson(t: Tables):
    path = W.scratch_path(t.spark, "features")
    pts = t.fx_point.select(F.lit("Point").alias("geometry_type"), F.array("lon", "lat").alias("coordinates"), "pid", "class_name")
    W.write_geojson(pts, path, source="customers")
    return path


@query("A5", "read_geojson", "SELECT 'Point' AS geometry_type, c_custkey AS pid, class_name, 'customers' AS source, round(lon, 6) AS lon FROM (SELECT pid AS c_custkey, class_name, lon FROM fx_point)")
def read_geojson(t: Tables):
    got = S.read_geojson(t.spark, _geojson(t), lines=True)
    prop = {"pid": "bigint", "class_name": "string", "source": "string"}
    return got.select("geometry_type", *[F.variant_get("properties", f"$.{k}", v).alias(k) for k, v in prop.items()],
                      F.round(F.from_json("coordinates", "array<double>")[0], 6).alias("lon"))


@query("A15", "write_geojson", "SELECT count(*) AS n, CAST(sum(pid) AS BIGINT) AS ids FROM fx_point")
def write_geojson(t: Tables):
    lines = t.spark.read.text(_geojson(t))
    pid = F.get_json_object("value", "$.properties.pid").cast("bigint")
    return lines.agg(F.count(F.lit(1)).alias("n"), F.sum(pid).alias("ids"))


@query("A6", "read_geoparquet", "SELECT pid, 'Point' AS geometry_type, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_point")
def read_geoparquet(t: Tables):
    path = W.scratch_path(t.spark, "geoparquet")
    W.write_geoparquet(t.fx_point.select("pid", "lon", "lat"), path)
    got = S.read_geoparquet(t.spark, path)
    return got.select("pid", "geometry_type", F.round(F.col("rings")[0][0][0], 6).alias("lon"), F.round(F.col("rings")[0][0][1], 6).alias("lat"))


@query("A15", "feature_collection", """
SELECT poly_id, 'Polygon' AS geometry_type, 'surveys' AS source, CAST(count(*) AS BIGINT) AS n_positions, round(min(lon), 6) AS west, round(max(lat), 6) AS north,
  round(sum(lon * vtx), 4) AS x, round(sum(lat * vtx), 4) AS y FROM fx_ring GROUP BY 1""")
def feature_collection(t: Tables):
    """Whole bodies, read back as collections, compared by their geometry."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("vtx", F.array("lon", "lat").alias("p")))), lambda v: v["p"])
    rings = t.fx_ring.groupBy("poly_id").agg(F.array(ring).alias("coordinates")).select("poly_id", F.lit("Polygon").alias("geometry_type"), "coordinates")
    path = W.scratch_path(t.spark, "collections")
    W.write_feature_collection(rings.repartition(3), path, source="surveys", scene="S2 \"A\"")
    got = S.read_geojson(t.spark, path).withColumn("p", F.from_json("coordinates", "array<array<array<double>>>")[0])

    def over(k: int) -> Column:
        return F.transform("p", lambda p: F.get(p, F.lit(k)))

    def weighed(k: int) -> Column:
        return F.round(F.aggregate(F.transform(over(k), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x), 4)

    return got.select(F.variant_get("properties", "$.poly_id", "bigint").alias("poly_id"), "geometry_type", F.variant_get("properties", "$.source", "string").alias("source"),
                      F.size("p").cast("bigint").alias("n_positions"), F.round(F.array_min(over(0)), 6).alias("west"), F.round(F.array_max(over(1)), 6).alias("north"),
                      weighed(0).alias("x"), weighed(1).alias("y"))


_KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


@query("A6", "read_geoparquet_kinds", f"""
WITH k AS (SELECT poly_id, vtx, lon, lat, ['{"', '".join(_KINDS)}'][1 + poly_id % 6] AS kind, (poly_id // 6) % 4 AS d FROM fx_ring),
v AS (SELECT k.*, p AS part FROM k, (VALUES (0), (1)) w(p) WHERE p = 0 OR kind LIKE 'Multi%' AND kind <> 'MultiPoint')
SELECT poly_id, kind AS geometry_type, ['XY', 'XYZ', 'XYM', 'XYZM'][1 + d] AS dims, CAST(count(*) FILTER (WHERE kind <> 'Point' OR vtx = 0) AS BIGINT) AS n_positions,
  CAST(max(CASE kind WHEN 'MultiPoint' THEN vtx ELSE part END) + 1 AS BIGINT) AS n_parts,
  round(sum(CASE WHEN kind <> 'Point' OR vtx = 0 THEN lon + 100 * part END), 4) AS x, round(sum(CASE WHEN kind <> 'Point' OR vtx = 0 THEN lat END), 4) AS y,
  round(CAST(sum(CASE WHEN kind <> 'Point' OR vtx = 0 THEN CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 * vtx + 7 ELSE vtx END END) AS DOUBLE), 4) AS other
FROM v GROUP BY ALL""")
def read_geoparquet_kinds(t: Tables):
    """Every kind and dimension, written and read back through the reader."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("poly_id") % 6 + 1).cast("int"))
    d = F.floor(F.col("poly_id") / 6) % 4
    more = F.when(d == 0, F.array().cast("array<double>")).when(d == 3, F.array(F.col("vtx").cast("double"), F.col("vtx") + F.lit(7.0))).otherwise(F.array(F.col("vtx").cast("double")))
    line = t.fx_ring.groupBy("poly_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vtx", F.concat(F.array("lon", "lat"), more).alias("p")))), lambda v: v["p"]).alias("line"))
    moved = F.transform("line", lambda p: F.concat(F.array(p[0] + 100), F.slice(p, F.lit(2), F.size(p))))
    parts = (F.when(kind == "Point", F.array(F.array(F.slice("line", 1, 1)))).when(kind == "MultiPoint", F.transform("line", lambda p: F.array(F.array(p))))
             .when(kind.startswith("Multi"), F.array(F.array(F.col("line")), F.array(moved))).otherwise(F.array(F.array(F.col("line")))))
    dims = F.element_at(F.array(*[F.lit(x) for x in ("XY", "XYZ", "XYM", "XYZM")]), (d + 1).cast("int"))
    path = W.scratch_path(t.spark, "geometries")
    W.write_geometries(line.select("poly_id", kind.alias("geometry_type"), dims.alias("dims"), parts.alias("parts")), path)
    got = S.read_geoparquet(t.spark, path).withColumn("p", F.flatten("rings"))

    def total(of) -> Column:
        return F.round(F.aggregate("p", F.lit(0.0), lambda s, p: s + of(p)), 4)

    return got.select("poly_id", "geometry_type", "dims", F.size("p").cast("bigint").alias("n_positions"), F.size("parts").cast("bigint").alias("n_parts"),
                      total(lambda p: p[0]).alias("x"), total(lambda p: p[1]).alias("y"), total(lambda p: F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)) + F.coalesce(F.get(p, F.lit(3)), F.lit(0.0))).alias("other"))


@query("A8", "vector_profile", """SELECT 'Polygon' AS geometry_type, count(DISTINCT poly_id) AS feature_count, round(min(lon), 6) AS west, round(min(lat), 6) AS south,
  round(max(lon), 6) AS east, round(max(lat), 6) AS north, 'poly_id,vtx,lon,lat' AS columns, min(poly_id) AS sample_id FROM fx_ring
UNION ALL SELECT 'LineString', count(DISTINCT poly_id), round(min(lon), 6), round(min(lat), 6), round(max(lon), 6), round(max(lat), 6), 'poly_id,vtx,lon,lat', min(poly_id) FROM fx_ring WHERE vtx < 5
UNION ALL SELECT 'Point', count(*), round(min(lon), 6), round(min(lat), 6), round(max(lon), 6), round(max(lat), 6), 'poly_id,vtx,lon,lat', min(pid) FROM fx_point
UNION ALL SELECT 'Mixed', (SELECT count(DISTINCT poly_id) FROM fx_ring), round(min(lon), 6), round(min(lat), 6), round(max(lon), 6), round(max(lat), 6), 'poly_id,vtx,lon,lat', min(poly_id)
  FROM fx_ring WHERE NOT (vtx > 0 AND poly_id % 2 = 0)""")
def vector_profile(t: Tables):
    ring = t.fx_ring
    point = t.fx_point.select(F.col("pid").alias("poly_id"), F.lit(0).alias("vtx"), "lon", "lat")
    shapes = (ring, ring.where("vtx < 5"), point, ring.where("NOT (vtx > 0 AND poly_id % 2 = 0)"))
    out = None
    for s in shapes:
        got = S.vector_profile(s, "poly_id").select("geometry_type", "feature_count", *r6("west", "south", "east", "north"),
                                                    "columns", F.col("sample.poly_id").alias("sample_id"))
        out = got if out is None else out.unionByName(got)
    return out


@query("A9", "array_profile", """SELECT event_type AS variable, count(*) AS n_values, CAST(min(ts) AS DATE) AS first_time, CAST(max(ts) AS DATE) AS last_time,
  count(DISTINCT job_id) AS dim_job_id, min(job_id) AS min_job_id, max(job_id) AS max_job_id FROM fx_outcome GROUP BY 1""")
def array_profile(t: Tables):
    got = S.array_profile(t.fx_outcome.withColumnRenamed("event_type", "variable"), ["job_id"], "ts")
    return got.withColumn("first_time", F.to_date("first_time")).withColumn("last_time", F.to_date("last_time"))


@query("A10", "point_cloud_profile", """SELECT count(*) AS n_points, round(min(lon), 6) AS min_x, round(max(lon), 6) AS max_x, round(min(lat), 6) AS min_y,
  round(max(lat), 6) AS max_y, true AS has_z, false AS has_gps_time FROM fx_point""")
def point_cloud_profile(t: Tables):
    pts = t.fx_point.select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("confidence").alias("z"), F.lit(None).cast("double").alias("gps_time"))
    return S.point_cloud_profile(pts).select("n_points", *r6("min_x", "max_x", "min_y", "max_y"), "has_z", "has_gps_time")


@query("A11", "preview_features", """SELECT pid, class_name, concat('{"lon":', CAST(CAST(floor(lon) AS INT) AS VARCHAR), '}') AS place FROM fx_point ORDER BY pid LIMIT 500""")
def preview_features(t: Tables):
    f = t.fx_point.select("pid", "class_name", F.struct(F.floor("lon").cast("int").alias("lon")).alias("place"))
    return S.preview_features(f, "pid")


@query("A12", "bbox_to_feature", """SELECT scene_id, i, round(CASE WHEN i IN (0, 3, 4) THEN west ELSE east END, 6) AS lon, round(CASE WHEN i IN (0, 1, 4) THEN south ELSE north END, 6) AS lat,
  'Feature' AS type FROM fx_scene, (VALUES (0), (1), (2), (3), (4)) v(i)""")
def bbox_to_feature(t: Tables):
    f = S.bbox_to_feature(t.fx_scene)
    return f.select("scene_id", F.get_json_object("feature", "$.type").alias("type"), F.posexplode("ring").alias("i", "p")).select(
        "scene_id", "type", "i", F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"))


def _log(t: Tables):
    return t.documents.select(F.concat("source", F.lit("/"), (F.col("doc_id") % 13).cast("string")).alias("filename"),
                              F.col("n_chars").alias("uploaded_at"), F.col("doc_id").alias("version"), "lang",
                              F.when(F.col("doc_id") % 9 == 0, "delete").otherwise("upsert").alias("op"))


@query("A13", "dataset_registry", """
WITH l AS (SELECT concat(source, '/', CAST(doc_id % 13 AS VARCHAR)) AS filename, n_chars AS uploaded_at, doc_id AS version, lang, doc_id % 9 = 0 AS gone FROM documents)
SELECT filename, uploaded_at, version, lang FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY filename ORDER BY uploaded_at DESC, version DESC) = 1) WHERE NOT gone""")
def dataset_registry(t: Tables):
    return K.newest_first(K.latest(_log(t), "filename", "uploaded_at"), "uploaded_at", "filename")


def _projects(t: Tables):
    return t.fx_project.select("id", "name", "state_json", F.col("version").alias("created_at"), F.col("version").alias("updated_at"))


def _upserted(t: Tables):
    new = t.fx_project.where("version >= 800").select(
        F.when(F.col("version") >= 3000, F.col("id") + 1000000).otherwise(F.col("id")).alias("id"), F.concat(F.lit("New "), "name").alias("name"),
        "state_json", (F.col("version") + 7).alias("created_at"), (F.col("version") + 9).alias("updated_at"))
    return K.upsert_projects(_projects(t), new)


_UPS = """nw AS (SELECT CASE WHEN version >= 3000 THEN id + 1000000 ELSE id END AS id, concat('New ', name) AS name, version + 7 AS created_at, version + 9 AS updated_at FROM fx_project WHERE version >= 800),
up AS (SELECT coalesce(n.id, p.id) AS id, coalesce(n.name, p.name) AS name, coalesce(p.version, n.created_at) AS created_at, coalesce(n.updated_at, p.version) AS updated_at
  FROM fx_project p FULL JOIN nw n ON n.id = p.id)"""


@query("A14", "projects_upsert", f"WITH {_UPS} SELECT * FROM up")
def projects_upsert(t: Tables):
    return _upserted(t).drop("state_json")


@query("A14", "projects_search", f"WITH {_UPS} SELECT * FROM up WHERE contains(lower(name), 'new src1')")
def projects_search(t: Tables):
    return K.search_projects(_upserted(t), "NEW src1").drop("state_json")


@query("A14", "projects_delete", f"WITH {_UPS} SELECT id, name FROM up WHERE id NOT IN (SELECT doc_id FROM labels)")
def projects_delete(t: Tables):
    return K.delete_rows(_upserted(t), t.labels.select(F.col("doc_id").alias("id")), "id").select("id", "name")


@query("H3", "page", "SELECT id, name, version AS updated_at FROM fx_project ORDER BY updated_at DESC, id LIMIT 50 OFFSET 20")
def page(t: Tables):
    return K.newest_first(_projects(t), "updated_at", "id", 50, 20).select("id", "name", "updated_at")


@query("S13", "project_state", """SELECT id, CASE WHEN id % 5 <> 0 THEN version END AS n, CASE WHEN id % 5 = 0 THEN '{}' ELSE concat('{"n":', CAST(version AS VARCHAR), '}') END AS text FROM fx_project""")
def project_state(t: Tables):
    text = F.when(F.col("id") % 10 == 0, " ").when(F.col("id") % 5 != 0, F.col("state_json"))
    s = K.project_state(text, "n bigint")
    return t.fx_project.select("id", s["n"].alias("n"), F.to_json(s).alias("text"))


@query("A16", "write_timeseries_csv", PR._D4 + """SELECT status, count(*) AS n, CAST(sum(n_pixels) AS BIGINT) AS pixels, strftime(min(month), '%Y-%m') AS first_month,
  min(CASE status WHEN 'no_scene' THEN 'no scene in this month' WHEN 'too_cloudy' THEN printf('scene cloud cover %.1f%% exceeds 10%% threshold', cloud_cover) END) AS detail
FROM ts GROUP BY status""")
def write_timeseries_csv(t: Tables):
    path = W.scratch_path(t.spark, "series")
    W.write_timeseries_csv(PR._timeseries(t), path)
    got = t.spark.read.csv(path, header=True, schema="aoi_id int, month string, status string, scene_id bigint, scene_datetime string,"
                           " scene_cloud_cover double, ndvi_mean double, ndvi_median double, ndvi_p10 double, ndvi_p90 double,"
                           " n_pixels bigint, detail string")
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_pixels").alias("pixels"),
                                     F.min("month").alias("first_month"), F.min("detail").alias("detail"))


@query("A17", "write_raster", "SELECT raster_id, CAST(class_id AS INT) AS value, count(*) AS n, 7 AS tags FROM fx_class GROUP BY 1, 2")
def write_raster(t: Tables):
    path = W.scratch_path(t.spark, "raster")
    W.write_raster(t.fx_class, path, "class_id", legend_dim(t), 16, crs="EPSG:32610", model="sample", task="classes", gsd="10", units="none", date="2024")
    tags = t.spark.read.parquet(f"{path}/tags").agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return (t.spark.read.parquet(f"{path}/pixels").groupBy("raster_id", F.col("value").cast("int").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).withColumn("tags", tags))


@query("A18", "write_embeddings", f"WITH {PV._QUANT} SELECT raster_id, count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM qz GROUP BY 1")
def write_embeddings(t: Tables):
    path = W.scratch_path(t.spark, "bands")
    p = PV.patches(t)
    bands = p.select("raster_id", "r", "c", VF.quantize_int8(F.col("embedding"), VF.is_nodata(F.col("embedding"))).alias("bands"))
    W.write_embeddings(bands, path, PV.DIM, model="sample")
    q = t.spark.read.parquet(f"{path}/bands").select("raster_id", F.explode("bands").alias("q"))
    return q.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"))


@query("A19", "artifact_sweep", """
WITH f AS (SELECT event_type, regexp_replace(concat(event_type, ' ', CAST(event_id AS VARCHAR), '.tif'), '[^A-Za-z0-9._-]', '_', 'g') AS filename, CAST(event_id AS DOUBLE) AS mt, user_id AS size FROM events),
x AS (SELECT filename, CASE WHEN event_type = 'view' THEN 'orphan' ELSE 'expired' END AS why, size FROM f WHERE mt < 5000)
SELECT why, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY why""")
def artifact_sweep(t: Tables):
    name = K.safe_name(F.concat_ws(" ", "event_type", F.concat(F.col("event_id").cast("string"), F.lit(".tif"))))
    files = t.events.select("event_id", "event_type", name.alias("filename"), F.col("event_id").cast("double").alias("mtime"), F.col("user_id").alias("size"))
    index = files.where("event_type <> 'view'").select(F.col("event_id").alias("artifact_id"), "filename", F.col("mtime").alias("created_at"))
    return K.sweep_totals(K.sweep(index, files, 20000.0, 15000.0))


@query("A21", "catalog_merge", """
SELECT concat('hub/', CAST(p_partkey AS VARCHAR)) AS repo_id, p_size AS downloads, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS task,
  p_brand AS tier, 'live' AS origin FROM part WHERE p_size > 25""")
def catalog_merge(t: Tables):
    rid = F.concat(F.lit("hub/"), F.col("p_partkey").cast("string"))
    live = t.part.where("p_size > 25").select(rid.alias("repo_id"), F.col("p_size").alias("downloads"),
                                                    F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("task"))
    static = t.part.select(rid.alias("repo_id"), F.col("p_type").alias("task"), F.col("p_brand").alias("tier"))
    return K.catalog_merge(live, static)


_FEAT = """ft AS (SELECT CASE WHEN pid % 2 = 0 THEN concat('f', CAST(pid * 3 AS VARCHAR)) END AS id, concat('p', CAST(pid AS VARCHAR)) AS polygon_id, pid AS pos FROM fx_point),
rq AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN concat('f', CAST(o_custkey AS VARCHAR)) WHEN 1 THEN concat('p', CAST(o_custkey AS VARCHAR))
   WHEN 2 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' END AS key FROM orders)"""


@query("B8", "find_feature", f"""WITH {_FEAT}
SELECT request_id, rq.key, coalesce(a.pos, b.pos, c.pos) AS pos, coalesce(a.pos, b.pos, c.pos) IS NOT NULL AS found FROM rq
LEFT JOIN ft a ON a.id = rq.key LEFT JOIN ft b ON b.polygon_id = rq.key LEFT JOIN ft c ON CAST(c.pos AS VARCHAR) = rq.key""")
def find_feature(t: Tables):
    f = t.fx_point.select(F.when(F.col("pid") % 2 == 0, F.concat(F.lit("f"), F.col("pid") * 3)).alias("id"),
                          F.concat(F.lit("p"), F.col("pid")).alias("polygon_id"), F.col("pid").alias("pos"))
    k, cust = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    rq = t.orders.select(F.col("o_orderkey").alias("request_id"), F.when(k == 0, F.concat(F.lit("f"), cust)).when(
        k == 1, F.concat(F.lit("p"), cust)).when(k == 2, cust).otherwise("x").alias("key"))
    return K.find_feature(rq, f).drop("id")


_HEADS = [("1-URGENT", 4, True, False), ("2-HIGH", 12, False, False), ("3-MEDIUM", 1, False, False), ("5-LOW", 12, False, True)]


@query("B10", "task_dispatch", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 <> 0 THEN 'pre_post' WHEN o_orderpriority = '2-HIGH' THEN 'temporal' ELSE 'single_scene' END AS route,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 THEN 'event date is missing' WHEN o_orderpriority = '5-LOW' THEN 'radar input is missing' END AS warning FROM orders""")
def task_dispatch(t: Tables):
    jobs = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("head"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("event_date"))
    return K.task_dispatch(jobs, t.values("head, n_periods, pre_post_split, s1_required", _HEADS)).select("o_orderkey", "route", "warning")


_REASONS = {"click": "ValueError: effectively all-zero input", "error": "values outside expected DN range; NaN found",
            "view": "No Sentinel scenes in window", "signup": "timeout"}


@query("B11", "suggest_retries", """
SELECT event_id, action, params FROM events, (VALUES ('click', 'widen_dates', '{"date_range":"2024-03-01/2024-09-30"}'), ('click', 'one_window', '{"sliding_window":false}'),
  ('view', 'widen_dates', '{"date_range":"2024-03-01/2024-09-30"}'), ('view', 'one_window', '{"sliding_window":false}'), ('error', 'other_area_or_dates', '{}'), ('error', 'retry_once', '{}'),
  ('signup', 'smaller_input', '{"max_size_px":128}'), ('purchase', 'smaller_input', '{"max_size_px":128}')) v(et, action, params)
WHERE et = event_type AND (action <> 'one_window' OR user_id % 2 = 0)""")
def suggest_retries(t: Tables):
    reason = F.create_map(*[F.lit(x) for kv in _REASONS.items() for x in kv])[F.col("event_type")]
    return K.suggest_retries(t.events.select("event_id", reason.alias("reason"), (F.col("user_id") % 2 == 0).alias("sliding_window"))).select(
        "event_id", "action", "params")


_KEYWORDS = [("blue", "m-blue"), ("ring", "m-ring"), ("economy", "m-economy"), ("small", "m-small"), ("hot", "m-hot")]
_FIRST = "CASE " + " ".join(f"WHEN contains(task, '{k}') THEN '{m}'" for k, m in _KEYWORDS) + " END"


@query("G7", "first_match", f"WITH p AS (SELECT p_partkey, lower(concat(p_name, ' ', p_type)) AS task FROM part) SELECT p_partkey, {_FIRST} AS model FROM p")
def first_match(t: Tables):
    return t.part.select("p_partkey", K.first_match(F.concat_ws(" ", "p_name", "p_type"), _KEYWORDS).alias("model"))


def _catalog(t: Tables):
    """A head per second word of the part names, in order, and two encoders; the words of some are aliases only."""
    word = F.element_at(F.split("p_name", " "), 2)
    heads = t.part.select(word.alias("w")).distinct().select(
        F.concat(F.lit("1"), "w").alias("pos"), F.concat(F.lit("m-"), "w").alias("repo_id"), F.when(F.col("w") > "k", "fine-tuned").otherwise("legacy").alias("type"),
        F.col("w").alias("task_key"), F.concat("w", F.lit(" mapping")).alias("task"), F.lit(None).cast("string").alias("size_tier"))
    rest = t.values("pos, repo_id, type, task_key, task, size_tier", [
        ("2a", "m-tiny", "encoder", "", "", "small"), ("2b", "m-base", "encoder", "", "", "medium"), ("0", "m-blue", "legacy", "", "", "")])
    return heads.unionByName(rest)


def _models(t: Tables):
    return K.recommend_model(t.part.select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("task")),
                             _catalog(t), _KEYWORDS)


_MODELS = f"""wa AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS w FROM part), wd AS (SELECT w FROM wa WHERE w > 'k'),
tk AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN lower(concat(p_name, ' ', p_type)) END AS task FROM part),
hd AS (SELECT p_partkey, min(w) AS w FROM tk JOIN wd ON contains(task, w) OR contains(w, task) OR contains(concat(w, ' mapping'), task) GROUP BY 1),
al AS (SELECT p_partkey, arg_min(m, i) AS m FROM tk JOIN {values_sql([(i, k, m) for i, (k, m) in enumerate(_KEYWORDS)])} AS kw(i, k, m) ON contains(task, k)
  WHERE m = 'm-blue' OR m IN (SELECT concat('m-', w) FROM wa) GROUP BY 1),
md AS (SELECT tk.p_partkey, CASE WHEN w IS NOT NULL THEN concat('m-', w) WHEN al.m IS NOT NULL THEN al.m ELSE 'm-base' END AS repo_id,
  CASE WHEN w IS NOT NULL THEN 'task' WHEN al.m IS NOT NULL THEN 'alias' ELSE 'size' END AS reason FROM tk LEFT JOIN hd USING (p_partkey) LEFT JOIN al USING (p_partkey))"""


@query("G8", "recommend_model", f"WITH {_MODELS} SELECT * FROM md")
def recommend_model(t: Tables):
    return _models(t).drop("task")


@query("D25", "aoi_report", f"""WITH nr AS (SELECT max(raster_id) + 1 AS k FROM fx_class),
lc AS (SELECT raster_id, class_id, count(*) AS n FROM fx_class WHERE class_id <> -1 GROUP BY ALL),
lt AS (SELECT raster_id, sum(n) AS total FROM lc GROUP BY 1),
lp AS (SELECT raster_id, name, round(CAST(n AS DOUBLE) / total * 100, 1) AS percent FROM lc JOIN lt USING (raster_id) JOIN {LEGEND_SQL} USING (class_id)),
cv AS (SELECT raster_id, count(*) AS n_classes, arg_min(name, (-percent, name)) AS top_class, string_agg(name || ':' || percent, ', ' ORDER BY percent DESC, name) AS land_cover FROM lp GROUP BY 1),
{_MODELS},
cov AS (SELECT p.pid AS aoi_id, count(*) AS n_regions, min(b.name) AS first_region FROM fx_point p JOIN fx_box b
  ON b.west <= p.lon + 0.5::DOUBLE AND b.east >= p.lon AND b.south <= p.lat + 0.5::DOUBLE AND b.north >= p.lat GROUP BY 1)
SELECT p.pid AS aoi_id, round(0.5::DOUBLE * 111.32::DOUBLE * cos(radians(p.lat + 0.25::DOUBLE)) * 0.5::DOUBLE * 110.574::DOUBLE, 4) AS area_km2, n_classes, top_class, land_cover,
  coalesce(n_regions, 0) AS n_regions, first_region, md.repo_id
FROM fx_point p JOIN nr ON true LEFT JOIN cv ON cv.raster_id = p.pid % nr.k LEFT JOIN cov ON cov.aoi_id = p.pid LEFT JOIN md ON md.p_partkey = p.pid""")
def aoi_report(t: Tables):
    sites = t.fx_point.select(F.col("pid").alias("aoi_id"), F.col("lon").alias("west"), F.col("lat").alias("south"),
                              (F.col("lon") + 0.5).alias("east"), (F.col("lat") + 0.5).alias("north"))
    px = t.fx_class.select(F.col("raster_id").alias("aoi_id"), F.lit(2021).alias("year"), (F.col("class_id") + 1).alias("code"))
    shares = R.land_cover(px, legend_dim(t).select((F.col("class_id") + 1).alias("code"), "name", "color"))
    rasters = t.fx_class.agg((F.max("raster_id") + 1).alias("k")).scalar()
    cover = (sites.select("aoi_id", (F.col("aoi_id") % rasters).cast("int").alias("raster_id"))
             .join(shares.select(F.col("aoi_id").alias("raster_id"), "name", "percent"), "raster_id").select("aoi_id", "name", "percent"))
    coverage = G.project_coverage(sites, t.fx_box).select("aoi_id", F.col("r_name").alias("region"))
    models = _models(t).select(F.col("p_partkey").alias("aoi_id"), "repo_id")
    areas = sites.select("aoi_id", F.round(bbox_area_km2("west", "south", "east", "north"), 4).alias("area_km2"))
    got = K.aoi_report(areas, cover, coverage, models)
    listed = F.array_join(F.transform("land_cover", lambda x: F.concat(x["name"], F.lit(":"), x["percent"].cast("string"))), ", ")
    return got.select("aoi_id", "area_km2", F.when(F.col("land_cover").isNotNull(), F.size("land_cover")).cast("bigint").alias("n_classes"),
                      F.get("land_cover", F.lit(0))["name"].alias("top_class"), listed.alias("land_cover"), "n_regions", "first_region", "repo_id")


@query("S1", "job_id", """SELECT o_orderkey, substr(sha256(concat('{"date":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '","head":"', o_orderpriority, '","key":', CAST(o_custkey AS VARCHAR), '}')), 1, 16) AS job_id FROM orders""")
def job_id(t: Tables):
    return t.orders.select("o_orderkey", X.spec_id(key=F.col("o_custkey"), head=F.col("o_orderpriority"),
                                                   date=F.to_date("o_orderdate").cast("string")).alias("job_id"))


@query("S8", "composite_url", """
WITH s AS (SELECT scene_id, CASE WHEN scene_id % 11 = 0 THEN 'naip' WHEN scene_id % 13 = 0 THEN 'other' ELSE collection END AS collection, scene_id % 17 = 0 AS own FROM fx_scene),
q AS (SELECT *, CASE WHEN own THEN 'assets=B11&assets=a%20b' WHEN collection = 'naip' THEN 'assets=image' WHEN collection = 'sentinel-2-l2a' THEN 'assets=B04&assets=B03&assets=B02'
    WHEN collection = 'landsat-c2-l2' THEN 'assets=red&assets=green&assets=blue' END AS b,
  CASE WHEN collection = 'sentinel-2-l2a' THEN '&rescale=0,3000&color_formula=Gamma%20RGB%203.5%20Saturation%201.5'
    WHEN collection = 'landsat-c2-l2' THEN '&rescale=7500,40000&color_formula=Gamma%20RGB%202.7%20Saturation%201.4' ELSE '' END AS x FROM s)
SELECT scene_id, CASE WHEN b IS NOT NULL THEN concat('https://tiles.example.org/mosaic/', CAST(scene_id AS VARCHAR), '/tiles/{z}/{x}/{y}@2x?', b, x, '&collection=', collection) END AS tile_url,
  CASE WHEN b IS NULL THEN 'no_assets' END AS error FROM q""")
def composite_url(t: Tables):
    spec = t.fx_scene.select(
        "scene_id", F.col("scene_id").cast("string").alias("search_id"),
        F.when(F.col("scene_id") % 11 == 0, "naip").when(F.col("scene_id") % 13 == 0, "other").otherwise(F.col("collection")).alias("collection"),
        F.when(F.col("scene_id") % 17 == 0, F.array(F.lit("B11"), F.lit("a b"))).alias("assets"),
        F.lit(None).cast("string").alias("rescale"), F.lit(None).cast("string").alias("color_formula"))
    return K.composite_url(spec, "https://tiles.example.org").select("scene_id", "tile_url", "error")


_NAME = """CASE p_size % 4 WHEN 0 THEN concat('hub/Geo-v1-FT-', p_type, '-Base') WHEN 1 THEN 'hub/Geo-v2-Tiny' WHEN 2 THEN concat('hub/Geo-v1-', p_type) ELSE 'hub/Geo-v1-large' END"""


@query("S9", "parse_model_name", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'fine-tuned' WHEN p_size % 4 = 2 AND p_type <> 'LARGE' THEN 'unknown' ELSE 'encoder' END AS type,
  CASE WHEN p_size % 4 = 0 THEN lower(p_type) END AS task_key, CASE WHEN p_size % 4 = 0 THEN 'v1-Base' END AS base,
  CASE WHEN p_size % 4 = 1 THEN 'small' WHEN p_size % 4 = 3 OR (p_size % 4 = 2 AND p_type = 'LARGE') THEN 'largest' END AS size_tier FROM part""")
def parse_model_name(t: Tables):
    return t.part.select("p_partkey", X.model_parts(F.expr(_NAME)).alias("m")).select("p_partkey", "m.*")


@query("S12", "evidence_block", f"""WITH h AS ({PR.HISTOGRAM} QUALIFY rank <= 5)
SELECT raster_id, concat(printf('{K.HISTOGRAM_HEAD}', any_value(total_pixels), any_value(n_present), 8), chr(10),
  string_agg(concat('- ', coalesce(name, concat('class_', class_id)), ' (id=', class_id, '): ', percent, '% (', n_pixels, ' pixels)'), chr(10) ORDER BY rank)) AS block
FROM h LEFT JOIN {LEGEND_SQL} USING (class_id) GROUP BY raster_id""")
def evidence_block(t: Tables):
    return K.histogram_block(R.class_histogram(t.fx_class, 8, 5), legend_dim(t).select("class_id", "name"), 8)


@query("S12", "stats_block", f"""SELECT raster_id, concat(printf('{K.STATS_HEAD}', count(*)), chr(10), '- mean: ', round(avg(scalar), 3), ' m', chr(10), '- min: ', round(min(scalar), 3), ' m', chr(10),
  '- p10: ', round(quantile_cont(scalar, 0.1), 3), ' m', chr(10), '- p50 (median): ', round(quantile_cont(scalar, 0.5), 3), ' m', chr(10),
  '- p90: ', round(quantile_cont(scalar, 0.9), 3), ' m', chr(10), '- max: ', round(max(scalar), 3), ' m') AS block FROM fx_class GROUP BY raster_id""")
def stats_block(t: Tables):
    return K.stats_block(R.scalar_stats(t.fx_class, "scalar"), "m")


@query("K21", "demo_catalog", """
WITH p AS (SELECT scene_id, collection AS model, CAST(dt AS VARCHAR) AS da, CAST(CAST(dt + 365 AS DATE) AS VARCHAR) AS db, west, south, east, north, west + 0.5::DOUBLE AS w2, east + 0.5::DOUBLE AS e2 FROM fx_scene),
s AS (SELECT scene_id, 'a' AS side, model, da AS d, printf('%.6f,%.6f,%.6f,%.6f', west, south, east, north) AS bb, west, south, e2, north FROM p
  UNION ALL SELECT scene_id, 'b', model, db, printf('%.6f,%.6f,%.6f,%.6f', w2, south, e2, north), west, south, e2, north FROM p),
j AS (SELECT *, substr(sha256(concat('{"bbox":"', bb, '","date":"', d, '","model":"', model, '"}')), 1, 16) AS job_id FROM s)
SELECT scene_id AS pair_id, side, job_id, concat('/infer-tile/', job_id, '/{z}/{x}/{y}.png') AS tile_url, round(west, 6) AS fit_west, round(south, 6) AS fit_south, round(e2, 6) AS fit_east, round(north, 6) AS fit_north FROM j""")
def demo_catalog(t: Tables):
    def side(days: int, shift: float):
        return F.struct(F.col("collection").alias("model"), F.date_add("dt", days).cast("string").alias("date"), (F.col("west") + shift).alias("west"),
                        F.col("south"), (F.col("east") + shift).alias("east"), F.col("north"))

    got = K.demo_catalog(t.fx_scene.select(F.col("scene_id").alias("pair_id"), side(0, 0.0).alias("a"), side(365, 0.5).alias("b")))
    return got.select("pair_id", "side", "job_id", "tile_url", *r6("fit_west", "fit_south", "fit_east", "fit_north"))


@query("U1", "check_calls", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown_tool' WHEN event_id % 11 = 0 THEN 'bad_arguments' WHEN event_type = 'purchase' THEN 'bad_arguments'
  WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'bad_arguments' WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'bad_arguments' ELSE 'ok' END AS status,
  CASE WHEN event_id % 11 = 0 OR event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN 'win,schema' ELSE '' END AS missing,
  CASE WHEN event_id % 11 = 0 OR event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN 'keys' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'aois'
    WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'num_classes,top_n' ELSE '' END AS wrong_type FROM events""")
def check(t: Tables):
    """Calls of the registry's own tools: right ones, not JSON, arguments missing, arguments of the wrong type."""
    kind, n = F.col("event_type"), F.col("event_id")
    name = (F.when(kind == "click", "query_raster_histogram").when(kind == "purchase", "score_windows").when(kind == "view", "plan_chunks")
            .when(kind == "error", "no_such_tool").otherwise("vectorize"))
    args = (F.when(n % 11 == 0, "oops")
            .when(kind == "click", F.when(n % 5 == 0, '{"px": "t", "num_classes": "five", "top_n": [1]}').otherwise('{"px": "t", "num_classes": 5}'))
            .when(kind == "purchase", '{"px": "t", "keys": "scene_id", "scorer": "s", "schema": null}')
            .when(kind == "view", F.when(n % 7 == 0, '{"aois": 3}').otherwise('{"aois": "a", "size_m": 2500.5}')).otherwise('{"px": "t", "block": 64, "more": true}'))
    calls = t.events.select("event_id", name.alias("name"), F.when((kind == "error") & (n % 11 != 0), "[1]").otherwise(args).alias("args"))
    return check_calls(calls).select("event_id", "status", "missing", "wrong_type")


@query("U4", "sql_functions", """
SELECT scene_id, CAST(i AS INT) AS t, CAST(dt - CAST((3 - i) * 10 AS INT) AS DATE) AS "start", CAST(dt - CAST((2 - i) * 10 AS INT) AS DATE) AS "end",
  round(abs(east - west) * 111.32::DOUBLE * cos(radians((north + south) / 2)) * abs(north - south) * 110.574::DOUBLE, 4) AS area_km2,
  CAST(floor((west + 180) / 360 * 128) AS INT) AS tile, CAST(least(60, greatest(1, floor((west + 180) / 6) + 1)) AS INT) AS zone, west <= 10 AND east >= -10 AND south <= 20 AND north >= -20 AS near,
  round(least(1, greatest(0.1::DOUBLE, cos((i * 2 / 9.0::DOUBLE - 1) * pi() / 2) * cos((2 / 9.0::DOUBLE - 1) * pi() / 2))), 6) AS weight,
  CAST(floor(34 * cloud_cover / 100 + 255 * (1 - cloud_cover / 100)) AS INT) AS faded, list_extract([0, 32, 64], CAST(i AS INT) + 1) AS tile_start FROM fx_scene, range(3) v(i)""")
def sql_functions(t: Tables):
    sqlfuncs.register(t.spark)
    return t.spark.sql("""
        SELECT s.scene_id, p.t, p.start, p.end, round(bbox_area_km2(s.west, s.south, s.east, s.north), 4) AS area_km2, tile_x(s.west, 7) AS tile,
          utm_zone(s.west) AS zone, bbox_intersects(s.west, s.south, s.east, s.north, -10, -20, 10, 20) AS near, round(window_weight(p.t, 1, 10), 6) AS weight,
          fade_to_white(34, s.cloud_cover / 100) AS faded, w.start AS tile_start
        FROM {scenes} s, LATERAL period_rows(s.dt, 3, 10) p, LATERAL tile_rows(112, 48, 32) w WHERE w.i = p.t""", scenes=t.fx_scene)


@query("U5", "vector_mean", f"WITH {PV._G}, m AS {PV.mean_sql('g', 'label', 'p')} SELECT label, CAST(unnest(range(len(p))) AS INT) AS i, round(unnest(p), 6) AS v FROM m")
def vector_mean(t: Tables):
    return PV.elements(t.fx_grid.groupBy("label").agg(VF.mean_vector(F.col("embedding")).alias("m")), "m", "label")
