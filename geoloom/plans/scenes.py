"""Scene, period and area queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.fixtures import Tables, values_sql
from geoloom.functions import geo as X
from geoloom.functions import temporal as D
from geoloom.functions.text import sign_href
from geoloom.operators import grids as G
from geoloom.operators import scenes as S
from geoloom.plans.rasters import r6
from geoloom.registry import query

# The twelve surface-reflectance bands and one provider's names for them.
BANDS = ["B02", "B03", "B04", "B08", "B05", "B06", "B07", "B8A", "B11", "B12", "B01", "B09"]
ALIASES = [("blue", "B02"), ("green", "B03"), ("red", "B04"), ("nir", "B08"), ("rededge1", "B05"),
           ("rededge2", "B06"), ("rededge3", "B07"), ("nir08", "B8A"), ("swir16", "B11"), ("swir22", "B12"),
           ("coastal", "B01"), ("nir09", "B09")]


@query("B1", "search_scenes", """
SELECT *, CASE WHEN scene_id % 2 = 0 THEN 'B02,B04,thumbnail' ELSE 'B04,visual' END AS assets, CASE WHEN scene_id % 2 = 0 THEN 3 ELSE 2 END AS n_assets, count(*) OVER () AS matched FROM fx_scene
WHERE west <= 60 AND east >= -60 AND south <= 50 AND north >= -50 AND dt BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
  AND collection IN ('sentinel-2-l2a') AND cloud_cover < 20 ORDER BY dt DESC, scene_id LIMIT 500""")
def search_scenes(t: Tables):
    scenes = t.fx_scene.withColumn("assets", F.when(F.col("scene_id") % 2 == 0, F.array(F.lit("thumbnail"), F.lit("B04"), F.lit("B02"))).otherwise(F.array(F.lit("visual"), F.lit("B04"))))
    found = S.search_scenes(scenes, (-60.0, -50.0, 60.0, 50.0), F.lit("1996-01-01").cast("date"),
                           F.lit("1999-12-31").cast("date"), ["sentinel-2-l2a"], 20.0, 500)
    return found.withColumn("assets", F.array_join("assets", ","))


@query("C1", "scenes_for_aois", """
SELECT a.box_id, s.scene_id AS r_scene_id, s.dt AS r_dt, s.cloud_cover AS r_cloud_cover FROM fx_box a JOIN fx_scene s
ON s.west <= a.east AND s.east >= a.west AND s.south <= a.north AND s.north >= a.south""")
def scenes_for_aois(t: Tables):
    return S.scenes_for_aois(t.fx_box, t.fx_scene).select("box_id", "r_scene_id", "r_dt", "r_cloud_cover")


def _aoi_scenes(t: Tables):
    return t.fx_scene.withColumn("aoi_id", (F.col("scene_id") % 25).cast("int"))


@query("G2", "least_cloudy", """
SELECT collection, dt, scene_id, cloud_cover FROM fx_scene WHERE cloud_cover < 40
QUALIFY row_number() OVER (PARTITION BY collection, dt ORDER BY cloud_cover, scene_id) = 1""")
def least_cloudy(t: Tables):
    return S.least_cloudy(t.fx_scene, ["collection", "dt"], 40.0).select("collection", "dt", "scene_id", "cloud_cover")


_PERIODS = """p AS (SELECT box_id AS aoi_id, CAST(i AS INT) AS t, CAST(DATE '2001-08-05' - CAST((84 - i) * 30 AS INT) AS DATE) AS "start",
        CAST(DATE '2001-08-05' - CAST((83 - i) * 30 AS INT) AS DATE) AS "end" FROM fx_box, range(84) v(i)),
sc AS (SELECT *, CAST(scene_id % 25 AS INT) AS aoi_id FROM fx_scene WHERE cloud_cover < 8),
best AS (SELECT p.aoi_id, p.t, scene_id, dt, cloud_cover FROM p JOIN sc ON sc.aoi_id = p.aoi_id AND dt >= p."start" AND dt < p."end"
         QUALIFY row_number() OVER (PARTITION BY p.aoi_id, p.t ORDER BY cloud_cover, scene_id) = 1),
ps AS (SELECT p.*, scene_id, dt, cloud_cover, scene_id IS NULL AS skipped FROM p LEFT JOIN best USING (aoi_id, t))"""


def _period_scenes(t: Tables):
    spine = t.fx_box.select(F.col("box_id").alias("aoi_id"), F.explode(D.periods(
        D.anchor_date(F.lit("1999-01-01/2001-08-05")), 84, 30)).alias("p")).select("aoi_id", "p.*")
    return S.scenes_for_periods(spine, _aoi_scenes(t), 30, 8.0)


@query("C2", "scenes_for_periods", f"WITH {_PERIODS} SELECT * FROM ps")
def scenes_for_periods(t: Tables):
    return _period_scenes(t)


@query("B9", "latest_scene", f"""WITH {_PERIODS}
SELECT aoi_id, arg_max(scene_id, t) FILTER (WHERE scene_id IS NOT NULL) AS scene_id FROM ps GROUP BY aoi_id""")
def latest_scene(t: Tables):
    return S.latest_scene(_period_scenes(t), ["aoi_id"])


_ANSWERS = """
a AS (SELECT dt, CASE WHEN dayofyear(dt) % 6 = 0 THEN 'error' WHEN min(cloud_cover) >= 60 THEN 'empty' ELSE 'ok' END AS status,
        CASE WHEN dayofyear(dt) % 6 = 0 OR min(cloud_cover) >= 60 THEN NULL ELSE min(scene_id) END AS scene_id
      FROM fx_scene WHERE provider = 'primary' GROUP BY dt),
b AS (SELECT dt, 'ok' AS status, min(scene_id) AS scene_id FROM fx_scene WHERE provider = 'secondary' GROUP BY dt)"""


@query("C3", "provider_fallback", f"""WITH {_ANSWERS}
SELECT a.dt, CASE WHEN a.status = 'error' THEN 'secondary' ELSE 'primary' END AS provider,
  CASE WHEN a.status = 'error' THEN coalesce(b.status, 'error') ELSE a.status END AS status,
  CASE WHEN a.status = 'error' THEN b.scene_id ELSE a.scene_id END AS scene_id FROM a LEFT JOIN b USING (dt)""")
def provider_fallback(t: Tables):
    sc = t.fx_scene
    failed, hazy = F.dayofyear("dt") % 6 == 0, F.min("cloud_cover") >= 60
    a = sc.where("provider = 'primary'").groupBy("dt").agg(hazy.alias("hazy"), F.min("scene_id").alias("scene_id")).select(
        "dt", F.when(failed, "error").when(F.col("hazy"), "empty").otherwise("ok").alias("status"),
        F.when(~failed & ~F.col("hazy"), F.col("scene_id")).alias("scene_id"))
    b = sc.where("provider = 'secondary'").groupBy("dt").agg(F.lit("ok").alias("status"), F.min("scene_id").alias("scene_id"))
    return S.provider_fallback(a, b, "dt")


def _assets(t: Tables):
    """One asset per scene and band; cloudy scenes of the secondary provider lack the last two, hazy ones one band."""
    names = F.array(*[F.lit(a) for a, _ in ALIASES])
    gone = ((F.col("provider") == "secondary") & (F.col("cloud_cover") > 50) & (F.col("i") >= 10)) | (
        (F.col("cloud_cover") > 90) & (F.col("i") == 7))
    return (t.fx_scene.select("scene_id", "provider", "cloud_cover", F.posexplode(names).alias("i", "asset"))
            .where(~gone).select("scene_id", "asset"))


_ASSETS = f"""al AS (SELECT * FROM {values_sql([(i, a, b) for i, (a, b) in enumerate(ALIASES)])} v(i, asset, band)),
ast AS (SELECT scene_id, asset, band FROM fx_scene, al
   WHERE NOT (provider = 'secondary' AND cloud_cover > 50 AND i >= 10) AND NOT (cloud_cover > 90 AND i = 7))"""


@query("C19", "rename_bands", f"WITH {_ASSETS} SELECT scene_id, band FROM ast")
def rename_bands(t: Tables):
    return S.rename_bands(_assets(t), t.values("asset, band", ALIASES))


_MISSING = f"""WITH {_ASSETS},
m AS (SELECT s.scene_id, coalesce(string_agg(al.band, ',' ORDER BY al.band) FILTER (WHERE ast.band IS NULL), '') AS missing
      FROM fx_scene s CROSS JOIN al LEFT JOIN ast ON ast.scene_id = s.scene_id AND ast.band = al.band GROUP BY 1)"""


@query("B7", "complete_scenes", _MISSING + " SELECT scene_id, missing = '' AS usable FROM m")
def complete_scenes(t: Tables):
    return S.complete_scenes(rename_bands(t), BANDS).select("scene_id", "usable")


@query("I4", "missing_bands", _MISSING + " SELECT scene_id, missing FROM m WHERE missing <> ''")
def missing_bands(t: Tables):
    got = S.complete_scenes(rename_bands(t), BANDS).withColumn("missing", F.array_join("missing", ","))
    return got.where(~F.col("usable")).select("scene_id", "missing")


@query("I3", "merge_providers", """
SELECT provider, scene_id, cloud_cover, CASE WHEN provider = 'primary' THEN collection END AS collection FROM fx_scene""")
def merge_providers(t: Tables):
    a = t.fx_scene.where("provider = 'primary'").select("scene_id", "cloud_cover", "collection")
    b = t.fx_scene.where("provider = 'secondary'").select("scene_id", "cloud_cover")
    return S.merge_providers({"primary": a, "secondary": b})


@query("A20", "cache_plan", f"""WITH {_ASSETS},
need AS (SELECT a.scene_id, substr(sha256(concat_ws('|', 'v1', CAST(a.scene_id AS VARCHAR), printf('%.6f', west), printf('%.6f', south),
           printf('%.6f', east), printf('%.6f', north), printf('%.6f', 10.0::DOUBLE), band)), 1, 16) AS cache_key, band, cloud_cover
         FROM ast a JOIN fx_scene USING (scene_id)),
have AS (SELECT DISTINCT cache_key FROM need WHERE cloud_cover < 30 OR (cloud_cover < 60 AND band < 'B06'))
SELECT scene_id, count(h.cache_key) AS n_hit, count(*) - count(h.cache_key) AS n_miss,
  CASE WHEN count(*) = count(h.cache_key) THEN 'full' WHEN count(h.cache_key) = 0 THEN 'none' ELSE 'partial' END AS state
FROM need LEFT JOIN have h USING (cache_key) GROUP BY scene_id""")
def cache_plan(t: Tables):
    stems = t.fx_scene.select("scene_id", "cloud_cover", S.cache_stem(
        F.col("scene_id"), [F.col(b) for b in S.BOX], F.lit(10.0), "v1").alias("stem"))
    need = rename_bands(t).join(stems, "scene_id").withColumn("cache_key", S.cache_key(F.col("stem"), F.col("band")))
    have = need.where((F.col("cloud_cover") < 30) | ((F.col("cloud_cover") < 60) & (F.col("band") < "B06")))
    return S.cache_plan(need.select("scene_id", "cache_key"), have.select("cache_key"))


@query("I5", "dedupe_jobs", """
WITH done AS (SELECT DISTINCT job_id FROM fx_outcome WHERE event_type = 'purchase' AND latency > 200),
stub AS (SELECT DISTINCT job_id FROM fx_outcome WHERE event_type = 'view')
SELECT job_id, min(event_id) AS event_id, count(*) AS n_requests FROM fx_outcome
WHERE job_id NOT IN (SELECT job_id FROM done) GROUP BY job_id""")
def dedupe_jobs(t: Tables):
    ev = t.fx_outcome
    finished = (ev.where("event_type = 'purchase' AND latency > 200").select("job_id", F.lit("result").alias("kind"))
                .unionByName(ev.where("event_type = 'view'").select("job_id", F.lit("stub").alias("kind"))))
    return S.dedupe_jobs(ev, finished)


@query("S2", "subtract_months", """
SELECT scene_id, CAST(dt - INTERVAL 1 MONTH AS DATE) AS m1, CAST(dt - INTERVAL 13 MONTH AS DATE) AS m13 FROM fx_scene""")
def subtract_months(t: Tables):
    return t.fx_scene.select("scene_id", D.subtract_months(F.col("dt"), 1).alias("m1"),
                             D.subtract_months(F.col("dt"), 13).alias("m13"))


@query("S3", "periods", """
SELECT scene_id, CAST(i AS INT) AS t, CAST(dt + CAST(5 - (6 - i) * 30 AS INT) AS DATE) AS "start",
       CAST(dt + CAST(5 - (5 - i) * 30 AS INT) AS DATE) AS "end" FROM fx_scene, range(6) v(i)""")
def periods(t: Tables):
    text = F.concat(F.lit("1990-01-01/"), F.col("dt").cast("string"))
    return t.fx_scene.select("scene_id", F.explode(D.periods(D.anchor_date(text), 6, 30, 5)).alias("p")).select("scene_id", "p.*")


@query("S4", "pre_post_periods", """
SELECT scene_id, 'pre' AS side, CAST(i AS INT) AS t, CAST(dt + CAST(-300 - (4 - i) * 30 AS INT) AS DATE) AS "start",
       CAST(dt + CAST(-300 - (3 - i) * 30 AS INT) AS DATE) AS "end" FROM fx_scene, range(4) v(i)
UNION ALL SELECT scene_id, 'post', CAST(i AS INT), CAST(dt + CAST(7 - (4 - i) * 30 AS INT) AS DATE),
       CAST(dt + CAST(7 - (3 - i) * 30 AS INT) AS DATE) FROM fx_scene, range(4) v(i)""")
def pre_post_periods(t: Tables):
    return t.fx_scene.select("scene_id", F.explode(D.pre_post_periods(F.col("dt"))).alias("p")).select("scene_id", "p.*")


@query("S5", "timestamp_dmy", """
SELECT scene_id, CAST(day(dt) AS INT) AS day, CAST(month(dt) - 1 AS INT) AS month0, CAST(year(dt) AS INT) AS year,
       CAST(dt + 15 AS DATE) AS mid FROM fx_scene""")
def timestamp_dmy(t: Tables):
    return t.fx_scene.select("scene_id", D.timestamp_dmy(F.col("dt")).alias("d"),
                             D.midpoint(F.col("dt"), F.date_add("dt", 31)).alias("mid")).select("scene_id", "d.*", "mid")


@query("S6", "to_rfc3339", """
SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN concat(CAST(dt AS VARCHAR), 'T00:00:00Z')
  WHEN scene_id % 3 = 1 THEN concat(CAST(dt AS VARCHAR), 'T00:00:00Z/', CAST(CAST(dt + 30 AS DATE) AS VARCHAR), 'T00:00:00Z')
  ELSE concat(CAST(dt AS VARCHAR), 'T10:12:03Z/', CAST(dt AS VARCHAR), 'T11:00:00Z') END AS rfc FROM fx_scene""")
def to_rfc3339(t: Tables):
    d = F.col("dt").cast("string")
    text = (F.when(F.col("scene_id") % 3 == 0, F.concat(F.lit(" "), d))
            .when(F.col("scene_id") % 3 == 1, F.concat(d, F.lit(" / "), F.date_add("dt", 30).cast("string")))
            .otherwise(F.concat(d, F.lit("T10:12:03/"), d, F.lit("T11:00:00Z"))))
    return t.fx_scene.select("scene_id", D.to_rfc3339(text).alias("rfc"))


@query("S7", "sign_href", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url WHEN contains(url, '?') THEN concat(url, '&sig=', CAST(page_id AS VARCHAR))
  ELSE concat(url, '?sig=', CAST(page_id AS VARCHAR)) END AS href FROM pages""")
def sign(t: Tables):
    provider = F.when(F.col("page_id") % 5 == 0, "secondary").otherwise("primary")
    return t.pages.select("page_id", sign_href(
        F.col("url"), F.concat(F.lit("sig="), F.col("page_id").cast("string")), provider).alias("href"))


_CHUNK = """g AS (SELECT *, CAST(greatest(1, ceil((north - south) / (50000 / 111000.0::DOUBLE))) AS INT) AS n_rows,
  CAST(greatest(1, ceil((east - west) / (50000 / (111000.0::DOUBLE * cos(radians((north + south) / 2)))))) AS INT) AS n_cols FROM fx_box)"""


@query("E2", "plan_chunks", f"""WITH {_CHUNK}
SELECT box_id, CAST(i AS INT) AS chunk_r, CAST(j AS INT) AS chunk_c, round(west + j * (east - west) / n_cols, 6) AS chunk_west,
  round(south + i * (north - south) / n_rows, 6) AS chunk_south, round(west + (j + 1) * (east - west) / n_cols, 6) AS chunk_east,
  round(south + (i + 1) * (north - south) / n_rows, 6) AS chunk_north
FROM (SELECT *, unnest(range(n_rows)) AS i FROM g) g, LATERAL (SELECT unnest(range(n_cols)) AS j)""")
def plan_chunks(t: Tables):
    return G.plan_chunks(t.fx_box, 50000).select("box_id", "chunk_r", "chunk_c",
                                                 *r6("chunk_west", "chunk_south", "chunk_east", "chunk_north"))


@query("B12", "check_aoi_size", f"""WITH {_CHUNK}
SELECT box_id, CAST(n_rows AS BIGINT) * n_cols AS n_chunks,
  round(abs(east - west) * 111 * cos(radians((north + south) / 2)) * abs(north - south) * 111, 4) AS area_km2,
  CASE WHEN n_rows * n_cols > 600 THEN 'too_large' ELSE 'ok' END AS status,
  CASE WHEN n_rows * n_cols > 600 THEN CAST(600 * 2500 AS DOUBLE) END AS max_area_km2 FROM g""")
def check_aoi_size(t: Tables):
    return G.check_aoi_size(t.fx_box, 50000, 600).select("box_id", "n_chunks", F.round("area_km2", 4).alias("area_km2"),
                                                         "status", "max_area_km2")


def _utm_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Easting and northing by the same published series, as SQL text."""
    d = f"radians({lon} - ({zone} * 6 - 183))"
    e = X._E2 ** 0.5
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos({d}))", f"asinh(sin({d}) / sqrt({t} * {t} + cos({d}) * cos({d})))"
    x = eta + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(X._ALPHA, 1))
    y = xi + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(X._ALPHA, 1))
    scale = f"{X._K0 * X._RECT!r}::DOUBLE"
    return f"(500000 + {scale} * ({x}))", f"({scale} * ({y}) + CASE WHEN {lat} < 0 THEN 1e7 ELSE 0 END)"


def _grid_sql() -> str:
    corners = [_utm_sql(x, y, "zone") for x in ("west", "east") for y in ("south", "north")]
    xs, ys = ", ".join(c[0] for c in corners), ", ".join(c[1] for c in corners)
    return f"""WITH b AS (SELECT pid, lon AS west, lat AS south, lon + 0.05::DOUBLE AS east, lat + 0.03::DOUBLE AS north FROM fx_point),
z AS (SELECT *, CAST(least(60, greatest(1, floor(((west + east) / 2 + 180) / 6) + 1)) AS INT) AS zone FROM b),
u AS (SELECT pid, zone, least({xs}) AS x0, greatest({xs}) AS x1, least({ys}) AS y0, greatest({ys}) AS y1 FROM z),
n AS (SELECT *, CAST(greatest(1, round_even(abs(x1 - x0) / 10, 0)) AS INT) AS w, CAST(greatest(1, round_even(abs(y1 - y0) / 10, 0)) AS INT) AS h FROM u)
SELECT pid, zone, greatest(4, w - w % 4) AS width, greatest(4, h - h % 4) AS height, round(x0, 3) AS x_min, round(y1, 3) AS y_max FROM n"""


@query("E3", "resolve_grid", _grid_sql())
def resolve_grid(t: Tables):
    sites = t.fx_point.select(
        "pid", F.col("lon").alias("west"), F.col("lat").alias("south"),
        (F.col("lon") + 0.05).alias("east"), (F.col("lat") + 0.03).alias("north"))
    return G.resolve_grid(sites, 10.0, 4).select("pid", "zone", "width", "height", *[
        F.round(x, 3).alias(x) for x in ("x_min", "y_max")])


@query("C13", "project_coverage", """
SELECT p.pid, b.box_id AS r_box_id FROM fx_point p JOIN fx_box b
ON b.west <= p.lon + 0.5::DOUBLE AND b.east >= p.lon AND b.south <= p.lat + 0.5::DOUBLE AND b.north >= p.lat""")
def project_coverage(t: Tables):
    sites = t.fx_point.select("pid", F.col("lon").alias("west"), F.col("lat").alias("south"),
                              (F.col("lon") + 0.5).alias("east"), (F.col("lat") + 0.5).alias("north"))
    return G.project_coverage(sites, t.fx_box).select("pid", "r_box_id")


@query("C14", "off_distribution", """
WITH q AS (SELECT pid, lon AS west, lat AS south, lon + 1 AS east, lat + 1 AS north, CAST(pid % 25 AS INT) AS head FROM fx_point),
d AS (SELECT q.pid, q.head, radians((b.south + b.north) / 2 - (q.south + q.north) / 2) AS dp,
        radians((b.west + b.east) / 2 - (q.west + q.east) / 2) AS dl, radians((q.south + q.north) / 2) AS p1, radians((b.south + b.north) / 2) AS p2
      FROM q JOIN fx_box b ON b.box_id = q.head
      WHERE NOT (q.west >= b.west AND q.east <= b.east AND q.south >= b.south AND q.north <= b.north)),
h AS (SELECT pid, head, pow(sin(dp / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2) AS h FROM d)
SELECT pid, head, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h))) AS distance_km FROM h""")
def off_distribution(t: Tables):
    req = t.fx_point.select("pid", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 1).alias("east"),
                            (F.col("lat") + 1).alias("north"), (F.col("pid") % 25).cast("int").alias("head"))
    return G.off_distribution(req, t.fx_box.withColumnRenamed("box_id", "head")).select("pid", "head", "distance_km")


_WEATHER = """w AS (SELECT CAST(floor(west / 10) AS INT) AS cx, CAST(floor(south / 10) AS INT) AS cy, max(dt) AS ts,
             arg_max(temperature, dt) AS temperature, arg_max(humidity, dt) AS humidity
           FROM (SELECT west, south, dt, max(cloud_cover) / 4 - 5 AS temperature, min(cloud_cover) AS humidity FROM fx_scene GROUP BY west, south, dt
                 QUALIFY row_number() OVER (PARTITION BY floor(west / 10), floor(south / 10), dt ORDER BY west, south) = 1) GROUP BY 1, 2),
a AS (SELECT pid, CAST(floor((lon + 0.5::DOUBLE) / 10) AS INT) AS cx, CAST(floor((lat + 0.5::DOUBLE) / 10) AS INT) AS cy FROM fx_point)"""


def environment(t: Tables):
    """C15 over the points: the last reading of the weather cell at the middle of each site."""
    from geoloom.operators.scale import first_per

    raw = (t.fx_scene.groupBy("west", "south", "dt")
           .agg((F.max("cloud_cover") / 4 - 5).alias("temperature"), F.min("cloud_cover").alias("humidity"))
           .withColumn("cx", F.floor(F.col("west") / 10).cast("int")).withColumn("cy", F.floor(F.col("south") / 10).cast("int")))
    weather = first_per(raw, ["cx", "cy", "dt"], [F.asc("west"), F.asc("south")]).withColumnRenamed("dt", "ts")
    sites = t.fx_point.select("pid", F.col("lon").alias("west"), F.col("lat").alias("south"),
                              (F.col("lon") + 1).alias("east"), (F.col("lat") + 1).alias("north"))
    return G.enrich_env(sites, weather.drop("west", "south"), ["temperature", "humidity", "ozone"], 10.0)


@query("C15", "enrich_env", f"""WITH {_WEATHER}
SELECT pid, ts, round(temperature, 6) AS temperature, humidity,
  CASE WHEN ts IS NULL THEN 'no reading for this cell' ELSE 'unknown variables: ozone' END AS error FROM a LEFT JOIN w USING (cx, cy)""")
def enrich_env(t: Tables):
    return environment(t).select("pid", "ts", *r6("temperature"), "humidity", "error")


@query("C17", "sample_pixels_at", """
WITH tile AS (SELECT CAST(floor(c / 16.0) AS INT) AS x, CAST(floor((raster_id * 20 + r) / 16.0) AS INT) AS y, c % 16 AS px,
  (raster_id * 20 + r) % 16 AS py, class_id FROM fx_class),
z AS (SELECT pow(2, greatest(2, ceil(log2((max(raster_id) + 1) * 20 / 16.0)))) AS n FROM fx_class),
f AS (SELECT pid, (lon + 180) / 360 * n AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * n AS fy FROM fx_point JOIN z ON true),
p AS (SELECT pid, CAST(floor(fx) AS INT) AS x, CAST(floor(fy) AS INT) AS y, CAST(floor((fx - floor(fx)) * 16) AS INT) AS px,
        CAST(floor((fy - floor(fy)) * 16) AS INT) AS py FROM f)
SELECT pid, x, y, px, py, class_id FROM p LEFT JOIN tile USING (x, y, px, py)""")
def sample_pixels_at(t: Tables):
    row = F.col("raster_id") * 20 + F.col("r")
    tiles = t.fx_class.select(
        F.floor(F.col("c") / 16).cast("int").alias("x"), F.floor(row / 16).cast("int").alias("y"),
        (F.col("c") % 16).alias("px"), (row % 16).alias("py"), "class_id")
    # the zoom at which the tiles reach every raster
    (last,) = t.fx_class.agg(F.max("raster_id")).first()
    zoom = max(2, math.ceil(math.log2((last + 1) * 20 / 16)))
    return G.sample_pixels_at(t.fx_point, tiles, zoom, 16).select("pid", "x", "y", "px", "py", "class_id")


_ANCHORS = [(0, 34, 139, 34), (1, 240, 230, 140), (2, 128, 128, 128), (3, 30, 144, 255)]


@query("C18", "nearest_color_class", f"""
WITH px AS (SELECT raster_id, r, c, (r * 12) % 256 AS red, (c * 5) % 256 AS green, CAST(floor(scalar) AS INT) % 256 AS blue FROM fx_class)
SELECT raster_id, r, c, k AS class_id FROM px, {values_sql(_ANCHORS)} a(k, ar, ag, ab)
QUALIFY row_number() OVER (PARTITION BY raster_id, r, c ORDER BY pow(red - ar, 2) + pow(green - ag, 2) + pow(blue - ab, 2), k) = 1""")
def nearest_color_class(t: Tables):
    px = t.fx_class.select("raster_id", "r", "c", ((F.col("r") * 12) % 256).alias("red"), ((F.col("c") * 5) % 256).alias("green"),
                           (F.floor("scalar").cast("int") % 256).alias("blue"))
    return G.nearest_color_class(px, _ANCHORS).drop("red", "green", "blue")
