"""Identities and invariants of the operators."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import tools
from geoloom.functions import color, geo, sqlfuncs, temporal, text, vector
from geoloom.operators import catalog, embeddings, grids, labels, rasters, scenes
from geoloom.operators.monitoring import failure_streaks
from geoloom.sources import files, sinks
from geoloom.streaming import jobs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.fixture(scope="module")
def emb(spark):
    rng = np.random.default_rng(0)
    rows = []
    for r in range(12):
        for c in range(14):
            v = rng.normal(size=8) + (3.0 if c < 7 else -3.0)
            rows.append((1, r, c, [0.0] * 8 if (r, c) in ((0, 0), (5, 7)) else [float(x) for x in v]))
    return spark.createDataFrame(rows, "raster_id int, r int, c int, embedding array<float>")


def test_cosine_of_self_and_negation(spark):
    q = vec(1, 2, 3)
    assert one(spark, vector.cosine01(q, q)) == pytest.approx(1.0)
    assert one(spark, vector.cosine01(vec(-1, -2, -3), q)) == pytest.approx(0.0, abs=1e-8)
    assert one(spark, vector.cosine01(vec(0, 0, 0), q)) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, vector.cosine01(vec(1, 2), q))


def test_softmax_and_argmax(spark):
    p = one(spark, vector.softmax(vec(1, 2, 3), 2.0))
    assert sum(p) == pytest.approx(1.0) and p[2] == max(p)
    assert one(spark, vector.argmax(vec(5, 7, 7))) == 1


def test_quantise_round_trip(spark):
    back = one(spark, vector.dequantize_int8(vector.quantize_int8(vec(-1, -0.3, 0, 0.02, 1), F.lit(False))))
    assert back == pytest.approx([-1, -0.3, 0, 0.02, 1], abs=0.01)
    assert one(spark, vector.quantize_int8(vec(1, 2), F.lit(True))) == [-128, -128]


def test_pca(spark, emb):
    axes = embeddings.principal_axes(emb, 3).collect()[0]
    x = np.array([r["embedding"] for r in emb.collect() if any(r["embedding"])])
    s = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert axes["variance"] == pytest.approx((s[1] ** 2 / len(x))[:3], rel=1e-6)
    for a, b in zip(axes["axes"], s[2]):
        assert abs(np.dot(a, b)) == pytest.approx(1.0, abs=1e-6)
    got = {(r["r"], r["c"]): r["value"] for r in embeddings.pca_scalar(emb).collect()}
    assert got[0, 0] is None
    vals = [v for v in got.values() if v is not None]
    assert min(vals) == 0.0 and max(vals) == 1.0
    rgb = {(r["r"], r["c"]): (r["red"], r["green"], r["blue"]) for r in embeddings.pca_rgb(emb, 1.5).collect()}
    assert rgb[0, 0] == (0, 0, 0)
    assert {min(v[i] for k, v in rgb.items()) for i in range(3)} == {0}
    assert {max(v[i] for k, v in rgb.items()) for i in range(3)} == {255}


def test_pca_pads_short_vectors(spark):
    df = spark.createDataFrame([(1, 0, i, [float(i), 1.0]) for i in range(5)], "raster_id int, r int, c int, embedding array<float>")
    assert all(r["blue"] == 0 for r in embeddings.pca_rgb(df, 0).collect())


def test_few_shot_and_logistic_find_the_halves(spark, emb):
    pts = emb.where("r IN (3, 4, 9)").select("raster_id", F.when(F.col("c") < 7, 0).otherwise(1).alias("class_id"), "r", "c", "embedding")
    pts = pts.where(~vector.is_nodata(F.col("embedding")))
    for got in (embeddings.few_shot(emb, embeddings.prototypes(pts)), embeddings.few_shot_logistic(emb, pts)):
        rows = {(r["r"], r["c"]): r["class_id"] for r in got.collect()}
        assert rows.pop((0, 0)) == -1 and rows.pop((5, 7)) == -1
        assert all(k == (0 if c < 7 else 1) for (_, c), k in rows.items())
    with pytest.raises(Exception, match="two classes"):
        embeddings.few_shot(emb, embeddings.prototypes(pts.where("class_id = 0"))).collect()


def test_similarity_smoothing_keeps_nodata(spark, emb):
    q = emb.where("r = 2 AND c = 2").select("raster_id", F.col("embedding").alias("query"))
    raw = {(r["r"], r["c"]): r["similarity"] for r in embeddings.similarity(emb, q, 0).collect()}
    soft = {(r["r"], r["c"]): r["similarity"] for r in embeddings.similarity(emb, q, 1.5, block=6).collect()}
    assert raw[2, 2] == pytest.approx(1.0) and soft[0, 0] == 0.0
    seam = lambda m: abs(m[9, 6] - m[9, 7])
    assert seam(soft) < seam(raw)


@pytest.mark.parametrize("block", [6, 7, 256])
def test_smoothing_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(1)
    g = rng.random((23, 19))
    px = spark.createDataFrame([(1, r, c, float(g[r, c])) for r in range(23) for c in range(19)], "raster_id int, r int, c int, v double")
    k = rasters.gaussian_kernel(1.5)
    pad = np.pad(g, 6, mode="symmetric")
    rows = sum(w * pad[i:i + 23, :] for i, w in enumerate(k))
    want = sum(w * rows[:, i:i + 19] for i, w in enumerate(k))
    for r in rasters.smooth_raster(px, ["v"], 1.5, block).collect():
        assert r["v"] == pytest.approx(want[r["r"], r["c"]], abs=1e-12)
    assert rasters.smooth_raster(px, ["v"], 0) is px


def test_every_month_asked_for_is_there(spark):
    a = spark.createDataFrame([(1,)], "aoi_id int")
    anchor = F.lit("2026-04-19").cast("date")
    assert rasters.month_spine(a, anchor, 99).count() == 99
    got = [r["month"] for r in rasters.month_spine(a, anchor, 0).collect()]
    assert got == [datetime.date(2026, 3, 1)]


def test_subtract_months(spark):
    d = F.lit("2024-03-31").cast("date")
    assert one(spark, temporal.subtract_months(d, 1)) == datetime.date(2024, 2, 29)
    assert one(spark, temporal.subtract_months(d, 15)) == datetime.date(2022, 12, 31)


def test_periods_adjoin(spark):
    p = one(spark, temporal.periods(temporal.anchor_date(F.lit("2024-01-01/2024-06-30T10:00:00Z")), 4, 30, 5))
    assert p[-1]["end"] == datetime.date(2024, 7, 5)
    assert all(a["end"] == b["start"] for a, b in zip(p, p[1:]))
    with pytest.raises(ValueError):
        temporal.periods(F.lit(None), 0, 30)


def test_chunks_tile_the_area(spark):
    a = spark.createDataFrame([(1, -122.35, 47.60, -122.02, 47.83), (2, 0.0, 0.0, 1e-6, 1e-6)], "aoi_id int, west double, south double, east double, north double")
    rows = grids.plan_chunks(a).collect()
    big = [r for r in rows if r["aoi_id"] == 1]
    assert len(big) > 1 and len(rows) - len(big) == 1
    area = sum((r["chunk_east"] - r["chunk_west"]) * (r["chunk_north"] - r["chunk_south"]) for r in big)
    assert area == pytest.approx(0.33 * 0.23)
    assert {r["status"] for r in grids.check_aoi_size(a, 5000, 20).collect()} == {"ok", "too_large"}
    assert {r["status"] for r in grids.check_aoi_size(a).collect()} == {"ok"}


def test_utm(spark):
    u = one(spark, geo.to_utm(F.lit(-122.335167), F.lit(47.608013)))
    # published worked values for this point are 549 970 E 5 273 000 N, zone 10
    assert u["zone"] == 10 and u["x"] == pytest.approx(549970, abs=60) and u["y"] == pytest.approx(5273000, abs=300)
    back = one(spark, geo.from_utm(F.lit(u["x"]), F.lit(u["y"]), F.lit(10), F.lit(False)))
    assert back["lon"] == pytest.approx(-122.335167, abs=1e-9) and back["lat"] == pytest.approx(47.608013, abs=1e-9)
    # a degree of longitude on the equator and the central meridian's scale
    c = one(spark, geo.to_utm(F.lit(3.0), F.lit(0.0)))
    assert c["x"] == pytest.approx(500000) and c["y"] == pytest.approx(0)


def test_grid_is_whole_patches(spark):
    a = spark.createDataFrame([(1, 9.0, 48.0, 9.05, 48.03)], "aoi_id int, west double, south double, east double, north double")
    g = grids.resolve_grid(a, 10.0, 4).collect()[0]
    assert g["width"] % 4 == 0 and g["height"] % 4 == 0
    assert g["width"] * 10 == pytest.approx(3730, abs=60) and g["height"] * 10 == pytest.approx(3340, abs=60)


def test_tile_bounds_of_the_world(spark):
    b = one(spark, geo.tile_bounds(F.lit(0), F.lit(0), F.lit(0)))
    assert (b["west"], b["east"]) == (-180.0, 180.0) and b["north"] == pytest.approx(85.0511287798)


def test_colors(spark):
    assert one(spark, color.hex_to_rgb(F.lit("#21918c"))).asDict() == {"red": 0x21, "green": 0x91, "blue": 0x8c}
    g = lambda v, **k: one(spark, color.gradient(F.lit(v).cast("double"), **k))
    assert g(0.0)["red"] == 0x44 and g(5.0)["red"] == 0xfd and g(None)["alpha"] == 0
    assert g(float("nan"))["alpha"] == 0 and g(5.0, clamp=False)["alpha"] == 0
    assert one(spark, color.class_rgba(F.lit(9), ["#000000", "#0a0b0c"]))["green"] == 0x0b
    assert one(spark, color.class_rgba(F.lit(-1), ["#000000"]))["alpha"] == 0


def test_legend_of_another_length_is_left_out(spark):
    px = spark.createDataFrame([(1, 0)], "raster_id int, class_id int")
    legend = spark.createDataFrame([(0, "Forest", "#00ff00")], "class_id int, name string, color string")
    assert rasters.with_legend(px, legend, num_classes=1).collect()[0]["name"] == "Forest"
    row = rasters.with_legend(px, legend, num_classes=2).collect()[0]
    assert (row["name"], row["color"]) == ("class_0", "#888888")


def test_land_cover_percents(spark):
    px = spark.createDataFrame([(1, 2021, 10)] * 6 + [(1, 2021, 40)] * 3 + [(1, 2021, 77)] + [(1, 2021, 0)] * 5 + [(2, 2020, 80)], "aoi_id int, year int, code int")
    names = spark.createDataFrame([(10, "Tree", "#1"), (40, "Crop", "#2"), (80, "Water", "#3")], "code int, name string, color string")
    got = {(r["aoi_id"], r["name"]): (r["percent"], r["year"]) for r in rasters.land_cover(px, names).collect()}
    assert got == {(1, "Tree"): (60.0, 2021), (1, "Crop"): (30.0, 2021), (2, "Water"): (100.0, 2020)}


def test_reflectance_rules(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("nan", nan, 5.0), ("nan", 1.0, 2.0), ("inf", inf, 1.0), ("low", -2000.0, 5.0), ("high", 5.0, 50000.0), ("zero", 0.0, 0.0), ("unit", 0.5, 1.2), ("fine", 500.0, 900.0)]
    got = {r["k"]: r["status"] for r in rasters.reflectance_checks(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], ["a", "b"]).collect()}
    assert got == {"nan": "non_finite", "inf": "non_finite", "low": "outside_dn_range", "high": "outside_dn_range", "zero": "all_zero", "unit": "pre_normalized", "fine": "ok"}


def test_valid_pixels(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 5.0), (3, float("nan"), 5.0), (4, -9999.0, 5.0)], "i int, a double, b double")
    assert {r["i"] for r in rasters.valid_pixels(df, ["a", "b"]).collect()} == {2, 4}
    assert {r["i"] for r in rasters.valid_pixels(df, ["a", "b"], -9999.0).collect()} >= {1, 2}


def test_forced_provider(spark):
    a = spark.createDataFrame([(1, "ok", 10), (2, "error", None), (3, "empty", None)], "k int, status string, scene_id int")
    b = spark.createDataFrame([(1, "ok", 91), (2, "ok", 92)], "k int, status string, scene_id int")
    got = {r["k"]: (r["provider"], r["status"], r["scene_id"]) for r in scenes.provider_fallback(a, b, "k").collect()}
    assert got == {1: ("primary", "ok", 10), 2: ("secondary", "ok", 92), 3: ("primary", "empty", None)}
    assert {r["provider"] for r in scenes.provider_fallback(a, b, "k", "secondary").collect()} == {"secondary"}


def test_strip_meta(spark):
    body = "This answer is long enough to be kept as it stands."
    s = lambda x: one(spark, text.strip_meta(F.lit(x)))
    assert s(f"<think>a\nb</think>{body}") == body
    assert s(f"{body}<think>never closed") == body
    assert s(f"Okay, let's go.\n\nI'll write it.\n\n{body}") == body
    assert s(f"Paragraph 2: {body}") == body
    assert s("<think>" + "x" * 50) == text.UNFINISHED
    assert s("") == "" and s("short") == "short"


def test_phantom(spark):
    p = lambda x: one(spark, text.looks_phantom(F.lit(x)))
    assert p("Well, I have started the job") == "I have started" and p("I'm running late") is None


def test_segment_confidence_is_per_segment_and_per_class(spark):
    px = spark.createDataFrame([(1, 0, c, 0, "Forest", 0.9 if c < 5 else 0.1) for c in range(10)], "raster_id int, r int, c int, cluster int, class_name string, confidence double")
    reg = spark.createDataFrame([(1, 0, c, 0 if c < 5 else 7) for c in range(10)], "raster_id int, r int, c int, region long")
    rows = {r["region"]: r for r in labels.segment_features(px, reg, 10.0, 5).collect()}
    assert rows[0]["segment_confidence"] == pytest.approx(0.9) and rows[7]["segment_confidence"] == pytest.approx(0.1)
    assert rows[0]["confidence"] == rows[7]["confidence"] == 0.5 and rows[0]["area_m2"] == 500.0


def test_too_few_pixels_give_nothing(spark):
    """A raster with too few has a status and no pixels, and takes nothing from another one."""
    small = [(1, 0, c, 1.0 + c) for c in range(9)]
    large = [(2, r, c, 100.0 * (c // 4) + r + 1) for r in range(10) for c in range(12)]
    kind = "raster_id int, r int, c int, a double"
    both, status = labels.label_raster_kmeans(spark.createDataFrame(small + large, kind), ["a"], 3)
    alone, _ = labels.label_raster_kmeans(spark.createDataFrame(large, kind), ["a"], 3)
    assert {(r.raster_id, r.status, r.n_classes) for r in status.collect()} == {(1, "too_few", 0), (2, "ok", 3)}
    key = lambda df: sorted((r.raster_id, r.r, r.c, r.cluster, r.class_id, r.color, round(r.confidence, 9)) for r in df.collect())
    assert key(both) == key(alone) and len(key(alone)) == 120


def test_category_labels(spark):
    df = spark.createDataFrame([(i, "abcdefghijk"[i]) for i in range(11)], "pid int, kind string")
    got = {r["auto_class"]: r["auto_color"] for r in labels.label_by_category(df, "pid").collect()}
    assert got["a"] == got["i"] == color.CLUSTER_COLORS[0] and got["k"] == color.CLUSTER_COLORS[2]
    bare = labels.label_by_category(df.select("pid"), "pid").collect()
    assert {(r["auto_class"], r["needs_review"]) for r in bare} == {("Unclassified", True)}


def test_streaks(spark):
    t0 = datetime.datetime(2024, 1, 1)
    oks = [True, False, False, True, False, False, False, False]
    rows = [(i, t0 + datetime.timedelta(minutes=40 * i), 5, ok) for i, ok in enumerate(oks)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, job_id int, ok boolean")
    assert failure_streaks(df, 3).collect()[0]["trip_event_id"] == 6
    assert failure_streaks(df, 5).collect()[0]["tripped"] is False
    assert failure_streaks(df, 0).collect()[0]["tripped"] is False


def test_registry_log(spark):
    log = spark.createDataFrame([("a", 1, 1, "upsert"), ("a", 2, 2, "delete"), ("b", 1, 3, "upsert"), ("b", 3, 4, "upsert")], "filename string, at int, version int, op string")
    assert [(r["filename"], r["at"]) for r in catalog.latest(log, "filename", "at").collect()] == [("b", 3)]


def test_static_catalog_stands_in(spark):
    static = spark.createDataFrame([("x", "t")], "repo_id string, task string")
    live = spark.createDataFrame([], "repo_id string, downloads int")
    assert [tuple(r) for r in catalog.catalog_merge(live, static).select("repo_id", "task", "origin").collect()] == [("x", "t", "static")]


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/src"
    os.makedirs(path)
    with open(f"{path}/bad.tif", "w") as f:
        f.write(' {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"a": 1}}]}')
    with open(f"{path}/points.csv", "w") as f:
        f.write("id,LAT_dd,Lng\n1,2.5,3.5\n")
    spark.range(1).write.parquet(f"{path}-parquet")
    status = {r["name"]: r["status"] for r in files.quarantine_mismatch(files.read_heads(spark, path)).collect()}
    assert status["bad.tif"] == "format_mismatch" and status["points.csv"] == "ok"
    row = files.read_points_csv(spark, f"{path}/points.csv").collect()[0]
    assert (row["lon"], row["lat"]) == (3.5, 2.5)
    feature = files.read_geojson(spark, f"{path}/bad.tif").select("geometry_type", "coordinates", F.variant_get("properties", "$.a", "int").alias("a")).collect()[0]
    assert (feature["geometry_type"], feature["a"]) == ("Point", 1) and feature["coordinates"].startswith("[1.5,")
    foot = files.geo_footers(spark.read.format("binaryFile").load(f"{path}-parquet/*.parquet")).collect()
    assert foot and not any(r["geo_footer"] for r in foot)
    with pytest.raises(ValueError):
        files.read_points_csv(spark, f"{path}/bad.tif")


def test_polygon_wkb(spark):
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    df = spark.createDataFrame([(1, bytearray(wkb)), (2, None)], "id int, geometry binary")
    got = {r["id"]: r for r in files.decode_wkb(df).collect()}
    assert got[1]["rings"] == [[list(p) for p in ring]] and got[2]["geometry_type"] is None


def test_tools(spark):
    px = spark.createDataFrame([(1, 0, c, c % 3) for c in range(9)], "raster_id int, r int, c int, class_id int")
    assert tools.call("query_raster_histogram", px=px, num_classes=3).count() == 3
    with pytest.raises(KeyError):
        tools.call("nothing")
    with pytest.raises(TypeError):
        tools.call("vectorize")


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    row = spark.sql("SELECT ndvi(1D, 3D) AS a, hex_green('#21918c') AS b, vector_dot(array(1D, 2D), array(3D, 4D)) AS c, subtract_months(DATE '2024-03-31', 1) AS d").collect()[0]
    assert (row["a"], row["b"], row["c"], row["d"]) == (0.5, 0x91, 11.0, datetime.date(2024, 2, 29))


def test_streak_over_many_small_files(spark):
    """Events split over files in mixed order: the stream's answer does not depend on the split."""
    src = "/root/testdata/sf0.001/events*.parquet"
    path = sinks.scratch_path(spark, "events")
    spark.read.parquet(src).repartition(6).write.parquet(path)
    whole = {tuple(r) for r in jobs.run_available(jobs.streak_stream(jobs.event_stream(spark, src), 3), "a").collect()}
    stream = jobs.event_stream(spark, path)
    parts = {tuple(r) for r in jobs.run_available(jobs.streak_stream(stream, 3), "b").collect()}
    assert whole == parts and whole


def test_streaks_of_jobs_in_shared_state(spark):
    """Jobs of one bucket, one of them nameless, over several batches: each event as if counted job by job."""
    path = sinks.scratch_path(spark, "outcomes")
    rows = spark.range(600).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 7 END AS job_id", "timestamp_micros(1700000000000000 + (id - id % 5) * 60000000) AS ts",
                                       "id AS event_id", "xxhash64(id) % 4 = 0 AS ok")
    held = rows.orderBy("event_id").collect()
    for lo in range(0, 600, 200):
        rows.where(f"event_id >= {lo} AND event_id < {lo + 200}").repartition(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["job_id"] or 0, r["event_id"]) for r in jobs.run_available(jobs.streak_stream(stream, 3, buckets=2), "shared").collect())
    last, want, run = max(r["ts"] for r in held) - datetime.timedelta(hours=1), [], {}
    for r in sorted(held, key=lambda r: (r["ts"], r["event_id"])):
        run[r["job_id"]] = 0 if r["ok"] else run.get(r["job_id"], 0) + 1
        if run[r["job_id"]] == 3 and r["ts"] <= last:
            want.append((r["job_id"] or 0, r["event_id"]))
    assert got == sorted(want) and want


def test_no_cap_on_classes_and_ids(spark):
    """More ids than 256 and more classes than 1,024 come out whole."""
    from geoloom.operators import embeddings

    px = spark.range(3000).selectExpr("1 AS raster_id", "CAST(id AS INT) AS r", "0 AS c", "CAST(id % 300 AS INT) AS class_id")
    assert rasters.present_classes(px).collect()[0]["class_ids"] == list(range(300))
    assert len(rasters.present_classes(px, 5).collect()[0]["class_ids"]) == 5
    angle = F.col("id") * (2 * 3.141592653589793 / 1500)
    vectors = spark.range(1500).select(F.lit(1).alias("raster_id"), F.col("id").cast("int").alias("class_id"), F.array(F.cos(angle), F.sin(angle)).alias("prototype"))
    emb = vectors.select("raster_id", F.col("class_id").alias("r"), F.lit(0).alias("c"), F.col("prototype").alias("embedding"))
    got = embeddings.few_shot(emb, vectors).collect()
    assert len(got) == 1500 and all(g["class_id"] == g["r"] for g in got)


def test_geo_footer_makes_geoparquet(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    plain = pa.table({"a": [1]})
    pq.write_table(plain, f"{tmp_path}/plain.parquet")
    pq.write_table(plain.replace_schema_metadata({"geo": "{}"}), f"{tmp_path}/geo.parquet")
    with open(f"{tmp_path}/broken.parquet", "w") as f:
        f.write("PAR1 but not a table")
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length", "modificationTime")
    got = {r["name"]: (r["format"], r["head_hex"][:8]) for r in files.with_format(files.with_heads(listed)).collect()}
    assert got == {"plain.parquet": ("parquet", "50415231"), "geo.parquet": ("geoparquet", "50415231"), "broken.parquet": ("parquet", "50415231")}


def test_per_raster_logistic(spark):
    """A raster's model is its own: another raster changes nothing, one class gives no model."""
    import numpy as np

    from geoloom.operators import embeddings

    rng = np.random.default_rng(5)

    def patches(raster, flip):
        return [(raster, i, 0, (rng.normal(0, 0.3, 4) + (1.0 if (i % 2) ^ flip else -1.0)).tolist(), i % 2) for i in range(60)]

    kind = "raster_id int, r int, c int, embedding array<double>, class_id int"
    one, two, single = patches(1, 0), patches(2, 1), [(3, 0, 0, [1.0] * 4, 1)]
    both = spark.createDataFrame(one + two + single, kind)
    alone = spark.createDataFrame(one, kind)
    run = lambda df: {(r.raster_id, r.r): r.class_id for r in embeddings.few_shot_logistic(df.drop("class_id"), df).collect()}
    got, first = run(both), run(alone)
    assert {k: v for k, v in got.items() if k[0] == 1} == first and set(k[0] for k in got) == {1, 2}
    assert sum(got[r[0], r[1]] == r[4] for r in one + two) > 115


def test_collections_are_split_by_lines(spark, tmp_path):
    """A feature per line is read by many tasks; any other form of body is read whole, to the same features."""
    def feature(i: int) -> str:
        return '{"type":"Feature","geometry":{"type":"Point","coordinates":[%d.50,1]},"properties":{"i":%d}}' % (i, i)

    (tmp_path / "lines").mkdir()
    (tmp_path / "any").mkdir()
    lines = '{"type":"FeatureCollection","features":[\n' + ",\n".join(feature(i) for i in range(5000)) + "\n]}\n"
    (tmp_path / "lines" / "a.json").write_text(lines)
    (tmp_path / "any" / "a.json").write_text(lines)
    two = '{"type":"FeatureCollection","features":[\n%s,%s,\n%s\n]}' % tuple(feature(i) for i in range(5000, 5003))
    (tmp_path / "any" / "two.json").write_text(two)
    (tmp_path / "any" / "more.json").write_text('{"features":[\n%s\n],"bbox":[0,0,1,1]}' % feature(5003))
    (tmp_path / "any" / "tall.json").write_text('{\n"features": [\n{"type": "Feature",\n"geometry": null,\n"properties": {"i": 5004}}]}')
    (tmp_path / "any" / "none.json").write_text('{"type":"FeatureCollection","features":[\n]}\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        assert files.read_geojson(spark, str(tmp_path / "lines")).rdd.getNumPartitions() > 3
        got = files.read_geojson(spark, str(tmp_path / "any")).selectExpr("variant_get(properties, '$.i', 'int') AS i", "coordinates").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(r["i"] for r in got) == list(range(5005))
    assert {r["i"]: r["coordinates"] for r in got}[4999] == "[4999.50,1]"
