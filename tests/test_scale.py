"""The building blocks against brute force, on data with hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import labels, scale
from geoloom.operators.polygons import neighbors_within, points_in_polygons, ring_edges, sample_grid
from geoloom.operators.vectorize import connected_regions, region_rings, region_table, simplify


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, and half of those with one value."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        key = 0 if i % 3 == 0 else int(rng.integers(1, 40))
        value = 7.5 if key == 0 and i % 2 == 0 else float(rng.normal() * 10.0 ** rng.integers(-3, 6))
        rows.append((i, key, value))
    rows += [(6000, 1, None), (6001, 1, float("nan")), (6002, 99, -0.0), (6003, 99, 0.0)]
    return rows, spark.createDataFrame(rows, "id int, key int, v double")


@pytest.mark.parametrize("parts", [1, 16])
def test_exact_stats(hot, parts):
    rows, df = hot
    probs = {"p2": 0.02, "p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r["key"]: r for r in scale.exact_stats(df.repartition(parts), ["key"], "v", probs).collect()}
    groups = {}
    for _, k, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    assert got.keys() == groups.keys()
    for k, vals in groups.items():
        assert got[k]["n"] == len(vals)
        assert got[k]["mean"] == pytest.approx(np.mean(vals), rel=1e-9, abs=1e-9)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vals, p), rel=1e-12, abs=1e-12)


def test_exact_stats_of_crowded_and_endless_values(spark):
    """All values within a millionth of each other, and infinities."""
    rng = np.random.default_rng(9)
    close = 1.7e9 + rng.random(3000)
    rows = [(1, float(v)) for v in close] + [(2, float("inf")), (2, float("-inf")), (2, 3.0)]
    got = {r["key"]: r for r in scale.exact_stats(spark.createDataFrame(rows, "key int, v double"), ["key"], "v", {"p": 0.3, "m": 0.5}).collect()}
    assert got[1]["p"] == pytest.approx(np.quantile(close, 0.3), rel=1e-15)
    assert got[2]["m"] == 3.0 and got[2]["n"] == 3


def test_exact_stats_without_keys(hot):
    rows, df = hot
    vals = [v for _, _, v in rows if v is not None and not math.isnan(v)]
    r = scale.exact_stats(df, [], "v", {"p": 0.37}).collect()
    assert len(r) == 1 and r[0]["p"] == pytest.approx(np.quantile(vals, 0.37))


def test_order_bin_never_decreases(spark):
    rng = np.random.default_rng(5)
    vals = np.sort(np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-12, 12, 2000), [0.0, -1e300, 1e300]]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double")
    bins = [r[0] for r in df.orderBy("i").select(scale.order_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_matches_a_plain_window(hot, how):
    _, df = hot
    df = df.where("v IS NOT NULL AND NOT isnan(v)").withColumn("b", F.floor(F.col("id") / 97)).withColumn("x", F.floor("v"))
    got = scale.running(df, ["key"], "b", [F.asc("id")], how, {"y": F.col("x")})
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("y", (F.sum if how == "sum" else F.max)("x").over(w))
    pick = lambda d: sorted((r["id"], float(r["y"])) for r in d.select("id", "y").collect())
    assert pick(got) == pick(want)


def test_first_per_limits_before_the_shuffle(hot):
    _, df = hot
    top = scale.first_per(df, ["key"], [F.desc("v"), F.asc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert top.groupBy("key").count().where("count > 3").count() == 0


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = scale.row_index(df, [F.asc("v")], "i").collect()
    assert sorted((r["v"], r["i"]) for r in got) == [(i, i) for i in range(1000)]


def test_cell_join_in_a_crowded_cell(spark):
    rng = np.random.default_rng(1)
    boxes = [(i, float(x), float(y), float(x + w), float(y + 1)) for i, (x, y, w) in
             enumerate(zip(rng.uniform(-3, 3, 300), rng.uniform(-3, 3, 300), rng.uniform(0, 9, 300)))]
    a, b = boxes[:40], boxes[40:]
    cols = "id int, west double, south double, east double, north double"
    got = scale.cell_join(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 2.0).select("id", "r_id").collect()
    want = [(i[0], j[0]) for i in a for j in b if i[1] <= j[3] and i[3] >= j[1] and i[2] <= j[4] and i[4] >= j[2]]
    assert sorted(map(tuple, got)) == sorted(want)


def _near(points, km, k):
    out = {}
    for p, lon, lat in points:
        d = [(math.sqrt(((x - lon) * 111 * math.cos(math.radians(lat))) ** 2 + ((y - lat) * 111) ** 2), q)
             for q, x, y in points if q != p]
        out[p] = [q for dist, q in sorted(d) if dist <= km][:k]
    return {p: v for p, v in out.items() if v}


def test_neighbors_with_hot_places(spark):
    """A third of the points in one place, a tight cluster, a sparse rest, and points near a pole."""
    rng = np.random.default_rng(2)
    pts = [(i, 10.0, 50.0) for i in range(60)]
    pts += [(60 + i, 10.0 + float(x), 50.0 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.001, (60, 2)))]
    pts += [(120 + i, 10.0 + float(x), 50.0 + float(y)) for i, (x, y) in enumerate(rng.uniform(-0.03, 0.03, (60, 2)))]
    pts += [(180 + i, float(x), 89.0) for i, x in enumerate(rng.uniform(0, 2, 20))]
    df = spark.createDataFrame(pts, "pid int, lon double, lat double")
    got = {}
    for r in neighbors_within(df, 1.0, 5).orderBy("pid", "rank").collect():
        got.setdefault(r["pid"], []).append(r["neighbor"])
    assert got == _near(pts, 1.0, 5)


def test_points_in_a_crowded_polygon(spark):
    ring = [(0, 0.0, 0.0), (1, 4.0, 0.5), (2, 3.0, 2.0), (3, 4.0, 4.0), (4, 1.0, 3.0), (5, 0.0, 0.0)]
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 5, (500, 2)))]
    rings = spark.createDataFrame([(1, *v) for v in ring], "poly_id int, vtx int, lon double, lat double")
    got = {r["pid"] for r in points_in_polygons(spark.createDataFrame(pts, "pid int, lon double, lat double"), rings).collect()}

    def inside(x, y):
        hit = False
        for (_, x1, y1), (_, x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    assert got == {i for i, x, y in pts if inside(x, y)}


def sends(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def spread(spark, n: int):
    """Points of a table that Spark takes for small."""
    return spark.range(n).selectExpr("id AS pid", "id * 7919 % 3600 / 10D - 180 AS lon", "id * 104729 % 1700 / 10D - 85 AS lat")


def rings_of(spark, n: int):
    return spark.range(n).selectExpr("id AS poly_id", "inline(array(struct(0, 0, 0), struct(1, 10, 0), struct(2, 15, 8), struct(3, 7, 5), struct(4, 2, 12), struct(5, 0, 0))) AS (vtx, dx, dy)").selectExpr(
        "poly_id", "vtx", "poly_id * 37 % 340 - 170 + dx / 10D AS lon", "poly_id * 11 % 140 - 70 + dy / 10D AS lat")


def test_cells_and_lists_of_neighbours_are_dealt(spark):
    """Multiplied rows are no small table, whatever the files' size."""
    assert not sends(neighbors_within(spread(spark, 2000), 400.0, 5))


def test_cells_and_edges_of_polygons_are_dealt(spark):
    assert not sends(points_in_polygons(spread(spark, 2000), rings_of(spark, 200)))


@pytest.mark.parametrize("n", [1, 12, 70])
def test_lattice_points_by_the_crossings_of_their_row(spark, n):
    """The same points as edge by edge; only crossed rows of the lattice are made, and no table is sent."""
    rings = rings_of(spark, 20)
    got = sample_grid(rings, n)
    assert not sends(got)
    want = set()
    for poly in {r["poly_id"] for r in rings.collect()}:
        ring = [(r["lon"], r["lat"]) for r in rings.where(F.col("poly_id") == poly).orderBy("vtx").collect()]
        west, east, south, north = min(x for x, _ in ring), max(x for x, _ in ring), min(y for _, y in ring), max(y for _, y in ring)
        for i in range(n):
            for j in range(n):
                lat, lon = south + (north - south) / max(n - 1, 1) * i, west + (east - west) / max(n - 1, 1) * j
                hits = sum((y1 > lat) != (y2 > lat) and lon < (x1 - x2) * (lat - y2) / (y1 - y2 + 1e-20) + x2
                           for (x1, y1), (x2, y2) in zip(ring, ring[1:]))
                if hits % 2:
                    want.add((poly, i, j, lat, lon))
    assert {tuple(r) for r in got.select("poly_id", "i", "j", "lat", "lon").collect()} == want


def test_votes_and_evidence_are_dealt(spark):
    f = spark.range(2000).selectExpr("id AS pid", "concat('c', id % 3) AS class_name", "id % 10 / 10D AS confidence", "id % 10 < 6 AS needs_review")
    near = spark.range(10000).selectExpr("id % 2000 AS pid", "id * 31 % 2000 AS neighbor")
    got = labels.validate_features(f, near, {"a": spark.range(0, 2000, 2).toDF("pid"), "b": spark.range(0, 2000, 3).toDF("pid")})
    assert not sends(got) and got.count() == 2000
    assert got.where("target AND pid % 6 = 0").agg(F.min(F.array_join("evidence", ",")), F.max(F.array_join("evidence", ","))).first() == ("a,b,neighbors",) * 2


def test_open_rings_are_closed(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 0.0, 1.0)], "poly_id int, vtx int, lon double, lat double")
    got = sorted(tuple(r) for r in ring_edges(df).select("vtx", "lon1", "lat1", "lon2", "lat2").collect())
    assert got == [(0, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 0.0)]


def _flood(grid):
    label, out = {}, {}
    for p in sorted(grid):
        if p in label or grid[p] < 0:
            continue
        stack = [p]
        while stack:
            q = stack.pop()
            if q in label:
                continue
            label[q] = p
            for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                n = (q[0] + d[0], q[1] + d[1])
                if grid.get(n) == grid[p] and n not in label:
                    stack.append(n)
    for q, root in label.items():
        out.setdefault(root, set()).add(q)
    return {frozenset(v) for v in out.values()}


@pytest.fixture(scope="module")
def raster():
    """A spiral of one class, rings with holes, diagonal touches, speckle and nodata."""
    rng = np.random.default_rng(8)
    g = (rng.random((37, 41)) < 0.45).astype(int)
    g[5:30, 5:35] = 2
    g[8:27, 8:32] = 3
    g[12:20, 12:20] = 2
    g[14:16, 14:16] = 3
    g[0:4, :] = -1
    return {(i, j): int(g[i, j]) for i in range(37) for j in range(41)}


@pytest.mark.parametrize("block", [5, 64])
def test_regions_match_a_flood_fill(spark, raster, block):
    px = spark.createDataFrame([(1, r, c, k) for (r, c), k in raster.items()], "raster_id int, r int, c int, class_id int")
    got = {}
    for r in connected_regions(px, block).collect():
        got.setdefault(r["region"], set()).add((r["r"], r["c"]))
    assert {frozenset(v) for v in got.values()} == _flood(raster)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 3000 nodes in mixed order, many local minima, and a star."""
    from geoloom.operators import vectorize

    names = np.random.default_rng(12).permutation(3000)
    chain = [(1, int(a), int(b)) for a, b in zip(names, names[1:])]
    star = [(2, 0, i) for i in range(1, 500)] + [(2, 900, 901)]
    rounds = []
    cut = vectorize.cut_lineage
    monkeypatch.setattr(vectorize, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    got = vectorize.smallest_reachable(spark.createDataFrame(chain + star, "raster_id int, u long, v long")).collect()
    assert {r["root"] for r in got if r["raster_id"] == 1} == {0}
    assert {(r["node"] >= 900, r["root"]) for r in got if r["raster_id"] == 2} == {(False, 0), (True, 900)}
    assert len(rounds) < 16


@pytest.mark.parametrize("block", [5, 64])
def test_rings_enclose_their_regions(spark, raster, block):
    px = spark.createDataFrame([(1, r, c, k) for (r, c), k in raster.items()], "raster_id int, r int, c int, class_id int")
    regions = connected_regions(px, block)
    size = {r["region"]: r["pixel_count"] for r in region_table(regions, 1.0, 1).collect()}
    rings = {}
    for r in region_rings(regions, block).collect():
        rings.setdefault((r["region"], r["ring"]), []).append((r["vtx"], r["x"], r["y"], r["hole"]))
    area = {}
    for (region, _), pts in rings.items():
        pts.sort()
        xy = [(x, y) for _, x, y, _ in pts]
        a = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(xy, xy[1:] + xy[:1])) / 2
        assert (a < 0) == pts[0][3]
        # corners only, and every side is axis-parallel
        for (x1, y1), (x2, y2) in zip(xy, xy[1:] + xy[:1]):
            assert (x1 == x2) != (y1 == y2)
        area[region] = area.get(region, 0) + a
    assert area == size


def plain_simplify(x, y, tol):
    """Douglas-Peucker with a stack; the ends, the farthest vertex and the one farthest from it where fewer than four stay."""
    def gap(k, a, b):
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = min(1, max(0, ((x[k] - x[a]) * dx + (y[k] - y[a]) * dy) / length)) if length else 0
        return np.hypot(x[k] - x[a] - t * dx, y[k] - y[a] - t * dy)

    keep, stack = {0, len(x) - 1}, [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        far = max(((gap(k, a, b), -k) for k in range(a + 1, b)), default=(0, 0))
        if far[0] > tol:
            keep.add(-far[1])
            stack += [(a, -far[1]), (-far[1], b)]
    if len(keep) < 4:
        inner = range(1, len(x) - 1)
        tip = -max((np.hypot(x[k] - x[0], y[k] - y[0]), -k) for k in inner)[1]
        keep |= {tip, -max((gap(k, 0, tip), -k) for k in inner if k != tip)[1]}
    return sorted(keep)


def test_simplify_equals_a_plain_one(spark):
    rng = np.random.default_rng(6)
    rows, shapes = [], []
    for p in range(5):
        n = 200
        a = np.linspace(0, 2 * np.pi, n)
        rad = 10 + rng.normal(0, 0.3, n)
        x, y = rad * np.cos(a), rad * np.sin(a)
        x[-1], y[-1] = x[0], y[0]
        shapes.append((x, y))
        rows += [(p, i, float(x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "poly_id int, vtx int, lon double, lat double")
    for tol in (0.5, 1000.0):
        got = sorted((r["poly_id"], r["vtx"]) for r in simplify(df, tol).collect())
        assert got == [(p, k) for p, (x, y) in enumerate(shapes) for k in plain_simplify(x, y, tol)]
    assert len(got) == 20  # no ring is lost
    assert simplify(df, 0).count() == 1000


def test_polygons_in_wgs84_are_exact_with_holes(spark):
    """A ring of pixels around another class, in UTM: the outer ring and the hole come out at the pixel corners."""
    from geoloom.functions.geo import to_utm
    from geoloom.operators.vectorize import polygon_features, region_polygons

    px = spark.createDataFrame([(3, r, c, 2 if 2 <= r < 4 and 2 <= c < 5 else 1) for r in range(6) for c in range(8)], "raster_id int, r int, c int, class_id int")
    geo = spark.createDataFrame([(3, 500000.0, 4649776.0, 10.0, 10.0, 33, False)], "raster_id int, x0 double, y0 double, dx double, dy double, zone int, south boolean")
    for block in (3, 256):
        regions = connected_regions(px, block)
        table = region_table(regions, 10.0)
        got = region_polygons(regions, table, geo, 0.0, block)
        back = got.withColumn("u", to_utm("lon", "lat", F.lit(33))).select("region", "ring", "hole", "vtx", "u.x", "u.y").collect()
        corners = {}
        for r in sorted(back, key=lambda r: r["vtx"]):
            corners.setdefault((r["region"], r["ring"], r["hole"]), []).append((round((r["x"] - 500000) / 10, 5), round((4649776 - r["y"]) / 10, 5)))
        outer = {(0.0, 0.0), (8.0, 0.0), (8.0, 6.0), (0.0, 6.0)}
        inner = {(2.0, 2.0), (5.0, 2.0), (5.0, 4.0), (2.0, 4.0)}
        assert sorted((hole, sorted(set(v))) for (_, _, hole), v in corners.items()) == sorted([(False, sorted(outer)), (True, sorted(inner)), (False, sorted(inner))])
        assert all(v[0] == v[-1] and len(v) == 5 for v in corners.values())
        shapes = {r["pixel_count"]: r["coordinates"] for r in polygon_features(got, table).collect()}
        assert {n: len(c) for n, c in shapes.items()} == {42: 2, 6: 1}




def test_texts_inside_texts(spark):
    """Against every pair; needles shorter than a piece, missing ones and one in a text that repeats its pieces."""
    from geoloom.operators.catalog import texts_inside

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc"), rng.integers(1, 40))) for _ in range(200)] + ["a" * 300, "é日本語ab", ""]
    needles = ["a", "ab", "abc", "abca", "abcabc", "zzzz", "aaaaaaa", "日本", "語ab", "", "b" * 9] + [t[2:9] for t in texts[:40]]
    got = texts_inside(spark.createDataFrame([(x,) for x in needles * 2], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string"))
    want = {(n, t) for n in needles if n for t in texts if n in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.count() > 200 and texts_inside(got.select("needle").limit(0), got.select("text")).count() == 0
