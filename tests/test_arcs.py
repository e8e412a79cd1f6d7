"""Simplified outlines: shared borders stay shared, nothing crosses, nothing changes sides."""

from collections import Counter

import numpy as np
import pytest

from geoloom.operators.arcs import simplify_regions
from geoloom.operators.vectorize import connected_regions, labelled_polygons, region_rings, simplify
from geoloom.session import cut_lineage


def cross(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on(a, b, p):
    return cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def clash(s, t):
    """Two segments meet in more than an end they share."""
    (a, b), (c, d) = s, t
    if np.sign(cross(a, b, c)) * np.sign(cross(a, b, d)) < 0 and np.sign(cross(c, d, a)) * np.sign(cross(c, d, b)) < 0:
        return True
    return any(on(*x, p) and p not in x for x, y in ((s, t), (t, s)) for p in y)


def rasters():
    rng = np.random.default_rng(4)
    speckle = (rng.random((22, 25)) < 0.5).astype(int)
    thin = np.zeros((24, 30), int)  # bands a pixel wide that wind, and islands close to them
    for i in range(24):
        at = int(12 + 6 * np.sin(i / 3))
        thin[i, at] = 1
        thin[i, at + 2 : at + 4] = 2
    thin[5, 3] = thin[6, 4] = thin[15, 25] = 3
    nested = np.full((30, 30), -1)
    for k, (lo, hi) in enumerate(((1, 29), (2, 28), (5, 25), (6, 12), (7, 10), (14, 24), (15, 16))):
        nested[lo:hi, lo:hi] = k
    nested[20:23, 8:11] = 9
    yy, xx = np.mgrid[:40, :40]
    disc = ((yy - 20) ** 2 + (xx - 19) ** 2 < 200).astype(int) + ((yy - 12) ** 2 + (xx - 12) ** 2 < 60) + 3 * (xx + yy > 58)
    return [speckle, thin, nested, disc]


@pytest.fixture(scope="module")
def regions(spark):
    px = [(k, r, c, int(v)) for k, g in enumerate(rasters()) for (r, c), v in np.ndenumerate(g)]
    return cut_lineage(connected_regions(spark.createDataFrame(px, "raster_id int, r int, c int, class_id int"), 16))


@pytest.mark.parametrize("tol", [0.0, 0.6, 1.5, 4.0])
def test_topology_stays(spark, regions, tol):
    rings = cut_lineage(region_rings(regions, 16, True))
    scale = spark.createDataFrame([(k, 1.0, 1.0, tol) for k in range(4)], "raster_id int, sx double, sy double, tol double")
    got, full = {}, {}
    for out, df in ((got, simplify_regions(rings, scale)), (full, rings)):
        for r in df.collect():
            out.setdefault((r.raster_id, r.region, r.ring, r.hole), []).append((r.vtx, (r.x, r.y)))
    rings_of = {k: [p for _, p in sorted(v)] for k, v in got.items()}
    assert rings_of.keys() == full.keys()
    if tol > 1:
        # the speckle is all nodes; the discs have long borders
        assert sum(len(v) for k, v in rings_of.items() if k[0] == 3) < 0.7 * sum(len(v) for k, v in full.items() if k[0] == 3)
    for raster in range(4):
        edges = Counter()
        for (k, _, _, hole), p in rings_of.items():
            if k == raster:
                assert len(p) == len(set(p)) or len(p) >= 4  # a ring may pass a node twice
                assert len(set(p)) >= 3
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))
                assert area != 0 and (area < 0) == hole
                edges.update(zip(p, p[1:] + p[:1]))
        assert set(edges.values()) == {1}  # a side of a border belongs to one ring
        whole = {tuple(sorted(e)) for e in edges}
        inner = sum((b, a) in edges for a, b in edges)
        grid = rasters()[raster]
        assert (inner == len(edges)) is False and (inner > 0)
        assert (grid < 0).any() or len(whole) == len(edges) - inner // 2
        listed = sorted(whole)
        assert not [(s, t) for i, s in enumerate(listed) for t in listed[i + 1 :] if clash(s, t)]


def test_islands_stay_inside(spark):
    """A pixel in a bay that the tolerance would cut off stays on its side of the border."""
    g = np.zeros((20, 20), int)
    g[10:, :] = 1
    for c in range(2, 18):
        g[7:10, c] = 1 if c not in (8, 9, 10) else 0
    g[8, 9] = 2
    px = spark.createDataFrame([(0, r, c, int(v)) for (r, c), v in np.ndenumerate(g)], "raster_id int, r int, c int, class_id int")
    rings = cut_lineage(region_rings(connected_regions(px), nodes=True))
    out = {}
    for r in simplify_regions(rings, spark.createDataFrame([(0, 1.0, 1.0, 2.5)], "raster_id int, sx double, sy double, tol double")).collect():
        out.setdefault((r.region, r.ring), []).append((r.vtx, r.x, r.y, r.hole))
    first = {(r, c): min((i, j) for i, j in np.argwhere(g == v)) for (r, c), v in np.ndenumerate(g)}
    grey = [[(x, y) for _, x, y, _ in sorted(v)] for (region, _), v in out.items() if region == 10 * (1 << 31) or not v[0][3] and any(y > 12 for _, _, y, _ in v)]
    inside = sum((a[1] > 8.5) != (b[1] > 8.5) and 9.5 < (b[0] - a[0]) * (8.5 - a[1]) / (b[1] - a[1]) + a[0] for p in grey for a, b in zip(p, p[1:] + p[:1])) % 2
    assert first and inside == 0


def test_a_ring_does_not_cross_itself(spark):
    """Plain Douglas-Peucker cuts the hairpin's tongue with its far side."""
    ring = [(0, 0), (10, 0), (10, 10), (6, 10), (6, 1.2), (5.5, 0.9), (5, 1.2), (5, 10), (0, 10), (0, 0)]
    ring = [(x, y - (0.8 if 2 < x < 8 and y == 0 else 0)) for x, y in ring]
    ring[1:1] = [(4.0, 0.7), (5.5, 0.8), (7.0, 0.7)]
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(ring)]
    df = spark.createDataFrame(rows, "poly_id int, vtx int, lon double, lat double")
    for keep in (False, True):
        p = [(r.lon, r.lat) for r in sorted(simplify(df, 1.0, keep).collect(), key=lambda r: r.vtx)]
        edges = list(zip(p, p[1:]))
        bad = [(s, t) for i, s in enumerate(edges) for t in edges[i + 1 :] if clash(s, t)]
        assert not bad or not keep


def test_features_of_labelled_pixels(spark):
    """K9: each raster's own half pixel is its tolerance; one in degrees keeps its outlines beside one in metres."""
    g = rasters()[3]
    px = [(k, r, c, int(v), int(v), f"class {v}", "#00ff00", 0.9) for k in (0, 1) for (r, c), v in np.ndenumerate(g)]
    pixels = spark.createDataFrame(px, "raster_id int, r int, c int, cluster int, class_id int, class_name string, color string, confidence double")
    geo = spark.createDataFrame([(0, 10.0, 50.0, 0.0001, 0.0001, None, False), (1, 500000.0, 5600000.0, 10.0, 10.0, 32, False)],
                                "raster_id int, x0 double, y0 double, dx double, dy double, zone int, south boolean")
    features, polygons = labelled_polygons(pixels, geo, 10.0, min_px=5)
    assert features.count() == 2 * len({r.region for r in features.where("raster_id = 0").collect()}) > 4
    size = {(r.raster_id, r.region): r.n for r in polygons.groupBy("raster_id", "region").count().toDF("raster_id", "region", "n").collect()}
    assert all(size[0, k[1]] == n for k, n in size.items()) and max(size.values()) > 12
