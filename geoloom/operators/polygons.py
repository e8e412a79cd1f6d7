"""Polygons as vertex tables ``(poly_id, vtx, lon, lat)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import authalic_edge_m2, haversine_km
from geoloom.operators.scale import dealt, first_per


def outer_rings(features: DataFrame) -> DataFrame:
    """G1. The first ring of each polygon or multipolygon in GeoJSON arrays, as vertices."""
    ring = F.when(F.col("type") == "Polygon", F.col("rings")[0]).otherwise(F.col("parts")[0][0])
    return (features.select("poly_id", F.posexplode(ring).alias("vtx", "_p"))
            .select("poly_id", "vtx", F.col("_p")[0].alias("lon"), F.col("_p")[1].alias("lat")))


def ring_edges(rings: DataFrame) -> DataFrame:
    """G1. Vertex pairs of each ring, and a closing edge where the ring is open.

    Vertices are numbered without gaps, so each goes to the edge it starts and
    the edge it ends, and meets its partner on ``(poly_id, edge)``. No task
    holds a ring. What is left unmatched are the two ends of each ring.
    """
    point = F.struct("lon", "lat")
    role = F.array(F.struct(F.col("vtx").alias("e"), F.lit(True).alias("s")),
                   F.struct((F.col("vtx") - 1).alias("e"), F.lit(False).alias("s")))
    halves = (rings.select("poly_id", "lon", "lat", F.explode(role).alias("_r"))
              .groupBy("poly_id", F.col("_r.e").alias("vtx"))
              .agg(F.max(F.when(F.col("_r.s"), point)).alias("a"), F.max(F.when(~F.col("_r.s"), point)).alias("b")))
    # two rows per ring
    ends = (halves.where(F.col("a").isNull() | F.col("b").isNull()).groupBy("poly_id")
            .agg(F.max("vtx").alias("vtx"), F.max("a").alias("a"), F.max("b").alias("b"))
            .where((F.col("a.lon") != F.col("b.lon")) | (F.col("a.lat") != F.col("b.lat"))))
    edges = halves.where(F.col("a").isNotNull() & F.col("b").isNotNull()).unionByName(ends.select(halves.columns))
    return edges.select("poly_id", "vtx", F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"),
                        F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"))


def ring_measures(edges: DataFrame) -> DataFrame:
    """F2, F3, F6. Perimeter, equirectangular area and ellipsoidal area per ring.

    The scale at the mean latitude is a common factor, so one pass is enough;
    the mean is over the vertices, which the caller brings as ``mean_lat``.
    """
    cross = F.col("lon1") * F.col("lat2") - F.col("lon2") * F.col("lat1")
    return edges.groupBy("poly_id").agg(
        F.sum(haversine_km("lat1", "lon1", "lat2", "lon2")).alias("perimeter_km"),
        (F.abs(F.sum(cross)) / 2).alias("area_deg2"),
        F.abs(F.sum(authalic_edge_m2("lon1", "lat1", "lon2", "lat2"))).alias("geodesic_m2"))


def vertex_measures(rings: DataFrame) -> DataFrame:
    """F5. Vertex mean, extremes and count per ring, the closing vertex included."""
    return rings.groupBy("poly_id").agg(
        F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"),
        F.max("lat").alias("north"), F.count(F.lit(1)).alias("vertex_count"))


def polygon_stats(rings: DataFrame, elevation: DataFrame | None = None) -> DataFrame:
    """D8. The full readout; a ring of fewer than 3 vertices is reported, not measured."""
    ok = F.col("vertex_count") >= 3
    out = vertex_measures(rings).join(ring_measures(ring_edges(rings)), "poly_id", "left")
    area = F.col("area_deg2") * 111.32 * F.cos(F.radians("centroid_lat")) * 110.574
    out = (out.withColumn("area_km2", F.when(ok, F.round(area, 4)))
           .withColumn("perimeter_km", F.when(ok, F.round("perimeter_km", 4)))
           .withColumn("status", F.when(ok, "ok").otherwise("degenerate_polygon"))
           .drop("area_deg2", "geodesic_m2"))
    return out if elevation is None else out.join(elevation, "poly_id", "left")


def sample_grid(rings: DataFrame, n: int) -> DataFrame:
    """E11. The points of an ``n x n`` lattice over each ring's box that lie inside.

    Points are made only where they are kept. An edge goes to the lattice rows
    it crosses and marks the points west of its crossing as bits, 32 columns a
    word; the marks of a row's edges, combined by exclusive or, leave the
    points with an odd number of crossings to their east.
    """
    width = 32
    step = F.lit(max(n - 1, 1))
    box = vertex_measures(rings).select("poly_id", "west", "south", "east", "north")
    lat = F.col("south") + (F.col("north") - F.col("south")) / step * F.col("i")

    def lon(j: Column) -> Column:
        return F.col("west") + (F.col("east") - F.col("west")) / step * j

    # rows of the lattice between the ends of an edge, one more on either side; ``_crosses`` has the last word
    def row(end: Column) -> Column:
        at = (end - F.col("south")) / (F.col("north") - F.col("south")) * step
        return F.least(F.lit(n), F.greatest(F.lit(-1), F.floor(at))).cast("int")

    lo, hi = F.greatest(F.lit(0), row(F.least("lat1", "lat2")) - 1), F.least(F.lit(n - 1), row(F.greatest("lat1", "lat2")) + 1)
    words = F.sequence(F.lit(0), F.lit((n - 1) // width))
    columns = F.sequence(F.col("w") * width, F.least(F.col("w") * width + width, F.lit(n)) - 1)

    def bit(j: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), j - F.col("w") * width)

    def marks() -> Column:
        return F.aggregate(columns, F.lit(0).cast("bigint"), lambda m, j: m + F.when(F.col("at") > lon(j), bit(j)).otherwise(F.lit(0).cast("bigint")))

    met = (ring_edges(rings).where(F.col("lat1") != F.col("lat2")).join(dealt(box), "poly_id").where(F.col("north") > F.col("south"))
           .withColumn("i", F.explode(F.sequence(lo, hi))).withColumn("lat", lat).where(_spans())
           .withColumn("at", _crossing()).withColumn("w", F.explode(words)))
    inside = met.groupBy("poly_id", "i", "w").agg(
        F.bit_xor(marks()).alias("_m"), *[F.first(c).alias(c) for c in ("west", "east", "lat")])
    return (inside.where(F.col("_m") != 0).withColumn("j", F.explode(columns)).where(F.col("_m").bitwiseAND(bit(F.col("j"))) != 0)
            .select("poly_id", "i", "j", "lat", lon(F.col("j")).alias("lon")))


def _spans() -> Column:
    """The edge has one end above the point's latitude and one not."""
    return (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))


def _crossing() -> Column:
    """The longitude at which the edge passes the point's latitude."""
    return ((F.col("lon1") - F.col("lon2")) * (F.col("lat") - F.col("lat2"))
            / (F.col("lat1") - F.col("lat2") + 1e-20) + F.col("lon2"))


def _crosses() -> Column:
    """Even-odd rule: a ray to the east from the point crosses the edge."""
    return _spans() & (F.col("lon") < _crossing())


def _banded(edges: DataFrame, cell_deg: float) -> DataFrame:
    lo, hi = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    return (edges.where(F.col("lat1") != F.col("lat2"))
            .withColumn("_band", F.explode(F.sequence(F.floor(lo / cell_deg), F.floor(hi / cell_deg)))))


def points_in_polygons(points: DataFrame, rings: DataFrame, cell_deg: float = 1.0, salts: int = 8) -> DataFrame:
    """C8. Pairs of point and polygon with the point inside.

    Grid cells name the polygons a point may be in; the crossings are then
    counted over the edges of the point's latitude band only. Points are
    salted by id, so a crowded cell spreads over tasks. Cells and edges are
    many times their rings and are dealt, never sent.
    """
    box = vertex_measures(rings)
    west, east = F.floor(F.col("west") / cell_deg), F.floor(F.col("east") / cell_deg)
    south, north = F.floor(F.col("south") / cell_deg), F.floor(F.col("north") / cell_deg)
    cells = (box.withColumn("_cx", F.explode(F.sequence(west, east)))
             .withColumn("_band", F.explode(F.sequence(south, north)))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
             .select("poly_id", "_cx", "_band", "_salt", "west", "south", "east", "north"))
    pts = (points.select("pid", "lon", "lat").withColumn("_cx", F.floor(F.col("lon") / cell_deg))
           .withColumn("_band", F.floor(F.col("lat") / cell_deg))
           .withColumn("_salt", F.pmod(F.xxhash64("pid"), F.lit(salts)).cast("int")))
    near = (pts.join(dealt(cells), ["_cx", "_band", "_salt"])
            .where(F.col("lon").between(F.col("west"), F.col("east"))
                   & F.col("lat").between(F.col("south"), F.col("north")))
            .select("pid", "lon", "lat", "poly_id", "_band", "_salt"))
    edges = (_banded(ring_edges(rings), cell_deg)
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    hits = (near.join(dealt(edges), ["poly_id", "_band", "_salt"])
            .groupBy("pid", "poly_id").agg(F.sum(_crosses().cast("int")).alias("_n")))
    return hits.where(F.col("_n") % 2 == 1).select("pid", "poly_id")


def elevation_for(samples: DataFrame, dem: DataFrame, cell_deg: float) -> DataFrame:
    """C16. Elevation of the grid cell each sample falls in; null where there is none."""
    cell = dem.select("cx", "cy", "elevation")
    return (samples.withColumn("cx", F.floor(F.col("lon") / cell_deg).cast("bigint"))
            .withColumn("cy", F.floor(F.col("lat") / cell_deg).cast("bigint"))
            .join(cell, ["cx", "cy"], "left").drop("cx", "cy"))


def elevation_stats(samples: DataFrame) -> DataFrame:
    """D7. Elevation summary per polygon; polygons without any value have none.

    The lattice bounds the samples of a polygon, so the median holds few values.
    """
    e = F.when(~F.isnan("elevation"), F.col("elevation"))
    return samples.groupBy("poly_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.min(e).alias("min_m"), F.max(e).alias("max_m"),
        F.avg(e).alias("mean_m"), F.median(e).alias("median_m"), (F.max(e) - F.min(e)).alias("range_m"))


def neighbors_within(points: DataFrame, km: float = 1.0, k: int = 5, levels: int = 12,
                     km_per_deg: float = 111.0) -> DataFrame:
    """C7. Up to ``k`` nearest other points within ``km``, by planar distance at the point's latitude.

    Exact without pairing up a crowded cell. Each distinct place keeps its
    ``k + 1`` smallest ids, which is all a nearest list can use. A nested grid
    halves the cell from level to level, and each place asks at the finest
    level where its own cell alone holds ``k + 1`` points: the answer then lies
    within one cell diagonal, so the ask covers few cells, and a place in a
    sparse part of a crowded cell has at most a handful of peers. Cells, asks
    and lists are many times the points and are dealt, never sent.
    """
    place = (points.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n_here"), F.min("pid").alias("o_pid"))
             .withColumn("x", F.col("lon") * km_per_deg).withColumn("y", F.col("lat") * km_per_deg))
    kept = first_per(points.select("pid", "lon", "lat"), ["lon", "lat"], [F.asc("pid")], k + 1)
    # cell widths in km of unscaled longitude: the scale 1 / cos(lat) is applied when asking
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    size = F.lit(km) / F.pow(F.lit(2.0), F.col("lv"))
    cos_lat = F.greatest(F.lit(1e-6), F.cos(F.radians("lat")))
    cells = (place.withColumn("lv", lv)
             .withColumn("cx", F.floor(F.col("x") / size).cast("bigint"))
             .withColumn("cy", F.floor(F.col("y") / size).cast("bigint")))
    dense = (cells.groupBy("lv", "cx", "cy").agg(F.sum("n_here").alias("n"))
             .where(F.col("n") >= k + 1).drop("n"))
    # near a pole a cell of longitude is too narrow to ask finely
    level = (cells.where((F.col("lv") == 0) | (cos_lat > 0.05)).join(dealt(dense), ["lv", "cx", "cy"])
             .groupBy("lon", "lat").agg(F.max("lv").alias("lv")))
    asks = (place.join(dealt(level), ["lon", "lat"], "left")
            .withColumn("full", F.col("lv").isNotNull()).withColumn("lv", F.coalesce("lv", F.lit(0))))
    # own cell full: within its diagonal; otherwise within the whole radius
    reach = F.least(F.lit(km), F.when(F.col("full"), size * (2 ** 0.5)).otherwise(F.lit(km)))
    world = 180 * km_per_deg
    cx_lo = F.floor(F.greatest(F.lit(-world), F.col("x") - F.col("reach") / cos_lat) / size).cast("bigint")
    cx_hi = F.floor(F.least(F.lit(world), F.col("x") + F.col("reach") / cos_lat) / size).cast("bigint")
    cy_lo = F.floor((F.col("y") - F.col("reach")) / size).cast("bigint")
    cy_hi = F.floor((F.col("y") + F.col("reach")) / size).cast("bigint")
    asks = (asks.withColumn("reach", reach).withColumn("cx", F.explode(F.sequence(cx_lo, cx_hi)))
            .withColumn("cy", F.explode(F.sequence(cy_lo, cy_hi)))
            .select("lv", "cx", "cy", "lon", "lat"))
    other = cells.select("lv", "cx", "cy", "o_pid", F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    d = F.sqrt(F.pow((F.col("o_lon") - F.col("lon")) * km_per_deg * F.cos(F.radians("lat")), 2)
               + F.pow((F.col("o_lat") - F.col("lat")) * km_per_deg, 2))
    near = asks.join(dealt(other), ["lv", "cx", "cy"]).withColumn("distance_km", d).where(F.col("distance_km") <= km)
    # k + 1 nearest places hold the k + 1 nearest points
    near = first_per(near.select("lon", "lat", "o_lon", "o_lat", "o_pid", "distance_km"), ["lon", "lat"],
                     [F.asc("distance_km"), F.asc("o_pid")], k + 1)
    o = kept.select(F.col("pid").alias("neighbor"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    near = near.join(dealt(o), ["o_lon", "o_lat"])
    near = first_per(near, ["lon", "lat"], [F.asc("distance_km"), F.asc("neighbor")], k + 1)
    lists = near.groupBy("lon", "lat").agg(F.collect_list(F.struct("distance_km", "neighbor")).alias("_l"))
    out = (points.select("pid", "lon", "lat").join(dealt(lists), ["lon", "lat"])
           .withColumn("_l", F.slice(F.array_sort(F.filter("_l", lambda s: s["neighbor"] != F.col("pid"))), 1, k)))
    return out.select("pid", F.posexplode("_l").alias("rank", "_n")).select(
        "pid", (F.col("rank") + 1).alias("rank"), F.col("_n.neighbor").alias("neighbor"),
        F.col("_n.distance_km").alias("distance_km"))
