"""Planning over areas of interest: chunks, pixel grids, coverage, conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import (bbox_area_km2, bbox_contains, great_circle_km, lonlat_to_tile,
                                   reproject_bbox, utm_zone)
from geoloom.operators.scale import cell_join

BOX = ("west", "south", "east", "north")


def chunk_counts(aois: DataFrame, size_m: float = 5000, m_per_deg: float = 111000.0) -> DataFrame:
    """Rows and columns of the chunk grid of each area, at least one each."""
    mid = F.radians((F.col("north") + F.col("south")) / 2)

    def n(span: Column, step: Column | float) -> Column:
        return F.greatest(F.lit(1), F.ceil(span / step)).cast("int")

    return (aois.withColumn("n_rows", n(F.col("north") - F.col("south"), F.lit(size_m / m_per_deg)))
            .withColumn("n_cols", n(F.col("east") - F.col("west"), size_m / (m_per_deg * F.cos(mid)))))


def plan_chunks(aois: DataFrame, size_m: float = 5000, m_per_deg: float = 111000.0) -> DataFrame:
    """E2. Row-major grid of equal sub-boxes no larger than ``size_m``; ``chunk_*`` columns."""
    g = chunk_counts(aois, size_m, m_per_deg)
    dx = (F.col("east") - F.col("west")) / F.col("n_cols")
    dy = (F.col("north") - F.col("south")) / F.col("n_rows")
    rc = (g.withColumn("chunk_r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
          .withColumn("chunk_c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))))
    return (rc.withColumn("chunk_west", F.col("west") + F.col("chunk_c") * dx)
            .withColumn("chunk_south", F.col("south") + F.col("chunk_r") * dy)
            .withColumn("chunk_east", F.col("west") + (F.col("chunk_c") + 1) * dx)
            .withColumn("chunk_north", F.col("south") + (F.col("chunk_r") + 1) * dy))


def check_aoi_size(aois: DataFrame, size_m: float = 5000, limit: int = 0) -> DataFrame:
    """B12. Chunk count per area and whether it passes the limit; 0 means no limit."""
    g = chunk_counts(aois, size_m)
    n = F.col("n_rows").cast("bigint") * F.col("n_cols")
    over = (n > limit) if limit > 0 else F.lit(False)
    return (g.withColumn("n_chunks", n).withColumn("area_km2", bbox_area_km2(*BOX, 111.0, 111.0))
            .withColumn("status", F.when(over, "too_large").otherwise("ok"))
            .withColumn("max_area_km2", F.when(over, F.lit(limit * size_m ** 2 / 1e6))))


def resolve_grid(aois: DataFrame, gsd: float = 10.0, patch: int = 1) -> DataFrame:
    """E3. One UTM zone per area and a pixel grid over its box, in whole patches."""
    mid = (F.col("west") + F.col("east")) / 2
    g = aois.withColumn("zone", utm_zone(mid)).withColumn("_b", reproject_bbox(*BOX, "zone"))

    def n(lo: str, hi: str) -> Column:
        px = F.greatest(F.lit(1), F.bround(F.abs(F.col(f"_b.{hi}") - F.col(f"_b.{lo}")) / gsd)).cast("int")
        return F.greatest(F.lit(patch), px - px % patch).cast("int")

    return (g.withColumn("width", n("x_min", "x_max")).withColumn("height", n("y_min", "y_max"))
            .withColumn("x_min", F.col("_b.x_min")).withColumn("y_max", F.col("_b.y_max")).drop("_b"))


def project_coverage(aois: DataFrame, regions: DataFrame, cell_deg: float = 10.0) -> DataFrame:
    """C13. Regions that overlap each area; region columns come out as ``r_*``.

    The areas are the many: they are the salted side, so a crowded cell spreads
    over tasks, and the regions are copied.
    """
    met = cell_join(regions, aois, cell_deg)
    return met.select(*[F.col(f"r_{c}").alias(c) for c in aois.columns], *[F.col(c).alias(f"r_{c}") for c in regions.columns])


def off_distribution(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """C14. Requests whose box is not wholly in the region their head was trained on."""
    r = regions.select("head", *[F.col(b).alias(f"r_{b}") for b in BOX])
    rbox = [f"r_{b}" for b in BOX]

    def mid(a: str, b: str) -> Column:
        return (F.col(a) + F.col(b)) / 2

    return (requests.join(r, "head").where(~bbox_contains(tuple(rbox), BOX))
            .withColumn("distance_km", great_circle_km(mid("south", "north"), mid("west", "east"),
                                                       mid("r_south", "r_north"), mid("r_west", "r_east")))
            .drop(*rbox))


def enrich_env(aois: DataFrame, weather: DataFrame, variables: list[str], cell_deg: float) -> DataFrame:
    """C15. The latest reading of the cell of each area's centre, for the wanted variables.

    ``weather``: ``cx cy ts`` and one column per variable. A cell without a
    reading, or an unknown variable, gives an error text and not silent nulls.
    """
    known = [v for v in variables if v in weather.columns]
    unknown = [v for v in variables if v not in weather.columns]
    latest = weather.groupBy("cx", "cy").agg(F.max_by(F.struct(*known), F.col("ts")).alias("_w"), F.max("ts").alias("ts"))

    def cell(a: str, b: str) -> Column:
        return F.floor((F.col(a) + F.col(b)) / 2 / cell_deg).cast("int")

    out = (aois.withColumn("cx", cell("west", "east")).withColumn("cy", cell("south", "north"))
           .join(latest, ["cx", "cy"], "left"))
    error = F.when(F.col("_w").isNull(), "no reading for this cell")
    if unknown:
        error = error.otherwise("unknown variables: " + ", ".join(unknown))
    return out.select(*aois.columns, "ts", *[F.col(f"_w.{v}").alias(v) for v in known], error.alias("error"))


def sample_pixels_at(points: DataFrame, tiles: DataFrame, zoom: int, tile_px: int = 256) -> DataFrame:
    """C17. The class of the tile pixel under each point; null where there is none."""
    at = points.withColumn("_t", lonlat_to_tile("lon", "lat", zoom, tile_px)).select(
        *points.columns, F.col("_t.x").alias("x"), F.col("_t.y").alias("y"), F.col("_t.px").alias("px"), F.col("_t.py").alias("py"))
    return at.join(tiles, ["x", "y", "px", "py"], "left")


def nearest_color_class(px: DataFrame, anchors: list[tuple[int, int, int, int]]) -> DataFrame:
    """C18. The class of the nearest legend colour, the lower class on ties.

    The legend is a short list in the plan, so each pixel compares itself with
    it in place and no rows are multiplied.
    """
    def away(a: tuple) -> Column:
        k, r, g, b = a
        d = F.pow(F.col("red") - r, 2) + F.pow(F.col("green") - g, 2) + F.pow(F.col("blue") - b, 2)
        return F.struct(d.alias("d"), F.lit(k).alias("k"))

    return px.withColumn("class_id", F.least(*[away(a) for a in anchors])["k"])
