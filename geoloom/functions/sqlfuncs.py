"""The scalar functions and row generators under SQL names.

Each is a SQL function whose body is an expression, so Spark inlines it and a
SQL user gets the same plan as the DataFrame user.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "ndvi(red DOUBLE, nir DOUBLE) RETURNS DOUBLE": "CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red) END",
    "bbox_area_km2(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE) RETURNS DOUBLE":
        "abs(east - west) * 111.32D * cos(radians((north + south) / 2)) * abs(north - south) * 110.574D",
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE":
        "2 * 6371.0088D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) "
        "* cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "subtract_months(d DATE, n INT) RETURNS DATE": "add_months(d, -n)",
    "normalize_range(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE": "least(1D, greatest(0D, (x - lo) / (hi - lo)))",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "hex_red(h STRING) RETURNS INT": "CAST(conv(substr(regexp_replace(h, '^#', ''), 1, 2), 16, 10) AS INT)",
    "hex_green(h STRING) RETURNS INT": "CAST(conv(substr(regexp_replace(h, '^#', ''), 3, 2), 16, 10) AS INT)",
    "hex_blue(h STRING) RETURNS INT": "CAST(conv(substr(regexp_replace(h, '^#', ''), 5, 2), 16, 10) AS INT)",
    "denormalize_range(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE": "x * (hi - lo) + lo",
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / ((sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) + 1e-9D) "
        "* (sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) + 1e-9D))",
    "bbox_intersects(aw DOUBLE, a_s DOUBLE, ae DOUBLE, an DOUBLE, bw DOUBLE, b_s DOUBLE, be DOUBLE, bn DOUBLE) RETURNS BOOLEAN":
        "ae >= bw AND aw <= be AND an >= b_s AND a_s <= bn",
    "bbox_contains(ow DOUBLE, o_s DOUBLE, oe DOUBLE, o_n DOUBLE, iw DOUBLE, i_s DOUBLE, ie DOUBLE, i_n DOUBLE) RETURNS BOOLEAN":
        "iw >= ow AND i_s >= o_s AND ie <= oe AND i_n <= o_n",
    "great_circle_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE":
        "round(2 * 6371D * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), "
        "sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))",
    "utm_zone(lon DOUBLE) RETURNS INT": "CAST(least(60, greatest(1, floor((lon + 180) / 6) + 1)) AS INT)",
    "window_weight(y DOUBLE, x DOUBLE, size INT) RETURNS DOUBLE":
        "least(1D, greatest(0.1D, cos((y * 2 / (size - 1) - 1) * pi() / 2) * cos((x * 2 / (size - 1) - 1) * pi() / 2)))",
    "needs_review(confidence DOUBLE, threshold DOUBLE) RETURNS BOOLEAN": "confidence < threshold",
    "stretch_255(v DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS INT": "CAST(least(1D, greatest(0D, (v - lo) / greatest(1e-9D, hi - lo))) * 255 AS INT)",
    "fade_to_white(channel DOUBLE, conf DOUBLE) RETURNS INT": "CAST(channel * conf + 255 * (1 - conf) AS INT)",
    "mercator_x(lon DOUBLE) RETURNS DOUBLE": "radians(lon) * 6378137D",
    "mercator_y(lat DOUBLE) RETURNS DOUBLE": "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137D",
    "tile_west(z INT, x INT) RETURNS DOUBLE": "x / pow(2, z) * 360 - 180",
    "tile_north(z INT, y INT) RETURNS DOUBLE": "degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z)))))",
    "tile_x(lon DOUBLE, z INT) RETURNS INT": "CAST(floor((lon + 180) / 360 * pow(2, z)) AS INT)",
    "tile_y(lat DOUBLE, z INT) RETURNS INT":
        "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS INT)",
}

# U4. Row generators, used as LATERAL tables.
TABLES = {
    "period_rows(anchor DATE, n INT, days INT) RETURNS TABLE(t INT, start DATE, end DATE)":
        "SELECT t, date_add(anchor, -(n - t) * days), date_add(anchor, -(n - 1 - t) * days) "
        "FROM (SELECT explode(sequence(0, n - 1)) AS t)",
    "chunk_rows(n_rows INT, n_cols INT) RETURNS TABLE(chunk_r INT, chunk_c INT)":
        "SELECT r, explode(sequence(0, n_cols - 1)) FROM (SELECT explode(sequence(0, n_rows - 1)) AS r)",
    # E1. Starts of tiles along an axis; the last one is flush with the end
    "tile_rows(dim INT, tile INT, stride INT) RETURNS TABLE(i INT, start INT)":
        "SELECT posexplode(CASE WHEN dim <= tile THEN array(0) ELSE array_union(sequence(0, dim - tile, stride), array(dim - tile)) END)",
    # E11. Edges of a closed ring
    "edge_rows(ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>) RETURNS TABLE(i INT, lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)":
        "SELECT k, ring[k].lon, ring[k].lat, ring[k + 1].lon, ring[k + 1].lat "
        "FROM (SELECT explode(CASE WHEN size(ring) > 1 THEN sequence(0, size(ring) - 2) ELSE array() END) AS k)",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to this session."""
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
