"""Views that give the sample tables the shape of the data model.

Each view is one SQL text that Spark and DuckDB both run, so a query and its
oracle start from the same rows. A view keeps every row of its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # embedding raster, 10 x 25 patches per raster; nodata marks missing patches
    "fx_grid": """
        SELECT vec_id, CAST(floor(vec_id / 250.0) AS INT) AS raster_id,
               CAST(floor((vec_id % 250) / 25.0) AS INT) AS r, CAST(vec_id % 25 AS INT) AS c,
               embedding, label, (vec_id % 17 = 0) AS nodata
        FROM embeddings""",
    # pixel reflectances by scene and month; (r, c) is not unique
    "fx_px": """
        SELECT l_suppkey AS scene_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
               CAST(l_partkey % 64 AS INT) AS r, CAST(l_orderkey % 64 AS INT) AS c,
               l_quantity * 100 AS b04,
               CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / 10 END AS b08,
               CAST((l_suppkey * 37) % 101 AS DOUBLE) AS cloud_cover
        FROM lineitem""",
    # class raster of 20 x 50 pixels per raster; -1 is nodata
    "fx_class": """
        SELECT CAST(floor(p_partkey / 1000.0) AS INT) AS raster_id,
               CAST(floor((p_partkey % 1000) / 50.0) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
               CASE WHEN p_size = 1 THEN -1 WHEN p_size = 2 THEN 7
                    ELSE CAST((floor(floor((p_partkey % 1000) / 50.0) / 7.0)
                               + floor((p_partkey % 50) / 11.0)) % 4 AS INT)
               END AS class_id, p_retailprice AS scalar
        FROM part""",
    "fx_scene": """
        SELECT o_orderkey AS scene_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END AS collection,
               CAST(o_orderdate AS DATE) AS dt, CAST((o_orderkey * 37) % 101 AS DOUBLE) AS cloud_cover,
               CAST((o_custkey * 7919) % 35800 AS DOUBLE) / 100 - 180 AS west,
               CAST((o_custkey * 104729) % 16800 AS DOUBLE) / 100 - 85 AS south,
               CAST((o_custkey * 7919) % 35800 AS DOUBLE) / 100 - 179 AS east,
               CAST((o_custkey * 104729) % 16800 AS DOUBLE) / 100 - 84 AS north,
               CASE WHEN o_orderkey % 5 = 0 THEN 'secondary' ELSE 'primary' END AS provider
        FROM orders""",
    "fx_point": """
        SELECT c_custkey AS pid, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon,
               CAST((c_custkey * 104729) % 17000 AS DOUBLE) / 100 - 85 AS lat,
               c_mktsegment AS class_name, (c_acctbal + 1000) / 11000 AS confidence
        FROM customer""",
    "fx_box": """
        SELECT n_nationkey AS box_id, n_name AS name,
               CAST((n_nationkey * 13) % 34 * 10 - 180 AS DOUBLE) AS west,
               CAST((n_nationkey * 7) % 15 * 10 - 80 AS DOUBLE) AS south,
               CAST((n_nationkey * 13) % 34 * 10 - 165 AS DOUBLE) AS east,
               CAST((n_nationkey * 7) % 15 * 10 - 68 AS DOUBLE) AS north
        FROM nation""",
    # closed rings of 6 vertices, not convex
    "fx_ring": """
        SELECT s_suppkey AS poly_id, v.k AS vtx,
               CAST((s_suppkey * 7919) % 34000 AS DOUBLE) / 100 - 170
                 + CAST(v.dx AS DOUBLE) / 10 * (1 + s_suppkey % 3) AS lon,
               CAST((s_suppkey * 104729) % 14000 AS DOUBLE) / 100 - 70
                 + CAST(v.dy AS DOUBLE) / 10 * (1 + s_suppkey % 3) AS lat
        FROM supplier CROSS JOIN
             (VALUES (0, 0, 0), (1, 10, 0), (2, 15, 8), (3, 7, 5), (4, 2, 12), (5, 0, 0)) AS v(k, dx, dy)""",
    # overlapping tile class probabilities with weights
    "fx_prob": """
        SELECT CAST(l_partkey % 32 AS INT) AS r, CAST(l_orderkey % 32 AS INT) AS c, l_suppkey AS tile_id,
               l_linenumber AS class_id, l_discount * 10 AS prob, CAST(1 AS DOUBLE) / 10 + l_tax * 10 AS w
        FROM lineitem""",
    "fx_refpred": """
        SELECT vec_id AS uid, label AS ref,
               CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS pred
        FROM embeddings""",
    "fx_outcome": """
        SELECT event_id, ts, user_id AS job_id, event_type, event_type <> 'error' AS ok, value AS latency
        FROM events""",
    "fx_project": """
        SELECT doc_id AS id, concat(source, '-', CAST(doc_id % 7 AS VARCHAR(8))) AS name,
               CAST(n_chars AS BIGINT) AS version, concat('{"n":', CAST(n_chars AS VARCHAR(12)), '}') AS state_json
        FROM documents""",
    "fx_reply": "SELECT conv_id, turn, role, text FROM conversations",
    # replies with reasoning blocks, openers, labels, markup and claims put in by turn
    "fx_marked": """
        SELECT conv_id, turn, role, CASE turn % 8
            WHEN 0 THEN concat('<think>plan', chr(10), 'more</think>', chr(10), text)
            WHEN 1 THEN concat('Please stand by. <Reasoning>never closed ', text)
            WHEN 2 THEN concat('Let me write this.', chr(10), chr(10), text)
            WHEN 3 THEN concat('Okay, here', chr(39), 's it.', chr(10), chr(10), 'I', chr(39), 'll draft it now', chr(10), chr(10), text)
            WHEN 4 THEN concat('Paragraph 1: ', text, chr(10), '  paragraph 22 - Job ID: ab12cd34 ', text)
            WHEN 5 THEN concat('## Heading', chr(10), '**bold** word ', text, chr(10), '- item one', chr(10), '* item two')
            WHEN 6 THEN concat(text, chr(10), chr(10), chr(10), chr(10), 'I am now running the tool. ', text)
            ELSE concat(text, CASE WHEN role = 'system' THEN ' PHANTOM TOOL CALL DETECTED.' ELSE '' END) END AS text
        FROM conversations""",
    # uploads: one file name per page, its extension and leading bytes chosen by the id
    "fx_file": """
        SELECT page_id AS file_id,
               concat(CASE WHEN page_id % 23 = 0 THEN '../' ELSE '' END, 'scene_', CAST(page_id AS VARCHAR(12)), '.',
                 CASE page_id % 12 WHEN 0 THEN 'tif' WHEN 1 THEN 'GeoJSON' WHEN 2 THEN 'nc' WHEN 3 THEN 'zip'
                   WHEN 4 THEN 'parquet' WHEN 5 THEN 'csv' WHEN 6 THEN 'gpkg' WHEN 7 THEN 'las' WHEN 8 THEN 'laz'
                   WHEN 9 THEN 'json' WHEN 10 THEN 'html' ELSE 'zarr' END) AS name,
               CASE page_id % 9 WHEN 0 THEN '49492A00' WHEN 1 THEN '7B2274' WHEN 2 THEN '43444601'
                   WHEN 3 THEN '504B0304' WHEN 4 THEN '50415231' WHEN 5 THEN '6C61742C6C6F6E'
                   WHEN 6 THEN '53514C69746520666F726D6174203300' WHEN 7 THEN '4C415346'
                   ELSE '200A5B7B227479' END AS head_hex,
               length(html) AS size, url
        FROM pages""",
}

# The same view where Spark has a plan without a cross join: the vertices of a
# supplier come from an array in its row.
SPARK_VIEWS = {
    "fx_ring": """
        SELECT s_suppkey AS poly_id, v.k AS vtx,
               CAST((s_suppkey * 7919) % 34000 AS DOUBLE) / 100 - 170
                 + CAST(v.dx AS DOUBLE) / 10 * (1 + s_suppkey % 3) AS lon,
               CAST((s_suppkey * 104729) % 14000 AS DOUBLE) / 100 - 70
                 + CAST(v.dy AS DOUBLE) / 10 * (1 + s_suppkey % 3) AS lat
        FROM supplier LATERAL VIEW inline(array(struct(0, 0, 0), struct(1, 10, 0), struct(2, 15, 8), struct(3, 7, 5),
                                                struct(4, 2, 12), struct(5, 0, 0))) v AS k, dx, dy""",
}

_TABLE_REF = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")
_VIEW_REF = re.compile(r"\bfx_\w+\b")


class Tables:
    """The sample tables and views of one scale-factor folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            text = _TABLE_REF.sub(
                lambda m: f"{m[1]} parquet.`{self.folder}/{m[2]}.parquet`", SPARK_VIEWS.get(name, VIEWS[name])
            )
            return self.spark.sql(text)
        raise AttributeError(name)

    def values(self, columns: str, rows: list[tuple]) -> DataFrame:
        """A fixed lookup table, such as a legend; its size is that of the source text."""
        return self.spark.sql(f"SELECT * FROM {values_sql(rows)} AS v({columns})")


def with_views(sql: str) -> str:
    """Prefix an oracle text with the views it names."""
    used = [v for v in VIEWS if v in set(_VIEW_REF.findall(sql))]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body[:15].upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:].strip()}"
    return f"WITH {ctes}\n{body}"


def values_sql(rows: list[tuple]) -> str:
    """Rows as a SQL ``VALUES`` list, the same text for Spark and DuckDB."""
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"
