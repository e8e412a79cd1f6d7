"""File sources: formats, quarantine, readers and profiles."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.geo import bbox_ring
from geoloom.sources.wkb import decode_wkb

# File extensions and their formats, leading bytes and theirs, the size cap.
EXTENSIONS = {
    "tif": "geotiff", "tiff": "geotiff", "geotiff": "geotiff", "nc": "netcdf", "nc4": "netcdf", "netcdf": "netcdf",
    "zarr": "zarr", "gpkg": "geopackage", "geojson": "geojson", "json": "geojson", "shp": "shapefile",
    "zip": "shapefile", "las": "las", "laz": "laz", "parquet": "parquet", "geoparquet": "geoparquet", "csv": "csv",
}
MAGIC = [
    ("43444601", ["netcdf"]), ("43444602", ["netcdf"]), ("894844460D0A1A0A", ["netcdf"]),
    ("49492A00", ["cog", "geotiff"]), ("4D4D002A", ["cog", "geotiff"]), ("504B0304", ["shapefile"]),
    ("50415231", ["geoparquet", "parquet"]), ("53514C69746520666F726D6174203300", ["geopackage"]), ("4C415346", ["las", "laz"]),
]
MAX_BYTES = 500 * 1024 * 1024
LAT_NAMES = ["lat", "latitude", "lat_dd", "y"]
LON_NAMES = ["lon", "lng", "longitude", "long_dd", "x"]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))


def detect_format(name: Column, geo_footer: Column | None = None) -> Column:
    """A1. Format by extension; a parquet file with a ``geo`` footer key is geoparquet."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    fmt = F.coalesce(table[extension(name)], F.lit("unknown"))
    return fmt if geo_footer is None else F.when((fmt == "parquet") & geo_footer, "geoparquet").otherwise(fmt)


def _open(path: str):
    """A file on any file system that Arrow knows; only the bytes asked for are read."""
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))
    return fs.open_input_file(inner)


def geo_footers(files: DataFrame) -> DataFrame:
    """A1. ``path`` and whether its parquet footer has a ``geo`` key; the tasks read the footers and nothing else."""
    def scan(batches):
        import pyarrow.parquet as pq

        for pdf in batches:
            flags = []
            for path in pdf["path"]:
                try:
                    with _open(path) as f:
                        flags.append(b"geo" in (pq.ParquetFile(f).metadata.metadata or {}))
                except Exception:  # not parquet after all
                    flags.append(False)
            yield pd.DataFrame({"path": pdf["path"], "geo_footer": flags})

    return files.select("path").mapInPandas(scan, "path string, geo_footer boolean")


def with_format(files: DataFrame) -> DataFrame:
    """A1. ``files`` (``path name ...``) with ``format``; footers are read of parquet files alone."""
    parquet = detect_format(F.col("name")) == "parquet"
    feet = geo_footers(files.where(parquet).select("path").distinct())
    joined = files.join(feet, "path", "left")
    return joined.withColumn("format", detect_format(F.col("name"), F.coalesce("geo_footer", F.lit(False)))).drop("geo_footer")


def sniff_magic(head_hex: Column) -> Column:
    """A2. The formats the leading bytes (as hex) may belong to, sorted; empty when unknown."""
    out = F.when(F.length(head_hex) < 8, F.array().cast("array<string>"))
    for prefix, formats in MAGIC:
        out = out.when(head_hex.startswith(prefix), F.array(*[F.lit(f) for f in formats]))
    json = head_hex.rlike("^(?:20|09|0D|0A)*(?:7B|5B)")
    return out.when(json, F.array(F.lit("geojson"))).otherwise(F.array().cast("array<string>"))


def with_heads(files: DataFrame, size: int = 16) -> DataFrame:
    """``path name size`` of listed files and their first bytes as ``head_hex``; no more of a file is read, however large it is."""
    def scan(batches):
        for pdf in batches:
            heads = []
            for path in pdf["path"]:
                with _open(path) as f:
                    heads.append(f.read(size).hex().upper())
            yield pdf.assign(head_hex=heads)

    listed = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")
    return listed.mapInPandas(scan, "path string, name string, size long, modificationTime timestamp, head_hex string")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size and leading bytes of the files under a folder. Spark lists them, and the column of contents is not asked for."""
    return with_heads(spark.read.format("binaryFile").load(path)).drop("modificationTime")


def quarantine_mismatch(files: DataFrame) -> DataFrame:
    """A3. Why a file is refused, or ``ok``: unsafe name, unknown format, size, content."""
    fmt, seen = F.col("format"), sniff_magic(F.col("head_hex"))
    if "format" not in files.columns:
        files = files.withColumn("format", detect_format(F.col("name")))
    unsafe = (F.col("name") == "") | F.col("name").rlike(r"[/\\\x00]") | F.col("name").isin(".", "..")
    wrong = (F.size(seen) > 0) & ~F.array_contains(seen, fmt) & (extension(F.col("name")) != "csv")
    return files.withColumn("sniffed", seen).withColumn(
        "status", F.when(unsafe, "unsafe_name").when(fmt == "unknown", "unsupported_format")
        .when(F.col("size") > MAX_BYTES, "too_large").when(wrong, "format_mismatch").otherwise("ok"))


def _find(df: DataFrame, names: list[str]) -> str:
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n in have:
            return have[n]
    raise ValueError(f"no column named one of {names} among {df.columns}")


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4. A CSV of points: its columns and ``lon`` / ``lat`` under whatever name they have."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    lat, lon = _find(raw, LAT_NAMES), _find(raw, LON_NAMES)
    rest = [c for c in raw.columns if c not in (lat, lon)]
    return raw.select(*rest, F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))


FEATURE = "type string, geometry struct<type:string, coordinates:string>, properties string"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A5. Features of a FeatureCollection, or of one feature per line.

    Geometry coordinates and open properties stay JSON: coordinates nest to a
    different depth per geometry type, and properties have no fixed schema.
    ``lines`` splits a large file over tasks, and so is a collection with one
    feature per line split; one of any other form is one task per file.
    """
    features = spark.read.schema(FEATURE).json(path)
    if lines:
        f = features
    else:
        # the paths only, as the driver lists them anyway
        whole = [r["file"] for r in _unlike_lines(spark.read.text(path)).collect()]
        file = F.col("_metadata.file_path")
        f = features.where((F.col("type") == "Feature") & ~file.isin(whole))
        if whole:
            bodies = spark.read.schema(f"type string, features array<struct<{_fields(FEATURE)}>>").json(path, multiLine=True)
            f = f.unionByName(bodies.where(file.isin(whole)).select(F.explode("features").alias("f")).select("f.*"))
    return f.select(F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"),
                    F.parse_json("properties").alias("properties"))


def _unlike_lines(text: DataFrame) -> DataFrame:
    """``file``: those with a line that is neither the head of a collection, nor one whole feature, nor brackets that close it."""
    line = F.rtrim(F.trim("value"))
    body = F.regexp_replace(line, r"\s*,$", "")
    only = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<struct<type string>>")
    feature = body.startswith("{") & body.endswith("}") & (F.size(only) == 1) & (F.get(only, F.lit(0))["type"] == "Feature")
    head = line.startswith("{") & line.rlike(r'"features"\s*:\s*\[$')
    fits = F.coalesce(feature, F.lit(False)) | line.rlike(r"^[\s\]}]*$")
    return (text.select(F.col("_metadata.file_path").alias("file"), head.alias("head"), (head | fits).alias("fits"))
            .groupBy("file").agg(F.count_if("head").alias("heads"), F.count_if(~F.col("fits")).alias("others"))
            .where((F.col("heads") != 1) | (F.col("others") > 0)).select("file"))


def _fields(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def encode_point_wkb(lon: str, lat: str) -> Column:
    """Points as little-endian WKB."""
    def pack(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y)])

    return F.pandas_udf(pack, T.BinaryType())(lon, lat)


def read_geoparquet(spark: SparkSession, path: str, col: str = "geometry") -> DataFrame:
    """A6. Geometries of any kind (``wkb.decode_wkb``). Column pruning and filters on plain columns still reach the parquet scan."""
    return decode_wkb(spark.read.parquet(path), col)


def vector_profile(vertices: DataFrame, key: str) -> DataFrame:
    """A8. One row: geometry type, features, bounds, columns and the first row as a sample.

    A feature of one vertex is a point; one whose last vertex is its first is a
    polygon, any other a line. Features of several kinds are ``Mixed``.
    """
    cols = vertices.columns[:10]
    # the vertices of a feature are not brought together: its ends are combined before the shuffle
    each = vertices.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("lon", "lat"), "vtx").alias("_a"), F.max_by(F.struct("lon", "lat"), "vtx").alias("_b"),
        F.min("lon").alias("_w"), F.min("lat").alias("_s"), F.max("lon").alias("_e"), F.max("lat").alias("_top"), F.min_by(F.struct(*cols), "vtx").alias("_row"))
    kind = F.when(F.col("_n") == 1, "Point").when((F.col("_a") == F.col("_b")) & (F.col("_n") > 3), "Polygon").otherwise("LineString")
    return each.withColumn("_kind", kind).agg(
        F.when(F.min("_kind") == F.max("_kind"), F.min("_kind")).otherwise("Mixed").alias("geometry_type"), F.count(F.lit(1)).alias("feature_count"),
        F.min("_w").alias("west"), F.min("_s").alias("south"), F.max("_e").alias("east"), F.max("_top").alias("north"),
        F.lit(",".join(vertices.columns)).alias("columns"), F.min_by("_row", key).alias("sample"))


def array_profile(long: DataFrame, coords: list[str], time: str, variable: str = "variable") -> DataFrame:
    """A9. Per variable: size and bounds of each coordinate, first and last time, values."""
    aggs = [F.count(F.lit(1)).alias("n_values"), F.min(time).alias("first_time"), F.max(time).alias("last_time")]
    for c in coords:
        aggs += [F.count_distinct(c).alias(f"dim_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return long.groupBy(variable).agg(*aggs)


POINT_DIMS = ["x", "y", "z", "intensity", "classification", "return_number", "red", "green", "blue", "gps_time"]


def point_cloud_profile(points: DataFrame) -> DataFrame:
    """A10. Count, bounds and which dimensions hold values."""
    def has(d: str) -> Column:
        return (F.count(d) > 0 if d in points.columns else F.lit(False)).alias(f"has_{d}")

    return points.agg(F.count(F.lit(1)).alias("n_points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
                      F.min("y").alias("min_y"), F.max("y").alias("max_y"), *[has(d) for d in POINT_DIMS[2:]])


def preview_features(features: DataFrame, key: str, n: int = 500) -> DataFrame:
    """A11. The first ``n`` rows by key, nested columns as JSON text."""
    def flat(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(f.name).alias(f.name) if nested else F.col(f.name)

    return features.orderBy(key).limit(n).select(*[flat(f) for f in features.schema])


def bbox_to_feature(boxes: DataFrame) -> DataFrame:
    """A12. Each box as a GeoJSON polygon: the ring as an array and the feature as text."""
    ring = bbox_ring("west", "south", "east", "north")
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.col("ring")).alias("coordinates"))
    return boxes.withColumn("ring", ring).withColumn("feature", F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"))))
