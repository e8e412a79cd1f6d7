"""Sinks. Every write is one file per task; nothing is gathered first."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _features(features: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """``value``: each feature as text, provenance among its properties."""
    props = [F.col(c) for c in features.columns if c not in ("geometry_type", "coordinates")]
    props += [F.lit(v).alias(k) for k, v in provenance.items()]
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct(F.col("geometry_type").alias("type"), "coordinates").alias("geometry"),
                       F.struct(*props).alias("properties"))
    return features.select(F.to_json(feature).alias("value"))


def write_geojson(features: DataFrame, path: str, **provenance: str) -> None:
    """A15. One GeoJSON feature per line. ``features``: ``geometry_type coordinates`` and properties."""
    _features(features, provenance).write.text(path)


def write_feature_collection(features: DataFrame, path: str, **provenance: str) -> None:
    """A15. FeatureCollections with provenance in the body and in each feature: a whole one per task, a feature per line.

    One task's rows pass one by one, so a collection may be of any size; a table
    that has to be one body is coalesced to one partition by its owner. No rows
    make an empty collection.
    """
    head = json.dumps({"type": "FeatureCollection", "properties": provenance}, separators=(",", ":"))[:-1] + ',"features":['

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        held = None
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                lines = ([] if held is None else [held + ","]) + [r + "," for r in rows[:-1]]
                held = rows[-1]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(([] if held is None else [held]) + ["]}"], pa.string())], ["value"])

    _features(features, provenance).mapInArrow(run, "value string").write.text(path)


# The columns of a series file, after the area.
SERIES_COLUMNS = ["month", "status", "scene_id", "scene_datetime", "scene_cloud_cover", "ndvi_mean", "ndvi_median",
                  "ndvi_p10", "ndvi_p90", "n_pixels", "detail"]


def write_timeseries_csv(series: DataFrame, path: str) -> None:
    """A16. All months, failed ones too, in fixed column order. A scene's date is written where ``dt`` is known."""
    dt = F.col("dt") if "dt" in series.columns else F.lit(None).cast("string")
    named = (series.withColumn("scene_datetime", dt).withColumnRenamed("cloud_cover", "scene_cloud_cover")
             .withColumn("month", F.date_format("month", "yyyy-MM")))
    named.select("aoi_id", *SERIES_COLUMNS).write.csv(path, header=True)


def write_raster(px: DataFrame, path: str, value: str, classes: DataFrame | None = None, block: int = 256,
                 **tags: str) -> None:
    """A17. Pixels by raster and block, with a table of tags and the class table beside them.

    Class rasters are stored as small integers with -1 for nodata, scalar ones as floats.
    """
    spark = px.sparkSession
    whole = px.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    v = F.coalesce(F.col(value), F.lit(-1)).cast("smallint") if whole else F.col(value).cast("float")
    (px.select("raster_id", F.floor(F.col("r") / block).cast("int").alias("br"), F.floor(F.col("c") / block).cast("int").alias("bc"),
               "r", "c", v.alias("value"))
     # a raster spreads over its blocks, so one large raster is not one task
     .repartition("raster_id", "br", "bc").sortWithinPartitions("raster_id", "br", "bc", "r", "c")
     .write.partitionBy("raster_id").parquet(f"{path}/pixels"))
    rows = [(k, str(t)) for k, t in {"nodata": "-1" if whole else "nan", **tags}.items()]
    spark.createDataFrame(rows, "tag string, text string").coalesce(1).write.parquet(f"{path}/tags")
    if classes is not None:
        classes.write.parquet(f"{path}/classes")


def write_embeddings(bands: DataFrame, path: str, dim: int, **tags: str) -> None:
    """A18. Quantised vectors by raster, with provenance and band names beside them."""
    spark = bands.sparkSession
    (bands.repartition("raster_id", F.floor(F.col("r") / 256)).write.partitionBy("raster_id").parquet(f"{path}/bands"))
    rows = [(k, str(t)) for k, t in tags.items()] + [(f"band_{i}", f"dim_{i:03d}") for i in range(dim)]
    spark.createDataFrame(rows, "tag string, text string").coalesce(1).write.parquet(f"{path}/tags")


def write_geoparquet(points: DataFrame, path: str) -> None:
    """Points with a WKB ``geometry`` column."""
    from geoloom.sources.files import encode_point_wkb

    points.withColumn("geometry", encode_point_wkb("lon", "lat")).write.parquet(path)


def write_geometries(features: DataFrame, path: str) -> None:
    """Features (``geometry_type dims parts`` as ``wkb.decode_wkb`` gives them) with a WKB ``geometry`` column."""
    from geoloom.sources.wkb import encode_wkb

    features.withColumn("geometry", encode_wkb("geometry_type", "dims", "parts")).drop("geometry_type", "dims", "parts").write.parquet(path)
