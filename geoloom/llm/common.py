"""What the operators share: written intermediates, batches of rows, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import shared_dir


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later steps start from files."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def octets(name: str):
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(name).cast("string").cast("binary")


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column ``text`` holds about ``most`` bytes, or a single row."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def record_batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def connected(edges: DataFrame) -> DataFrame:
    """``node root`` for every end of ``edges`` (``a b``): the smallest node of its component.

    Large-star and small-star in turn: each node's neighbours are tied to the
    smallest node among them, until nothing changes. A round is two minima with
    map-side combining and two equi-joins whose hot keys adaptive execution
    splits, and it ends in a written table, so a lost executor costs one round
    at most. Nulls and loops are no edges.
    """

    def tie(pairs: DataFrame, larger_only: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if larger_only else pairs.groupBy("a").agg(F.min("b").alias("m"))
        tied = pairs.join(least, "a")
        if larger_only:
            return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, seen = None, state(now)
    while seen[0] and seen != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = keep(tie(both, True).where("a <> b").distinct())
        now = keep(tie(large, False).where("a <> b").distinct())
        before, seen = seen, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct().toDF("node", "root"))
