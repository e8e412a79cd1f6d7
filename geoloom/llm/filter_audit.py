"""What quality filters take from each other, counted by a stream that takes back what it said too early.

A text fails any of five filters, a bit each:

* A: fewer than 200 words; B: fewer different words than half of all; C: capital
  letters A-Z above 3 % of the code points; D: any of ``#$%&*|``;
* E: the same text stands under a smaller id anywhere in the table. A to D hang on
  the text alone; E hangs on all rows, so the files run as
  available-now micro-batches through keyed state: of each text the smallest id so
  far and its rows by part. A row of a larger id fails E at once; when a smaller
  id arrives, the earlier rows' masks are retracted (``delta`` -1) and counted
  again with E. The log of changes adds up to the masks of all rows, whatever
  order the files come in.

All orders of the filters follow from how many rows of a part have which mask, 32
numbers, so the rest of the work does not grow.

A text is known by two 64-bit hashes. Texts share a state row per bucket of about
``BUCKET`` texts, as a call per text costs a millisecond and a half in Python; a
micro-batch rewrites the buckets, some 40 bytes a text, and their number is
fixed for all sizes. Within a batch of rows only a text's smallest id goes to the
text's bucket; the other rows fail E already and are dealt by id, so a text with a
third of all rows is not one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoloom.llm.common import scratch, small_batches

FILTERS = "ABCDE"
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
COPY = BITS["E"]
BATCHES = 4  # micro-batches a run is cut into, if there are as many files
BUCKET = 1 << 13  # texts of a state row, about


_SIGNS = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes) -> int:
    """The bits of A to D of a text in UTF-8."""
    words = text.split()  # of bytes, at the six ASCII spaces
    octet = np.frombuffer(text, "u1")
    points = np.count_nonzero((octet & 0xC0) != 0x80)
    capitals = np.count_nonzero((octet - np.uint8(65)) < 26)
    fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 3 * points, "D": _SIGNS.search(text) is not None}
    return sum(BITS[f] for f, x in fails.items() if x)


def _first_of_batch(buckets: int):
    """Marks rows ``hi lo doc_id part text`` and deals them to buckets; those whose text has a smaller id in the same batch are settled: they fail E."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4):
            rows = b.select(range(4)).to_pandas()
            own = np.array([text_mask(t) for t in b.column(4).to_pylist()], np.int32)
            known = rows["doc_id"].notna().to_numpy()
            doc = b.column(2).fill_null(0).to_numpy()
            of = rows.groupby(["hi", "lo"], sort=False).ngroup().to_numpy()
            least = np.full(of.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, of[known], doc[known])
            copy = known & (doc > least[of])
            settled = copy | ~known
            mask = own | np.where(copy, COPY, 0).astype(np.int32)
            bucket = np.where(settled, doc, b.column(0).to_numpy()) % buckets
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns[:4], pa.array(mask), pa.array(settled)], ["bucket", "hi", "lo", "doc_id", "part", "mask", "settled"])

    return run


def _update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket's rows of a micro-batch against its texts' smallest ids; the state is an Arrow table ``hi lo least part n``."""
    rows = pd.concat(list(frames))
    done = rows["settled"].to_numpy(bool)
    yield rows.loc[done, ["doc_id", "part", "mask"]].assign(delta=1)
    new = rows.loc[~done, ["hi", "lo", "doc_id", "part", "mask"]]
    if new.empty:
        return
    by = ["hi", "lo"]
    new["doc_id"] = new["doc_id"].astype("int64")
    new["fresh"] = new.groupby(by)["doc_id"].transform("min")
    held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else pd.DataFrame(columns=HELD).astype({"hi": "int64", "lo": "int64", "least": "int64", "n": "int64"})
    # what the batch tells of texts that are held, and what is held of the batch's texts
    told = held.merge(new.drop_duplicates(by)[[*by, "fresh", "mask"]], "left", by)
    old = told["fresh"] < told["least"]
    known = held.drop_duplicates(by)[[*by, "least"]]
    new = new.merge(known, "left", by)
    first = new["least"].isna() | (new["doc_id"] <= new["least"])
    first &= new["doc_id"] == new["fresh"]
    mask = new["mask"].where(first, new["mask"] | COPY)
    yield pd.DataFrame({"doc_id": new["doc_id"], "part": new["part"], "mask": mask, "delta": 1})
    back = told[old]
    if len(back):
        plain = back["mask"].astype("int32")
        for m, delta in ((plain, -back["n"]), (plain | COPY, back["n"])):
            yield pd.DataFrame({"doc_id": back["least"], "part": back["part"], "mask": m, "delta": delta})
    if first.any():
        own = new[first].groupby([*by, "doc_id", "part"], sort=False).size().reset_index(name="n").rename(columns={"doc_id": "least"})
        table = pa.Table.from_pandas(pd.concat([held[~old.to_numpy()], own])[HELD], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))


HELD = ["hi", "lo", "least", "part", "n"]
CHANGES = "doc_id long, part string, mask int, delta long"


def changes(stream: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The change log ``doc_id part mask delta`` of a stream of documents; its sum by the first three is the rows' masks.

    A null text is an empty one, a null part the empty string. A null id neither
    fails E nor makes others fail it. Rows that repeat an id and its text count
    each and are no copies of each other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stream.select(
        F.xxhash64(text).alias("hi"), F.xxhash64(F.lit(1), text).alias("lo"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.cast("binary").alias("text"))
    first = rows.mapInArrow(_first_of_batch(buckets), "bucket long, hi long, lo long, doc_id long, part string, mask int, settled boolean")
    return first.groupBy("bucket").applyInPandasWithState(_update, CHANGES, "held binary", "append", GroupStateTimeout.NoTimeout)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def change_log(spark: SparkSession, path: str, progress: str | None = None, batches: int = BATCHES, **columns: str) -> DataFrame:
    """All changes of the documents at ``path`` (Parquet), written by a run over what is there.

    With a ``progress`` folder that lasts, a later run takes only the files that
    are new and adds to the same log; the number of buckets stays as the first
    run chose it by its rows. A lost executor costs a micro-batch's tasks, a lost
    driver the micro-batch. State is kept in the store that the session sets: Spark's
    own holds it on the heap, so a large cluster sets the RocksDB provider.
    """
    there = spark.read.parquet(path)
    if progress and _exists(spark, f"{progress}/buckets/_SUCCESS"):
        (buckets,) = spark.read.parquet(f"{progress}/buckets").first()
    else:
        progress = progress or scratch(spark)
        buckets = max(64, there.count() // BUCKET)
        spark.range(1).select(F.lit(buckets).cast("long").alias("n")).write.mode("overwrite").parquet(f"{progress}/buckets")
    each = max(1, -(-len(there.inputFiles()) // batches))
    path = path.rstrip("/")
    alone = f"{path[:-1]}[{path[-1]}]"  # a pattern for this path only: a stream takes a single file by pattern and not by name
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", each).parquet(alone)
    log = changes(stream, buckets, **columns).writeStream.format("parquet").outputMode("append")
    log.option("path", f"{progress}/changes").option("checkpointLocation", f"{progress}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{progress}/changes")


def mask_counts(log: DataFrame, labels: DataFrame) -> DataFrame:
    """``part mask n good toxic``: rows of each part and mask, and those of them that ``labels`` (``doc_id quality toxic``) marks with 1."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("g"), F.max((F.col("toxic") == 1).cast("long")).alias("t"))
    n = F.col("delta")
    rows = log.join(told, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("g", F.lit(0))).alias("good"), F.sum(n * F.coalesce("t", F.lit(0))).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """``counts`` for every part, order of the filters and step: what stays, what goes, and what went before.

    ``redundant`` fails the step's filter but is gone already, ``unique_fails``
    fails no other. ``shapley`` is what the filter removes, summed over all orders:
    a mask of k filters falls to each of them in a k-th of the 120.
    """
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), b).otherwise(0) for f, b in BITS.items()), F.lit(0))

    rows = rows.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")

    def total(of, what) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(of(c["mask"]), what(c)).otherwise(0))

    def fails(m: Column) -> Column:
        return m.bitwiseAND(own) != 0

    def gone(m: Column) -> Column:
        return m.bitwiseAND(before) != 0

    def removed(m: Column) -> Column:
        return fails(m) & ~gone(m)

    measures = {
        "kept": (lambda m: ~fails(m) & ~gone(m), lambda c: c["n"]), "removed": (removed, lambda c: c["n"]),
        "redundant": (lambda m: fails(m) & gone(m), lambda c: c["n"]), "unique_fails": (lambda m: m == own, lambda c: c["n"]),
        "good_lost": (removed, lambda c: c["good"]), "toxic_lost": (removed, lambda c: c["toxic"]),
        "shapley": (fails, lambda c: c["n"] * F.floor(120 / F.bit_count(c["mask"])).cast("long")),
    }
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[total(*m).alias(name) for name, m in measures.items()])


def audit(spark: SparkSession, path: str, labels: DataFrame, progress: str | None = None, **columns: str) -> DataFrame:
    """The interactions of all documents at ``path``. No documents give no rows; other columns play no part."""
    return interactions(mask_counts(change_log(spark, path, progress, **columns), labels).where("n <> 0"))
