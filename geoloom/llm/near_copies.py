"""Near copies by five-word shingles: MinHash bands find candidates, the shingles decide.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Such texts differ in about ten of 64 SimHash bits (the
angle of two sets of similarity 0.8 is 0.48), too many for balls of flipped
bits, so candidates come from MinHash: 25 bands of five minima each, of which a
pair of similarity 0.8 shares none with probability (1 - 0.8^5)^25 = 5e-5, and a
closer one with less. Nothing is taken on the bands' word.

A crowded band's texts are not paired. First each is compared with one text of its
band, the one that shares most bands with others and so lies in the middle of
its group; that joins nearly all of a group. What a band still holds of different
groups is searched exactly by prefixes: shingles are ordered by how many of these
texts hold them, and a pair whose first common shingle stands too far back in
either text can't have enough in common (``_prefix_pairs``).

Null and empty texts have no shingles and are near copies of none. Texts that are
equal are one text, however often they come; a very long text counts whole. No
rows give no rows; columns other than the text play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import connected, keep, octets, small_batches

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z become a-z, other bytes stay
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
ROUNDS = 2  # comparisons with the middle of a band
SENT = 1 << 20  # rows of a list of text hashes that is sent to every task: 8 bytes each
_RNG = np.random.default_rng(5)
FLIP = _RNG.integers(0, 2**64, BANDS * ROWS, dtype="u8")
TIMES = _RNG.integers(0, 2**64, BANDS * ROWS, dtype="u8") | np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 values of the text's different shingles, sorted; the whole sequence if words are few, none without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, "u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(starts, ends[-n:].tolist())), "u8", n))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band, its number included; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(hashes), 1 << 11):
        np.minimum(least, (((hashes[at : at + (1 << 11), None] ^ FLIP) * TIMES) >> np.uint64(32)).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, "u8").view("i8").tolist()


def sketches(docs: DataFrame, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``text_hash n bands`` of every different text with words; ``n`` counts its different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            own = [shingles(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in own], pa.int64()), pa.array([bands(h) for h in own], pa.list_(pa.int64()))], ["text_hash", "n", "bands"])

    rows = docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), octets(text_col).alias("t"))
    return rows.mapInArrow(run, "text_hash long, n long, bands array<long>").where("n > 0").dropDuplicates(["text_hash"])


def _sets(docs: DataFrame, asked: DataFrame, text_col: str, size: int) -> DataFrame:
    """``text_hash shingles`` of the texts that ``asked`` lists (``text_hash``, written), each once.

    A list of at most ``SENT`` texts is sent to every task, so that the others' texts stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            own = [shingles(t, size).view("i8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    rows = docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), octets(text_col).alias("t"))
    few = F.broadcast(asked) if asked.count() <= SENT else asked
    return rows.join(few, "text_hash", "left_semi").dropDuplicates(["text_hash"]).mapInArrow(run, "text_hash long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The roots ``a b`` of those ``pairs`` (``a b ra rb``, text hashes and their roots) that are near copies."""
    met = pairs.join(sets.toDF("a", "sa"), "a").select("b", "ra", "rb", "sa").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    good = both >= F.lit(least) * (F.size("sa") + F.size("sb") - both)
    return met.where(good).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def _mixed(crowd: DataFrame) -> DataFrame:
    """The bands of ``crowd`` (``key text_hash n root``) that hold more than one root, and their rows."""
    bands = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return keep(crowd.join(bands.select("key", "crowd"), "key"))


def _head_pairs(crowd: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``a b ra rb`` of each text with the middle text of its band, and those texts as ``key head``, both written."""
    rank = crowd.groupBy("text_hash").agg(F.sum("crowd").alias("rank"))
    heads = keep(crowd.join(rank, "text_hash").groupBy("key").agg(F.max_by("text_hash", "rank").alias("head")))
    of = crowd.select(F.col("text_hash").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")).distinct()
    asked = crowd.join(heads, "key").where("text_hash <> head").select(F.col("text_hash").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("head").alias("b")).distinct()
    # sets whose sizes differ by more can't be so alike
    met = asked.join(of, "b").where((F.col("ra") != F.col("rb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least))
    return keep(met.select("a", "b", "ra", "rb")), heads


def _prefix_pairs(texts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a b ra rb``: pairs of ``texts`` (``text_hash n root``) of different roots, among them all that are near copies.

    Sets of na <= nb shingles are near copies if they have s * (na + nb) in
    common, s = least / (1 + least). With all shingles in one order, rarest first,
    the first common one, at places i and j, leaves at most min(na - i, nb - j) of
    them, so na - i and nb - j must reach that number. The smaller text sends the
    shingles whose places allow a partner of its own size, the larger one those
    that allow a partner of each class of sizes (a class is a tenth wide). Shingles
    of one text alone need no partner; they count as the first places. Of the rows
    that meet in a shingle, those of the most frequent root meet the others only.
    """
    s, width = least / (1 + least), math.log(1 / 0.9)

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / width).cast("int")

    tokens = sets.join(texts.select("text_hash"), "text_hash", "left_semi").select("text_hash", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    listed = tokens.join(often, "token").groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("shared"))
    rows = keep(texts.join(listed, "text_hash").withColumn("alone", F.col("n") - F.size("shared")))
    n = F.col("n")

    def placed(most: Column) -> DataFrame:
        """The shared shingles with a place up to ``most``."""
        cut = rows.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.floor(most + 1e-6).cast("int") + 1 - F.col("alone").cast("int"))))
        return cut.select("text_hash", "n", "root", "alone", F.posexplode("shared").alias("at", "s")).withColumn("place", F.col("alone") + F.col("at")).withColumn("token", F.col("s.token"))

    small = placed(n - 2 * s * n).select("token", size_class(n).alias("cls"), F.col("text_hash").alias("a"), F.col("n").alias("na"), F.col("place").alias("i"), F.col("root").alias("ra"))
    classes = F.explode(F.sequence(size_class(F.ceil(n * least - 1e-6)), size_class(n)))
    large = placed(n - s * (1 + least) * n).withColumn("cls", classes).where(F.col("place") <= n - s * (n + F.exp(F.col("cls") * width)) + 1e-6)
    large = large.select("token", "cls", F.col("text_hash").alias("b"), F.col("n").alias("nb"), F.col("place").alias("j"), F.col("root").alias("rb"))
    by = ["token", "cls"]
    counts = small.select(*by, F.col("ra").alias("root")).union(large.select(*by, "rb")).groupBy(*by, "root").agg(F.count(F.lit(1)).alias("k"))
    meeting = keep(counts.groupBy(*by).agg(F.max_by("root", "k").alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots"))
    small, large = keep(small.join(meeting, by)), keep(large.join(meeting.select(*by), by))
    need = s * (F.col("na") + F.col("nb")) - 1e-6
    fits = (F.col("na") <= F.col("nb")) & (F.col("ra") != F.col("rb")) & (F.col("na") >= least * F.col("nb") - 1e-6) & (F.col("na") - F.col("i") >= need) & (F.col("nb") - F.col("j") >= need)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        same = (left["token"] == right["token"]) & (left["cls"] == right["cls"])
        return left.join(right, same & fits).select("a", "b", "ra", "rb")

    others = keep(large.join(meeting, by).where("rb <> most").drop("most"))
    return keep(met(small.where("ra <> most"), large).union(met(small.where("ra = most"), others)).distinct())


def merged(docs: DataFrame, roots: DataFrame, text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``root merged``: roots of ``roots`` (``text_hash root``, written) and what they become, with near copies joined."""
    own = sketches(docs, text_col, size).join(roots, "text_hash")
    crowd = _mixed(own.select("text_hash", "n", "root", F.explode("bands").alias("key")))
    sets = keep(_sets(docs, keep(crowd.select("text_hash").distinct()), text_col, size))
    steps = roots.select("root").distinct().withColumn("merged", F.col("root"))

    def become(rows: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
        joined = connected(_alike(pairs, sets, least)).toDF(column, "to")
        return rows.join(joined, column, "left").withColumn(column, F.coalesce("to", column)).select(*rows.columns)

    for _ in range(ROUNDS):
        pairs, heads = _head_pairs(crowd, least)
        changed = keep(become(crowd.select("root").distinct().withColumn("now", F.col("root")), "now", pairs))
        steps = keep(steps.join(changed.toDF("merged", "now"), "merged", "left").select("root", F.coalesce("now", "merged").alias("merged")))
        rest = crowd.join(heads.withColumnRenamed("head", "text_hash"), ["key", "text_hash"], "left_anti")
        crowd = _mixed(rest.drop("crowd").join(changed, "root").select("key", "text_hash", "n", F.col("now").alias("root")))
    left = keep(crowd.select("text_hash", "n", "root").distinct())
    return keep(become(steps, "merged", _prefix_pairs(left, sets, least)))
