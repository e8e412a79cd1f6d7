"""Exact dedup by progressive refinement: length, then a hash of the text's head, then the hash of the whole text.

Each level counts its groups, combined before the shuffle, and hands on only the
groups of two rows or more. A table of such groups is sent to every task if it
was counted and has ``SENT`` rows at most; then a row of a group that is already
alone costs neither its head's nor its text's hash. A larger table is joined by
a shuffle of ids and hashes, for which the next level is hashed in every row.
Texts are never shuffled, and the result is the same either way.

Two texts are equal if their length, head and SHA-256 are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, keep, octets

HEAD = 256  # bytes of a text that the second level hashes
SENT = 1 << 20  # rows of a table of groups that is sent to every task: 24 bytes each


def _refined(rows: DataFrame, groups: DataFrame, by: list[str], level: str, value: Column) -> DataFrame:
    """``rows`` with ``level``: ``value`` where ``by`` is a key of ``groups``, null elsewhere."""
    known = groups.withColumn("_met", F.lit(True))
    if groups.count() <= SENT:
        met = rows.join(F.broadcast(known), by, "left").withColumn(level, F.when(F.col("_met"), value))
        return met.drop("_met", "_text")
    met = rows.withColumn(level, value).drop("_text").join(known, by, "left")
    return met.withColumn(level, F.when(F.col("_met"), F.col(level))).drop("_met")


def _crowded(rows: DataFrame, by: list[str]) -> DataFrame:
    """The keys that two rows or more share, written."""
    whole = rows.where(F.col(by[-1]).isNotNull())
    return keep(whole.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id keep_id group_size kept text_sha256`` of every row of ``docs``.

    Of rows with equal texts the one of the largest id stays; nulls are the
    smallest, and of rows that repeat an id and its text exactly one stays. A
    null text is an empty one. ``text_sha256`` is null for texts that are alone
    by length or head, unless ``digests`` asks for it everywhere. Texts count
    whole, however long. No rows give no rows; other columns play no part.
    """
    text = F.coalesce(octets(text_col), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).withColumn("length", F.octet_length("_text"))
    head, whole = F.xxhash64(F.substring("_text", 1, HEAD)), F.sha2("_text", 256)

    lengths = _crowded(rows, ["length"])
    heads = _crowded(_refined(rows, lengths, ["length"], "head", head), ["length", "head"])
    last = rows.withColumn("head", head)  # a crowded head has a crowded length
    if digests:
        last = last.withColumn("text_sha256", whole)
        whole = F.col("text_sha256")
    # the number that tells rows apart is written with them, so it can't change
    found = keep(_refined(last, heads, ["length", "head"], "full", whole).withColumn("row", F.monotonically_increasing_id()))
    if not digests:
        found = found.withColumn("text_sha256", F.col("full"))

    by = ["length", "head", "full"]
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    ids = found.where("full IS NOT NULL").groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"))
    # written, so that the join sees their size and a large group is split on its side
    groups = keep(ids.groupBy(*by).agg(F.sum("n").alias("size"), F.max("doc_id").alias("keep_id"), F.max_by("row", rank).alias("kept_row")).where("size > 1"))
    told = found.join(groups, by, "left")
    alone = F.col("size").isNull()
    return told.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("kept_row"))).alias("kept"), "text_sha256")


def largest_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of rows that repeat an id and its text one stays.

    The rows that go are few and listed by id and text hash; texts are dealt
    once, by these.
    """
    of, digest = fresh(docs, "of", "digest")
    gone = exact_groups(docs, id_col, text_col)
    stay = gone.where("kept AND group_size > 1").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(digest))
    copies = gone.where("group_size > 1").select(F.col("text_sha256").alias(digest)).distinct()
    rows = docs.withColumns({of: F.col(id_col).cast("long"), digest: F.sha2(F.coalesce(octets(text_col), F.lit(b"")), 256)})
    alone = rows.join(copies, digest, "left_anti")
    same = rows[of].eqNullSafe(stay[of]) & (rows[digest] == stay[digest])
    first = rows.join(stay, same, "left_semi").dropDuplicates([of, digest])
    return alone.unionByName(first).drop(of, digest)
