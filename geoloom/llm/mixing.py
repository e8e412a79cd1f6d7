"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its
documents. The whole part is taken by all; the fractions are rounded in pairs:
words move at random from one of two documents to the other until a fraction
becomes nought or one, so a source's words stay as they are, and every document
keeps its expectation. What is left over meets in a tree: leaves of bounded
size leave one fraction each, these are paired again a level higher, and the
last one of a source is drawn. So a source misses its target by less than one
document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, keep

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source or a document is taken
LEAF = 2_000  # documents of a leaf, and leaves of a node of the tree, about
SEED = 17


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source source_size rows target``: shares of all sizes by weight, none above ``most`` times its source's size.

    Sources in order of code points, null last, take the weights in turn. What
    a source can't hold goes to the others by weight; the level at which this
    ends is found by sorting the sources by the level that fills them. There is
    one row per source here, never one per document.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = each.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1))
    cap = F.lit(float(most)) * F.col("source_size")
    to_here = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    full = (
        ranked.withColumns({"cap": cap, "full_at": cap / F.col("w"), "total": F.sum("source_size").over(Window.partitionBy()).cast("double"), "all_w": F.sum("w").over(Window.partitionBy())})
        .withColumns({"caps": F.sum("cap").over(to_here) - F.col("cap"), "rest_w": F.col("all_w") - F.sum("w").over(to_here) + F.col("w")})
        .withColumn("is_full", F.col("caps") + F.col("full_at") * F.col("rest_w") <= F.col("total"))
    )
    everyone = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(everyone), F.lit(0.0))) / F.sum(F.when(~F.col("is_full"), F.col("w"))).over(everyone)
    return full.select("source", "source_size", "rows", F.when(F.col("is_full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def _round(rng: np.random.Generator, units: Iterator[tuple[int, float, float]]) -> tuple[list[tuple[int, int]], tuple[int, float, float] | None]:
    """Pairs ``(place, size, fraction)`` one after another. Gives the places that became 0 or 1, and the one left between."""
    done, held = [], None
    for b in units:
        if held is None:
            held = b
            continue
        (i, si, pi), (j, sj, pj) = held, b
        to_i, to_j = min((1 - pi) * si, pj * sj), min(pi * si, (1 - pj) * sj)
        if rng.random() * (to_i + to_j) < to_j:
            pi, pj = (1.0 if (1 - pi) * si <= to_i else pi + to_i / si), (0.0 if pj * sj <= to_i else pj - to_i / sj)
        else:
            pi, pj = (0.0 if pi * si <= to_j else pi - to_j / si), (1.0 if (1 - pj) * sj <= to_j else pj + to_j / sj)
        held = None
        for k, s, p in ((i, si, pi), (j, sj, pj)):
            if 0.0 < p < 1.0:
                held = (k, s, p)
            else:
                done.append((k, int(p)))
    return done, held


def _level(units: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One level of the tree. ``units``: ``tree node key size part extra digest``; a written copy with ``extra`` set where ``part`` became whole.

    Each (tree, node) is streamed in order of ``key``; its random numbers hang on
    seed, level, tree and node alone, so that reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rng, held, held_row = None, None, None, None
        for b in batches:
            tree, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            size, part = b.column(3).to_numpy(), b.column(4).to_numpy()
            extra, left = np.full(b.num_rows, -1, np.int32), part.copy()
            cut = np.flatnonzero((np.diff(tree) != 0) | (np.diff(node) != 0)) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, b.num_rows)):
                if lo == hi:
                    continue
                if name != (tree[lo], node[lo]):
                    if held_row is not None:
                        yield _finish(held_row, held, rng, last)
                    name, held, held_row = (tree[lo], node[lo]), None, None
                    rng = np.random.default_rng([seed, level, int(tree[lo]) & (2**64 - 1), int(node[lo])])
                queue = zip(range(lo, hi), size[lo:hi].tolist(), part[lo:hi].tolist())
                if held is not None:
                    queue = (x for q in ([(-1, *held[1:])], queue) for x in q)
                done, now = _round(rng, queue)
                for k, v in done:
                    if k >= 0:
                        extra[k] = v
                    else:
                        yield _row(held_row, v, float(v))
                        held_row = None
                if now is not None and now[0] >= 0:
                    held_row = b.slice(now[0], 1)
                    extra[now[0]] = -2  # goes out when its node ends
                held = now
            keep_rows = extra != -2
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(left), pa.array(extra, pa.int32()), b.column(6)], b.schema.names)
            yield out.filter(pa.array(keep_rows))
        if held_row is not None:
            yield _finish(held_row, held, rng, last)

    dealt = units.repartition("tree", "node").sortWithinPartitions("tree", "node", "key", "digest")
    return keep(dealt.mapInArrow(run, units.schema))


def _row(row: pa.RecordBatch, extra: int, part: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(row.column(i) for i in range(4)), pa.array([part]), pa.array([extra], pa.int32()), row.column(6)], row.schema.names)


def _finish(row: pa.RecordBatch, held: tuple, rng: np.random.Generator, last: bool) -> pa.RecordBatch:
    """A node's left-over: drawn at the root, else passed on with its fraction."""
    return _row(row, int(rng.random() < held[2]) if last else -1, held[2])


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """``doc_id source text_hash size source_size target rows copies``: one row for all equal rows; ``copies`` are theirs together.

    Equal rows are counted before anything else, so a row that repeats without
    end is one unit. Size counts runs of other than ASCII white space; null and
    empty texts have size 0 and are taken as often as the whole part says. No
    documents give no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("text_hash"), words.alias("size"))
    units = keep(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows")))
    share = keep(targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.round(F.col("n") * rate, 9)
    units, share = units.withColumnRenamed("rows", "n"), share.withColumnRenamed("source", "src")
    key = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size", "source")
    units = units.join(share, units["source"].eqNullSafe(share["src"])).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", "n", F.floor(wanted).alias("whole"), (wanted - F.floor(wanted)).alias("part"),
        F.xxhash64(F.lit(seed), F.col("source").isNull(), "source").alias("tree"), F.pmod(key, F.ceil(F.col("rows") / F.lit(leaf))).alias("node"), key.alias("key"))
    units = keep(units)
    level = units.where("part > 0 and size > 0").select("tree", "node", "key", F.col("size").cast("double").alias("size"), "part", F.lit(-1).alias("extra"), F.col("text_hash").alias("digest"))
    (nodes,) = units.agg(F.coalesce(F.max("node"), F.lit(0))).first()
    drawn, depth, nodes = [], 0, nodes + 1
    while True:
        now = _level(level, depth, nodes == 1, seed)
        drawn.append(now.where("extra >= 0"))
        if nodes == 1:
            break
        nodes = -(-nodes // leaf)
        level, depth = now.where("extra < 0").withColumn("node", F.floor(F.col("node") / leaf)), depth + 1
    extra = drawn[0]
    for d in drawn[1:]:
        extra = extra.union(d)
    extra = extra.select("tree", "key", F.col("digest").alias("text_hash"), "extra")
    taken = units.join(extra, ["tree", "key", "text_hash"], "left")
    return taken.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.col("n").alias("rows"), (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def _spread(of: DataFrame) -> DataFrame:
    """A row for each of the equal rows, with its own part of their copies as ``taken_times``."""
    each = of.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("i") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return each.withColumn("taken_times", own.cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``doc_id size source_size target taken`` of every row; ``taken`` counts words, repeats included."""
    return _spread(copies(docs, **how)).select("doc_id", "size", "source_size", "target", (F.col("taken_times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Rows equal in id, source and text share their copies as in ``mix``, in an
    order of their other columns; of rows equal in all columns one is exploded.
    Texts are shuffled once, to their decisions.
    """
    own_id, no_id, own_source, no_source, digest, other, times, rows_of, n, before = fresh(
        docs, "own_id", "no_id", "own_source", "no_source", "digest", "other", "times", "rows_of", "n", "before")
    unit = [own_id, no_id, own_source, no_source, digest]

    def keys(id_: str, source: str) -> dict[str, Column]:
        """The unit's columns without nulls, so that one dealing serves all steps."""
        a, b = F.col(id_).cast("string"), F.col(source).cast("string")
        return {own_id: F.coalesce(a, F.lit("")), no_id: a.isNull(), own_source: F.coalesce(b, F.lit("")), no_source: b.isNull()}

    chosen = copies(docs, id_col, text_col, source_col, **how).where("copies > 0")
    chosen = chosen.withColumns(keys("doc_id", "source")).select(*unit[:4], F.col("text_hash").alias(digest), F.col("copies").alias(times), F.col("rows").alias(rows_of))
    rest = [c for c in docs.columns if c not in (id_col, source_col, text_col)]
    rows = docs.withColumns({**keys(id_col, source_col), digest: F.xxhash64(F.col(text_col)), other: F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")})
    alike = rows.groupBy(*unit, other).agg(F.count(F.lit(1)).alias(n))
    alike = alike.withColumn(before, F.sum(n).over(Window.partitionBy(*unit).orderBy(other)) - F.col(n))
    extra = F.greatest(F.lit(0), F.least(F.col(n), F.col(times) % F.col(rows_of) - F.col(before)))
    own = F.col(n) * F.floor(F.col(times) / F.col(rows_of)) + extra
    share = alike.join(chosen, unit).select(*unit, other, own.cast("long").alias(times)).where(F.col(times) > 0)
    out = rows.dropDuplicates([*unit, other]).join(share, [*unit, other]).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return out.select(*docs.columns)
