"""Building blocks that keep hot groups and large joins spread over the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut_lineage


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
              rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark turns ``row_number() <= n`` into a group limit before the shuffle, so
    at most ``n`` rows per group leave a map task, however large the group.
    """
    col = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(col, F.row_number().over(w)).where(F.col(col) <= n)
    return out if rank else out.drop(col)


def order_bin(v: Column) -> Column:
    """A bin number that never decreases with ``v``; about 0.1 % wide, any range, infinities too."""
    return (F.signum(v) * F.floor(F.least(F.log1p(F.abs(v) * 1000) * 1024, F.lit(1e6)))).cast("bigint")


SENT = 64 << 20  # bytes of a table that is sent to every task
FEW = 1 << 22  # values that are counted one by one at last, in all groups together


def sent(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written copy of ``table``; marked to be sent to every task if it was counted and its size allows it."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() * row_bytes <= SENT else table


def dealt(table: DataFrame) -> DataFrame:
    """``table`` marked to be dealt by the keys of a join and not sent whole.

    Spark guesses a size from the bytes of the files, which says nothing of a
    table whose rows were multiplied or whose columns pack well on disk.
    """
    return table.hint("merge")


def exact_stats(df: DataFrame, keys: Sequence[str], value: str,
                probs: dict[str, float]) -> DataFrame:
    """Count ``n``, ``mean``, ``min``, ``max`` and exact quantiles per group.

    ``percentile`` holds all distinct values of a group in one task. Here a
    first pass counts rows per order-preserving bin, combined before the
    shuffle, and the counts say which bins hold the wanted ranks. These bins, at
    most two a rank and group, are sent to the tasks of the next pass, which
    counts their rows by 4,096 parts between the bin's own extremes, and so on
    until what is left of them is few enough to count value by value, or each is
    one value. So counts are shuffled and not values. Only where the wanted bins
    of all groups exceed ``SENT`` are rows dealt to them by group and bin.
    Quantiles are linear between ranks. Null and NaN do not count; rows with a
    null key belong to no group.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    # adding 0.0 makes -0.0 and 0.0 one value
    rows = (df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + F.lit(0.0)).alias("_v"))
            .withColumn("_bin", order_bin(F.col("_v"))))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    run = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    bins = (
        rows.groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_bn"), F.sum("_v").alias("_bs"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
        .withColumn("_before", F.sum("_bn").over(run) - F.col("_bn"))
        .withColumn("n", F.sum("_bn").over(whole))
        .withColumn("mean", F.sum("_bs").over(whole) / F.col("n"))
        .withColumn("min", F.min("_bmin").over(whole))
        .withColumn("max", F.max("_bmax").over(whole))
    )
    facts = ["n", "mean", "min", "max"]

    def lo(p: float) -> Column:
        return F.floor(F.lit(p) * (F.col("n") - 1))

    def hi(p: float) -> Column:
        return F.ceil(F.lit(p) * (F.col("n") - 1))

    def holding(table: DataFrame) -> DataFrame:
        out = F.lit(False)
        for p in probs.values():
            for rank in (lo(p), hi(p)):
                out = out | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bn")))
        return table.where(out).select(*keys, "_bin", "_bn", "_bmin", "_bmax", "_before", *facts)

    def narrowed(wanted: DataFrame, part: Column) -> DataFrame:
        """The rows of the wanted bins, counted by ``part``; the parts that hold a wanted rank."""
        inside = (rows.join(wanted.withColumnsRenamed({"_bmin": "_lo", "_bmax": "_hi"}), [*keys, "_bin"])
                  .where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).withColumn("_part", part))
        parts = (inside.groupBy(*keys, "_bin", "_lo", "_before", *facts, "_part")
                 .agg(F.count(F.lit(1)).alias("_pn"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
        upto = Window.partitionBy(*keys, "_bin", "_lo").orderBy("_part")
        before = F.col("_before") + F.sum("_pn").over(upto) - F.col("_pn")
        return holding(parts.withColumn("_before", before).withColumnRenamed("_pn", "_bn"))

    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    parts_of = F.when(F.col("_hi") > F.col("_lo"), F.floor(share * 4095)).otherwise(0)
    wanted = sent(holding(bins), 200)
    while True:
        (left,) = wanted.agg(F.sum(F.when(F.col("_bmin") < F.col("_bmax"), F.col("_bn")))).first()
        if not left:
            break
        if left <= FEW:
            # bins of one value stay as they are
            wanted = narrowed(wanted.where("_bmin < _bmax"), F.col("_v")).unionByName(wanted.where("_bmin = _bmax"))
            break
        wanted = sent(narrowed(wanted, parts_of), 200)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_bn")), F.col("_bmin")))

    picks = [F.max(f).alias(f"_{f}") for f in facts]
    for name, p in probs.items():
        picks += [at(lo(p)).alias(f"_lo_{name}"), at(hi(p)).alias(f"_hi_{name}")]
    got = wanted.groupBy(*keys).agg(*picks)
    for f in facts:
        got = got.withColumnRenamed(f"_{f}", f)
    for name, p in probs.items():
        frac = F.lit(p) * (F.col("n") - 1) - lo(p)
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        got = got.withColumn(name, a + (b - a) * frac)
    return got.select(*keys, *facts, *probs)


def running(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
            how: str, values: dict[str, Column]) -> DataFrame:
    """Running sum or max per group, computed bucket by bucket.

    A plain window would sort a whole group in one task. Rows are first run
    inside ``(keys, bucket)``; the bucket totals, few per group, are run over
    the buckets; and the two are added. ``bucket`` must rise with ``order``.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    part = [*keys, bucket]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (Window.partitionBy(*keys).orderBy(bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = df
    for name, col in values.items():
        out = out.withColumn(f"_v_{name}", col)
    totals = out.groupBy(*part).agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n in values])
    for name in values:
        totals = totals.withColumn(f"_b_{name}", fold(f"_t_{name}").over(before))
    totals = totals.drop(*[f"_t_{n}" for n in values])
    for name in values:
        out = out.withColumn(name, fold(f"_v_{name}").over(local))
    out = out.join(totals, part, "left")
    for name in values:
        got, carried = F.col(name), F.col(f"_b_{name}")
        both = got + F.coalesce(carried, F.lit(0)) if how == "sum" else F.greatest(got, carried)
        out = out.withColumn(name, both)
    return out.drop(*[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])


def row_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in order, over all of them, without one task seeing them all.

    The sort leaves each partition with a range; rows count inside their
    partition, and the sizes of the partitions, a short list, give the offsets.
    The sorted rows are written out first, so a retry cannot renumber them.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_row_m", F.monotonically_increasing_id()))
    rows = (placed.withColumn("_row_p", F.shiftright("_row_m", 33))
            .withColumn("_row_i", F.col("_row_m").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_row_p").agg(F.count(F.lit(1)).alias("_row_n"))
    before = Window.orderBy("_row_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_row_p", F.coalesce(F.sum("_row_n").over(before), F.lit(0)).alias("_row_o"))
    return (rows.join(offsets, "_row_p").withColumn(name, F.col("_row_o") + F.col("_row_i"))
            .select(*df.columns, name))


def cover_cells(west: Column, south: Column, east: Column, north: Column, deg: float) -> Column:
    """The grid cells a box touches, as an array of ``(cx, cy)``."""
    def cells(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / deg).cast("int"), F.floor(hi / deg).cast("int"))

    return F.flatten(F.transform(
        cells(west, east),
        lambda x: F.transform(cells(south, north), lambda y: F.struct(x.alias("cx"), y.alias("cy"))),
    ))


def cell_join(left: DataFrame, right: DataFrame, deg: float, salts: int = 8) -> DataFrame:
    """Pairs of boxes that touch, as an equi-join on grid cells.

    Both sides carry ``west south east north``; the right ones come out as
    ``r_*``. A pair meets in every cell both boxes cover and is kept in one of
    them only, the cell of the lower-left corner of the overlap, so no
    ``distinct`` is needed. The right side is salted by its content and the
    left side copied ``salts`` times, so a crowded cell spreads over tasks.
    """
    box = ("west", "south", "east", "north")
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    lc = (left.withColumn("_cell", F.explode(cover_cells(*[F.col(c) for c in box], deg)))
          .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    rc = (r.withColumn("_salt", F.pmod(F.xxhash64(*r.columns), F.lit(salts)).cast("int"))
          .withColumn("_cell", F.explode(cover_cells(*[F.col(f"r_{c}") for c in box], deg))))
    cx = F.floor(F.greatest("west", "r_west") / deg).cast("int")
    cy = F.floor(F.greatest("south", "r_south") / deg).cast("int")
    return (
        lc.join(rc, ["_cell", "_salt"])
        .where((F.col("r_west") <= F.col("east")) & (F.col("r_east") >= F.col("west"))
               & (F.col("r_south") <= F.col("north")) & (F.col("r_north") >= F.col("south"))
               & (F.col("_cell.cx") == cx) & (F.col("_cell.cy") == cy))
        .drop("_cell", "_salt")
    )


