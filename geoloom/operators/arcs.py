"""Outlines simplified with their topology.

Borders of neighbouring regions are cut into arcs at the corners where three or
more borders meet. An arc belongs to the rings on both its sides and is
simplified once, so neighbours go on sharing it. Segments of simplified arcs that
then cross, touch or come too near another border get their farthest vertex back
until none does; the pixels' own borders never cross, so that ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.scale import running
from geoloom.operators.vectorize import KEY, ROW, _gap, peucker
from geoloom.sources.sinks import scratch_path

CELL = 32  # pixels


def _written(df: DataFrame) -> DataFrame:
    """``df`` written and read back. A checkpoint carries the constraints of its plan on, which grow with each round here."""
    path = scratch_path(df.sparkSession, "arcs")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(df: DataFrame, keys: list[str], order: str, names: dict[str, Column]) -> DataFrame:
    """Running sums along ``order``, bucket by bucket, so that a long line is not one task's."""
    return running(df.withColumn("_b", F.floor(F.col(order) / 65536)), keys, "_b", [F.asc(order)], "sum", names).drop("_b")


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _faults(segments: DataFrame) -> DataFrame:
    """``line v0 v1``: segments with vertices to give back (``loose``) that cross, touch or come too near another.

    Segments (``grp line v0 v1 x0 y0 x1 y1 ... loose cell tol``) meet in the
    cells of a grid, cut into pieces of a cell's length before, so that a long
    one lies in as many cells as it is long. A border of another part, one that
    shares no end with the segment's, may not come nearer than the tolerance:
    else an island could change sides without a crossing.
    """
    def pieces(df: DataFrame, margin: Column) -> DataFrame:
        size = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
        n = F.greatest(F.lit(1), F.ceil(size / F.col("cell"))).cast("int")
        cut = df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

        def cells(a: str, b: str) -> Column:
            s, t = (F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") + k) / F.col("_n") for k in (0, 1))
            low, high = F.least(s, t) - margin, F.greatest(s, t) + margin
            return F.explode(F.sequence(F.floor(low / F.col("cell")), F.floor(high / F.col("cell"))))

        return cut.withColumn("_cx", cells("x0", "x1")).withColumn("_cy", cells("y0", "y1")).drop("_n", "_i").distinct()

    left = pieces(segments.where("loose"), F.col("reach"))
    names = ("line", "v0", "x0", "y0", "x1", "y1", "lon0", "lat0", "e0", "e1")
    right = pieces(segments, F.lit(0.0)).select("grp", "_cx", "_cy", *[F.col(c).alias(f"o_{c}") for c in names])
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    u0, w0, u1, w1 = (F.col(f"o_{c}") for c in ("x0", "y0", "x1", "y1"))

    def inside(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        """The point lies on the segment and is none of its ends."""
        between = px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
        return between & (_cross(ax, ay, bx, by, px, py) == 0) & ~((px == ax) & (py == ay)) & ~((px == bx) & (py == by))

    sides = [F.signum(_cross(*of).cast("double")) for of in ((x0, y0, x1, y1, u0, w0), (x0, y0, x1, y1, u1, w1), (u0, w0, u1, w1, x0, y0), (u0, w0, u1, w1, x1, y1))]
    proper = (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0)
    touch = inside(u0, w0, x0, y0, x1, y1) | inside(u1, w1, x0, y0, x1, y1) | inside(x0, y0, u0, w0, u1, w1) | inside(x1, y1, u0, w0, u1, w1)
    same = ((x0 == u0) & (y0 == w0) & (x1 == u1) & (y1 == w1)) | ((x0 == u1) & (y0 == w1) & (x1 == u0) & (y1 == w0))
    apart = (F.col("line") != F.col("o_line")) & ~F.col("e0").isin(F.col("o_e0"), F.col("o_e1")) & ~F.col("e1").isin(F.col("o_e0"), F.col("o_e1"))
    near = apart & (_gap(F.col("o_lon0"), F.col("o_lat0"), F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1")) <= F.col("tol"))
    other = (F.col("line") != F.col("o_line")) | (F.col("v0") != F.col("o_v0"))
    met = left.join(right, ["grp", "_cx", "_cy"]).where(other & (proper | touch | same | near))
    empty = segments.where(F.col("loose") & (x0 == x1) & (y0 == y1))
    return met.select("line", "v0", "v1").union(empty.select("line", "v0", "v1")).distinct()


def untangled(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` (``line vtx``) with the vertices of ``lines`` that keep simplified lines apart.

    ``lines``: ``grp line vtx x y lon lat tol cell``; lines of one ``grp`` are
    held against each other and themselves. ``x y`` decide crossings, exactly if
    they are whole numbers; distances are those of ``lon lat``. ``cell`` is the
    side of a grid's cell in the unit of ``x y``.
    """
    place = F.concat_ws(" ", "x", "y")
    ends = lines.groupBy("line").agg(F.min_by(place, "vtx").alias("e0"), F.max_by(place, "vtx").alias("e1"))
    lines = _written(_numbered(lines, ["line"], "vtx", {"_o": F.lit(1)}))
    facts = ["grp", "x", "y", "lon", "lat", "tol", "cell", "_o"]
    kept = _written(lines.join(kept, ["line", "vtx"]).select("line", "vtx", *facts).distinct())
    along = Window.partitionBy("line").orderBy("vtx")
    while True:
        nexts = {f"{c}1": F.lead(c).over(along) for c in ("vtx", "x", "y", "lon", "lat", "_o")}
        segments = kept.withColumns(nexts).where("vtx1 IS NOT NULL").join(ends, "line")
        segments = segments.withColumnsRenamed({"vtx": "v0", "vtx1": "v1", "x": "x0", "y": "y0", "lon": "lon0", "lat": "lat0"})
        # the tolerance in the unit of x y: lon lat may be scaled
        wide = F.greatest(F.abs(F.col("lon1") - F.col("lon0")), F.abs(F.col("lat1") - F.col("lat0")))
        unit = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
        segments = segments.withColumn("loose", F.col("_o1") > F.col("_o") + 1).withColumn("reach", F.when(wide > 0, F.col("tol") * 2 * unit / wide).otherwise(F.col("cell")))
        bad = _faults(_written(segments)).withColumnRenamed("v0", "_v0").withColumnRenamed("v1", "_v1")
        held = kept.select("line", F.col("vtx").alias("_v0"), F.col("lon").alias("_a"), F.col("lat").alias("_b"))
        until = kept.select("line", F.col("vtx").alias("_v1"), F.col("lon").alias("_c"), F.col("lat").alias("_d"))
        gone = lines.join(bad.join(held, ["line", "_v0"]).join(until, ["line", "_v1"]), "line").where((F.col("vtx") > F.col("_v0")) & (F.col("vtx") < F.col("_v1")))
        far = F.struct(_gap(F.col("lon"), F.col("lat"), F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d")), -F.col("vtx"))
        back = gone.groupBy("line", "_v0").agg(F.max_by(F.struct("vtx", *facts), far).alias("m")).select("line", "m.*")
        more = _written(back)
        if more.isEmpty():
            return kept.select("line", "vtx")
        kept = _written(kept.unionByName(more.select(kept.columns)))


def _arcs(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs of ``rings`` (``raster_id region ring vtx x y hole node n``, written) and their vertices.

    Arcs ``raster_id ring j line flip size`` in the ring's order and vertices
    ``line at raster_id x y``. A ring without nodes is cut at its least corner and
    the one farthest from it, the same from either side. An arc is named by the
    end and direction that come first, and runs from there; ``flip`` says
    that its ring has it the other way round.
    """
    ring = [KEY, "ring"]
    place = F.col("x").cast("long") * ROW + F.col("y")
    rows = rings.withColumn("_p", place)
    facts = rows.groupBy(*ring).agg(F.bool_or("node").alias("_has"), F.min("_p").alias("_least"))
    bare = rows.join(facts.where("NOT _has"), ring)
    apart = F.pow(F.col("x") - F.floor(F.col("_least") / ROW), F.lit(2)) + F.pow(F.col("y") - F.col("_least") % ROW, F.lit(2))
    bare = bare.withColumn("_d", apart)
    farthest = bare.join(bare.groupBy(*ring).agg(F.max("_d").alias("_d")), [*ring, "_d"]).groupBy(*ring).agg(F.min("_p").alias("_far"))
    rows = rows.join(facts, ring).join(farthest, ring, "left")
    rows = rows.withColumn("node", F.when(F.col("_has"), F.col("node")).otherwise((F.col("_p") == F.col("_least")) | (F.col("_p") == F.col("_far"))))
    first = rows.where("node").groupBy(*ring).agg(F.min("vtx").alias("_first"), F.count(F.lit(1)).alias("_arcs"))
    rows = rows.join(first, ring).withColumn("w", F.pmod(F.col("vtx") - F.col("_first"), F.col("n")))
    rows = _written(_numbered(rows.select(*ring, "w", "x", "y", "node", "n", "_arcs"), ring, "w", {"j": F.col("node").cast("long")}))
    starts = rows.where("node").select(*ring, "j", F.col("w").alias("w0"))
    ends = rows.where("node").select(*ring, F.when(F.col("j") == 1, F.col("_arcs")).otherwise(F.col("j") - 1).alias("j"), F.when(F.col("j") == 1, F.col("n")).otherwise(F.col("w")).alias("w"), "x", "y")
    every = rows.select(*ring, "j", "w", "x", "y").unionByName(ends).join(starts, [*ring, "j"]).withColumn("k", F.col("w") - F.col("w0")).drop("w", "w0")
    every = _written(every)
    at = F.struct("x", "y")
    sizes = every.groupBy(*ring, "j").agg(F.max("k").alias("size"))
    tips = every.join(sizes, [*ring, "j"]).groupBy(*ring, "j", "size").agg(
        F.min_by(at, "k").alias("a"), F.max_by(at, "k").alias("b"), F.min_by(at, F.when(F.col("k") > 0, F.col("k"))).alias("a2"),
        F.max_by(at, F.when(F.col("k") < F.col("size"), F.col("k"))).alias("b2"))

    def name(here: str, there: str) -> Column:
        dx, dy = F.col(f"{there}.x") - F.col(f"{here}.x"), F.col(f"{there}.y") - F.col(f"{here}.y")
        way = F.when(dx > 0, 0).when(dy > 0, 1).when(dx < 0, 2).otherwise(3)
        return (F.col(f"{here}.x").cast("long") * ROW + F.col(f"{here}.y")) * 4 + way

    named = tips.withColumn("_a", name("a", "a2")).withColumn("_b", name("b", "b2"))
    arcs = _written(named.select(*ring, "j", "size", F.concat_ws(":", KEY, F.least("_a", "_b")).alias("line"), (F.col("_b") < F.col("_a")).alias("flip")))
    along = F.when(F.col("flip"), F.col("size") - F.col("k")).otherwise(F.col("k"))
    vertices = every.join(arcs, [*ring, "j"]).select("line", along.alias("at"), KEY, "x", "y").dropDuplicates(["line", "at"])
    return arcs, vertices


def simplify_regions(rings: DataFrame, scale: DataFrame) -> DataFrame:
    """``rings`` (of ``region_rings`` with ``nodes``, written) with simplified borders: ``raster_id region ring vtx x y hole``.

    ``scale``: ``raster_id sx sy tol``: a pixel's sides and the tolerance in the
    same unit, for each raster its own; 0 keeps all corners. Neighbours share
    their borders exactly; no border crosses or touches another but in
    a node, and islands stay on their side. ``vtx`` orders a ring and has gaps.
    """
    arcs, vertices = _arcs(rings)
    # in units of a pixel's width, so that degrees and metres round alike
    lines = vertices.join(scale, KEY).select(
        "line", F.col("at").alias("vtx"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("x").cast("double").alias("lon"), (F.col("y") * (F.col("sy") / F.col("sx"))).alias("lat"),
        (F.col("tol") / F.col("sx")).alias("tol"), F.col(KEY).cast("string").alias("grp"), F.lit(float(CELL)).alias("cell"))
    lines = _written(lines)
    kept = untangled(lines, peucker(lines))
    shapes = kept.join(lines.select("line", "vtx", "x", "y"), ["line", "vtx"])
    back = arcs.join(shapes, "line").withColumn("k", F.when(F.col("flip"), F.col("size") - F.col("vtx")).otherwise(F.col("vtx"))).where(F.col("k") < F.col("size"))
    before = Window.partitionBy(KEY, "ring").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    starts = arcs.select(KEY, "ring", "j", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_w"))
    whose = rings.select(KEY, "region", "ring", "hole").distinct()
    return (back.join(starts, [KEY, "ring", "j"]).join(whose, [KEY, "ring"])
            .select(KEY, "region", "ring", (F.col("_w") + F.col("k")).alias("vtx"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "hole"))
