"""From class rasters to polygons: regions, rings and simplified outlines.

Nothing here holds a whole region in one task. Regions are labelled inside
blocks of bounded size and joined across block borders by passing the smallest
label around; rings are chains of pixel sides whose order is found by pointer
doubling; outlines are simplified segment by segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import from_utm
from geoloom.session import cut_and_count, cut_lineage

KEY = "raster_id"
ROW = 1 << 31  # pixel number = r * ROW + c

# sides of a pixel in clockwise order (the pixel on the right hand): top, right, bottom, left
STEP = ((0, 1), (1, 0), (0, -1), (-1, 0))    # the pixel straight ahead along a side
OUT = ((-1, 0), (0, 1), (1, 0), (0, -1))     # the pixel across a side


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Label one block of pixels, given with a margin of one pixel."""
    r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
    r0, c0 = r.min() - 2, c.min() - 2
    grid = np.full((r.max() - r0 + 3, c.max() - c0 + 3), -1, dtype=np.int64)
    grid[r - r0, c - c0] = pdf["class_id"].to_numpy()
    own = np.zeros(grid.shape, dtype=bool)
    own[r - r0, c - c0] = pdf["own"].to_numpy()
    own &= grid >= 0
    pos = np.arange(grid.size).reshape(grid.shape)
    label = pos.ravel().copy()
    pairs = []
    for dr, dc in ((0, 1), (1, 0)):
        a, b = grid[:grid.shape[0] - dr, :grid.shape[1] - dc], grid[dr:, dc:]
        ok = (a == b) & own[:grid.shape[0] - dr, :grid.shape[1] - dc] & own[dr:, dc:]
        pairs.append((pos[:grid.shape[0] - dr, :grid.shape[1] - dc][ok], pos[dr:, dc:][ok]))
    u, v = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while u.size:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    rr, cc = np.nonzero(own)
    root = label[pos[rr, cc]]
    cls = grid[rr, cc]
    out = pd.DataFrame({
        KEY: pdf[KEY].iloc[0], "r": (rr + r0).astype(np.int32), "c": (cc + c0).astype(np.int32),
        "class_id": cls.astype(np.int32),
        "label": (root // grid.shape[1] + r0) * ROW + root % grid.shape[1] + c0,
    })
    same = [grid[rr + dr, cc + dc] == cls for dr, dc in OUT]
    # corners where three or four borders meet, by the pixel to their lower right
    around = (grid[:-1, :-1], grid[:-1, 1:], grid[1:, 1:], grid[1:, :-1])
    node = sum((a != b).astype(np.int32) for a, b in zip(around, around[1:] + around[:1])) > 2
    # turn at the end of each side: 0 no side, 1 right, 2 ahead, 3 left; 4 more if a node is there
    for side in range(4):
        nxt = (side + 1) % 4
        ahead_r, ahead_c = rr + STEP[side][0], cc + STEP[side][1]
        diag = grid[ahead_r + OUT[side][0], ahead_c + OUT[side][1]] == cls
        turn = np.where(~same[nxt], 1, np.where(diag, 3, 2))
        at_node = node[rr + (0, 1, 1, 0)[side] - 1, cc + (1, 1, 0, 0)[side] - 1]
        out[f"turn{side}"] = np.where(same[side], 0, turn + 4 * at_node).astype(np.int32)
    out["joins_right"] = same[1] & ~own[rr, cc + 1]
    out["joins_down"] = same[2] & ~own[rr + 1, cc]
    return out


_LABELLED = (f"{KEY} int, r int, c int, class_id int, label long, turn0 int, turn1 int, turn2 int, turn3 int, "
             "joins_right boolean, joins_down boolean")


def label_blocks(px: DataFrame, block: int = 256) -> DataFrame:
    """Regions inside blocks of ``block x block`` pixels, and the shape of each pixel's sides."""
    def spread(i: str) -> Column:
        return F.array_distinct(F.array(*[F.floor((F.col(i) + d) / block) for d in (-1, 0, 1)]))

    placed = (px.select(KEY, "r", "c", F.col("class_id").cast("int").alias("class_id"))
              .where(F.col("class_id") >= 0)
              .withColumn("br", F.explode(spread("r"))).withColumn("bc", F.explode(spread("c")))
              .withColumn("own", (F.floor(F.col("r") / block) == F.col("br"))
                          & (F.floor(F.col("c") / block) == F.col("bc"))))
    return placed.groupBy(KEY, "br", "bc").applyInPandas(_label_block, _LABELLED)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """Connected components of ``(raster_id, u, v)``: each node with the smallest node it reaches.

    In each round the nodes of one root pool the smallest root next to any of
    them and all move to it, then to the root of that root. Whole groups merge
    at once, so a long winding region takes few rounds. A round is written out
    before the next.
    """
    both = edges.select(KEY, "u", "v").unionByName(edges.select(KEY, F.col("v").alias("u"), F.col("u").alias("v")))
    both, some = cut_and_count(both.distinct(), F.lit(True))
    if not some:
        return both.select(KEY, F.col("u").alias("node"), F.col("v").alias("root"))
    roots = both.groupBy(KEY, F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root"))
    roots = cut_lineage(roots)
    while True:
        far = (both.join(roots.select(KEY, F.col("node").alias("v"), "root"), [KEY, "v"])
               .groupBy(KEY, F.col("u").alias("node")).agg(F.min("root").alias("_near")))
        # pooled per root; both steps combine before the shuffle
        pooled = (roots.join(far, [KEY, "node"]).groupBy(KEY, "root")
                  .agg(F.least(F.min("_near"), F.col("root")).alias("_pool")))
        low = (roots.join(pooled, [KEY, "root"])
               .select(KEY, "node", F.col("root").alias("_old"), F.col("_pool").alias("root")))
        up = low.select(KEY, F.col("node").alias("root"), F.col("root").alias("_up"))
        new, changed = cut_and_count(low.join(up, [KEY, "root"], "left").select(
            KEY, "node", "_old", F.coalesce("_up", "root").alias("root")), F.col("root") != F.col("_old"))
        roots = new.drop("_old")
        if not changed:
            return roots


def connected_regions(px: DataFrame, block: int = 256) -> DataFrame:
    """K14, first part. Pixels with the id of their 4-connected region of equal class."""
    labelled = cut_lineage(label_blocks(px, block))
    a = labelled.where("joins_right").select(KEY, F.col("label").alias("u"), "r", (F.col("c") + 1).alias("c"))
    b = labelled.where("joins_down").select(KEY, F.col("label").alias("u"), (F.col("r") + 1).alias("r"), "c")
    rim = labelled.where(((F.col("r") % block == 0) | (F.col("c") % block == 0)))
    links = (a.unionByName(b).join(rim.select(KEY, "r", "c", F.col("label").alias("v")), [KEY, "r", "c"])
             .select(KEY, "u", "v").distinct())
    roots = smallest_reachable(links)
    return (labelled.join(roots.withColumnRenamed("node", "label"), [KEY, "label"], "left")
            .withColumn("region", F.coalesce("root", "label")).drop("root", "label", "joins_right", "joins_down"))


def region_table(regions: DataFrame, gsd: float, min_px: int = 4) -> DataFrame:
    """K14, second part. Area and extent of each region of at least ``min_px`` pixels."""
    return (regions.groupBy(KEY, "region").agg(
                F.max("class_id").alias("class_id"), F.count(F.lit(1)).alias("pixel_count"),
                F.min("r").alias("r_min"), F.min("c").alias("c_min"), F.max("r").alias("r_max"), F.max("c").alias("c_max"))
            .where(F.col("pixel_count") >= min_px).withColumn("area_m2", F.col("pixel_count") * F.lit(gsd * gsd)))


def region_features(table: DataFrame, legend: DataFrame, num_classes: int) -> DataFrame:
    """K14. Regions of known classes with name, colour (grey where the legend has none) and rounded area."""
    from geoloom.operators.rasters import with_legend

    known = table.where((F.col("class_id") >= 0) & (F.col("class_id") < num_classes))
    return with_legend(known, legend).select(
        KEY, "region", "class_id", F.col("name").alias("class_name"), "color",
        F.round("area_m2", 1).alias("area_m2"), "pixel_count").orderBy(F.desc("area_m2"), KEY, "region")


def _block_paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sides of one block's pixels, chained as far as the block goes.

    Each side gets the first side of its chain and its place in it. A ring
    that closes inside the block is cut at its smallest side.
    """
    rows = []
    for side in range(4):
        t = pdf[pdf[f"turn{side}"] > 0]
        node, turn = t[f"turn{side}"].to_numpy() > 3, t[f"turn{side}"].to_numpy() & 3
        r, c = t["r"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64)
        dr = np.select([turn == 1, turn == 2], [0, STEP[side][0]], STEP[side][0] + OUT[side][0])
        dc = np.select([turn == 1, turn == 2], [0, STEP[side][1]], STEP[side][1] + OUT[side][1])
        ds = np.select([turn == 1, turn == 2], [1, 0], 3)
        rows.append(pd.DataFrame({
            KEY: t[KEY].to_numpy(), "region": t["region"].to_numpy(), "id": (r * ROW + c) * 4 + side,
            "next": ((r + dr) * ROW + c + dc) * 4 + (side + ds) % 4, "side": np.int32(side), "corner": turn != 2, "node": node,
            # the corner at the end of the side, clockwise
            "x": (c + (1, 1, 0, 0)[side]).astype(np.int32), "y": (r + (0, 1, 1, 0)[side]).astype(np.int32)}))
    out = pd.concat(rows).sort_values("id", ignore_index=True)
    ids, nxt = out["id"].to_numpy(), out["next"].to_numpy()
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, nxt), n - 1)
    inside = ids[at] == nxt
    prev = np.full(n, -1)
    prev[at[inside]] = np.nonzero(inside)[0]

    def back(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        jump, start, steps, low = prev.copy(), np.arange(n), np.zeros(n, dtype=np.int64), np.arange(n)
        for _ in range(n.bit_length() + 1):
            go = jump >= 0
            if not go.any():
                break
            k = jump[go]
            low[go] = np.minimum(low[go], low[k])
            # a start whose own chain has ended adds its steps and takes over
            steps[go] += steps[k] + 1
            start[go] = start[k]
            jump[go] = jump[k]
        return jump, start, steps, low

    jump, _, _, low = back(prev)
    ring = jump >= 0
    if ring.any():
        prev[np.unique(low[ring])] = -1
    _, start, steps, _ = back(prev)
    out["entry"], out["pos"] = ids[start], steps
    return out


_SIDES = (f"{KEY} int, region long, id long, next long, side int, corner boolean, node boolean, x int, y int, entry long, pos long")


def region_rings(regions: DataFrame, block: int = 256, nodes: bool = False) -> DataFrame:
    """K14, third part. Corner vertices of every region's rings, in order.

    The side that follows a side depends on three pixels only and is known from
    the labelling, so a ring is a linked list. Chains inside a block are made
    first, in memory. Chains then look twice as many chains ahead in each round
    and keep the smallest side seen and how far off it is; when nothing
    changes, that is the ring's first side, and the distance gives the position
    of every vertex. Rows: ``raster_id region ring vtx x y hole``; ``x`` and
    ``y`` count pixel corners. With ``nodes`` the corners where more than two
    borders meet are vertices even where the ring goes straight on, and ``node``
    and the ring's length ``n`` are given.
    """
    turns = [f"turn{s}" for s in range(4)]
    edge = regions.where(F.greatest(*turns) > 0).select(KEY, "region", "r", "c", *turns)
    sides = cut_lineage(edge.groupBy(KEY, F.floor(F.col("r") / block).alias("_br"), F.floor(F.col("c") / block).alias("_bc"))
                        .applyInPandas(_block_paths, _SIDES))
    # the sum of x over downward sides less that over upward ones is the area; holes are negative
    area = F.when(F.col("side") == 1, F.col("x")).when(F.col("side") == 3, -F.col("x")).otherwise(0)
    closed = F.col("ptr") == F.col("entry")
    chains, changed = cut_and_count(sides.groupBy(KEY, "entry").agg(
        F.count(F.lit(1)).alias("len"), F.min("id").alias("low"), F.min_by("pos", "id").alias("off"),
        F.max_by("next", "pos").alias("ptr"), F.sum(area).alias("area")), ~closed)
    # chains that leave their block; without any, the passes below have nothing to do
    walk = chains.where(~closed).select(KEY, "entry", "ptr", "low", "off", F.col("len").alias("span"))
    while changed:
        far = walk.select(KEY, F.col("entry").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"),
                          F.col("off").alias("_off"), F.col("span").alias("_span"))
        better = F.col("_low") < F.col("low")
        new, changed = cut_and_count(walk.join(far, [KEY, "ptr"]).select(
            KEY, "entry", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"),
            F.when(better, F.col("_off") + F.col("span")).otherwise(F.col("off")).alias("off"),
            (F.col("span") + F.col("_span")).alias("span"), better.alias("_new")), F.col("_new"))
        walk = new.drop("_new")
    heads = (chains.where(closed).select(KEY, "entry", "low", "off").unionByName(walk.select(KEY, "entry", "low", "off")))
    whole = (chains.select(KEY, "entry", "len", "area").join(heads, [KEY, "entry"]).groupBy(KEY, F.col("low").alias("ring"))
             .agg(F.sum("len").alias("n"), (F.sum("area") < 0).alias("hole")))
    placed = heads.withColumnRenamed("low", "ring").join(whole, [KEY, "ring"])
    return (sides.where("corner OR node" if nodes else "corner").select(KEY, "region", "entry", "pos", "x", "y", "node").join(placed, [KEY, "entry"])
            .select(KEY, "region", "ring", F.pmod(F.col("pos") - F.col("off"), F.col("n")).alias("vtx"), "x", "y", "hole", *(["node", "n"] if nodes else [])))


def close_rings(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Renumber vertices without gaps and repeat the first one at the end."""
    from geoloom.operators.scale import running

    dense = running(rings.withColumn("_b", F.floor(F.col("vtx") / 65536)), keys, "_b", [F.asc("vtx")],
                    "sum", {"_pos": F.lit(1)}).withColumn("vtx", (F.col("_pos") - 1).cast("int")).drop("_pos", "_b")
    size = dense.groupBy(*keys).agg((F.max("vtx") + 1).alias("_n"))
    last = dense.where(F.col("vtx") == 0).join(size, keys).withColumn("vtx", F.col("_n")).drop("_n")
    return dense.unionByName(last)


def _gap(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return F.hypot(px - ax - along * dx, py - ay - along * dy)


def peucker(lines: DataFrame) -> DataFrame:
    """The vertices ``line vtx`` of ``lines`` (``line vtx x y lon lat tol``, written) that Douglas-Peucker keeps, ends included.

    All segments of all lines are split in the same round, a round per depth of
    the recursion, and the farthest vertex of a segment is combined before the
    shuffle, so a line of any length is never in one task. Distances are those
    of ``lon lat``; of equal ones the lower number counts.
    """
    own = lines.select("line", "vtx", "lon", "lat", "tol")
    end = F.struct("vtx", "lon", "lat")
    ends = own.groupBy("line").agg(F.min_by(end, "vtx").alias("a"), F.max_by(end, "vtx").alias("b"))
    todo = own.join(ends, "line")
    kept = todo.where((F.col("vtx") == F.col("a.vtx")) | (F.col("vtx") == F.col("b.vtx"))).select("line", "vtx")
    todo, left_over = cut_and_count(todo.where((F.col("vtx") > F.col("a.vtx")) & (F.col("vtx") < F.col("b.vtx"))), F.lit(True))
    vertex = [F.col(c) for c in ("lon", "lat", "a.lon", "a.lat", "b.lon", "b.lat")]
    while left_over:
        farthest = F.max_by(end, F.struct("_d", -F.col("vtx")))
        far = cut_lineage(todo.withColumn("_d", _gap(*vertex)).where(F.col("_d") > F.col("tol")).groupBy("line", "a", "b").agg(farthest.alias("m")))
        kept = kept.unionByName(far.select("line", "m.vtx"))
        left = F.col("vtx") < F.col("m.vtx")
        todo, left_over = cut_and_count(
            todo.join(far, ["line", "a", "b"]).where(F.col("vtx") != F.col("m.vtx"))
            .select("line", "vtx", "lon", "lat", "tol", F.when(left, F.col("a")).otherwise(F.col("m")).alias("a"),
                    F.when(left, F.col("m")).otherwise(F.col("b")).alias("b")), F.lit(True))
    return cut_lineage(kept)


def simplify(rings: DataFrame, tol: float, keep_topology: bool = True) -> DataFrame:
    """K15. Douglas-Peucker per polygon; a tolerance of 0 changes nothing.

    A ring that would be left with fewer than four vertices keeps its ends, the
    vertex farthest from them and the one farthest from the line between: the
    smallest ring there is. With ``keep_topology`` vertices are put back where
    a ring would cross or touch itself. Polygons that share borders are
    simplified together by ``arcs.simplify_regions``.
    """
    from geoloom.operators.arcs import untangled

    if tol <= 0:
        return rings.select("poly_id", "vtx", "lon", "lat")
    rings = cut_lineage(rings.select("poly_id", "vtx", "lon", "lat"))
    lines = rings.select(F.col("poly_id").alias("line"), "vtx", F.col("lon").alias("x"), F.col("lat").alias("y"), "lon", "lat", F.lit(float(tol)).alias("tol"))
    kept = rings.join(peucker(lines).withColumnRenamed("line", "poly_id"), ["poly_id", "vtx"])
    end = F.struct("vtx", "lon", "lat")
    ends = rings.groupBy("poly_id").agg(F.min_by(end, "vtx").alias("a"), F.max_by(end, "vtx").alias("b"))
    few = kept.groupBy("poly_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < 4).select("poly_id")
    inner = rings.join(few, "poly_id", "left_semi").join(ends, "poly_id").where((F.col("vtx") > F.col("a.vtx")) & (F.col("vtx") < F.col("b.vtx")))
    tip = inner.withColumn("_d", F.hypot(F.col("lon") - F.col("a.lon"), F.col("lat") - F.col("a.lat"))).groupBy("poly_id").agg(
        F.max_by(end, F.struct("_d", -F.col("vtx"))).alias("m"))
    aside = _gap(F.col("lon"), F.col("lat"), F.col("a.lon"), F.col("a.lat"), F.col("m.lon"), F.col("m.lat"))
    side = inner.join(tip, "poly_id").where(F.col("vtx") != F.col("m.vtx")).withColumn("_d", aside).groupBy("poly_id").agg(
        F.max_by(end, F.struct("_d", -F.col("vtx"))).alias("m"))
    more = tip.unionByName(side).select("poly_id", "m.vtx", "m.lon", "m.lat")
    kept = kept.unionByName(more.select(kept.columns)).distinct()
    if not keep_topology:
        return kept.select("poly_id", "vtx", "lon", "lat")
    plain = untangled(lines.withColumn("grp", F.col("line")).withColumn("cell", F.lit(32.0 * tol)), kept.select(F.col("poly_id").alias("line"), "vtx"))
    return rings.join(plain.withColumnRenamed("line", "poly_id"), ["poly_id", "vtx"]).select("poly_id", "vtx", "lon", "lat")


def _outlines(regions: DataFrame, table: DataFrame, scale: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Closed rings ``poly_id vtx x y`` of the listed regions, and which region and ring each is.

    ``scale``: ``raster_id sx sy tol``: a pixel's sides and the tolerance in their unit; borders are simplified where it is above 0.
    """
    from geoloom.operators.arcs import simplify_regions

    listed = table.select(KEY, "region")
    # read several times below
    if scale is None:
        rings = cut_lineage(region_rings(regions, block).join(listed, [KEY, "region"], "left_semi"))
    else:
        rings = simplify_regions(cut_lineage(region_rings(regions, block, True).join(listed, [KEY, "region"], "left_semi")), scale)
    rings = rings.withColumn("poly_id", F.concat_ws(":", KEY, "ring"))
    named = rings.select("poly_id", KEY, "region", "ring", "hole").distinct()
    closed = close_rings(rings.select("poly_id", "vtx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), ["poly_id"])
    return closed, named


def outline(regions: DataFrame, table: DataFrame, gsd: float, tol: float = 0.0, block: int = 256) -> DataFrame:
    """K14. Outlines in metres of the listed regions; with a tolerance their borders are simplified, shared ones as one."""
    each = table.select(KEY, *[F.lit(float(v)).alias(c) for c, v in (("sx", gsd), ("sy", gsd), ("tol", tol))]).distinct()
    closed, named = _outlines(regions, table, each if tol > 0 else None, block)
    shape = closed.select("poly_id", "vtx", (F.col("x") * gsd).alias("lon"), (-F.col("y") * gsd).alias("lat"))
    return shape.join(named, "poly_id")


def region_polygons(regions: DataFrame, table: DataFrame, geo: DataFrame, tol: Column | float = 0.0, block: int = 256) -> DataFrame:
    """K14. Vertices in longitude and latitude of every ring of the listed regions, outer rings and holes.

    ``geo``: ``raster_id x0 y0 dx dy zone south``: the corner of the raster, the
    pixel size, and the UTM zone its coordinates are in, null for degrees.
    Borders are simplified in the raster's own coordinates, by ``tol`` of their
    unit, which may be an expression of ``geo``'s columns, and then brought to
    WGS84. Neighbours share their borders exactly, and no ring crosses itself, its
    holes or another. Rows: ``raster_id region ring hole vtx lon lat``.
    """
    plain = not isinstance(tol, Column) and tol <= 0
    limit = tol if isinstance(tol, Column) else F.lit(float(tol))
    scale = None if plain else geo.select(KEY, F.abs(F.col("dx").cast("double")).alias("sx"), F.abs(F.col("dy").cast("double")).alias("sy"), limit.cast("double").alias("tol"))
    closed, named = _outlines(regions, table, scale, block)
    placed = closed.join(named, "poly_id").join(geo, KEY)
    plane = placed.withColumn("lon", F.col("x0") + F.col("x") * F.col("dx")).withColumn("lat", F.col("y0") - F.col("y") * F.col("dy"))
    there = F.when(F.col("zone").isNotNull(), from_utm("lon", "lat", "zone", "south")).otherwise(F.struct("lon", "lat"))
    return plane.withColumn("_g", there).select(KEY, "region", "ring", "hole", "vtx", F.col("_g.lon").alias("lon"), F.col("_g.lat").alias("lat"))


def polygon_features(polygons: DataFrame, features: DataFrame) -> DataFrame:
    """K14. ``features`` (by ``raster_id region``) with ``geometry_type coordinates``, as A15 writes them: the outer ring, then the holes.

    A feature is one row of its file, so its vertices come together here, and
    only here.
    """
    # GeoJSON wants outer rings counter-clockwise; these run clockwise, with holes the other way round
    rings = polygons.groupBy(KEY, "region", "ring", "hole").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("vtx")).alias("v"), F.array("lon", "lat").alias("p")))).alias("_v"))
    shapes = rings.groupBy(KEY, "region").agg(F.array_sort(F.collect_list(F.struct(
        "hole", "ring", F.transform("_v", lambda v: v["p"]).alias("p")))).alias("_r"))
    return features.join(shapes.select(KEY, "region", F.lit("Polygon").alias("geometry_type"), F.transform("_r", lambda r: r["p"]).alias("coordinates")), [KEY, "region"])


def labelled_polygons(pixels: DataFrame, geo: DataFrame, gsd: float, min_px: int = 50, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """K9. Features of labelled pixels (``raster_id r c cluster class_id class_name color confidence``) and their rings.

    Regions are those of equal cluster; borders are simplified by half a pixel of their own raster.
    """
    from geoloom.operators.labels import segment_features

    regions = cut_lineage(connected_regions(pixels.select(KEY, "r", "c", F.col("cluster").alias("class_id")), block))
    table = cut_lineage(segment_features(pixels, regions, gsd, min_px))
    legend = pixels.groupBy(KEY, "cluster").agg(F.max("class_id").alias("class_id"), F.max("color").alias("color"))
    return table.join(legend, [KEY, "cluster"]), region_polygons(regions, table, geo, F.abs(F.col("dx")) / 2, block)
