"""Exact top-k by inner product: best-first search of M-trees.

An inner product is no distance, so vectors get one more coordinate, which
makes all of them equally long: ``sqrt(M^2 - |x|^2)`` with M the longest length,
and nought for a query. Then the nearest in Euclidean distance have the highest
products.

A tree holds some thousand vectors in pages. An entry of an inner page has a
pivot, a covering radius and its distance to the pivot of the page above; a
leaf's entry has the latter. A search keeps a queue of pages by the least
distance that any of their vectors can have, and with the distance from the query
to the parent's pivot it rules out entries by the triangle inequality before
their own distance is computed. Bounds are widened by a margin for rounding;
the scores themselves are sums of whole numbers.

The rows' partitions become a forest, written once. Blocks of queries meet all
trees, and each task hands on the best k of a query over its trees.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import keep

SCALE = 1024
PAGE = 128  # entries of a page
TREE = 8192  # vectors of a tree
QUERY_BLOCK = 4096
LIMIT = 2**63 - 1
NO_ID = LIMIT  # stands for a null id, so that it comes after all others


class Tree:
    """Pages over the rows of ``plain`` (whole numbers as float64), scaled and with the added coordinate."""

    def __init__(self, ids: list, plain: np.ndarray):
        self.names = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.plain = plain
        self.scale = max(1.0, float(np.abs(plain).max(initial=0)))
        self._extend()
        # inner: pivots, radii, distances to the parent's pivot, child pages; leaf: rows, distances to the parent's pivot
        self.pages: list[tuple] = []
        self.root = self._page(np.arange(len(plain)), None)

    def _extend(self) -> None:
        x = self.plain / self.scale
        squares = (x**2).sum(1)
        self.top = float(squares.max(initial=0))
        self.x = np.column_stack((x, np.sqrt(np.maximum(self.top - squares, 0))))

    def state(self) -> tuple:
        """What is written of a tree; ``of`` makes a tree of it again."""
        return self.names, self.plain, self.scale, self.pages, self.root

    @classmethod
    def of(cls, state: tuple) -> Tree:
        self = cls.__new__(cls)
        self.names, self.plain, self.scale, self.pages, self.root = state
        self._extend()
        return self

    def ask(self, q: np.ndarray, best: _Best) -> None:
        """Improves a query's best by what this tree holds."""
        width = self.plain.shape[1]
        q = np.append(q[:width], np.zeros(max(0, width - len(q))))  # components beyond meet noughts
        y = np.append(q / self.scale, 0.0)
        whole = float(y @ y) + self.top
        margin = 1e-6 * (1 + np.sqrt(whole))
        small = _small(self.scale, q)

        def worst() -> float:
            return float(np.sqrt(max(0.0, whole - 2 * float(best.scores[-1]) / self.scale / self.scale))) if best.full else np.inf

        def offer(rows: np.ndarray) -> float:
            best.add(_products(self.plain[rows], q, small), self.names[rows])
            return worst()

        self.search(y, margin, worst(), offer)

    def _far(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[rows] - pivot) ** 2).sum(1))

    def _page(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        zero = np.zeros(len(rows))
        if len(rows) <= PAGE:
            self.pages.append((True, rows, zero if parent is None else self._far(rows, parent)))
            return len(self.pages) - 1
        pivots = [self.x[rows[0]]]
        least = self._far(rows, pivots[0])
        for _ in range(min(PAGE, -(-2 * len(rows) // PAGE)) - 1):  # each next pivot is the row farthest from those before
            k = int(least.argmax())
            if least[k] == 0:
                break
            pivots.append(self.x[rows[k]])
            least = np.minimum(least, self._far(rows, pivots[-1]))
        p = np.array(pivots)
        nearest = np.argmin((p**2).sum(1) - 2 * self.x[rows] @ p.T, axis=1)
        groups = [rows[nearest == i] for i in range(len(p))]
        if max(map(len, groups)) > 0.9 * len(rows):  # hardly divided, as with many equal rows: cut by place
            groups = np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))
            p = np.array([self.x[g[0]] for g in groups])
        some = [i for i, g in enumerate(groups) if len(g)]
        groups, p = [groups[i] for i in some], p[some]
        radii = np.array([self._far(g, q).max() for g, q in zip(groups, p)])
        up = np.zeros(len(p)) if parent is None else np.sqrt(((p - parent) ** 2).sum(1))
        own = len(self.pages)
        self.pages.append(())
        self.pages[own] = (False, p, radii, up, [self._page(g, q) for g, q in zip(groups, p)])
        return own

    def search(self, q: np.ndarray, margin: float, worst: float, offer) -> None:
        """Offers ``(rows)`` that can be nearer than the worst of the best; ``offer`` gives the new worst."""
        queue, order = [(0.0, 0, self.root, None)], 0
        while queue:
            least, _, page, above = heapq.heappop(queue)
            if least > worst + margin:
                return
            if self.pages[page][0]:
                _, rows, up = self.pages[page]
                if above is not None:
                    rows = rows[np.abs(above - up) <= worst + margin]
                if len(rows):
                    worst = offer(rows)
                continue
            _, p, radii, up, children = self.pages[page]
            some = np.arange(len(p)) if above is None else np.flatnonzero(np.abs(above - up) - radii <= worst + margin)
            d = np.sqrt(np.maximum(((p[some] - q) ** 2).sum(1), 0))
            for i, far, least in zip(some.tolist(), d.tolist(), np.maximum(d - radii[some], 0).tolist()):
                if least <= worst + margin:
                    order += 1
                    heapq.heappush(queue, (least, order, children[i], far))


def _aligned(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """As rows of equal width; a shorter vector ends in noughts."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _small(largest: float, q: np.ndarray) -> bool:
    return largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**53


def _products(x: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Whole-number inner products; ``small`` if float64 holds all sums, else as Python's numbers, cut to the range of a long."""
    if small:
        return (x @ q).astype(np.int64)
    return np.array([max(-LIMIT - 1, min(LIMIT, sum(int(a) * int(b) for a, b in zip(r, q)))) for r in x], np.int64)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id v digest``: floor(1024 x) of each component, as packed doubles. Vectors that are null or hold null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for v in b.column(1).to_pylist():
                a = None if v is None or any(x is None for x in v) else np.array(v, np.float64)
                packed.append(None if a is None or not np.isfinite(a).all() else np.clip(np.floor(a * SCALE), -1e150, 1e150).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["vec_id", "v"]).filter(pa.array([p is not None for p in packed], pa.bool_()))

    whole = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, v binary")
    return whole.withColumn("digest", F.xxhash64("v"))


def _blocks(rows: DataFrame, size: int, pack) -> DataFrame:
    """``block``: ``pack`` of the (id, vector, digest) of up to ``size`` rows of a partition each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if held:
            yield out(held)

    def out(some: list[tuple]) -> pa.RecordBatch:
        ids, vectors, digests = zip(*some)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pack(ids, [np.frombuffer(v, "<f8") for v in vectors], digests))], pa.binary())], ["block"])

    return rows.select("vec_id", "v", "digest").mapInArrow(run, "block binary")


class _Best:
    """A query's best so far: scores and ids, and the added distance that the last of them has."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.full = k, np.empty(0, np.int64), np.empty(0, np.int64), False

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.full:
            some = scores >= self.scores[-1]
            if not some.any():
                return
            scores, ids = scores[some], ids[some]
        if len(scores) > 4 * self.k:  # all that tie with the k-th stay
            some = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[some], ids[some]
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores.astype(object) if (scores == -LIMIT - 1).any() else -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        self.full = len(self.ids) == self.k


def search(vectors: DataFrame, queries: DataFrame, k: int, tree: int = TREE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id digest self score vec_id``: for each row of ``queries`` the ``k`` best among all rows of ``vectors``, itself included.

    Both are ``vec_id v digest`` as ``whole_vectors`` gives them; rows come
    several times, from different trees, and the best ``k`` of them count.
    ``self`` is the query's product with itself. Queries that are equal in id and vector are to be given once.
    """
    trees = keep(_blocks(vectors, tree, lambda ids, v, _: Tree(ids, _aligned(v, max(map(len, v)))).state()))
    asked = keep(_blocks(queries, query_block, lambda *x: x))
    (n_trees,), (n_blocks,) = trees.agg(F.count(F.lit(1))).first(), asked.agg(F.count(F.lit(1))).first()
    # A task gets some trees and some queries: both meet by (group of queries, share of the trees).
    shares = max(1, min(n_trees, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(max(1, n))).cast("int")
    left = asked.select(part(n_blocks).alias("queries"), each(shares).alias("share"), F.lit(0).alias("kind"), "block")
    right = trees.select(each(n_blocks).alias("queries"), part(shares).alias("share"), F.lit(1).alias("kind"), "block")
    dealt = left.union(right).repartition(max(1, shares * n_blocks), "queries", "share").sortWithinPartitions("queries", "share", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(asked), 512):
                rows = [(a, d, _self(v), int(s), None if i == NO_ID else int(i)) for a, v, d, b in asked[at : at + 512] for s, i in zip(b.scores, b.ids)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "digest", "self", "score", "vec_id"])

        for b in batches:
            for r in range(b.num_rows):
                key, kind = (b.column(0)[r].as_py(), b.column(1)[r].as_py()), b.column(2)[r].as_py()
                if key != now:
                    yield from out()
                    now, asked = key, []
                block = pickle.loads(b.column(3)[r].as_py())
                if kind == 0:
                    asked += [(*x, _Best(k)) for x in zip(*block)]
                    continue
                tree = Tree.of(block)
                for _, v, _, best in asked:
                    tree.ask(v, best)
        yield from out()

    return dealt.mapInArrow(run, "query_id long, digest long, self long, score long, vec_id long")


def _self(v: np.ndarray) -> int:
    return int(_products(v[None, :], v, _small(float(np.abs(v).max(initial=0)), v))[0])


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """``query_id rank vec_id score``: the ``k`` highest products of each row whose id ``every`` divides, itself left out.

    Ties go to the smaller id, a null id last. Of equal rows each is asked and each is found, but not itself.
    Vectors of different lengths are filled up with noughts; an empty vector
    scores 0. Scores beyond a long are cut to its range.
    """
    whole = keep(whole_vectors(vectors, id_col, vector_col))
    asked = whole.where(F.col("vec_id") % every == 0)
    found = search(whole, asked.dropDuplicates(["vec_id", "digest"]), k + 1, **how)
    query = Window.partitionBy("query_id", "digest")
    best = found.withColumn("n", F.row_number().over(query.orderBy(F.col("score").desc(), F.col("vec_id").isNull(), "vec_id"))).where(F.col("n") <= k + 1)
    own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self")), F.lit(False))
    best = best.withColumn("own_at", F.min(F.when(own, F.col("n"))).over(query)).where("n <> coalesce(own_at, -1)")
    ranked = best.withColumn("rank", F.row_number().over(query.orderBy("n"))).where(F.col("rank") <= k)
    times = asked.groupBy(F.col("vec_id").alias("query_id"), "digest").agg(F.count(F.lit(1)).alias("times"))
    each = ranked.join(times, ["query_id", "digest"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
