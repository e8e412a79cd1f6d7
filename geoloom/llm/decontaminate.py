"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are runs of test words, written as `` w1 w2 ... `` in lower case, and
texts are written alike, so a pattern occurs only at word bounds. Patterns of
like lengths share a shift table over blocks of bytes: it tells how far a
window can move on without missing a pattern. Where it says nought, the block
at the window's end and the first bytes pick the test strings, and a direct
comparison confirms. Many windows move through a batch of texts at once, as
numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, keep, octets, small_batches

# Bytes of words stay, A-Z become a-z, other ASCII becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW = 10
#: Patterns of at least so many bytes, up to the next entry, share a table; the second number is the bytes of a block.
CLASSES = ((64, 8), (32, 8), (16, 8), (8, 5), (4, 3), (3, 3))
TABLE_BITS = 22
#: Bytes of test text that are searched for at once and broadcast, as windows about a hundred times as much. More text takes more passes.
PASS_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def spaced(text: bytes | None) -> bytes:
    """`` w1 w2 ... `` of a text; empty without words."""
    words = (text or b"").translate(WORDS).split()
    return b" %b " % b" ".join(words) if words else b""


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    """Every run of ``size`` words, or the whole of fewer."""
    words = (text or b"").translate(WORDS).split()
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _eight(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each position, as a number. ``buf`` has 8 spare bytes."""
    view = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    return view[at] & np.uint64((1 << 8 * width) - 1)


class _Class:
    """Shift table and suffix buckets of patterns of like lengths."""

    def __init__(self, patterns: list[tuple[int, bytes]], length: int, block: int):
        self.m, self.block = length, block
        buf = np.frombuffer(b"".join(p for _, p in patterns) + bytes(8), np.uint8)
        start = np.concatenate(([0], np.cumsum([len(p) for _, p in patterns])[:-1])).astype(np.int64)
        far = length - block + 1
        self.shift = np.full(1 << TABLE_BITS, far, np.uint8)
        for j in range(far):  # smaller shifts come later and stay
            self.shift[self.slot(_eight(buf, start + j, block))] = far - 1 - j
        key = self.key(buf, start)
        order = np.argsort(key, kind="stable")
        self.keys, self.order = key[order], order

    @staticmethod
    def slot(block: np.ndarray) -> np.ndarray:
        return ((block * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def key(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bucket of a window: its last block and its first bytes."""
        return _eight(buf, at + self.m - self.block, self.block) * MIX ^ _eight(buf, at, min(8, self.m))

    def candidates(self, buf: np.ndarray, n: int, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Window starts in the first ``n`` bytes and the patterns (by place in the class) to compare there."""
        last = n - self.m
        if last < 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(0, last + 1, lane, dtype=np.int64)
        end = np.minimum(at + lane, last + 1)
        stops = []
        while len(at):
            step = self.shift[self.slot(_eight(buf, at + (self.m - self.block), self.block))]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        at = np.concatenate(stops)
        key = self.key(buf, at)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        some = hi > lo
        at, lo, size = at[some], lo[some], (hi - lo)[some]
        first = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else lo
        return np.repeat(at, size), self.order[first + np.arange(size.sum())]


class Search:
    """Finds the windows of test items, ``(id, text)``, in texts."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], size: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(name)
        self.owners = [(p, p.count(b" ") - 1, tuple(sorted(o))) for p, o in sorted(owners.items())]
        self.classes = None

    def _build(self) -> None:
        by: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for i, (p, _, _) in enumerate(self.owners):
            by.setdefault(next(c for c in CLASSES if len(p) >= c[0]), []).append((i, p))
        self.classes = [(_Class(ps, *c), [i for i, _ in ps]) for c, ps in sorted(by.items())]

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, int, bytes | None, list[str]]]:
        """Of each text: words, words inside occurrences, these as packed bits (null if none), items found."""
        if self.classes is None:
            self._build()
        docs = [spaced(t) for t in texts]
        whole = b"".join(docs)
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        buf = np.frombuffer(whole + bytes(8), np.uint8)
        n_words = [max(0, d.count(b" ") - 1) for d in docs]
        found: list[tuple[int, int]] = []
        for table, ids in self.classes:
            for at, k in zip(*(x.tolist() for x in table.candidates(buf, len(whole)))):
                if whole.startswith(self.owners[ids[k]][0], at):
                    found.append((at, ids[k]))
        out: list = [(n, 0, None, []) for n in n_words]
        of = np.searchsorted(bounds, [at for at, _ in found], "right") - 1
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for d, f in zip(of.tolist(), found):
            by_doc.setdefault(d, []).append(f)
        for d, hits in by_doc.items():
            gaps = np.flatnonzero(buf[bounds[d] : bounds[d + 1]] == 32)
            first = np.searchsorted(gaps, [at - bounds[d] for at, _ in hits])
            edge = np.zeros(n_words[d] + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + [self.owners[p][1] for _, p in hits], -1)
            inside = np.cumsum(edge[:-1]) > 0
            out[d] = (n_words[d], int(inside.sum()), np.packbits(inside).tobytes(), sorted({o for p in {p for _, p in hits} for o in self.owners[p][2]}))
        return out


def _passes(start: DataFrame, step: Callable[[DataFrame, Broadcast], DataFrame], items: DataFrame, id_col: str, text_col: str, size: int, pass_bytes: int) -> DataFrame:
    """``start`` after a ``step`` with each of the broadcast searches that cover ``items`` together.

    A search is built from about ``pass_bytes`` of text. All but the last write
    their step's result and are gone before the next is built, so driver and
    executors hold one at a time.
    """
    spark = items.sparkSession
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), octets(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t") + 100)).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(passes)))
    now = start
    for p in range(passes):
        search = spark.sparkContext.broadcast(Search(((r.i, bytes(r.t)) for r in dealt.where(F.col("p") == p).toLocalIterator()), size))
        now = step(now, search)
        if p < passes - 1:
            now = keep(now)
            search.destroy()
    return now


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``doc_id n_words n_hit item_ids`` of every row: its words, those inside an occurrence, the items that occur.

    Null and empty texts have no words and no hits. Items without words are
    never found; a null item id reads ``null``; repeated item ids count once.
    Very long texts are searched whole. Only the two named columns are read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), octets(text_col).alias("t"), F.lit(None).cast("binary").alias("bits"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<string>").alias("item_ids"))
    kind = found.schema

    def step(found: DataFrame, search: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, 1):
                rows = search.value.scan(b.column(1).to_pylist())
                before = zip(b.column(2).to_pylist(), b.column(4).to_pylist())
                both = [(_either(x, r[2]), sorted({*(i or ()), *r[3]})) for (x, i), r in zip(before, rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in both], pa.binary()), pa.array([r[0] for r in rows], pa.int64()), pa.array([i for _, i in both], pa.list_(pa.string()))], ["doc_id", "t", "bits", "n_words", "item_ids"])

        return found.mapInArrow(run, kind)

    found = _passes(found, step, items, item_id, item_text, size, pass_bytes)
    hex_bits = F.hex("bits")
    n_hit = sum((F.length(F.regexp_replace(hex_bits, f"[^{digits}]", "")) * k for k, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F"))), F.lit(0))
    return found.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), "item_ids")


def _either(a: bytes | None, b: bytes | None) -> bytes | None:
    if a is None or b is None:
        return b if a is None else a
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, unchanged. No shuffle."""
    (text,) = fresh(docs, "t")
    at = len(docs.columns)

    def step(left: DataFrame, search: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, at):
                yield b.filter(pa.array([not r[1] for r in search.value.scan(b.column(at).to_pylist())], pa.bool_()))

        rows = left.withColumn(text, octets(text_col))
        return rows.mapInArrow(run, rows.schema).drop(text)

    return _passes(docs, step, items, item_id, item_text, size, pass_bytes)
