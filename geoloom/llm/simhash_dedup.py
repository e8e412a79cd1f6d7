"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has a bit for each of 64 majority votes among the XXH64 values
of the text's word shingles. Two fingerprints link if they differ in at most
three bits, and a document's component is all it can reach over links.

Half of radius three is one and a half, so one of the three differing bits is
hidden: the bits fall into three blocks, each block is left out in turn, and
the fingerprint sends every variant of the other bits within distance one.
Any linked pair meets in one variant at least (see ``_links``), and a variant is
42 or 43 bits, so chance meetings stay rare with tens of billions of texts.
Equal fingerprints are merged before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import near_copies
from geoloom.llm.common import connected, fresh, keep, octets, record_batch, small_batches

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z become a-z, other bytes stay
# (first bit, width) of the blocks left out in turn
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 majority bits over the shingles' hashes; 0 without words, the whole sequence if words are few."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = slice(at, at + (1 << 15))
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[part], ends[part])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id fp text_hash`` of every row; ``text_hash`` tells rows that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2):
            fps = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(1)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), octets(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _turn(x, by: int):
    """Rotate right, of a column or of an array of uint64."""
    if by == 0:
        return x
    if isinstance(x, np.ndarray):
        return (x >> np.uint64(by)) | (x << np.uint64(64 - by))
    return F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, 64 - by))


def variants(classes: DataFrame) -> DataFrame:
    """``key fp``: 132 keys per fingerprint. A key is the turned fingerprint with the left-out block's number in its place."""


    def ball(k: int, first: int, width: int):
        centre = _turn(F.col("fp"), first).bitwiseAND(F.lit(-1 << width)).bitwiseOR(F.lit(k))
        flips = [0, *(1 << i for i in range(width, 63)), -(1 << 63)]
        return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda flip: centre.bitwiseXOR(flip))

    balls = F.concat(*[ball(k, *block) for k, block in enumerate(BLOCKS)])
    return classes.select(F.explode(balls).alias("key"), "fp")


def _links(key: int, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints that met in one variant, enough to join all that link.

    Outside the block any two differ in at most two bits. So equal blocks link,
    and so do blocks one bit apart; by these, pairs that differ in two bits or in
    three bits of more than one block are found, the latter where the block with
    exactly one is left out. Three bits of one block remain: there both sides
    send their unchanged rest. Work is linear in the number of fingerprints: a
    partner is looked up, not paired.
    """
    k = key & 3
    first, width = BLOCKS[k]
    turned = _turn(fps, first)
    low = np.uint64((1 << width) - 1)
    inner = turned & low
    order = np.argsort(inner, kind="stable")
    fps, inner, whole = fps[order], inner[order], (turned[order] & ~low) == (np.uint64(key & (2**64 - 1)) & ~low)
    values, at = np.unique(inner, return_index=True)
    heads = fps[at]
    out = [(np.repeat(heads, np.diff(np.append(at, len(fps)))), fps)]
    own, own_fps = inner[whole], fps[whole]
    for vals, reps, bits in ((values, heads, 1), (own, own_fps, 3)):
        if len(vals) < 2:
            continue
        if len(vals) <= 64:
            i, j = np.nonzero(np.triu(np.bitwise_count(vals[:, None] ^ vals[None, :]) == bits))
            out.append((reps[i], reps[j]))
            continue
        for ones in combinations(range(width), bits):
            want = vals ^ np.uint64(sum(1 << o for o in ones))
            pos = np.minimum(np.searchsorted(vals, want), len(vals) - 1)
            hit = (vals[pos] == want) & (vals < want)
            out.append((reps[hit], reps[pos[hit]]))
    return out


def links(classes: DataFrame) -> DataFrame:
    """``a b``: links between different fingerprints (``fp``, each once) that join the same components as all links.

    A partition is sorted by variant in the JVM, which spills, and read as a
    stream; what is held is one batch and one variant's fingerprints. They are
    different and agree in 42 bits but one, so at most 43 * 2^22, and far fewer in
    any corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def work(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(keys)) + 1
            start, size = np.append(0, cut), np.diff(np.concatenate(([0], cut, [len(keys)])))
            two = start[size == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= 3
            found = [(fps[two][near], fps[two + 1][near])]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                found += _links(int(keys[s]), fps[s : s + n])
            a, b = (np.concatenate(x) for x in zip(*found))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            if len(pairs):
                yield record_batch(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [pairs[:, 0].view("i8"), pairs[:, 1].view("i8")])

        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view("u8")
            if not len(keys):
                continue
            held.append((keys, fps))
            if held[0][0][0] == keys[-1]:
                continue  # the same variant goes on
            keys, fps = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(keys, keys[-1]))
            yield from work(keys[:last], fps[:last])
            held = [(keys[last:], fps[last:])]
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held)))

    dealt = variants(classes).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(fps: DataFrame) -> DataFrame:
    """``fps`` (``doc_id fp ...``, written) with ``component_id``, the smallest doc_id that can be reached.

    Repeated rows and ids share a fingerprint class. A component whose ids are
    all null has a null id. No rows give no rows.
    """
    classes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = keep(connected(links(classes)).join(classes.withColumnRenamed("fp", "node"), "node"))
    root = nodes.groupBy("root").agg(F.min("least").alias("linked"))
    joined = nodes.join(root, "root").select(F.col("node").alias("fp"), "linked")
    label = classes.join(joined, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    return fps.join(label, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id fingerprint component_id`` of every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Very
    long texts are hashed whole, in parts. Other columns play no part.
    """
    found = components(keep(fingerprints(docs, id_col, text_col, shingle)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wider_components(docs: DataFrame, fps: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """``fps`` (written) with ``component_id``, a fingerprint: links of three bits, and of near copies by five-word shingles."""
    classes = keep(fps.select("fp").distinct())
    linked = connected(links(classes)).toDF("fp", "linked")
    root = keep(classes.join(linked, "fp", "left").select("fp", F.coalesce("linked", "fp").alias("root")))
    of_text = keep(fps.join(root, "fp").select("text_hash", "root").distinct())
    wider = near_copies.merged(docs, of_text, text_col, least=similarity)
    return fps.join(root.join(wider, "root").select("fp", F.col("merged").alias("component_id")), "fp")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest (doc_id, text hash); nulls come last, one of repeated rows stays.

    With ``similarity``, texts whose five-word shingles are so alike link as
    well, however many bits of their fingerprints differ. A component's choice
    is made among its ids only, and the texts are joined once, by id and text hash.
    """
    fps = keep(fingerprints(docs, id_col, text_col, shingle))
    found = components(fps) if similarity is None else wider_components(docs, fps, text_col, similarity)
    pick = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("p"))
    of, digest = fresh(docs, "of", "digest")
    pick = pick.select(F.col("p.doc_id").alias(of), F.col("p.text_hash").alias(digest)).distinct()
    rows = docs.withColumns({of: F.col(id_col).cast("long"), digest: F.xxhash64(F.col(text_col))})
    same = rows[of].eqNullSafe(pick[of]) & (rows[digest] == pick[digest])
    return rows.join(pick, same, "left_semi").dropDuplicates([of, digest]).drop(of, digest)
