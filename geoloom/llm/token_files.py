"""Token-id output by fixed-width bit packing.

Each id takes the least bits that hold the vocabulary. A file holds blocks of
packed ids, then the documents' ids and the place where each one ends, then the
places of the blocks, so that any document is read with two seeks and unpacked
by whole arrays.

    magic "PIDS" | bits u32 | ids per block u32
    blocks: 64 ids become ``bits`` little-endian 64-bit words; the last group is padded with noughts
    documents: id i64, null flag u8, end u64 (in ids) each, as three arrays
    block places u64
    ids u64 | documents u64 | blocks u64 | place of the documents u64

Documents are dealt to files by ranges of ascending id, files are numbered in
that order, and a table of the files (one row each) is what readers start from.
A task writes under a new name, so the remains of a lost attempt are in no
table.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import keep, octets, scratch, small_batches

MAGIC = b"PIDS"
BLOCK = 1 << 16
FILE_IDS = 1 << 25
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
# Units kept with their ids by a worker, and the longest that is kept.
CACHE_UNITS, CACHE_CHARS = 600_000, 48
LATIN, TOP = 0x250, chr(0x250)  # words of lower characters are letters to any version of Unicode
# ASCII signs that follow a word without being part of a contraction.
CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MANIFEST = "part int, sub int, path string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids at a time into ``bits`` words."""
    groups = -(-len(ids) // 64)
    cols = np.zeros(groups * 64, np.uint64)
    cols[: len(ids)] = ids
    cols = cols.reshape(groups, 64).T.copy()
    out = np.zeros((bits, groups), np.uint64)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        out[word] |= cols[j] << np.uint64(off)
        if off + bits > 64:
            out[word + 1] |= cols[j] >> np.uint64(64 - off)
    return out.T.astype("<u8").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits).T.copy()
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        x = words[word] >> np.uint64(off)
        if off + bits > 64:
            x |= words[word + 1] << np.uint64(64 - off)
        out[j] = x & mask
    return out.T.reshape(-1)[:count]


class Writer:
    """One file, written front to back; holds a block and the documents' table."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.wait, self.waiting, self.ids = [], 0, 0
        self.docs, self.nulls, self.ends, self.places = [], [], [], []
        self.at = 0
        self._put(MAGIC + struct.pack("<II", bits, block))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(self.waiting - self.waiting % self.block)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.empty(0, np.uint32)
        for lo in range(0, count, self.block):
            self.places.append(self.at)
            self._put(pack(ids[lo : min(count, lo + self.block)], self.bits))
        self.wait, self.waiting = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self._flush(self.waiting)
        table = self.at
        for values, kind in ((self.docs, "<i8"), (self.nulls, "u1"), (self.ends, "<u8"), (self.places, "<u8")):
            self._put(np.array(values, kind).tobytes())
        self._put(struct.pack("<4Q", self.ids, len(self.docs), len(self.places), table))
        self.stream.close()


class Reader:
    """Random access to a file: ``source`` is a seekable stream of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        head = self._at(0, 12)
        if head[:4] != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.block = struct.unpack("<II", head[4:])
        self.ids, n, blocks, self.table = struct.unpack("<4Q", self._at(size - 32, 32))
        raw = self._at(self.table, 17 * n + 8 * blocks)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, "u1", n, 8 * n)
        self.ends = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.places = np.frombuffer(raw, "<u8", blocks, 17 * n)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def read_block(self, k: int) -> np.ndarray:
        count = min(self.block, self.ids - k * self.block)
        return unpack(self._at(int(self.places[k]), -(-count // 64) * self.bits * 8), count, self.bits)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        lo, hi = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        blocks = [self.read_block(k) for k in range(lo // self.block, -(-hi // self.block))]
        first = lo // self.block * self.block
        return np.concatenate(blocks)[lo - first : hi - first] if blocks else np.empty(0, np.uint32)

    def digests(self) -> tuple[np.ndarray, list[int]]:
        """Number of ids and unsigned crc32 of each document's ids, read block after block."""
        crcs, doc, crc, at = [], 0, 0, 0
        for k in range(len(self.places)):
            ids = self.read_block(k).astype("<u4")
            data, lo = memoryview(ids).cast("B"), at
            at += len(ids)
            while doc < len(self.ends) and self.ends[doc] <= at:
                hi = int(self.ends[doc])
                crcs.append(zlib.crc32(data[4 * (lo - at + len(ids)) : 4 * (hi - at + len(ids))], crc))
                doc, crc, lo = doc + 1, 0, hi
            crc = zlib.crc32(data[4 * (lo - at + len(ids)) :], crc)
        crcs += [0] * (len(self.ends) - len(crcs))
        return np.diff(self.ends, prepend=0), crcs


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    A byte-level tokenizer with the usual splitting never joins what stands on
    both sides of a single space between two other characters, so a text is cut
    there and the ids of frequent units are kept. A new unit is cut further, at
    single line ends and before closing signs, and a bare word goes to the
    tokenizer's model. Whatever has another shape, a text with an added token's
    string and any other kind of tokenizer go through ``encode`` in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        how = json.loads(self.tokenizer.to_str())
        split = how.get("pre_tokenizer") or {}
        self.splits = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True) and not how.get("normalizer") and not how.get("post_processor") and how["model"]["type"] == "BPE"
        # the character that stands for each byte, as the splitter itself shows it
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {b: x for c in range(LATIN) for b, x in zip(chr(c).encode(), shown.pre_tokenize_str(chr(c))[0][0])}
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by what follows the space

    @staticmethod
    def units(text: str) -> list[str]:
        """The parts of a text that are encoded apart; all but the first begin with a space."""
        parts = text.split(" ")
        out, glue = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if glue or not p or p[0].isspace():
                out[-1] += f" {p}"
                glue = not p or p[-1].isspace()
            else:
                out.append(f" {p}")
                glue = p[-1].isspace()
        return out

    def _after_space(self, part: str) -> bytes:
        """Ids of a space and ``part``, kept by the part."""
        ids = self._new(f" {part}")
        if len(part) < CACHE_CHARS:
            self.spaced[part] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _kept(self, unit: str) -> bytes:
        if unit[:1] == " " and len(unit) > 1:
            return self.spaced.get(unit[1:]) or self._after_space(unit[1:])
        ids = self.cache.get(unit)
        if ids is None:
            ids = self._new(unit)
            if len(unit) <= CACHE_CHARS:
                self.cache[unit] = ids
        return ids

    def _new(self, unit: str) -> bytes:
        """Ids of a unit that isn't kept."""
        word = unit[1:] if unit[:1] == " " else unit
        if word.isalpha() and (word.isascii() or max(word) < TOP):
            shown = unit.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        bare = unit.rstrip(CLOSING)
        if "\n" in unit:
            parts = unit.split("\n")
            inner = all(p and not p[-1].isspace() for p in parts) and not any(p[0].isspace() for p in parts[1:])
            return self.line_end.join([self._kept(p) for p in parts]) if inner else self._whole(unit)
        if len(bare) < len(unit) and bare and bare[-1].isalpha():
            return self._kept(bare) + self._kept(unit[len(bare) :])
        return self._whole(unit)

    @cached_property
    def line_end(self) -> bytes:
        return self._whole("\n")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        end, get, after, kept = array("I", [END_ID]).tobytes(), self.spaced.get, self._after_space, self._kept
        out = []
        for t in texts:
            parts = t.split(" ")
            if not self.splits or any(a in t for a in self.added):
                ids = [self._whole(t)]
            elif len(t.split()) == len(parts) + t.count("\n"):  # white space comes singly and inside
                ids = [kept(parts[0])] + [get(p) or after(p) for p in parts[1:]]
            else:
                ids = [kept(u) for u in self.units(t)]
            if len(self.cache) + len(self.spaced) > CACHE_UNITS:
                self.cache.clear()
                self.spaced.clear()
            out.append(np.frombuffer(b"".join([*ids, end]), "<u4"))
        return out


_ENCODERS = "geoloom_llm_encoders"


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; the worker's module table outlives a task."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault(_ENCODERS, ModuleType(_ENCODERS)).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text into files under ``folder`` (a URI all executors reach); the table of files, written.

    ``part sub path n_docs n_ids``; (part, sub) ascends with the ids. Null ids
    come first, rows of one id in order of their texts' hash. Null and empty
    texts are the end id alone. No documents give no files. ``tokenizer`` is a path on every
    worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, sub, now = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        fs, base = pafs.FileSystem.from_uri(folder)
        rows = []

        def end(w: Writer, path: str) -> None:
            w.close()
            rows.append((part, sub, path, len(w.docs), w.ids))

        for b in small_batches(batches, 1):
            texts = [t.decode("utf-8", "replace") if t else "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(texts)):
                if now is None:
                    path = f"{base}/{part:07d}-{sub:04d}-{uuid.uuid4().hex}.pids"
                    now = Writer(fs.open_output_stream(path), bits_for(enc.vocabulary))
                now.add(doc_id, ids)
                if now.ids >= file_ids:
                    end(now, path)
                    now, sub = None, sub + 1
        if now is not None:
            end(now, path)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "sub", "path", "n_docs", "n_ids"])

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), octets(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(dealt.mapInArrow(run, MANIFEST))


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id start n_tokens ids_crc32`` of every document in the files of a table that ``write`` gave.

    ``start`` is the sum of the ids of all earlier files, a running sum over the
    table of files, and the document's place in its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    r = Reader(f, f.size())
                    n, crcs = r.digests()
                for lo in range(0, len(n), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs[s], pa.int64(), mask=r.nulls[s].astype(bool)), pa.array(before + r.ends[s] - n[s]), pa.array(n[s]), pa.array(crcs[s], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    earlier = Window.orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = keep(files.select("path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"), "part", "sub"))
    # one file a task, as near as can be: the table is small and would else be one partition
    dealt = placed.repartitionByRange(max(1, placed.count()), "part", "sub").select("path", "before")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts' ids to the shared folder and digest what the files hold."""
    folder = scratch(docs.sparkSession)
    return read_digests(write(docs, folder, tokenizer, id_col, text_col), folder)


def documents(paths: Iterable[str], filesystem: pafs.FileSystem | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every (id, ids) of files in order, for readers without Spark."""
    fs = filesystem or pafs.LocalFileSystem()
    for p in paths:
        with fs.open_input_file(p) as f:
            r = Reader(f, f.size())
            for i in range(len(r.ends)):
                yield None if r.nulls[i] else int(r.docs[i]), r.document(i)
