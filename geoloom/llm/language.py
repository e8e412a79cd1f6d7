"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long with the
counts of the bytes that followed. A byte's code length is read at the longest
context that was ever seen; where the byte never followed it, an escape is paid
and the next shorter one is asked, down to one in 256. (Escapes as in method C:
as likely as the context has different followers; without exclusions.) The
statistics are frozen, so a byte's code length hangs on itself and the three
before it alone, and a text's is a sum over its runs of four bytes.

A text is cut into pieces of 128 bytes. A piece's code length under each language
gives the languages' shares of the piece, two to the power of minus the bits over
their sum; the language with the largest share of all bytes wins, and that share
is the score. So a quoted passage of another language, whose bits could outweigh the
rest of the text, counts by its length only.

Null texts and those without a letter are unknown; very long ones count whole, in
parts. Rows that repeat are judged each, and teach once. Among equal shares the
first language by name wins. Without rows to learn from every text is unknown; no
rows give no rows. Columns other than id, text and language play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from geoloom.llm.common import octets, small_batches

#: Texts of each language the trees are grown on at most, those of the smallest hash. This bounds the model and the broadcast.
SAMPLE = 800
SHARES = 64
ORDER = 3
PIECE = 128  # bytes
PAD = bytes(ORDER)
UNKNOWN = "und"


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run of four bytes that ends at each byte, as a number, and the number of bytes of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.uint32)
    four = buf[:-3] << 24 | buf[1:-2] << 16 | buf[2:-1] << 8 | buf[3:]
    own = np.ones(len(four), bool)
    stop = np.cumsum(size + ORDER)[:-1] - ORDER
    for k in range(ORDER):  # runs that end in the padding of the next text
        own[stop + k] = False
    return four[own], size


def count(four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(four, return_counts=True)


class Tree:
    """One language's contexts: for each length the runs seen, and the contexts with their total and different followers."""

    def __init__(self, four: np.ndarray, n: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            keys, at = np.unique(four & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(at, n, len(keys))
            contexts, start = np.unique(keys >> np.uint32(8), return_index=True)
            total = np.add.reduceat(counts, start) if len(keys) else np.empty(0)
            different = np.diff(np.append(start, len(keys)))
            self.levels.append((k, keys, counts, contexts, total, different))

    def bits(self, four: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each run."""
        out, paid, open_ = np.full(len(four), np.nan), np.zeros(len(four)), np.ones(len(four), bool)
        for k, keys, counts, contexts, total, different in self.levels:
            if not len(keys):
                continue
            key = four & np.uint32((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(contexts, key >> np.uint32(8)), len(contexts) - 1)
            there = open_ & (contexts[c] == key >> np.uint32(8))
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            followed = there & (keys[i] == key)
            whole = total[c] + different[c]
            out[followed] = (paid + np.log2(whole / counts[i]))[followed]
            escaped = there & ~followed
            paid[escaped] += np.log2(whole / different[c])[escaped]
            open_ &= ~followed
        out[open_] = paid[open_] + 8.0
        return out


class Model:
    def __init__(self, grown: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(grown)
        self.trees = [Tree(*grown[name]) for name in self.languages]
        self.known = np.unique(np.concatenate([four for four, _ in grown.values()])) if grown else np.empty(0, np.uint32)
        self.table = self._bits(self.known)

    def _bits(self, four: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(four) for t in self.trees], 1) if self.trees else np.zeros((len(four), 0))

    def lengths(self, texts: list[bytes], piece: int | None = None, part: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code length in bits of each piece of the texts under each language; the piece's text and bytes.

        A piece has ``piece`` bytes, a text's last one up to twice as many; without ``piece``, each text is one.
        """
        four, size = runs(texts)
        n = np.maximum(1, size // piece) if piece else np.ones(len(size), np.int64)
        of = np.repeat(np.arange(len(texts)), n)
        long = np.full(len(of), piece or 0, np.int64)
        long[np.cumsum(n) - 1] = size - (n - 1) * (piece or 0)
        out, ends = np.zeros((len(of), len(self.languages))), np.cumsum(long)
        for lo in range(0, len(four), part):
            some, at = np.unique(four[lo : lo + part], return_inverse=True)
            i = np.minimum(np.searchsorted(self.known, some), max(0, len(self.known) - 1))
            bits = self.table[i].copy()
            new = self.known[i] != some
            bits[new] = self._bits(some[new])
            hi = lo + len(at)
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
            edge = np.clip(ends[first : last + 1], lo, hi) - lo
            before = np.concatenate(([0], edge[:-1]))
            for d in range(len(self.languages)):
                run = np.concatenate(([0.0], np.cumsum(bits[:, d][at])))
                out[first : last + 1, d] += run[edge] - run[before]
        return out, of, long

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language that most bytes speak for, the first by name among equals, and their share."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits, of, long = self.lengths(texts, PIECE)
        share = np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0))
        share *= (np.maximum(long, 1) / share.sum(1))[:, None]
        votes = np.zeros((len(texts), len(self.languages)))
        np.add.at(votes, of, share)
        votes /= votes.sum(1, keepdims=True)
        best = votes.argmax(1)
        return [self.languages[i] for i in best], votes[np.arange(len(best)), best].clip(0.0, 1.0).tolist()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Trees of every language among ``docs``, each grown on ``sample`` whole texts at most.

    Rows without text or language teach nothing. A language is ranked before
    the shuffle, so a common one sends few rows; the texts' runs are counted by
    the executors and the counts summed there.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), octets(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    # by share of the language first, so that no task ranks what all others send of one language
    each = rows.select("l", "h").distinct().withColumn("s", F.pmod(F.xxhash64("h"), F.lit(SHARES)))
    for by in (["l", "s"], ["l"]):
        each = each.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= sample)
    # at most ``sample`` short rows a language
    chosen = rows.join(F.broadcast(each.select("l", "h")), ["l", "h"], "left_semi").dropDuplicates(["l", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            names, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for name in sorted(set(names)):
                four, n = count(runs([texts[i] for i in np.flatnonzero(names == name)])[0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(four), pa.string()), pa.array(four, pa.int64()), pa.array(n, pa.int64())], ["l", "four", "n"])

    counted = chosen.select("l", "t").mapInArrow(run, "l string, four long, n long").groupBy("l", "four").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("l").agg(F.collect_list(F.struct("four", "n")).alias("c"))
    grown = {}
    for r in packed.toLocalIterator():
        four, n = np.array([x.four for x in r.c], np.uint32), np.array([x.n for x in r.c], np.int64)
        order = np.argsort(four)
        grown[r.l] = (four[order], n[order])
    return Model(grown)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id lang_pred score`` of every row, by its whole text; ``und`` and 0 for a null text or one without a letter."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1, 2 << 20):
            texts, letters = b.column(1).to_pylist(), b.column(2).to_pylist()
            some = [i for i, x in enumerate(letters) if x]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, name, s in zip(some, *held.value.predict([texts[i] for i in some])) if some else ():
                names[i], scores[i] = name, s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), octets(text_col).alias("t"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"]]).add("lang_pred", StringType()).add("score", DoubleType()))
