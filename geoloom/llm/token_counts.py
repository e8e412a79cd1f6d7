"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the pieces that end at each character, the
longest first. For each end only the best score and the number of pieces of the
best way there are carried; no way is traced back and no piece is made.

Ties fall as in the ``tokenizers`` library's unigram model: a later way must
have a greater sum, so among equal ones the longest last piece stays. A
character that is no piece by itself costs the least score less ten. Neighbouring
ones, and a literal unknown piece among them, go together: they count as their
bytes with ``byte_fallback``, else once.

A text is cut as by the library's ``Metaspace``: spaces become ``▁``, one is put
in front, and a unit begins at each. Counts of frequent units are kept.

Rows that repeat are counted each; null and empty texts have no tokens; a very long
text counts whole. No rows give no rows; columns other than id and text play no
part, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from types import ModuleType

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import octets, small_batches

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_UNITS, CACHE_CHARS = 600_000, 48


class Counter:
    """Counts for a vocabulary of ``(piece, score)``; a piece given twice keeps its last score."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool = True, unknown_id: int = 0):
        self.byte_fallback = byte_fallback
        self.pieces = {p for p, _ in vocabulary}
        self.unknown_piece = vocabulary[unknown_id][0] if vocabulary else ""
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == self.unknown_piece))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        # no piece holds a line end: what stands before and after it is counted apart
        self.cuts_lines = byte_fallback and not any("\n" in p for p, _ in vocabulary)
        self.kept: dict[str, int] = {}

    @classmethod
    def of_file(cls, path: str) -> Counter:
        """Pieces and scores of a SentencePiece file; bytes stand in for unknown characters if it has pieces for them."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in ids], any(map(model.is_byte, ids)), model.unk_id())

    def viterbi(self, unit: str) -> int:
        n = len(unit)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        if self.single.issuperset(unit) and self.unknown_piece not in unit:
            for last, (length, score, _) in self.automaton.iter(unit):
                end = last + 1
                start = end - length
                s = best[start] + score
                if s > best[end]:
                    best[end], count[end] = s, count[start] + 1
            return count[n]
        run = [-1] * (n + 1)  # where the unknown characters that end here began

        def unknown(start: int, end: int, s: float) -> None:
            first = start if run[start] < 0 else run[start]
            together = unit[first:end]
            whole = not self.byte_fallback or together in self.pieces
            best[end], run[end], count[end] = s, first, count[first] + (1 if whole else len(together.encode()))

        def finish(upto: int) -> None:
            """The unknown character before each end, after the pieces that end there."""
            nonlocal done
            while done < upto:
                if unit[done] not in self.single and best[done] + self.unknown > best[done + 1]:
                    unknown(done, done + 1, best[done] + self.unknown)
                done += 1

        done = 0
        for last, (length, score, is_unknown) in self.automaton.iter(unit):
            finish(last)
            end = last + 1
            start = end - length
            s = best[start] + score
            if s > best[end]:
                if is_unknown:
                    unknown(start, end, s)
                else:
                    best[end], count[end], run[end] = s, count[start] + 1, -1
        finish(n)
        return count[n]

    def _unit(self, unit: str) -> int:
        n = self.kept.get(unit)
        if n is None:
            if self.cuts_lines and "\n" in unit and self.unknown_piece not in unit:
                parts = unit.split("\n")
                n = len(parts) - 1 + sum(map(self._unit, filter(None, parts)))
            else:
                n = self.viterbi(unit)
            if len(unit) <= CACHE_CHARS:
                self.kept[unit] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; none for an empty one."""
        if not text:
            return 0
        if len(self.kept) > CACHE_UNITS:
            self.kept.clear()
        marked = text.replace(" ", SPACE)
        get, unit = self.kept.get, self._unit
        units = [SPACE + u for u in (marked[1:] if marked[0] == SPACE else marked).split(SPACE)]
        return sum([unit(u) if (n := get(u)) is None else n for u in units])


_COUNTERS = "geoloom_llm_counters"


def counter(path: str) -> Counter:
    """One counter per worker and file; the worker's module table outlives a task."""
    held = sys.modules.setdefault(_COUNTERS, ModuleType(_COUNTERS)).__dict__
    if path not in held:
        held[path] = Counter.of_file(path)
    return held[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id n_tokens n_units`` of every row, by its whole text; 0 for null and empty texts. No shuffle.

    ``vocabulary`` is a path on every worker. A unit without a space is as long
    as it is: its Viterbi holds three lists of its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in small_batches(batches, 1):
            texts = [t.decode("utf-8", "replace") if t else "" for t in b.column(1).to_pylist()]
            units = [(t if t[0] != " " else t[1:]).count(" ") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(c.count, texts), pa.int64()), pa.array(units, pa.int64())], ["doc_id", "n_tokens", "n_units"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), octets(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_units long")
