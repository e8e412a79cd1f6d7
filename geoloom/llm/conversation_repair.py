"""Repair of conversations by weighted interval parsing (CYK).

A repaired conversation has the role initials ``(s?(ua)+)?``. Of four states
(nothing yet, system, user, assistant) the grammar has a non-terminal ``X(p, q)``
for each two: what takes a conversation from state p to q. It is in Chomsky
normal form: ``X(p, q) -> X(p, r) X(r, q)``, and ``X(p, q)`` -> one row with its
edit (keep, rerole, delete). Inserted rows take no row of the input, so the
closure of the insertions is worked into the terminal rules, before the row, and
once at the end.

A span's cell has the least (cost, audit) of each non-terminal, audit being the
edits' initials in order. Cells are combined bottom-up by span length. As the
non-terminals name the states at both ends, every way to split a span gives the
same cell: whatever is between two rows is one of the states. So one split per
span is computed, in halves, and n rows take n - 1 combinations. Of two audits of
one cell and cost neither begins the other (they differ in edits of the same rows,
or in the number of insertions and so in cost), which is why the least of the
whole is made of the least of its parts.

Faults are found on ids, roles and hashes alone. A conversation's rows are one
sorted stream, as its audit and hash need them one after another: a byte a row and
its cells are held, some twelve letters a row; texts pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import keep, record_batch, small_batches

ROLES = {"s": "system", "u": "user", "a": "assistant"}
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # state after a row of this initial
STATES, ACCEPTED = range(4), (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping is free, an undeleted truncated row pays
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3

Cell = dict[tuple[int, int], tuple[int, str]]


def least(cells: Iterator[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: Cell = {}
    for at, found in cells:
        if at not in out or found < out[at]:
            out[at] = found
    return out


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts: all binary rules."""
    return least(((p, q), (a + b, x + y)) for (p, r), (a, x) in left.items() for (s, q), (b, y) in right.items() if r == s)


def _closure() -> Cell:
    """What insertions alone lead to: steps are added until nothing gets cheaper."""
    step = {(p, q): (INSERT, "I") for i in "ua" for p, q in NEXT[i].items()}
    now = {(p, p): (0, "") for p in STATES}
    while (more := least([*now.items(), *combined(now, step).items()])) != now:
        now = more
    return now


CLOSURE = _closure()


def _terminal(initial: str, fault: int) -> Cell:
    """The terminal rules of a row, insertions before it included."""
    edits = [((p, p), (DELETE, "D")) for p in STATES]
    if fault not in (BLANK_FAULT, DUPLICATE_FAULT):
        more = TRUNCATED if fault == TRUNCATED_FAULT else 0
        edits += [(step, (more, "K")) for step in NEXT.get(initial, {}).items()]
        edits += [(step, (REROLE + more, "R")) for i in "ua" for step in NEXT[i].items()]
    return combined(CLOSURE, least(edits))


# a symbol is a byte: 4 * initial + fault; 3 stands for any other initial
INITIALS = "sua"
LEAVES = [_terminal("sua?"[i >> 2], i & 3) for i in range(16)]


@lru_cache(1 << 14)
def _short(symbols: bytes) -> Cell:
    if len(symbols) == 1:
        return LEAVES[symbols[0]]
    half = len(symbols) // 2
    return combined(_short(symbols[:half]), _short(symbols[half:]))


class Parse:
    """Takes rows' symbols as they come; holds one cell per power of two of rows so far."""

    def __init__(self) -> None:
        self.waiting, self.spans = bytearray(), []

    def add(self, symbol: int) -> None:
        self.waiting.append(symbol)
        if len(self.waiting) == 8:
            self._push()

    def _push(self) -> None:
        size, cell = 8, _short(bytes(self.waiting))
        self.waiting.clear()
        while self.spans and self.spans[-1][0] == size:
            cell, size = combined(self.spans.pop()[1], cell), 2 * size
        self.spans.append((size, cell))

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the whole."""
        cell = CLOSURE
        if self.waiting:
            cell = combined(_short(bytes(self.waiting)), cell)
        for _, left in reversed(self.spans):
            cell = combined(left, cell)
        return min(cell[0, q] for q in ACCEPTED if (0, q) in cell)


def symbol(initial: str, fault: int) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 4 * (at if at >= 0 else 3) + fault


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id turn role text digest``; a null role or text is one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id turn initial nth fault`` of ``rows`` (``conv_id turn role text digest``): the first of blank, duplicate, truncated; else 0.

    Of equal rows all but the first are duplicates; ``nth`` counts them.
    """
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", "digest", last.alias("last"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    fault = (F.when(F.col("last") == "", BLANK_FAULT).when(F.col("nth") > 1, DUPLICATE_FAULT)
             .when(~F.col("last").isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0))
    return slim.withColumn("nth", nth).select("conv_id", "turn", "role", "digest", "nth", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    def __init__(self) -> None:
        self.parse, self.faults, self.illegal, self.before = Parse(), [0, 0, 0, 0], 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.turns == 0 else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.faults[fault] += 1
        self.parse.add(symbol(initial, fault))

    def row(self, conv_id: int | None) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return conv_id, gaps, *self.faults[1:], self.illegal, *self.parse.best()


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id gaps blank duplicate truncated illegal cost audit`` of every conversation of ``turns``.

    Rows go by turn, nulls first; those of one turn by role and hash of the text.
    A null role or text is one space, a null id a conversation of its own. Rows
    may repeat: all but the first are duplicates. ``gaps`` are turns that are
    missing between the least and the largest, ``illegal`` the neighbours that no
    repaired conversation has. No rows give no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, out = None, None, []
        schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
        for b in batches:
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in b.columns)):
                if own is None or conv != now:
                    if own is not None:
                        out.append(own.row(now))
                    now, own = conv, _Conversation()
                own.add(turn, initial, fault)
            if out:
                yield record_batch(schema, list(zip(*out)))
                out = []
        if own is not None:
            yield record_batch(schema, list(zip(*[own.row(now)])))

    found = faults(_named(turns, conv_col, turn_col, role_col, text_col))
    dealt = found.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "nth")
    return dealt.select("conv_id", "turn", "initial", "fault").mapInArrow(run, AUDITS)


def repaired(turns: DataFrame, audited: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id position role text`` of the repaired conversations, in order within a partition, a conversation in one.

    ``audited`` has the ``audit`` of each ``conv_id``. It goes before its rows in
    one sorted stream. A reroled or inserted row is a user's or an assistant's,
    whichever the state asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        now = audit = None
        at = state = position = 0
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal state, position
            state = NEXT[role[0]][state]
            out.append((now, position, role, text))
            position += 1

        def wanted() -> str:
            return ROLES["a" if state == 2 else "u"]

        def insert() -> None:
            nonlocal at
            while audit is not None and at < len(audit) and audit[at] == "I":
                put(wanted(), "")
                at += 1

        for b in small_batches(batches, 3):
            for conv, told, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if told is not None:
                    insert()
                    now, audit, at, state, position = conv, told, 0, 0, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(role if edit == "K" else wanted(), text)
            if out:
                yield record_batch(schema, list(zip(*out)))
                out.clear()
        insert()
        if out:
            yield record_batch(schema, list(zip(*out)))

    rows = _named(turns, conv_col, turn_col, role_col, text_col).withColumn("audit", F.lit(None).cast("string"))
    heads = audited.select("conv_id", "audit")
    both = rows.unionByName(heads, allowMissingColumns=True).withColumn("row", F.col("audit").isNull())
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "digest")
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(run, "conv_id long, position long, role string, text string")


def hashes(rows: DataFrame) -> DataFrame:
    """``conv_id repaired_sha256`` of ``repaired`` rows as they come: of ``role:text``, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        now, digest, out = None, None, []
        for b in batches:
            for conv, position, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if position == 0:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if out:
                yield record_batch(schema, list(zip(*out)))
                out = []
        if digest:
            yield record_batch(schema, [[now], [digest.hexdigest()]])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id turn role text`` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space there."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    code: Column = F.col("code")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code")).where(code != 0)
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_digests(turns: DataFrame, all_ids: DataFrame) -> DataFrame:
    """Faults, audit and hash of the repaired rows for every ``conv_id`` of ``all_ids``; zeros and empty text for one without rows."""
    audited = keep(audits(turns))
    digest = hashes(repaired(turns, audited))
    found = audited.join(digest, audited.conv_id.eqNullSafe(digest.conv_id), "left").drop(digest.conv_id)
    ids = all_ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    told = ids.join(found, ids.id.eqNullSafe(found.conv_id), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return told.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
