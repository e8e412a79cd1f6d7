"""Interval parsing against a search through all edits, and against a full table over every span and split."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from geoloom.llm import conversation_repair as R

GOAL = re.compile("(s?(ua)+)?")


def searched(symbols):
    """The least (cost, audit) among all edits, by trying them; ``symbols`` are pairs of initial and fault."""
    limit = 4 * len(symbols)
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(symbols) and GOAL.fullmatch(roles):
            return cost, audit
        if cost > limit or not re.fullmatch("s?(ua)*u?", roles):
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + (initial or "-")))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r))


def table(symbols):
    """CYK as written in books: every span, every split."""
    n = len(symbols)
    cell = {(i, i + 1): R.LEAVES[R.symbol(*s)] for i, s in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell[i, i + size] = R.least(x for k in range(i + 1, i + size) for x in R.combined(cell[i, k], cell[k, i + size]).items())
    whole = R.combined(cell[0, n], R.CLOSURE) if n else R.CLOSURE
    return min(whole[0, q] for q in R.ACCEPTED if (0, q) in whole)


def parsed(symbols):
    p = R.Parse()
    for s in symbols:
        p.add(R.symbol(*s))
    return p.best()


def test_all_short_conversations():
    kinds = [("s", 0), ("u", 0), ("a", 0), ("x", 0), ("u", 1), ("a", 3), ("s", 3), ("", 3)]
    for n in range(4):
        for symbols in product(kinds, repeat=n):
            assert parsed(symbols) == searched(symbols), symbols


@pytest.mark.parametrize("seed", range(6))
def test_any_split_gives_the_same(seed):
    rng = random.Random(seed)
    for _ in range(12):
        symbols = [(rng.choice("ssuuaax"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(4, 26))]
        assert parsed(symbols) == table(symbols)
        assert parsed(symbols[:5]) == searched(symbols[:5])


def plain(rows):
    """Facts and the repaired rows of one conversation's ``(turn, role, text)``."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, told = set(), []
    for _, role, text in rows:
        tail = re.findall("[^\x20\x09-\x0d]", text)
        told.append((role[:1], 1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, audit = table(told)
    out, it = [], iter(rows)
    for edit in audit:
        row = next(it) if edit != "I" else None
        if edit == "K":
            out.append((row[1], row[2]))
        elif edit != "D":
            roles = "".join(r[0] for r, _ in out)
            out.append(("user" if not roles.endswith("u") else "assistant", row[2] if row else ""))
    assert GOAL.fullmatch("".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[0] + b[0] for a, b in zip(told, told[1:])]
    faults = [sum(f == k for _, f in told) for k in (1, 2, 3)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest


def test_odd_rows(spark):
    rng = random.Random(3)
    convs = {c: [(rng.choice((None, *range(9))), rng.choice(("system", "user", "assistant", None, "", "tool", "user")), rng.choice(("A.", "B", "", None, " \n", "C! ", "ends.\n　"))) for _ in range(rng.randrange(1, 14))] for c in range(40)}
    convs[40] = [(None, "user", "Q?"), (None, "user", "Q?"), (7, "assistant", "y" * 3_000_000 + ".")]
    convs[None] = [(0, "user", "hello."), (2, "user", "there.")]
    convs[41] = [(i % 1000, "user" if i % 2 else "assistant", f"{i}.") for i in range(3000)]
    rows = [(x, r, t, c, "z") for c, own in convs.items() for t, r, x in own]
    turns = spark.createDataFrame(rows, "text string, role string, turn long, conv_id long, audit string").repartition(6)
    ids = spark.createDataFrame([(c,) for c in [*convs, 99, 99]], "conv_id long")
    got = {r[0]: tuple(r[1:]) for r in R.repair_digests(turns, ids).collect()}
    convs[41] = None
    assert got.pop(99) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    long = got.pop(41)
    assert long[0] == 0 and len(long[6]) >= 3000 and set(long[6]) <= set("DIKR")
    assert got == {c: plain(own) for c, own in convs.items() if own}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two?! end") for c in (1, None) for t in (*range(40), None)]
    got = sorted(map(tuple, R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code:
            row = (c, t, "user" if code == 4 else role, "" if code == 1 else "One Two end" if code == 2 else text)
            want += [row] * (2 if code == 3 else 1)
    assert got == sorted(want, key=repr) and len({r[2:] for r in got}) == 4


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair_digests(none, none).count() == 0 and R.repaired(none, R.audits(none)).count() == 0
