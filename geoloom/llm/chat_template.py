"""Chat formatting with a compiled template language.

A template is text with ``{{ expression }}`` and ``{% statement %}``:

    for NAME in EXPR / endfor      loop.index, loop.first and loop.last are known inside
    if EXPR / elif EXPR / else / endif
    set NAME = EXPR
    generation / endgeneration     what a model is to learn

Expressions have literals, names, dotted fields, ``+``, ``~`` (as text), comparisons,
``and or not``, ``in``, a conditional (``a if c else b``) and the filters
``escape upper lower trim length default(x)``. Names are looked up among the
values given and the template's own variables, fields in dictionaries only, so a template reaches
nothing else: no attributes, calls or modules, and loops run over given
sequences alone.

The text is parsed to a tree, constant parts are folded (operators on
constants, branches that are always or never taken, texts side by side), and the tree
becomes Python closures that yield ``(text, is_generation)`` one after another.
Turns may be an iterator: a loop looks one item ahead and no further, so a
conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import keep

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPE = "\\"
#: A turn: its role, then its text; the reply is under generation and ends in the mark of a turn's end.
TEMPLATE = (
    "{% for turn in turns %}{{ '<s>' }}{{ turn.role | escape }}{{ '[INST]' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '[/INST]' }}{{ '</s>' }}{% endfor %}"
)
PART_CHARS = 1 << 18  # of a conversation's written part, about


class TemplateError(ValueError):
    """A template that can't be parsed or a value that can't be rendered."""


# The tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    """Literal text."""

    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def escape(text: Any) -> str:
    """Control strings in a text, and the escape sign itself, get the escape sign in front."""
    return _CONTROL.sub(lambda m: ESCAPE + m[0], _text(text))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_CONTROL = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


FILTERS: Mapping[str, Callable[..., Any]] = {
    "escape": escape,
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x) if x is not None else 0,
    "default": lambda x, other="": other if x is None else x,
}


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) != isinstance(b, str) or not isinstance(a, (str, int, float)) or not isinstance(b, (str, int, float)):
        raise TemplateError("+ needs two texts or two numbers")
    return a + b


def _order(how: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def run(a: Any, b: Any) -> bool:
        try:
            return how(a, b)
        except TypeError as e:
            raise TemplateError(str(e)) from None

    return run


OPS: Mapping[str, Callable[..., Any]] = {
    "+": _add,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _order(lambda a, b: a < b),
    ">": _order(lambda a, b: a > b),
    "<=": _order(lambda a, b: a <= b),
    ">=": _order(lambda a, b: a >= b),
    "in": _order(lambda a, b: a in b),
    "not": lambda a: not a,
}

# Parsing

_TAG = re.compile(r"\{\{(?P<print>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)\}\}|\{%(?P<say>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().,|=]))", re.S)
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
_CHARS = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over an expression's tokens."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        """The next token's text if it is one of ``values`` (operators and words)."""
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if value in values and kind in ("op", "name"):
                self.at += 1
                return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _WORDS:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        value = self.choice()
        self.end()
        return value

    def choice(self) -> Any:
        value = self.disjunction()
        if self.take("if"):
            test = self.disjunction()
            self.need("else")
            return Op("if", (test, value, self.choice()))
        return value

    def disjunction(self) -> Any:
        value = self.conjunction()
        while self.take("or"):
            value = Op("or", (value, self.conjunction()))
        return value

    def conjunction(self) -> Any:
        value = self.negation()
        while self.take("and"):
            value = Op("and", (value, self.negation()))
        return value

    def negation(self) -> Any:
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        value = self.sum()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            value = Op(op, (value, self.sum()))
        return value

    def sum(self) -> Any:
        value = self.filtered()
        while op := self.take("+", "~"):
            value = Op(op, (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.atom()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if not self.take(","):
                        self.need(")")
                        break
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Op(f"|{name}", (value, *args))
        return value

    def atom(self) -> Any:
        if self.take("("):
            value = self.choice()
            self.need(")")
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        else:
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "num":
                value = Const(float(text) if "." in text else int(text))
            elif kind == "str":
                value = Const(re.sub(r"\\(.)", lambda m: _CHARS.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "name" and text in ("true", "false", "none"):
                value = Const({"true": True, "false": False, "none": None}[text])
            elif kind == "name" and text not in _WORDS:
                value = Name(text)
            else:
                raise TemplateError(f"unexpected {text!r}")
        while self.take("."):
            value = Field(value, self.name())
        return value


def parse(template: str) -> tuple:
    """A template's tree."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        if m["print"] is not None:
            parts.append(("print", m["print"]))
        elif m["say"] is not None:
            parts.append(("say", m["say"]))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    for kind, text in parts:
        if kind == "text" and re.search(r"\{[{%#]", text):
            raise TemplateError(f"a tag is not closed in {text[:40]!r}")
    body, rest, end = _block(parts, 0, ())
    return body


def _block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int, _Expression | None]:
    """Nodes up to a statement of ``ends``; the place after it and what follows its word."""
    nodes: list = []
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if kind == "text":
            nodes.append(Text(text))
        elif kind == "print":
            nodes.append(Print(_Expression(text).whole()))
        else:
            e = _Expression(text)
            word = next((w for w in (*ends, "for", "if", "set", "generation") if e.take(w)), None)
            if word in ends:
                e.word = word
                return tuple(nodes), at, e
            if word == "set":
                name = e.name()
                e.need("=")
                nodes.append(Set(name, e.whole()))
            elif word == "for":
                name = e.name()
                e.need("in")
                over = e.whole()
                body, at, last = _block(parts, at, ("endfor",))
                last.end()
                nodes.append(For(name, over, body))
            elif word == "generation":
                e.end()
                body, at, last = _block(parts, at, ("endgeneration",))
                last.end()
                nodes.append(Generation(body))
            elif word == "if":
                node, at = _branches(parts, at, e.whole())
                nodes.append(node)
            else:
                raise TemplateError(f"unknown statement {text.strip()!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), at, None


def _branches(parts: list, at: int, test: Any) -> tuple[If, int]:
    then, at, last = _block(parts, at, ("elif", "else", "endif"))
    if last.word == "elif":
        inner, at = _branches(parts, at, last.whole())
        return If(test, then, (inner,)), at
    last.end()
    other: tuple = ()
    if last.word == "else":
        other, at, last = _block(parts, at, ("endif",))
        last.end()
    return If(test, then, other), at


# Folding


def fold(e: Any) -> Any:
    """An expression with constant parts worked out. What can't be worked out is left to fail when it is rendered."""
    if isinstance(e, Field):
        return replace(e, of=fold(e.of))
    if not isinstance(e, Op):
        return e
    args = tuple(map(fold, e.args))
    first = args[0]
    if isinstance(first, Const):
        if e.name == "and":
            return args[1] if first.value else first
        if e.name == "or":
            return first if first.value else args[1]
        if e.name == "if":
            return args[1] if first.value else args[2]
    if e.name not in ("and", "or", "if") and all(isinstance(a, Const) for a in args):
        try:
            return Const(_function(e.name)(*(a.value for a in args)))
        except Exception:
            pass
    return Op(e.name, args)


def fold_body(nodes: tuple) -> tuple:
    """Nodes with folded expressions, decided branches in place and neighbouring texts joined."""
    out: list = []
    for n in nodes:
        if isinstance(n, Print):
            value = fold(n.value)
            new = [Text(_text(value.value)) if isinstance(value, Const) else Print(value)]
        elif isinstance(n, If):
            test, then, other = fold(n.test), fold_body(n.then), fold_body(n.other)
            new = list(then if test.value else other) if isinstance(test, Const) else [If(test, then, other)]
        elif isinstance(n, For):
            new = [For(n.name, fold(n.over), fold_body(n.body))]
        elif isinstance(n, Generation):
            new = [Generation(fold_body(n.body))]
        elif isinstance(n, Set):
            new = [Set(n.name, fold(n.value))]
        else:
            new = [n]
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return tuple(out)


# Closures


def _function(name: str) -> Callable[..., Any]:
    return FILTERS[name[1:]] if name[0] == "|" else OPS[name]


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda env: e.value
    if isinstance(e, Name):
        return lambda env: env.get(e.name)
    if isinstance(e, Field):
        of = _value(e.of)

        def field(env: dict) -> Any:
            value = of(env)
            return value.get(e.name) if isinstance(value, dict) else None

        return field
    args = [_value(a) for a in e.args]
    if e.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if e.name == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    run = _function(e.name)
    if len(args) == 1:
        return lambda env: run(args[0](env))
    if len(args) == 2:
        return lambda env: run(args[0](env), args[1](env))
    return lambda env: run(*(a(env) for a in args))


Piece = tuple[str, bool]


def _body(nodes: tuple, learn: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, learn) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return steps[0] if len(steps) == 1 else run


def _step(n: Any, learn: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(n, Text):
        piece = (n.text, learn)
        return lambda env: (piece,)
    if isinstance(n, Print):
        value = _value(n.value)
        return lambda env: ((_text(value(env)), learn),)
    if isinstance(n, Generation):
        return _body(n.body, True)
    if isinstance(n, If):
        test, then, other = _value(n.test), _body(n.then, learn), _body(n.other, learn)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(n, Set):
        name, value = n.name, _value(n.value)

        def put(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return put
    over, body = _value(n.over), _body(n.body, learn)

    def loop(env: dict) -> Iterator[Piece]:
        items = over(env)
        if items is None:
            return
        if isinstance(items, (str, dict)) or not hasattr(items, "__iter__"):
            raise TemplateError("a loop needs a sequence")
        outer = {k: env[k] for k in (n.name, "loop") if k in env}
        items, i, none = iter(items), 0, object()
        item = next(items, none)
        while item is not none:
            after, i = next(items, none), i + 1
            env[n.name], env["loop"] = item, {"index": i, "first": i == 1, "last": after is none}
            yield from body(env)
            item = after
        for k in (n.name, "loop"):
            env.pop(k, None)
        env |= outer

    return loop


def compile_template(template: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's values that yields ``(text, is_generation)``."""
    body = _body(fold_body(parse(template)), False)
    return lambda **values: body(dict(values))


# Spark

PARTS = "conv_id long, part int, last boolean, text string, spans array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id part last text spans``: each conversation's formatted text, most in one part, with the spans (in code points) to learn.

    Turns go in order of turn, role and text, nulls first; null roles and texts
    are empty; a null conv_id is a conversation of its own. A conversation is
    streamed through the template, so one with any number of turns takes the
    memory of a batch of rows and one part. No turns give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(*(x.to_pylist() for x in b.columns)))
        ahead = next(rows, None)

        def turns_of(conv: int | None) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1]
                ahead = next(rows, None)

        out, size = [], 0
        while ahead is not None:
            conv, part, texts, spans, n = ahead[0], 0, [], [], 0
            for text, learn in render(turns=turns_of(conv)):
                if n and n + len(text) > part_chars:
                    out.append((conv, part, False, "".join(texts), spans))
                    size, part, texts, spans, n = size + n, part + 1, [], [], 0
                    if size > 4 * part_chars:
                        yield batch(out)
                        out, size = [], 0
                if text and learn:
                    if spans and spans[-1]["end"] == n and texts[-1:] and spans[-1]["open"]:
                        spans[-1]["end"] = n + len(text)
                    else:
                        spans.append({"start": n, "end": n + len(text), "open": True})
                elif spans and text:
                    spans[-1]["open"] = False
                texts.append(text)
                n += len(text)
            for _ in turns_of(conv):  # turns that the template didn't ask for
                pass
            out.append((conv, part, True, "".join(texts), spans))
            size += n
            if size > 4 * part_chars or len(out) >= 2000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        conv, part, last, text, spans = zip(*rows)
        spans = [[{"start": s["start"], "end": s["end"]} for s in x] for x in spans]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(last), pa.array(text, pa.string()), pa.array(spans, span)], ["conv_id", "part", "last", "text", "spans"])

    names = {"conv_id": F.col(conv_col).cast("long"), "turn": F.col(turn_col), "role": F.col(role_col).cast("string"), "text": F.col(text_col).cast("string")}
    rows = turns.select(*(c.alias(n) for n, c in names.items()))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, PARTS)


_MARK = re.compile(re.escape(ESCAPE) + ".|" + "|".join(map(re.escape, CONTROLS)), re.S)


class Digest:
    """Reads a conversation back from its parts, one after another: turns and the text to learn, hashed as they come.

    A part may end anywhere but in a control string or after an escape sign,
    as whole pieces are written; a turn's role and text go to the hash piecewise.
    """

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def read(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        at = 0
        for m in _MARK.finditer(text):
            if m[0][0] == ESCAPE:
                continue
            self.turns.update(unescape(text[at : m.start()]).encode())
            at = m.end()
            if m[0] == "[INST]":
                self.turns.update(b"\n")
            elif m[0] == "[/INST]":
                self.turns.update(b"\n")
                self.n_turns += 1
        self.turns.update(unescape(text[at:]).encode())
        for start, end in spans:
            learnt = unescape(text[start:end])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame) -> DataFrame:
    """A row per conversation, read back from its formatted parts.

    Conversations of one part are read where they are; the others' parts are
    brought together in order and streamed, as a hash needs them one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, out = Digest(), []
        for b in batches:
            for conv, last, text, spans in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                d.read(text, [(s["start"], s["end"]) for s in spans])
                if last:
                    out.append(d.row(conv))
                    d = Digest()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*out))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                out = []

    one = F.col("last") & (F.col("part") == 0)
    more = parts.where(~one).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.where(one).mapInArrow(run, DIGESTS).union(more.mapInArrow(run, DIGESTS))


def formatted_digests(turns: DataFrame, **how) -> DataFrame:
    """Format, write, and read back."""
    return digests(keep(format_conversations(turns, **how)))
