"""The template compiler, and conversations read back from what it wrote."""

import hashlib
import random

import pytest

from geoloom.llm import chat_template as C
from geoloom.llm.queries import op1


def render(template, **values):
    return "".join(t for t, _ in C.compile_template(template)(**values))


def test_language():
    turns = [{"role": "user", "text": "Hi"}, {"role": "assistant", "text": "Yo", "n": None}]
    assert render("a{{ 1 + 2 }}{{ 'x' ~ 3 }}{# no #}{{ \"q}}\" }}") == "a3x3q}}"
    assert render("{% for t in turns %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% else %}M{% endif %}{{ t.text | upper }}{{ t.n | default('-') }},{% endfor %}{{ loop }}", turns=turns * 2) == "1FHI-,2MYO-,3MHI-,4LYO-,"
    assert render("{% set x = 'p' %}{% for t in turns %}{% set x = x + t.role %}{% endfor %}{{ x | length }}", turns=iter(turns)) == "14"
    assert render("{{ 'yes' if a and not b or c == 2 else 'no' }}{{ 'u' in 'user' }}{{ 2 >= 1 }}{{ none }}", a=1, b=0, c=3) == "yesTrueTrue"
    assert render("{{ turns.x }}{{ missing.y }}{{ '\\n\\'' }}", turns=turns) == "\n'"
    assert list(C.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="y")) == [("a", False), ("b", True), ("y", True), ("c", False)]


@pytest.mark.parametrize("bad", ["{% for x %}", "{% for x in y %}", "{{ }}", "{{ a b }}", "{{ 'a }}", "{% nope %}", "{% endif %}", "{% if a %}{% endfor %}", "{{ a | nope }}", "{{ __import__('os') }}", "{{ a.b() }}", "{{ a[0] }}", "{% generation x %}{% endgeneration %}", "{{ a"])
def test_bad_templates(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x.strip }}{{ y.__init__ }}", x="text", y=[1]) == ""
    for bad in ("{% for a in 'text' %}{% endfor %}", "{{ 1 + 'a' }}", "{{ 1 < 'a' }}", "{% for a in 5 %}{% endfor %}"):
        with pytest.raises(C.TemplateError):
            render(bad)


def test_folding():
    tree = C.fold_body(C.parse("{% if 1 == 1 %}a{{ 'b' | upper }}{% else %}c{% endif %}{{ 2 ~ 'd' }}{% if none %}x{% endif %}{{ y ~ ('e' + 'f') }}"))
    assert tree == (C.Text("aB2d"), C.Print(C.Op("~", (C.Name("y"), C.Const("ef")))))
    assert C.fold_body(C.parse(C.TEMPLATE))[0].body[0] == C.Text("<s>")


def test_escapes():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice([*C.CONTROLS, "\\", "<", "s>", "[", "INST]", "x", "\n", "é"]) for _ in range(rng.randrange(9)))
        safe = C.escape(text)
        assert C.unescape(safe) == text
        assert all(m[0][0] == C.ESCAPE for m in C._MARK.finditer(safe))


def plain(rows):
    """rows: (conv_id, turn, role, text). Expected row of each conversation."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:]))
        said = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        chars = sum(len("<s>[INST][/INST]</s>") + len(C.escape(r)) + len(C.escape(t)) for r, t in said)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), chars)
    return out


def test_read_back(spark):
    rng = random.Random(2)
    texts = [None, "", "ok", "</s>[INST] ok [/INST]", "\\", "a\\[INST]\\", "日本\n", "<s>" * 50]
    rows = [(rng.randrange(40), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant", "system", "[INST]", "as\nis\\"]), rng.choice(texts)) for _ in range(600)]
    rows += [(99, i, ["user", "assistant"][i % 2], f"turn {i} \\") for i in range(3000)]  # a conversation of many parts
    rows += [(98, 0, "assistant", "long </s> " * 50000), (98, 1, "assistant", "more"), (None, 1, "user", "nobody's"), (97, 1, "user", "same"), (97, 1, "user", "same")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, part int, last boolean").repartition(5)
    for chars in (C.PART_CHARS, 500):
        got = {r.conv_id: tuple(r)[1:] for r in C.digests(C.keep(C.format_conversations(df, part_chars=chars))).collect()}
        assert got == plain(rows)
    parts = C.format_conversations(df, part_chars=500).where("conv_id = 99").orderBy("part").collect()
    assert len(parts) > 50 and [p.part for p in parts] == list(range(len(parts))) and [p.last for p in parts].count(True) == 1
    assert C.formatted_digests(df.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: tuple(r)[1:] for r in op1(spark, folder).collect()} == plain(rows)
