"""Reply clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.fixtures import Tables
from geoloom.functions import text as X
from geoloom.registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_CLOSED = "regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g')"


def _skip(src: str, dst: str) -> str:
    after = _trim("substr(t, instr(t, chr(10) || chr(10)))")
    return (f"{dst} AS (SELECT conv_id, turn, raw, CASE WHEN regexp_matches(t, {_q(X.PLANNING)}) AND instr(t, chr(10) || chr(10)) > 0 "
            f"AND length({after}) >= 30 THEN {after} ELSE t END AS t FROM {src})")


_STRIP = f"""WITH s0 AS (SELECT conv_id, turn, text AS raw, {_trim("regexp_replace(" + _CLOSED.format("text") + ", '(?is)<(think|thinking|reasoning)>.*', '')")} AS t FROM fx_marked),
{_skip("s0", "s1")}, {_skip("s1", "s2")}, {_skip("s2", "s3")},
s4 AS (SELECT conv_id, turn, raw, {_trim("regexp_replace(t, " + _q(X.PARAGRAPH.replace("[^\\S\\n]", "[\\t ]")) + ", '', 'g')")} AS t FROM s3),
s5 AS (SELECT conv_id, turn, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\\s{{0,3}}#{{1,6}}\\s+', '', 'g'), '\\*\\*(.+?)\\*\\*', '\\1', 'g'),
  '(?m)^\\s*[-*]\\s+', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM s4)
SELECT conv_id, turn, CASE WHEN length(raw) = 0 THEN '' WHEN length(t) < 30 AND length(raw) >= 30 THEN {_q(X.UNFINISHED)} ELSE t END AS text FROM s5"""


@query("S10", "strip_meta", _STRIP)
def strip_meta(t: Tables):
    return t.fx_marked.select("conv_id", "turn", X.strip_meta(F.col("text")).alias("text"))


@query("S11", "looks_phantom", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, {_q(X.PHANTOM)}) THEN regexp_extract(text, {_q(X.PHANTOM)}, 1) END AS phrase FROM fx_marked""")
def looks_phantom(t: Tables):
    return t.fx_marked.select("conv_id", "turn", X.looks_phantom(F.col("text")).alias("phrase"))


@query("S11", "was_nudged", f"""SELECT conv_id, bool_or(role = 'system' AND contains(text, '{X.NUDGE_MARKER}')) AS nudged FROM fx_marked GROUP BY conv_id""")
def was_nudged(t: Tables):
    hit = (F.col("role") == "system") & F.col("text").contains(X.NUDGE_MARKER)
    return t.fx_marked.groupBy("conv_id").agg(F.bool_or(hit).alias("nudged"))
