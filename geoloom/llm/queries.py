"""The registered queries: each operator with production parameters over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo ``by``; a null id has none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


@register("op1_chat_formatting", """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(role, '(\\\\|</?s>|\\[/?INST\\])', '\\\\\\1', 'g') AS safe_role, regexp_replace(text, '(\\\\|</?s>|\\[/?INST\\])', '\\\\\\1', 'g') AS safe_text FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE role WHEN 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST][/INST]</s>') + length(safe_role) + length(safe_text)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.chat_template import formatted_digests

    hard = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, text FROM VALUES (0L, 'user', '{hard}'), (1L, 'assistant', '{hard}') AS v(turn, role, text)")
    return formatted_digests(turns.unionByName(own))


@register("op2_quality_neighbour_votes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.quality import CUT, fit, score

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, fit(docs, labels.where(remainder("doc_id", 5) != 0)))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


URL_RULES = (("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False))

_RULED = """
WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(html, '') AS html,
    lower(coalesce(regexp_extract(url, '(?s)^(.*?)://', 1), '')) AS scheme,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^#]*?(\\?[^#]*)', 1), '') AS query
  FROM pages),
own AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n),
addresses AS (
  SELECT n, html, scheme || '://' || host || CASE path WHEN '' THEN '/' ELSE path END || query AS address FROM parts WHERE scheme <> '' OR host <> ''),
linked AS (
  SELECT address AS a, regexp_extract(html, '(?is)<link\\b[^>]*\\brel="canonical"[^>]*\\bhref="([a-z]+://[^"#]*)', 1) AS b FROM addresses WHERE contains(html, 'canonical')),
edges AS (SELECT a, b FROM linked WHERE b <> '' UNION SELECT b, a FROM linked WHERE b <> ''),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
told AS (SELECT r.a AS address, o.verdict FROM reach r JOIN addresses x ON x.address = r.b JOIN own o USING (n)),
reached AS (SELECT address FROM told GROUP BY 1 HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
SELECT p.page_id, p.host, p.path, o.rule, coalesce(o.verdict, CASE WHEN r.address IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parts p LEFT JOIN own o USING (n) LEFT JOIN addresses x USING (n) LEFT JOIN reached r ON r.address = x.address
"""


@register("op3_redirect_equivalent_urls", _RULED)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.url_filter import Rule, judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), [Rule(*r) for r in URL_RULES])


@register("op4_mix_to_target_weights")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@register("op5_exact_top_k", """
WITH whole AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.n <> c.n WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.topk_search import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("op6_language_by_partial_matching")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.language import fit, predict

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs.where(remainder("doc_id", 4) != 2)))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@register("op7_packed_token_ids")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from geoloom.llm.token_files import TOKENIZER, token_digests

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))


@register("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.simhash_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@register("op9_viterbi_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from geoloom.llm.token_counts import VOCABULARY, token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@register("op10_benchmark_decontamination", f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS run, least(10, len(w)) AS size
  FROM items, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM runs),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
found AS (
  SELECT d.doc_id, r.item_id, i, r.size
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS run FROM docs, sizes, unnest(generate_series(1, len(w) - size + 1)) AS s(i)) AS d
  JOIN runs AS r ON r.run = d.run AND r.size = d.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM found) GROUP BY 1),
hits AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN hits USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.decontaminate import overlaps

    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _plus(cell: str, cost: str, edits: str) -> str:
    """A cell is its cost in nine digits and its audit, so that the least string is the least cell."""
    return f"(lpad(CAST(CAST({cell}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {cell}[10:] || '{edits}')"


_INSERTED = f"""c0 AS e0, c1 AS e1, least(c2, {_plus("c0", "3", "I")}, {_plus("c1", "3", "I")}, {_plus("c3", "3", "I")}) AS e2,
    least(c3, {_plus("c2", "3", "I")}, {_plus("c0", "6", "II")}, {_plus("c1", "6", "II")}) AS e3"""
_STEP = f"""
    {_plus("e0", "4", "D")} AS c0,
    least({_plus("e1", "4", "D")}, CASE WHEN free AND initial = 's' THEN {_plus("e0", "late", "K")} END) AS c1,
    least({_plus("e2", "4", "D")}, CASE WHEN free AND initial = 'u' THEN least({_plus("e0", "late", "K")}, {_plus("e1", "late", "K")}, {_plus("e3", "late", "K")}) END,
      CASE WHEN free THEN least({_plus("e0", "(3 + late)", "R")}, {_plus("e1", "(3 + late)", "R")}, {_plus("e3", "(3 + late)", "R")}) END) AS c2,
    least({_plus("e3", "4", "D")}, CASE WHEN free AND initial = 'a' THEN {_plus("e2", "late", "K")} END, CASE WHEN free THEN {_plus("e2", "(3 + late)", "R")} END) AS c3"""


@register("op11_conversation_repair", f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce([ascii(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
      lambda c, x: list_reduce(range(8), lambda v, i: CASE v % 2 WHEN 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(c, x)), 4294967295) AS crc
  FROM conversations),
coded AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS code FROM keyed),
rows AS (
  SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, conv_id, turn, role, text
  FROM (
    SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
      CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE code <> 0)),
told AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair
  FROM (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM rows)),
facts AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY 1),
cells(conv_id, n, c0, c1, c2, c3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM facts
  UNION ALL
  SELECT conv_id, n, {_STEP}
  FROM (
    SELECT conv_id, c.n + 1 AS n, {_INSERTED}, t.fault NOT IN (1, 2) AS free, t.role[1] AS initial, CASE t.fault WHEN 3 THEN 3 ELSE 0 END AS late
    FROM cells c JOIN told t USING (conv_id) WHERE t.n = c.n + 1)),
best AS (
  SELECT conv_id, CAST(cell[1:9] AS BIGINT) AS cost, cell[10:] AS audit
  FROM (SELECT conv_id, least(e0, e3) AS cell FROM (SELECT conv_id, n, {_INSERTED} FROM cells) JOIN facts USING (conv_id) WHERE n = size)),
edits AS (
  SELECT conv_id, edit, i, count(*) FILTER (WHERE edit <> 'I') OVER w AS n, count(*) FILTER (WHERE edit <> 'D') OVER w AS k
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS i FROM best WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
made AS (
  SELECT e.conv_id, i, edit, k, t.role, CASE edit WHEN 'I' THEN '' ELSE t.text END AS text,
    max(CASE WHEN k = 1 AND edit = 'K' AND t.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN told t ON t.conv_id = e.conv_id AND t.n = e.n AND edit <> 'I' WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256
  FROM made GROUP BY 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.conversation_repair import damaged, repair_digests

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_digests(damaged(turns), turns)


@register("op12_filter_interaction_audit", """
WITH letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, l.b AS own, (SELECT coalesce(sum(p.b), 0) FROM letters p WHERE contains(filter_order[1:s - 1], p.l)) AS before
  FROM orders, generate_series(1, 5) AS g(s), letters l WHERE l.l = filter_order[s]),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts),
flags AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 1 ELSE 0 END) AS good, max(CASE toxic WHEN 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN flags USING (doc_id) GROUP BY 1, 2)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.filter_audit import audit

    return audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op13_exact_dedup", """
WITH texts AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
sizes AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN sizes USING (text_sha256)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.exact_dedup import exact_groups

    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
