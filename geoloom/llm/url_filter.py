"""URL rules with redirect equivalence, in DataFrame operations only.

A rule names a host and the start of a path; it fits the host and its
subdomains, and the longest that fits gives the verdict. Pages that redirect to
each other or name each other as canonical are one resource: components are
found over these links, and where one address of a component is blocked by a
rule, the block reaches the addresses that no rule judges. An explicit allow
comes first: an address that a rule allows stays allowed, and a component with
an allowed address passes no block on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import connected, fresh, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``? #``; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one. Rules are a caller's own short list; allow comes first among equals."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.allow)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(verdict)
    return text, verdict


def with_address(df: DataFrame, url: str, out: str) -> DataFrame:
    """``df`` and in ``out`` what tells resources apart: scheme and host in lower case, path and query, no fragment. Null without ``://``."""
    parts = fresh(df, "scheme", "host", "path", "query")
    u = F.col(url)
    split = df.withColumns(dict(zip(parts, (F.translate(F.regexp_extract(u, "(?s)^(.*?)://", 1), UPPER, LOWER), host(u), path(u), F.regexp_extract(u, "(?s)^[^#]*?(\\?[^#]*)", 1)))))
    scheme, own_host, own_path, query = map(F.col, parts)
    whole = F.concat(scheme, F.lit("://"), own_host, F.when(own_path == "", F.lit("/")).otherwise(own_path), query)
    return split.withColumn(out, F.when(F.contains(u, F.lit("://")), whole)).drop(*parts)


def _absolute(links: DataFrame) -> DataFrame:
    """``u to``: the target ``to`` of a link seen from its page ``u``: whole, from the same scheme, from the root, or beside the page."""
    u, to = F.col("u"), F.col("to")
    seen = links.withColumns({"scheme": F.regexp_extract(u, "(?s)^(.*?:)//", 1), "root": F.regexp_extract(u, "(?s)^(.*?://[^/?#]*)", 1), "at": path(u)})
    seen = seen.withColumn("beside", F.regexp_replace(F.col("at"), "[^/]*$", ""))
    target = (
        F.when(to.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat("scheme", "to"))
        .when(F.startswith(to, F.lit("/")), F.concat("root", "to"))
        .when(F.startswith(to, F.lit("?")), F.concat("root", "at", "to"))
        .when(to.rlike("(?s)^[^#?:]+($|[#?])"), F.concat(F.col("root"), F.when(F.col("beside") == "", F.lit("/")).otherwise(F.col("beside")), to))
    )
    return seen.select("u", target.alias("to"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a b``: addresses tied by ``<link rel=canonical>`` or an immediate ``<meta http-equiv=refresh>`` of a page."""
    html, tag = F.lower("h"), F.col("t")
    found = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where(F.contains(html, F.lit("canonical")) | F.contains(html, F.lit("refresh")))
    found = found.select("u", F.explode(F.regexp_extract_all("h", F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0))).alias("t"))
    is_link = tag.rlike("(?is)^<link\\b.*\\brel\\s*=\\s*[\"']?[^\"'>]*\\bcanonical\\b")
    is_meta = tag.rlike("(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*[\"']?refresh")
    named = F.regexp_extract(tag, "(?is)\\bhref\\s*=\\s*[\"']?\\s*([^\\s\"'>]*)", 1)
    moved = F.regexp_extract(tag, "(?is)\\bcontent\\s*=\\s*[\"']?\\s*\\d+(?:\\.\\d*)?\\s*[;,]\\s*(?:url\\s*=\\s*)?[\"']?\\s*([^\\s\"'>]*)", 1)
    found = found.withColumn("to", F.replace(F.when(is_link, named).when(is_meta, moved), F.lit("&amp;"), F.lit("&"))).where("to <> ''")
    whole = with_address(with_address(_absolute(found.select("u", "to")), "u", "a"), "to", "b")
    return whole.select("a", "b").where("a is not null and b is not null")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``page_id host path rule verdict`` of every page.

    ``redirects`` (``from_url to_url``, whole addresses) adds links to those in
    the pages. Null urls and such without ``://`` have empty hosts, no address and the
    verdict allow; repeated rows are judged alike. A rule's block reaches along
    links also through addresses that are no page. Only components' addresses take
    part in the rounds; pages meet the blocked ones in one join, which Spark splits if one
    address has many pages.
    """
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        own = with_address(with_address(redirects.select("from_url", "to_url"), "from_url", "a"), "to_url", "b").select("a", "b")
        links = own if links is None else links.union(own)
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = with_address(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")), "u", "address")
    judged = judged.withColumns({"host": host(F.col("u")), "path": path(F.col("u"))}).withColumns({"rule": text, "own": verdict})
    if links is not None:
        members = keep(connected(links))
        _, said = matching_rule(host(F.col("node")), path(F.col("node")), rules)
        by_root = members.withColumn("said", said).groupBy("root").agg(F.bool_or(F.col("said") == "block").alias("blocked"), F.bool_or(F.col("said") == "allow").alias("allowed"))
        reached = members.join(by_root.where("blocked and not coalesce(allowed, false)").select("root"), "root", "left_semi")
        judged = judged.join(reached.select(F.col("node").alias("address"), F.lit("block").alias("reached")), "address", "left")
    else:
        judged = judged.withColumn("reached", F.lit(None).cast("string"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "reached", F.lit("allow")).alias("verdict"))


def allowed(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """The rows of ``pages`` that are not blocked, unchanged; an id is kept or dropped with all its urls' verdicts."""
    blocked = judge(pages, rules, redirects, id_col, url_col, html_col).where("verdict = 'block'")
    (of,) = fresh(pages, "of")
    bad = blocked.select(F.col("page_id").alias(of)).distinct()
    return pages.join(bad, pages[id_col].eqNullSafe(bad[of]), "left_anti")
