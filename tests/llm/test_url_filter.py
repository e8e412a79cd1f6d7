"""Rules and links on small pages; the query against its SQL is in test_queries.py."""

from geoloom.llm import url_filter as U

RULES = [U.Rule("org", "/", True), U.Rule("example.org", "/es/", False), U.Rule("example.org", "/en/1", False), U.Rule("com", "/fr/", True), U.Rule("com", "/de/", False)]
SCHEMA = "page_id long, url string, html string, host string, rule int, address string, a int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", 2) for i, u, h in rows], SCHEMA)


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1?x=/fr/", None), (2, "https://example.org/en/12", ""), (3, "http://example.org/en/21#/es/", ""), (4, "http://notexample.org/es/", ""),
        (5, "http://x.com/de/#q", ""), (6, "x.com/de/", ""), (7, None, ""), (8, "http://com/fr/é", ""), (9, "http://x.COM", ""), (10, "http://x.com?/de/", ""), (11, "://org/", ""), (12, "http://x.com:80/de/", ""),
        (13, "http://a/b://org/", ""), (14, "", "<link>"), (15, "http://example.org/es", ""), (16, "http://x.com/de/" + "y" * 300000, ""),
    ]
    got = verdicts(U.judge(pages(spark, rows), RULES))
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("example.org", "/en/21", "org/", "allow")
    assert got[4] == ("notexample.org", "/es/", "org/", "allow")
    assert got[5] == ("x.com", "/de/", "com/de/", "block")
    assert got[6] == got[7] == got[14] == ("", "", None, "allow")
    assert got[8] == ("com", "/fr/é", "com/fr/", "allow")
    assert got[9] == ("x.com", "", None, "allow") and got[10] == ("x.com", "", None, "allow")
    assert got[11] == ("org", "/", "org/", "allow")
    assert got[12] == ("x.com:80", "/de/", None, "allow")
    assert got[13] == ("a", "/b://org/", None, "allow")
    assert got[15][2:] == ("org/", "allow") and got[16][2:] == ("com/de/", "block")


def test_blocks_reach_aliases(spark):
    canonical = lambda u: f'<head><LINK href="{u}" rel="canonical"/></head>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://x.com/de/1", ""), (2, "http://alias.net/1", canonical("http://X.com/de/1#top")), (3, "http://alias.net/2", refresh("http://alias.net/1")),
        (4, "http://alias.net/2#frag", ""), (5, "http://alias.net/2", None), (6, "http://other.net/", ""), (7, "http://good.com/fr/", canonical("http://alias.net/1")),
        (10, "http://only.net/a", canonical("/b")), (11, "http://only.net/b", ""), (12, "http://only.net/c", canonical("//x.com/de/9")), (13, "http://only.net/d/e", canonical("../up")), (14, "http://only.net/d/", canonical("f?x=1&amp;y=2")),
        (15, "http://only.net/d/f?x=1&y=2", canonical("http://z.com/de/")), (16, "http://loop.net/", canonical("http://loop.net/")), (None, "http://alias.net/9", canonical("http://x.com/de/2")),
        (20, "http://text.net/", "canonical refresh <a href='http://x.com/de/1'>"), (21, "http://chain.net/0", ""),
    ]
    moves = spark.createDataFrame([(f"http://chain.net/{i}", f"http://chain.net/{i + 1}") for i in range(40)] + [("http://chain.net/40", "http://x.com/de/1234"), (None, "http://a.b/"), ("x", "y")], "from_url string, to_url string")
    got = {i: v[3] for i, v in verdicts(U.judge(pages(spark, rows), RULES, moves)).items()}
    # 7 is allowed by rule and tied to 1, 2 and 3: no block passes on
    assert {i: got[i] for i in (1, 2, 3, 4, 5, 6, 7)} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert {i: got[i] for i in (10, 11, 12, 14, 15, 16, None, 20, 21)} == {10: "allow", 11: "allow", 12: "block", 14: "block", 15: "block", 16: "allow", None: "block", 20: "allow", 21: "block"}
    without = {i: v[3] for i, v in verdicts(U.judge(pages(spark, [r for r in rows if r[0] != 7]), RULES)).items()}
    assert [without[i] for i in (1, 2, 3, 4, 5, 21)] == ["block"] * 5 + ["allow"]
    left = U.allowed(pages(spark, rows), RULES, moves)
    assert left.columns == pages(spark, rows).columns and {r.page_id for r in left.collect()} == {i for i, v in got.items() if v == "allow"}


def test_hot_address_and_empty(spark):
    rows = [(i, "http://hot.net/", '<link rel="canonical" href="http://x.com/de/1">') for i in range(300)]
    assert {v[3] for v in verdicts(U.judge(pages(spark, rows), RULES)).values()} == {"block"}
    assert U.judge(pages(spark, []), RULES).count() == 0
