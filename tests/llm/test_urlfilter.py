import random

from graphquarry.llm import urlfilter as U
from graphquarry.llm.components import components


def test_components_match_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs += [(5000, 5000 + i) for i in range(1, 120)] + [(7, 7), (9999, 9999)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    links = spark.createDataFrame([*pairs, (None, 3), (3, None)], "left long, right long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {n: find(n) for n in top}


def test_no_links_give_no_components(spark):
    assert components(spark.createDataFrame([], "left long, right long")).collect() == []


def page(i, url, html=""):
    return (i, url, html)


def verdicts(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages, **options).collect()}


def test_rules_longest_wins_and_subdomains_fit(spark):
    got = verdicts(spark, [
        page(1, "https://A.Example.NET/en/1?x#y"), page(2, "http://example.net/de/"), page(3, "http://notnet/"),
        page(4, "http://x.net"), page(5, None), page(6, "no scheme"), page(7, "http://example.org/fr/x"), page(8, ""),
        page(9, "ftp://h?a://b/"),
    ])
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"),
        3: ("notnet", "/", None, "allow"), 4: ("x.net", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("example.org", "/fr/x", "org/fr/", "allow"), 8: ("", "", None, "allow"),
        9: ("h", "", None, "allow"),
    }


def test_blocks_reach_aliases_and_allow_takes_precedence(spark):
    canonical = '<head><link REL="canonical" href="{}"></head>'
    rows = [
        page(1, "http://a.example.org/x", canonical.format("http://bad.net/1")),
        page(2, "http://b.example.org/x", canonical.format("http://a.example.org/x#top")),
        page(3, "http://c.example.org/x", canonical.format("//bad.net/2")),
        page(4, "http://c.example.org/y", '<meta http-equiv=refresh content="0; url=/x">'),
        page(5, "http://d.example.org/x", canonical.format("http://example.net/en/1") + canonical.format("http://bad.net/1")),
        page(6, "http://bad.net/1", ""), page(7, "http://e.example.org/", canonical.format("http://f.example.org/")),
        page(8, "https://c.example.org/x", None),
    ]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    # 5 ties the first component to an allowed page; 6 keeps its own rule
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "block"}


def test_redirect_log_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "http://q.example.org/a", None, "old"), (1, "http://q.example.org/a", None, "old")],
        "page_id long, url string, html string, host string",
    )
    log = spark.createDataFrame([("http://q.example.org/a", "http://z.net/")] * 2 + [(None, "http://z.net/")], "left string, right string")
    rows = U.judge(pages, edges=log).collect()
    assert [(r["host"], r["verdict"]) for r in rows] == [("q.example.org", "block")] * 2
    assert U.judge(pages.limit(0)).count() == 0
