"""URL filter lists whose decisions reach every alias of a page.

A rule names a host and a path prefix and blocks or allows; it fits its host and all subdomains, and
the longest fitting rule decides. URLs no rule decides are judged by redirect equivalence: redirects and
canonical links are edges, connected components of them are aliases of one page, and what a rule says
about any alias holds for all. An explicit allow takes precedence over blocks within a component; a URL
that a rule fits keeps its own rule's verdict; with no rule anywhere the default is allow.

All of it is DataFrame expressions and joins. Rules are a configured list, compared inside the row as
one literal array of at most ``MAX_RULES``; only pages with a link between different URLs
take part in a shuffle, next to one lookup of undecided pages in the table of decided aliases.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed;
null or empty HTML gives no edge; relative link targets are resolved against their page; repeated rows are
judged alike; among equally long fitting rules allow wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from graphquarry.llm.common import kept, table, without
from graphquarry.llm.components import components

MAX_RULES = 1000
RESULT = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


RULES = (
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
)

_TAG = r"(?is)<(?:link|meta)\b[^>]{0,4000}>"
_CANONICAL = r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (length, verdict, rule), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<length:int,allows:boolean,rule:string>")
    fitting = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host) + len(r.path)).alias("length"), F.lit(r.verdict == "allow").alias("allows"),
                F.lit(r.host + r.path).alias("rule"),
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fitting))


def page_key(url: Column) -> Column:
    """What names a page: host, path and query; scheme and fragment do not tell pages apart."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def resolved(target: Column, url: Column) -> Column:
    """An absolute form of a link target found on the page at ``url``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    host, path = host_and_path(url)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (left, right) between page keys from canonical links and refresh redirects in the HTML."""
    tags = F.regexp_extract_all(F.col(html), F.lit(_TAG), F.lit(0))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(
        F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1)
    )
    plain = F.replace(target, F.lit("&amp;"), F.lit("&"))
    return (
        pages.where(F.col(html).rlike(f"{_CANONICAL}|{_REFRESH}"))
        .select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
        .select("url", plain.alias("target")).where("target <> ''")
        .select(page_key(F.col("url")).alias("left"), page_key(resolved(F.col("target"), F.col("url"))).alias("right"))
        .where("left <> right")
    )


def alias_verdicts(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, allows) for every page key in a component that some rule decides; an allow wins."""
    named = kept(components(edges), "urlfilter-components")
    host = F.regexp_extract("node", r"(?s)^([^/]*)", 1)
    path = F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    decided = kept(
        named.withColumn("best", best_rule(host, path, rules)).where("best IS NOT NULL")
        .groupBy("component").agg(F.bool_or("best.allows").alias("allows")),
        "urlfilter-decided",
    )
    return kept(named.join(decided, "component").select(F.col("node").alias("key"), "allows"), "urlfilter-aliases")


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, edges: DataFrame | None = None,
    url: str = "url", html: str | None = "html",
) -> DataFrame:
    """Add host, path, the deciding rule and the verdict to every page.

    Edges come from the pages' HTML and from ``edges`` (columns left and right, URLs), such as a redirect log.
    """
    pages = without(pages, *RESULT)
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"host": host, "path": path})
    judged = judged.withColumn("best_", best_rule(F.col("host"), F.col("path"), rules))
    known = [links(pages, url, html)] if html is not None else []
    if edges is not None:
        known.append(edges.select(page_key(F.col("left")).alias("left"), page_key(F.col("right")).alias("right")))
    allows = F.col("best_.allows")
    if known:
        found = kept(known[0].unionByName(known[1]) if len(known) > 1 else known[0], "urlfilter-links")
        if not found.isEmpty():
            aliases = alias_verdicts(found, rules)
            # decided pages stay out of the join, where their missing keys would meet in one task
            undecided = judged.where("best_ IS NULL").withColumn("key_", page_key(F.col(url)))
            looked_up = undecided.where("key_ IS NOT NULL").join(
                aliases.select(F.col("key").alias("key_"), F.col("allows").alias("alias_")), "key_", "left"
            )
            rest = judged.where("best_ IS NOT NULL").unionByName(undecided.where("key_ IS NULL"), allowMissingColumns=True)
            judged = looked_up.unionByName(rest, allowMissingColumns=True)
            allows = F.coalesce("best_.allows", "alias_")
    verdict = F.when(F.coalesce(allows, F.lit(True)), "allow").otherwise("block")
    return judged.select(*pages.columns, "host", "path", F.col("best_.rule").alias("rule"), verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
