"""URL block lists whose decisions follow redirects and canonical links; built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.components import connected_components
from arborlake.llm.text import ascii_lower
from arborlake.runtime import durable, small_side


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """The lower-cased host, up to ``/``, ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """The path after the host, up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A page's identity for aliases: host, path and query, without scheme and fragment; null without host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` (with columns host and path) with a column r: struct(rule, action) of the longest rule that fits, else null.

    rules: (action, host, path prefix). A rule fits its host and all subdomains. Of rules of equal length the one that sorts
    last wins; of one rule given with both actions, allow. Rules are looked up, not tried in turn: for each number of labels
    that their hosts have, the last so many labels of a page's host are joined with the rules of that host, by broadcast
    while the rules are measured to be small. No rules leave all rows null.
    """
    none = F.lit(None).cast("struct<rule:string,action:string>")
    if not rules:
        return rows.withColumn("r", none)
    names, found = ("action", "name", "prefix"), []
    given = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, r, strict=True)]) for r in rules])
    table = rows.sparkSession.range(1).select(F.inline(given))
    rule = F.concat("name", "prefix")
    choice = F.struct(F.length(rule).alias("n"), rule.alias("rule"), (F.col("action") == "allow").alias("allow"), "action", "prefix")
    for depth in sorted({name.count(".") + 1 for _, name, _ in rules}):
        own = table.where(F.size(F.split("name", r"\.")) == depth).groupBy("name").agg(F.collect_list(choice).alias(f"rules{depth}"))
        own = own.withColumnRenamed("name", f"name{depth}")
        tail = F.when(F.size(F.split("host", r"\.")) >= depth, F.substring_index("host", ".", -depth))
        rows = rows.join(small_side(own), tail == F.col(f"name{depth}"), "left").drop(f"name{depth}")
        found.append(f"rules{depth}")
    every = F.flatten(F.array_compact(F.array(*found)))
    best = F.array_max(F.filter(every, lambda x: F.col("path").startswith(x["prefix"])))
    kept = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action"))).otherwise(none)
    return rows.withColumn("r", kept).drop(*found)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))


def _without_dots(path: Column) -> Column:
    """``path`` without its segments ``.`` and, with the segment before each, ``..``."""
    parts, none = F.split(path, "/"), F.expr("cast(array() as array<string>)")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    push = lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    clean = F.array_join(F.concat(F.aggregate(parts, none, push), end), "/")
    return F.when(path.rlike(r"/\.\.?(/|\z)"), clean).otherwise(path)


def _absolute(url: Column, link: Column) -> Column:
    """``link`` as found on ``url``: absolute, or relative to the scheme, the host, the path or the query; null for a
    fragment alone, nothing, and other schemes."""
    link, host, path = F.trim(link), F.concat(F.lit("http://"), host_of(url)), path_of(url)
    own, more = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)\z", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"[^/]*\z", ""), "^/", ""))
    below = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when((link == "") | link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("?"), F.concat(host, path, link))
        .otherwise(F.concat(host, _without_dots(below), more))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of the targets of their canonical links and refresh redirects.

    The first canonical link of a page counts and its first refresh, absolute or relative to the page. Null html or url give
    none, nor do links of other schemes than http and https.
    """
    html, url = F.col("html"), F.col("url")
    tag = lambda pattern: F.regexp_extract(html, pattern, 0)
    canonical = _attribute(tag(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), "href")
    refresh = tag(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""")
    refresh = F.regexp_extract(_attribute(refresh, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    some = pages.select(url, html).where(html.rlike("(?i)canonical|refresh"))
    out = some.select(node_of(url).alias("a"), F.explode(F.array(canonical, refresh)).alias("link"), url)
    return out.select("a", node_of(_absolute(url, F.col("link"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict.

    pages: page_id, url, html (further columns are ignored). redirects: known (source, target) urls, optional.
    A page under a rule gets the rule's action. Pages, redirects and canonical links make classes of
    aliases; a page without a rule is blocked if its class holds a blocked url and no allowed one
    (allow takes precedence), else allowed. Link targets that are no pages count with the rule
    that fits them. Null urls and those without ``://`` have no aliases and are allowed. Repeated pages
    give repeated rows; an empty table gives an empty one.
    """
    edges = alias_links(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rule(judged, rules)
    roots = durable(connected_components(edges), "aliases")
    as_url = roots.select("root", F.concat(F.lit("x://"), "node").alias("u"))
    known = with_rule(as_url.select("root", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), rules)
    action = F.col("r.action")
    classes = known.groupBy("root").agg(F.max(action == "block").alias("block"), F.max(action == "allow").alias("allow"))
    classes = classes.where("block AND NOT coalesce(allow, false)").select("root")
    blocked = roots.join(classes, "root", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("by_alias"))
    # pages that need no alias have keys of their own, which no node equals, so that they are not all one null key
    node = F.when(F.col("r").isNull(), node_of(F.col("url")))
    key = F.coalesce(node, F.concat(F.lit("\u0000"), F.xxhash64("page_id", "url").cast("string")))
    out = judged.join(small_side(durable(blocked, "blocked")), key == F.col("alias"), "left")
    verdict = F.coalesce(action, F.when(F.col("by_alias"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
