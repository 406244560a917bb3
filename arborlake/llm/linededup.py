"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.urlfilter import host_of
from arborlake.runtime import durable, small_side

#: Removed from the html before it is split; then each tag or line end ends a line. In order.
UNSEEN = ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?s)<!--.*?-->")
BREAK = "<[^>]*>|[\\r\\n]"


def html_lines(html: Column) -> Column:
    """The non-empty lines of visible text, trimmed of spaces, in order; null html has none."""
    html = F.coalesce(html, F.lit(""))
    for pattern in UNSEEN:
        html = F.regexp_replace(html, pattern, "")
    return F.filter(F.transform(F.split(html, BREAK), lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, text (the kept lines, joined by line ends).

    A line is dropped on a host if it stands on more than ``ratio`` of the host's pages and on at least
    ``min_pages`` of them: two, as a line on one page repeats nothing within its site (else a host of one page would lose
    all). A page counts once for a line however often it repeats it, and repeated rows count as pages of their own. Lines of 128-bit digest equality are the same line. Pages
    without a url or ``://`` share the empty host. Null html gives no lines and an empty text.

    What is counted leaves a map task as one row per host and line; the dropped lines of a host are at
    most its lines per page divided by ``ratio``, so they travel as one bounded array per host.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    rows = durable(rows, "lines")
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line"))
    often = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = often.join(total, "host").where(F.col("n") > F.col("pages") * ratio)
    site = durable(often.groupBy("host").agg(F.collect_list("line").alias("boilerplate")), "boilerplate")
    site = site.select(F.col("host").alias("_host"), "boilerplate")
    out = rows.join(small_side(site, 20_000), F.col("host") == F.col("_host"), "left")
    own = F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), _key(x)))
    out = out.withColumn("kept", F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(own))
    dropped = (F.size("lines") - F.size("kept")).cast("long")
    return out.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )
