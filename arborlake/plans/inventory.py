"""Queries of the file-inventory pipelines over the driver's tables, and their SQL twins."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake import relation
from arborlake.functions.calendar import Boundaries
from arborlake.functions.paths import base_name
from arborlake.functions.shell import deletion_line, distinct_trash_names, flat_name, shell_quote, trash_name
from arborlake.functions.sizes import human_bytes, human_bytes_column, size_bucket, timestamp_text
from arborlake.operators import aggregate, duplicates, filters, folders, listing
from arborlake.runtime import read_table, shared_path
from arborlake.sources.baseline import read_baseline, save_baseline
from arborlake.sources.fstree import scan_tree

CORPUS, SITES, EVENTS = "/corpus", "/", "/events"
#: Extensions, size and dates that the queries ask for.
WANTED, MIN_SIZE, EVENT_DAY, ORDER_DAY, ORDER_YEAR_DAY = frozenset({"html", "(none)"}), 2048, date(2024, 1, 20), date(1998, 7, 2), date(2001, 8, 1)
SPLIT_MS = 1_704_326_400_000  # 2024-01-04


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return relation.with_extension(relation.of_documents(read_table(spark, d, "documents")))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return relation.with_extension(relation.of_pages(read_table(spark, d, "pages")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return relation.with_extension(relation.of_events(read_table(spark, d, "events")))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return relation.of_orders(read_table(spark, d, "orders"))


def agg_by_extension(spark, d):
    return aggregate.by_extension(_pages(spark, d))


def agg_by_size_bucket(spark, d):
    return aggregate.by_size_bucket(_docs(spark, d))


def agg_by_date_cumulative(spark, d):
    return aggregate.by_date(_events(spark, d), Boundaries.of(EVENT_DAY))


def agg_by_date_week_clip(spark, d):
    return aggregate.by_date(_orders(spark, d), Boundaries.of(ORDER_DAY))


def agg_prior_years(spark, d):
    return aggregate.by_prior_year(_orders(spark, d), Boundaries.of(ORDER_YEAR_DAY))


def agg_date_table(spark, d):
    return aggregate.date_table(_orders(spark, d), Boundaries.of(ORDER_YEAR_DAY))


def agg_totals(spark, d):
    return aggregate.totals(_docs(spark, d))


def agg_grouping_sets(spark, d):
    return aggregate.report_cube(_docs(spark, d))


def filter_min_size(spark, d):
    return filters.at_least(_docs(spark, d), MIN_SIZE).select("path", "size")


def filter_extensions(spark, d):
    return filters.with_extensions(_pages(spark, d), WANTED).select("path", "extension", "size")


def filter_tally(spark, d):
    return filters.filter_tally(_pages(spark, d), MIN_SIZE, WANTED)


def exclude_subtree(spark, d):
    return filters.outside_folders(_docs(spark, d), ["de"]).select("path", "size")


def _ranked(files: DataFrame, key: str) -> DataFrame:
    return listing.ranked(files.select("path", "size", "mtime_ms"), key).select("rank", "path", "size", timestamp_text(F.col("mtime_ms")).alias("modified"))


def list_by_path(spark, d):
    return _ranked(_docs(spark, d), "path")


def list_by_size(spark, d):
    return _ranked(_docs(spark, d), "size")


def list_by_date(spark, d):
    return _ranked(_events(spark, d), "date")


def _with_rank(rows: DataFrame, *by) -> DataFrame:
    return listing.numbered(rows, *by).withColumn("rank", F.col("rank").cast("int"))


def list_display(spark, d):
    """The text columns of a listing by size, in its own order of columns."""
    shown = listing.ranked(_events(spark, d).select("path", "size", "mtime_ms"), "size")
    cells = listing.display(shown, "size", "rank")
    return cells.select("rank", F.concat_ws(" | ", *[c for c in cells.columns if c != "rank"]).alias("line"))


def folder_direct(spark, d):
    return folders.direct(_docs(spark, d))


def folder_rollup(spark, d):
    rows = folders.roll_up(folders.direct(_docs(spark, d)), CORPUS)
    rows = rows.where((F.col("folder") == CORPUS) | (F.col("bytes") >= 10_000))
    return _with_rank(rows, F.desc("bytes"), F.asc("folder"))


def folder_rollup_collapsed(spark, d):
    return folders.report_rows(_pages(spark, d), SITES)


def _user_folders(files: DataFrame) -> DataFrame:
    return folders.roll_up(folders.direct(files), EVENTS)


def folder_growth(spark, d):
    events = _events(spark, d)
    return folders.growth(_user_folders(events.where(F.col("mtime_ms") < SPLIT_MS)), _user_folders(events), 1000.0)


def folder_new(spark, d):
    events = _events(spark, d)
    return folders.appeared(_user_folders(events.where(F.col("mtime_ms") < SPLIT_MS)), _user_folders(events))


def folder_growth_ranked(spark, d):
    """The order of the report: most growth first."""
    return _with_rank(folder_growth(spark, d), F.desc("pct"), F.asc("folder"))


def folder_new_ranked(spark, d):
    """The order of the report: largest first."""
    return _with_rank(folder_new(spark, d), F.desc("bytes"), F.asc("folder"))


def baseline_roundtrip(spark, d):
    """Growth against a snapshot that was written as a table in the file's format and read back."""
    events = _events(spark, d)
    file = shared_path(spark, "baseline")
    save_baseline(_user_folders(events.where(F.col("mtime_ms") < SPLIT_MS)), datetime(2024, 1, 4, tzinfo=UTC), file)
    _, before = read_baseline(spark, file)
    return folders.growth(before, _user_folders(events), 1000.0)


def scan_files(spark, d):
    """A real tree: the folder that the tables lie in, as far as this machine sees it."""
    return scan_tree(spark, d).select("entry_kind", "name", "size")


def dup_size_candidates(spark, d):
    return duplicates.same_size(_docs(spark, d).drop("content")).select("path", "size")


def dup_small_hash(spark, d):
    files = duplicates.same_size(duplicates.content_digests(_docs(spark, d)))
    return duplicates.repeated(files, "size", "head").select("path", "size", "head")


def _digested(spark, d):
    return duplicates.same_size(duplicates.content_digests(_docs(spark, d))).select("path", "size", "digest", "doc_id")


def dup_groups(spark, d):
    return duplicates.groups(_digested(spark, d))


def dup_groups_ranked(spark, d):
    """The order of the script: most to gain first, then by the path that stays."""
    return _with_rank(dup_groups(spark, d), F.desc("waste"), F.asc("keeper"))


def dup_members(spark, d):
    return duplicates.members(_digested(spark, d)).select("path", "size", "position", "n", "waste")


def dup_redundant(spark, d):
    return duplicates.redundant(_digested(spark, d)).select("path", "size")


def dup_summary(spark, d):
    return duplicates.summary(dup_groups(spark, d))


def dup_hardlink_collapse(spark, d):
    files = _digested(spark, d)
    # within a content, documents of equal parity stand for names of one inode
    return duplicates.groups(duplicates.one_name_per_inode(files.withColumns({"dev": F.col("doc_id") % 2, "ino": F.xxhash64("digest")}))).drop("digest")


def human_sizes(spark, d):
    files = _docs(spark, d)
    return files.select("path", human_bytes(F.col("size")).alias("text"), human_bytes_column(F.col("size")).alias("cell"), size_bucket(F.col("size")).alias("bucket"))


def shell_quoting(spark, d):
    return read_table(spark, d, "documents").select("doc_id", shell_quote(F.col("text")).alias("quoted"))


def emit_deletion(spark, d):
    path = F.col("path")
    files = _docs(spark, d)
    return files.select("path", deletion_line(path, trash_name(path), False).alias("soft"), deletion_line(path, trash_name(path), True).alias("hard"))


def trash_names(spark, d):
    return _pages(spark, d).select("path", flat_name(F.col("path")).alias("name"), base_name(F.col("path")).alias("base"))


def trash_names_long(spark, d):
    """Names beyond what a file system takes: whole texts as paths."""
    return read_table(spark, d, "documents").select("doc_id", trash_name(F.col("text")).alias("name"))


def trash_names_distinct(spark, d):
    """Names of paths that meet in one trash folder: the n-th of a name gets a suffix."""
    files = _pages(spark, d)
    return distinct_trash_names(files.select("path"))


QUERIES = {
    f.__name__: f
    for f in (
        agg_by_extension, agg_by_size_bucket, agg_by_date_cumulative, agg_by_date_week_clip, agg_prior_years, agg_date_table, agg_totals, agg_grouping_sets,
        filter_min_size, filter_extensions, filter_tally, exclude_subtree, list_by_path, list_by_size, list_by_date, list_display,
        folder_direct, folder_rollup, folder_rollup_collapsed, folder_growth, folder_new, folder_growth_ranked, folder_new_ranked, baseline_roundtrip, scan_files,
        dup_size_candidates, dup_small_hash, dup_groups, dup_groups_ranked, dup_members, dup_redundant, dup_summary, dup_hardlink_collapse,
        human_sizes, shell_quoting, emit_deletion, trash_names, trash_names_long, trash_names_distinct,
    )
}

_DOCS = "SELECT doc_id, '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, encode(text) AS content FROM documents"
_PAGES = """SELECT path, size, CASE WHEN e = '' THEN '(none)' ELSE e END AS extension FROM (
  SELECT path, size, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(?s)^.+[.]([^.]+)$', 1)) AS e FROM (
  SELECT regexp_replace(regexp_extract(url, '^[^:]*:/(/[^?#]*)', 1), '/$', '') AS path, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size FROM pages))"""
_EVENTS = "SELECT '/events/' || event_type || '/' || user_id || '/' || event_id || '.json' AS path, CAST(octet_length(encode(coalesce(props, ''))) AS BIGINT) AS size, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS mtime_ms FROM events"
_ORDERS = "SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS size, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000 AS mtime_ms FROM orders"
_BUCKET = "CASE WHEN size <= 1024 THEN 0 WHEN size <= 1048576 THEN 1 WHEN size <= 20971520 THEN 2 WHEN size <= 1073741824 THEN 3 ELSE 4 END"
_LABELS = "(VALUES (0, '<= 1KB'), (1, '> 1KB and <= 1MB'), (2, '> 1MB and <= 20MB'), (3, '> 20MB and <= 1GB'), (4, '> 1GB')) l(ordinal, bucket)"


def _date_sql(files: str, day: date) -> str:
    """Boundaries by date arithmetic of the database, buckets by nested tests."""
    return f"""
WITH b AS (SELECT d, epoch_ms(CAST(d AS TIMESTAMP)) AS t0, epoch_ms(CAST(d + 1 AS TIMESTAMP)) AS t1, epoch_ms(CAST(d - CAST(dayofweek(d) AS INTEGER) AS TIMESTAMP)) AS w,
    epoch_ms(CAST(date_trunc('month', d) AS TIMESTAMP)) AS m, epoch_ms(CAST(date_trunc('year', d) AS TIMESTAMP)) AS y FROM (SELECT DATE '{day}' AS d)),
f AS (SELECT size, mtime_ms, CASE WHEN mtime_ms >= t1 OR mtime_ms < y THEN 0 WHEN mtime_ms < m THEN 1 WHEN mtime_ms < w THEN 2 WHEN mtime_ms < t0 THEN 3 ELSE 4 END AS depth FROM ({files}), b),
l(ordinal, bucket, need) AS (VALUES (0, 'today', 4), (1, 'this week', 3), (2, 'this month', 2), (3, 'this year', 1))
SELECT ordinal, bucket, count(depth) AS count, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM l LEFT JOIN f ON depth >= need GROUP BY ordinal, bucket"""


_YEARS = f"SELECT CAST(year(make_timestamp(mtime_ms * 1000)) AS INTEGER) AS year, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM ({_ORDERS}) WHERE mtime_ms < epoch_ms(TIMESTAMP '2001-01-01') GROUP BY 1"
_STAMP = "strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%d %H:%M:%S')"
_DIRECT = "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM ({}) WHERE path LIKE '%/%' GROUP BY 1"


def _roll_sql(files: str, root: str) -> str:
    """Every prefix of every folder, from the root down."""
    parts = "string_split(substr(folder, {}), '/')".format(2 if root == "/" else len(root) + 2)
    prefix = "" if root == "/" else root
    return f"""SELECT folder, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT '{prefix}/' || array_to_string({parts}[1:i], '/') AS folder, count, bytes FROM (SELECT * FROM ({_DIRECT.format(files)}) WHERE folder LIKE '{prefix}/_%'), unnest(range(1, len({parts}) + 1)) AS t(i)
  UNION ALL SELECT '{root}', count, bytes FROM ({_DIRECT.format(files)})) GROUP BY 1"""


_CAND = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY size) AS c FROM ({_DOCS})) WHERE size > 0 AND c >= 2"
_DIGESTED = f"SELECT path, size, doc_id, sha256(content) AS digest FROM ({_DOCS}) WHERE size > 0"
_GROUPS = f"SELECT size, digest, count(*) AS n, min(path) AS keeper, (count(*) - 1) * size AS waste FROM ({_DIGESTED}) GROUP BY size, digest HAVING count(*) >= 2"
_MEMBERS = f"SELECT path, size, row_number() OVER w AS position, count(*) OVER (PARTITION BY size, digest) AS n FROM ({_DIGESTED}) WINDOW w AS (PARTITION BY size, digest ORDER BY path)"
_SPLIT_BASE = _roll_sql(f"SELECT * FROM ({_EVENTS}) WHERE mtime_ms < {SPLIT_MS}", EVENTS)
_QUOTE = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), '$', chr(92) || '$'), '`', chr(92) || '`')"
_FLAT = "regexp_replace(replace(path, '/', '_'), '^_', '')"


def _decimal_text(divisor: str, unit: str, places: int) -> str:
    """Halves up, from integers, as printf rounds another way."""
    scale = 10**places
    whole = f"((size * {scale * 2} + {divisor}) // ({divisor} * 2))"
    return f"({whole} // {scale}) || '.' || lpad(CAST({whole} % {scale} AS VARCHAR), {places}, '0') || ' {unit}'"


_UNITS = (("1073741824", "GB"), ("1048576", "MB"), ("1024", "KB"))
_TEXT = "CASE " + " ".join(f"WHEN size >= {v} THEN {_decimal_text(v, u, 2)}" for v, u in _UNITS) + " ELSE size || ' B' END"
_CELL = "CASE " + " ".join(f"WHEN size >= {v} THEN lpad({_decimal_text(v, u, 1)}, 8, ' ')" for v, u in _UNITS) + " ELSE lpad(CAST(size AS VARCHAR), 5, ' ') || ' B' END"

ORACLE = {
    "agg_by_extension": f"SELECT extension, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes, CAST(row_number() OVER (ORDER BY sum(size) DESC, extension) AS INTEGER) AS rank FROM ({_PAGES}) GROUP BY extension",
    "agg_by_size_bucket": f"SELECT l.ordinal, l.bucket, count(size) AS count, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM {_LABELS} LEFT JOIN (SELECT size, {_BUCKET} AS b FROM ({_DOCS})) ON b = l.ordinal GROUP BY l.ordinal, l.bucket",
    "agg_by_date_cumulative": _date_sql(_EVENTS, EVENT_DAY),
    "agg_by_date_week_clip": _date_sql(_ORDERS, ORDER_DAY),
    "agg_prior_years": _YEARS,
    "agg_date_table": f"SELECT * FROM ({_date_sql(_ORDERS, ORDER_YEAR_DAY)}) UNION ALL SELECT 20000 - year, CAST(year AS VARCHAR), count, bytes FROM ({_YEARS})",
    "agg_totals": f"SELECT count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM ({_DOCS})",
    "agg_grouping_sets": f"SELECT CASE WHEN grouping(e, b) = 1 THEN 'extension' WHEN grouping(e, b) = 2 THEN 'bucket' ELSE 'total' END AS dimension, CASE WHEN grouping(e, b) = 1 THEN e WHEN grouping(e, b) = 2 THEN any_value(label) ELSE 'total' END AS key, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT 'txt' AS e, {_BUCKET} AS b, size FROM ({_DOCS})) JOIN (SELECT ordinal, bucket AS label FROM {_LABELS}) ON b = ordinal GROUP BY GROUPING SETS ((e), (b), ())",
    "filter_min_size": f"SELECT path, size FROM ({_DOCS}) WHERE size >= {MIN_SIZE}",
    "filter_extensions": f"SELECT path, extension, size FROM ({_PAGES}) WHERE extension IN ('html', '(none)')",
    "filter_tally": f"SELECT count(*) FILTER (size < {MIN_SIZE}) AS size_skipped_n, CAST(coalesce(sum(size) FILTER (size < {MIN_SIZE}), 0) AS BIGINT) AS size_skipped_bytes, count(*) FILTER (size >= {MIN_SIZE} AND extension NOT IN ('html', '(none)')) AS ext_skipped_n, CAST(coalesce(sum(size) FILTER (size >= {MIN_SIZE} AND extension NOT IN ('html', '(none)')), 0) AS BIGINT) AS ext_skipped_bytes, CAST(0 AS BIGINT) AS inaccessible_dirs, CAST(0 AS BIGINT) AS inaccessible_files FROM ({_PAGES})",
    "exclude_subtree": f"SELECT path, size FROM ({_DOCS}) WHERE NOT list_contains(string_split(path, '/')[:-2], 'de')",
    "list_by_path": f"SELECT row_number() OVER (ORDER BY path) AS rank, path, size, '1970-01-01 00:00:00' AS modified FROM ({_DOCS})",
    "list_by_size": f"SELECT row_number() OVER (ORDER BY size DESC, path) AS rank, path, size, '1970-01-01 00:00:00' AS modified FROM ({_DOCS})",
    "list_by_date": f"SELECT row_number() OVER (ORDER BY mtime_ms DESC, path) AS rank, path, size, {_STAMP} AS modified FROM ({_EVENTS})",
    "folder_direct": _DIRECT.format(_DOCS),
    "folder_rollup": f"SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, folder) AS INTEGER) AS rank FROM ({_roll_sql(_DOCS, CORPUS)}) WHERE folder = '/corpus' OR bytes >= 10000",
    "folder_rollup_collapsed": f"WITH r AS ({_roll_sql(_PAGES, SITES)}) SELECT * FROM r WHERE folder = '/' OR NOT EXISTS (SELECT 1 FROM r AS p WHERE p.folder = CASE WHEN regexp_replace(r.folder, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(r.folder, '/[^/]*$', '') END AND p.count = r.count AND p.bytes = r.bytes)",
    "folder_growth": f"SELECT c.folder, b.bytes AS was, c.bytes AS now, (c.bytes - b.bytes) * CAST(100 AS DOUBLE) / b.bytes AS pct FROM ({_roll_sql(_EVENTS, EVENTS)}) c JOIN ({_SPLIT_BASE}) b USING (folder) WHERE b.bytes > 0 AND (c.bytes - b.bytes) * CAST(100 AS DOUBLE) / b.bytes > 1000",
    "folder_new": f"SELECT c.* FROM ({_roll_sql(_EVENTS, EVENTS)}) c ANTI JOIN (SELECT folder FROM ({_SPLIT_BASE}) WHERE bytes <> 0) b USING (folder)",
    "dup_size_candidates": f"SELECT path, size FROM ({_CAND})",
    "dup_small_hash": f"SELECT path, size, head FROM (SELECT *, count(*) OVER (PARTITION BY size, head) AS k FROM (SELECT path, size, sha256(content[1:4096]) AS head FROM ({_CAND}))) WHERE k >= 2",
    "dup_groups": _GROUPS,
    "dup_members": f"SELECT path, size, CAST(position AS INTEGER) AS position, n, (n - 1) * size AS waste FROM ({_MEMBERS}) WHERE n >= 2",
    "dup_redundant": f"SELECT path, size FROM ({_MEMBERS}) WHERE position > 1",
    "dup_summary": f"SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant_files, CAST(coalesce(sum(waste), 0) AS BIGINT) AS redundant_bytes FROM ({_GROUPS})",
    "dup_hardlink_collapse": f"SELECT size, count(*) AS n, min(path) AS keeper, (count(*) - 1) * size AS waste FROM (SELECT size, digest, doc_id % 2 AS i, min(path) AS path FROM ({_DIGESTED}) GROUP BY ALL) GROUP BY size, digest HAVING count(*) >= 2",
    "human_sizes": f"SELECT path, {_TEXT} AS text, {_CELL} AS cell, {_BUCKET} AS bucket FROM ({_DOCS})",
    "shell_quoting": f"SELECT doc_id, {_QUOTE.format('text')} AS quoted FROM documents",
    "emit_deletion": f"SELECT path, 'mv \"' || {_QUOTE.format('path')} || '\" \"$BIN/' || {_QUOTE.format(_FLAT)} || '\"' AS soft, 'rm \"' || {_QUOTE.format('path')} || '\"' AS hard FROM ({_DOCS})",
    "trash_names": f"SELECT path, {_FLAT} AS name, regexp_extract(path, '[^/]*$') AS base FROM ({_PAGES})",
}

# the order of reports, over the tables above
ORACLE["folder_growth_ranked"] = f"SELECT *, CAST(row_number() OVER (ORDER BY pct DESC, folder) AS INTEGER) AS rank FROM ({ORACLE['folder_growth']})"
ORACLE["folder_new_ranked"] = f"SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, folder) AS INTEGER) AS rank FROM ({ORACLE['folder_new']})"
ORACLE["dup_groups_ranked"] = f"SELECT *, CAST(row_number() OVER (ORDER BY waste DESC, keeper) AS INTEGER) AS rank FROM ({_GROUPS})"
ORACLE["baseline_roundtrip"] = ORACLE["folder_growth"]
ORACLE["list_display"] = f"SELECT row_number() OVER (ORDER BY size DESC, path) AS rank, {_CELL} || ' | ' || path || ' | ' || {_STAMP} AS line FROM ({_EVENTS})"

# long names: the longest start of whole characters within 238 bytes, then a digest
_LONG = _FLAT.replace("path", "coalesce(text, '')")
ORACLE["trash_names_long"] = f"""
WITH f AS (SELECT doc_id, text, {_LONG} AS flat FROM documents),
c AS (SELECT *, (SELECT max(n) FROM (SELECT unnest(range(0, 239)) AS n) WHERE octet_length(encode(left(flat, CAST(n AS BIGINT)))) <= 238) AS chars FROM f)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN octet_length(encode(flat)) <= 255 THEN flat ELSE left(flat, chars) || '~' || left(sha256(encode(flat)), 16) END AS name FROM c"""
ORACLE["trash_names_distinct"] = f"""
SELECT path, CASE WHEN n = 1 THEN name ELSE name || '.' || (n - 1) END AS name FROM (
  SELECT path, {_FLAT} AS name, row_number() OVER (PARTITION BY {_FLAT} ORDER BY path) AS n FROM ({_PAGES}))"""
