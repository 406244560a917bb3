"""``python -m arborlake``: scan a tree and report, or write a clean-up script."""

from __future__ import annotations

import argparse
import contextlib
import logging
import os
import sys
import time
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake import report, scripts
from arborlake.config import Action, Config, ConfigError, Consumer, parse_config
from arborlake.functions.calendar import Boundaries
from arborlake.functions.paths import extension_of, parse_excluded
from arborlake.functions.sizes import bytes_text
from arborlake.operators import aggregate, duplicates, filters, folders, listing
from arborlake.runtime import durable
from arborlake.sources.baseline import read_baseline, write_baseline
from arborlake.sources.content import staged_digests
from arborlake.sources.fstree import scan_tree

log = logging.getLogger("arborlake")
VERSION = "0.1.0"
EXAMPLES = """Examples:
  python -m arborlake --exclude=node_modules,target /data
  python -m arborlake --consumer=folders --min-size-recursive=100MB /data
  python -m arborlake --consumer=folders --baseline=sizes.tsv --growth-threshold=10 /data
  python -m arborlake --consumer=duplicates --min-size=1MB /data
  python -m arborlake --consumer=filemanager --file-extensions=tmp,log --sort=size /data
  python -m arborlake --consumer=filemanager --action=delete --file-extensions=tmp /data
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("arborlake", description="Analyse a directory tree with Spark.", allow_abbrev=False)
    p.add_argument("target", nargs="?", default=".", metavar="PATH", help="directory to scan (default: the current one)")
    p.add_argument("--consumer", default="aggregate", help="aggregate, duplicates, filemanager or folders")
    p.add_argument("--exclude", default=".git", help="folder names to skip, comma-separated; .git is always among them")
    p.add_argument("--min-size", default="0", help="skip smaller files, e.g. 1MB")
    p.add_argument("--file-extensions", default="*", help="extensions to include; none: files without")
    p.add_argument("--action", help="filemanager: list or delete")
    p.add_argument("--sort", help="filemanager listing: path, date or size")
    p.add_argument("--order", help="asc or desc")
    p.add_argument("--hard-delete", action="store_true", help="scripts remove instead of moving to a trash folder")
    p.add_argument("--min-size-recursive", help="folders: omit smaller ones (default 10MB)")
    p.add_argument("--baseline", default="", help="folders: snapshot to compare with and to replace")
    p.add_argument("--growth-threshold", help="folders with --baseline: percent (default 10)")
    p.add_argument("--out", default="", help="file or folder for the report's mirror, or for the script")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--stats", action="store_true", help="log Spark's task count and parallelism")
    # thread and queue settings of a single-process scanner; a cluster's cores decide here
    for flag in ("--producers", "--consumers", "--queue-size"):
        p.add_argument(flag, type=int, help="accepted and checked; Spark's own parallelism is used")
    p.add_argument("--queue-type", choices=["abq", "lbq"], help="accepted; no meaning here")
    p.add_argument("--examples", action="store_true", help="with --help: show examples")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def _aggregate(out: report.Tee, files: DataFrame, as_of: date, zone: str) -> None:
    named = files.withColumn("extension", extension_of(F.col("name")))
    total = aggregate.totals(named).first()
    extensions = [(r.extension, r["count"], r.bytes) for r in aggregate.by_extension(named).orderBy("rank").toLocalIterator()]
    buckets = [(r.bucket, r["count"], r.bytes) for r in aggregate.by_size_bucket(named).collect()]
    dates = [(r.bucket, r["count"], r.bytes) for r in aggregate.date_table(named, Boundaries.of(as_of, zone)).collect()]
    out.write(report.aggregate_report(extensions, sorted(buckets, key=lambda r: [b for b, _, _ in buckets].index(r[0])), dates, total["count"], total.bytes))


def _listing(out: report.Tee, files: DataFrame, config: Config, n: int, size: int) -> None:
    columns = listing.KEYS[config.sort.value][2]
    rows = listing.display(listing.listing(files, config.sort.value, config.ascending), config.sort.value)
    out.write(report.listing_header(columns))
    for r in rows.toLocalIterator():
        out.write(report.listing_row(columns, tuple(r)))
    out.write(f"\nListed {n:,} files ({bytes_text(size)}).\n")


def _delete(out: report.Tee, files: DataFrame, config: Config, root: str, n: int, size: int) -> None:
    if not n:
        out.write("No file passes the filters, so there is no script.\n")
        return
    file = report.resolve_out(config.out, "delete-files.sh")
    scripts.write_delete_script(file, root, (r.path for r in listing.listing(files).select("path").toLocalIterator()), n, size, config.hard_delete)
    out.write(f"{n} files, {bytes_text(size)}, to {'remove' if config.hard_delete else 'move to the trash'}. Read {os.path.abspath(file)} before you run it.\n")


def _duplicates(out: report.Tee, files: DataFrame, config: Config, root: str) -> None:
    digested, unread = staged_digests(files)
    if unread:
        log.warning("%d candidates could not be read", unread)
    names = durable(duplicates.one_name_per_inode(digested), "names")
    total = duplicates.summary(duplicates.groups(names)).first()
    if not total.groups:
        out.write("No two files are alike, so there is no script.\n")
        return
    keepers = duplicates.groups(names).select("size", "digest", "keeper")
    rows = duplicates.members(names).join(keepers, ["size", "digest"]).orderBy(F.desc("waste"), "keeper", "position").select("size", "digest", "position", "n", "path")
    file = report.resolve_out(config.out, "remove-duplicates.sh")
    scripts.write_duplicate_script(file, root, (tuple(r) for r in rows.toLocalIterator()), total.groups, total.redundant_files, total.redundant_bytes, config.hard_delete)
    out.write(f"{total.redundant_files} copies in {total.groups} groups hold {bytes_text(total.redundant_bytes)}. Read {os.path.abspath(file)} before you run it.\n")


def _folders(out: report.Tee, spark: SparkSession, files: DataFrame, config: Config, root: str, size: int) -> None:
    rows = durable(folders.report_rows(files, root, config.min_size_recursive), "folders")
    shown = [(r.folder, r["count"], r.bytes) for r in rows.orderBy(F.desc("bytes"), "folder").toLocalIterator()]
    out.write(report.folder_report(shown, config.min_size_recursive, size))
    if not config.baseline:
        return
    now = datetime.now(UTC).replace(microsecond=0)
    if os.path.exists(config.baseline):
        since, before = read_baseline(spark, os.path.abspath(config.baseline))
        grown = [tuple(r) for r in folders.growth(before, rows, config.threshold).orderBy(F.desc("pct"), "folder").collect()]
        fresh = [tuple(r) for r in folders.appeared(before, rows).select("folder", "count", "bytes").orderBy(F.desc("bytes"), "folder").collect()]
        out.write(report.growth_report(since, config.threshold, grown) + report.new_report(since, fresh))
    write_baseline(config.baseline, now, shown)  # after everything that reads the old one


def run(config: Config, spark: SparkSession, root: str, stdout=sys.stdout, as_of: date | None = None) -> None:
    """Scan ``root`` once, write the report or script, and the summary lines."""
    began = time.time()
    with contextlib.ExitStack() as stack:
        mirror = report.mirror_path(config, datetime.now())
        out = report.Tee(stdout, *([stack.enter_context(open(mirror, "w", encoding="utf-8"))] if mirror else []))
        out.write(report.scan_header(config, root))
        entries = durable(scan_tree(spark, root, list(config.excluded)), "entries")
        named = entries.withColumn("extension", extension_of(F.col("name")))
        files, tally = filters.filtered(named, config.min_size, config.extensions)
        total = aggregate.totals(files).first()  # the action that fills the tally
        if config.consumer is Consumer.AGGREGATE:
            _aggregate(out, files, as_of or date.today(), spark.conf.get("spark.sql.session.timeZone"))
        elif config.consumer is Consumer.DUPLICATES:
            _duplicates(out, files, config, root)
        elif config.consumer is Consumer.FOLDERS:
            _folders(out, spark, files, config, root, total.bytes)
        elif config.action is Action.DELETE:
            _delete(out, files, config, root, total["count"], total.bytes)
        else:
            _listing(out, files, config, total["count"], total.bytes)
        out.write(report.filter_summary(config, tally.get))
        out.write(report.done_line(round((time.time() - began) * 1000), total["count"], total.bytes))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit status: 0, or 2 for any mistake in the settings, a bad target or a failed run."""
    argv = sys.argv[1:] if argv is None else argv
    if "--examples" in argv and not {"--help", "-h"} & set(argv):
        print("--examples must be combined with --help", file=sys.stderr)
        return 2
    p = parser()
    if "--examples" in argv:
        p.epilog, p.formatter_class = EXAMPLES, argparse.RawDescriptionHelpFormatter
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    logging.basicConfig(level=getattr(logging, args.log_level.upper(), logging.INFO), format="%(levelname)s %(message)s")
    counts = ("producers", "consumers", "queue_size")
    errors = [f"--{name.replace('_', '-')} is less than one" for name in counts if getattr(args, name) is not None and getattr(args, name) < 1]
    config = None
    try:
        config = parse_config(args.target, args.consumer, args.exclude, args.min_size, args.file_extensions, args.action, args.sort, args.order, args.hard_delete, args.min_size_recursive, args.baseline, args.growth_threshold, args.out)
    except ConfigError as e:
        errors += str(e).split("\n")
    root = os.path.normpath(os.path.abspath(args.target))
    if not errors and not os.path.isdir(root):
        errors.append(f"{root} is no folder")
    for line in errors:
        log.error(line)
    if errors:
        return 2
    if ".git" not in [x.strip() for x in (args.exclude or "").split(",")]:
        log.info("Excluding .git as well (%s)", ", ".join(parse_excluded(args.exclude)))
    try:
        if spark is None:
            from arborlake.session import local_session

            spark = local_session()
        run(config, spark, root)
    except Exception as e:
        log.error("%s", e)
        return 2
    if args.stats:
        log.info("parallelism %d, shuffle partitions %s", spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions"))
    return 0
