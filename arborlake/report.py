"""Text reports, from bounded results on the driver or streamed rows."""

from __future__ import annotations

import os
from collections.abc import Iterable
from datetime import datetime

from arborlake.config import Action, Config, Consumer
from arborlake.functions.paths import display_extensions
from arborlake.functions.sizes import bytes_text, elapsed_text, percent_text

_INDENT = "    "


def table(header: str, width: int, rows: Iterable[tuple[str, int, int]], count: int, size: int) -> str:
    """An indented table of (label, count, bytes) with a total row."""
    lines = [(header, "count", "bytes"), *((k, str(n), bytes_text(b)) for k, n, b in rows), ("total", str(count), bytes_text(size))]
    return "".join(f"{_INDENT}{k:<{width}} {n:>10} {b:>15}\n" for k, n, b in lines)


def aggregate_report(extensions, buckets, dates, count: int, size: int) -> str:
    parts = (("Extensions", "extension", 16, extensions), ("Sizes", "bucket", 20, buckets), ("Dates (each of the first four holds those above it)", "date", 16, dates))
    return "".join(f"\n{title}\n{table(header, width, rows, count, size)}" for title, header, width, rows in parts)


def _folder_lines(rows: Iterable[tuple[str, int, int]]) -> str:
    return f"{'bytes':>12} {'count':>10}  folder\n" + "".join(f"{bytes_text(b):>12} {n:>10}  {f}\n" for f, n, b in rows)


def folder_report(rows: list[tuple[str, int, int]], min_bytes: int, total: int) -> str:
    limit = f">= {bytes_text(min_bytes)}" if min_bytes > 0 else "all"
    return f"\nFolders by recursive size ({limit}):\n{_folder_lines(rows)}\nListed {len(rows):,} folders ({bytes_text(total)} total).\n"


def growth_report(since: datetime, threshold: float, rows: list[tuple[str, int, int, float]]) -> str:
    head = f"\nFolder growth since {since.astimezone().date()} (> {percent_text(threshold)}%):\n"
    if not rows:
        return head + "  none\n"
    lines = [f"{bytes_text(was):>12} {bytes_text(now):>12} {'+' + bytes_text(now - was):>14} {pct:6.1f}%  {folder}\n" for folder, was, now, pct in rows]
    return head + f"{'was':>12} {'now':>12} {'+delta':>14} {'+pct':>7}  folder\n" + "".join(lines)


def new_report(since: datetime, rows: list[tuple[str, int, int]]) -> str:
    return f"\nNew folders since {since.astimezone().date()}:\n" + (_folder_lines(rows) if rows else "  none\n")


#: Widths of columns that others follow.
_PATH_WIDTH, _SIZE_WIDTH = 160, 8


def listing_header(columns: tuple[str, ...]) -> str:
    return f"\nFiles ({'  '.join(columns)}):\n"


def listing_row(columns: tuple[str, ...], values: tuple[str, ...]) -> str:
    """The values in order; all but the last are padded (the time has a fixed width of its own)."""
    width = {"path": _PATH_WIDTH, "size": _SIZE_WIDTH, "modified": 0}
    cells = [f"{v:<{width[c]}}" if i + 1 < len(columns) else v for i, (c, v) in enumerate(zip(columns, values, strict=True))]
    return "  ".join(cells) + "\n"


def scan_header(config: Config, root: str) -> str:
    out = f"\n\nScanning {root} ==> consumer={config.consumer.value}\nExcluding directories: {', '.join(config.excluded)}\n"
    out += f"Extensions: {display_extensions(config.extensions)}\nMin size: {bytes_text(config.min_size)}\n"
    return out + (f"Min size recursive: {bytes_text(config.min_size_recursive)}\n" if config.min_size_recursive > 0 else "")


def filter_summary(config: Config, tally: dict[str, int]) -> str:
    """A line per active filter, and one for what could not be read."""
    out = ""
    if config.min_size > 0:
        out += f"\nSkipped (size < {bytes_text(config.min_size)}): {tally['size_skipped_n']:,} files ({bytes_text(tally['size_skipped_bytes'])}).\n"
    if config.extensions is not None:
        out += f"\nSkipped (extension not in {display_extensions(config.extensions)}): {tally['ext_skipped_n']:,} files ({bytes_text(tally['ext_skipped_bytes'])}).\n"
    if tally["inaccessible_dirs"] or tally["inaccessible_files"]:
        out += f"\nNot readable: {tally['inaccessible_dirs']:,} folders and {tally['inaccessible_files']:,} files, which this report leaves out.\n"
    return out


def done_line(ms: int, files: int, size: int) -> str:
    return f"\nDone in {elapsed_text(ms)}. Files={files:,}  TotalBytes={bytes_text(size)}\n"


def resolve_out(raw: str, default: str) -> str:
    """A given file verbatim; ``default`` in the working folder, or in the folder given."""
    if not raw:
        return default
    return os.path.join(raw, default) if raw.endswith("/") or os.path.isdir(raw) else raw


# Prefixes of mirrored reports' names.
_PREFIX = {Consumer.AGGREGATE: "aggregator-", Consumer.FOLDERS: "folder-sizes-", Consumer.FILEMANAGER: "file-list-"}


def mirror_path(config: Config, now: datetime) -> str | None:
    """Where a run's report is mirrored; None for runs that write scripts or were given no place."""
    reports = config.consumer in (Consumer.AGGREGATE, Consumer.FOLDERS) or config.consumer is Consumer.FILEMANAGER and config.action is Action.LIST
    return resolve_out(config.out, f"{_PREFIX[config.consumer]}{now:%Y%m%d-%H%M%S}.out") if reports and config.out else None


class Tee:
    """Writes text to several open files."""

    def __init__(self, *files):
        self.files = files

    def write(self, text: str) -> None:
        for f in self.files:
            f.write(text)
            f.flush()
