"""Size buckets and the text of sizes, times and thresholds."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB, TB = 1 << 10, 1 << 20, 1 << 30, 1 << 40

# Inclusive upper bounds (None: the rest) and labels.
BUCKETS = (
    (KB, "<= 1KB"),
    (MB, "> 1KB and <= 1MB"),
    (20 * MB, "> 1MB and <= 20MB"),
    (GB, "> 20MB and <= 1GB"),
    (None, "> 1GB"),
)
UNITS = ((TB, "TB"), (GB, "GB"), (MB, "MB"), (KB, "KB"), (1, "B"))


def size_bucket(size: Column) -> Column:
    """The bucket's number, 0 to 4."""
    number = F.lit(len(BUCKETS) - 1)
    for i in reversed(range(len(BUCKETS) - 1)):
        number = F.when(size <= BUCKETS[i][0], i).otherwise(number)
    return number


def bucket_label(number: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for _, label in BUCKETS]), number)


def _scaled(size: Column, whole: str, part: str) -> Column:
    out = F.format_string(whole, size)
    for unit, name in sorted(UNITS[:-1]):
        out = F.when(size >= unit, F.format_string(f"{part} {name}", size.cast("double") / float(unit))).otherwise(out)
    return out


def human_bytes(size: Column) -> Column:
    """``1023 B``, ``1.50 KB``: the unit is chosen before rounding, halves are rounded up."""
    return _scaled(size, "%d B", "%.2f")


def human_bytes_column(size: Column) -> Column:
    """The same in fixed width with one decimal place."""
    return _scaled(size, "%5d B", "%5.1f")


def _rounded(value: Decimal, places: int) -> str:
    return str(value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def bytes_text(size: int, places: int = 2, width: int = 0) -> str:
    """:func:`human_bytes` of one number on the driver."""
    for unit, name in UNITS[:-1]:
        if size >= unit:
            return f"{_rounded(Decimal(size) / unit, places):>{width}} {name}"
    return f"{size:>{width}d} B"


def elapsed_text(ms: int) -> str:
    """``59.9 s``, from a minute on ``90.0 s (1.5 m)``."""
    seconds = f"{_rounded(Decimal(ms) / 1000, 1)} s"
    return f"{seconds} ({_rounded(Decimal(ms) / 60_000, 1)} m)" if ms >= 60_000 else seconds


def percent_text(value: float) -> str:
    """Without a trailing ``.0``."""
    return str(int(value)) if value == int(value) else str(value)


def parse_size(raw: str | None) -> int:
    """Bytes of ``4096``, ``1KB``, ``512 kb``, up to TB; blank is 0. Raises ValueError for anything else or beyond 64 bits."""
    text = (raw or "").strip().upper()
    if not text:
        return 0
    factor = next(((unit, name) for unit, name in UNITS if text.endswith(name)), None)
    number = text.removesuffix(factor[1]).strip() if factor else text
    if not (number.isascii() and number.isdigit()):
        raise ValueError(f"not a size: {raw}")
    size = int(number) * (factor[0] if factor else 1)
    if size >= 1 << 63:
        raise ValueError(f"size too large: {raw}")
    return size


def timestamp_text(mtime_ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in the session's time zone."""
    return F.date_format(F.timestamp_millis(mtime_ms), "yyyy-MM-dd HH:mm:ss")
