"""Words of a text, as bytes, and the Arrow plumbing shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Maps every byte of UTF-8 text: digits, letters and all bytes of non-ASCII characters stay
#: (A-Z lower-cased), everything else becomes a space.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.translate(text, _UPPER, _LOWER)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of anything but ASCII white space (0x20, 0x09-0x0D)."""
    return text.lower().split()


#: What this worker process remembers between tasks: one thing at a time, by its owner's name.
_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """What ``owner`` remembers in this process; whatever another owner remembered is forgotten."""
    if owner not in _kept:
        forget()
        _kept[owner] = make()
    return _kept[owner]


def forget() -> None:
    """Drop what is remembered and give free memory back to the system: workers outlive the stages they serve."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only GNU's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release(table: pa.Table) -> None:
    """:func:`forget` after a group's work, if the group was large enough to matter."""
    if table.nbytes > 1 << 20:
        forget()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes (one row at least), which bounds what Python
    holds at once. Before the first and after the last, what others than ``owner`` remember is forgotten."""
    if owner not in _kept:
        forget()
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
    if owner not in _kept:
        forget()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... and these names; ``toDF`` with the caller's names puts those back. So no name
    of a caller, with dots or like one used here, matters in between."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def arrow_columns(ddl: str, rows: list[tuple]) -> dict[str, pa.Array]:
    """The rows as Arrow columns of a schema such as ``"a long, b array<string>"``."""
    out = {}
    for i, field in enumerate(ddl.split(", ")):
        name, kind = field.split()
        kind = pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]
        out[name] = pa.array([r[i] for r in rows], kind)
    return out
