"""Shell quoting and flat trash names."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What must be escaped between double quotes, the backslash first.
SPECIAL = ("\\", '"', "$", "`")
#: Bytes of a file name, at most.
NAME_BYTES = 255


def quoted(text: str) -> str:
    """For use between double quotes; line ends stay as they are."""
    for c in SPECIAL:
        text = text.replace(c, "\\" + c)
    return text


def shell_quote(text: Column) -> Column:
    """:func:`quoted` as a column."""
    for c in SPECIAL:
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def flat_name(path: Column) -> Column:
    """Slashes to underscores, without one leading underscore."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit("_")), "^_", "")


def capped(name: str) -> str:
    """At most NAME_BYTES of UTF-8: longer names are cut between characters and end in ``~`` and a digest's first 16 digits."""
    data = name.encode()
    if len(data) <= NAME_BYTES:
        return name
    tail = "~" + sha256(data).hexdigest()[:16]
    return data[: NAME_BYTES - len(tail)].decode(errors="ignore") + tail


def capped_name(name: Column) -> Column:
    """:func:`capped` as a column: of the cuts at the last four bytes, the longest that is whole characters."""
    tail = F.concat(F.lit("~"), F.substring(F.sha2(name, 256), 1, 16))
    room = NAME_BYTES - 17
    cuts = [F.try_validate_utf8(F.substring(name.cast("binary"), 1, n).cast("string")) for n in range(room, room - 4, -1)]
    return F.when(F.octet_length(name) <= NAME_BYTES, name).otherwise(F.concat(F.coalesce(*cuts), tail))


def trash_name(path: Column) -> Column:
    """The name of one path in a trash folder."""
    return capped_name(flat_name(path))


def distinct_trash_names(files: DataFrame) -> DataFrame:
    """path and the name of each in one trash folder: of paths with the same name the n-th in order gets ``.n`` from the second on.

    For tables; :class:`TrashNames` names a stream and also steps over names that others have taken with their suffix.
    """
    named = files.select("path", trash_name(F.col("path")).alias("name"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    return named.withColumn("n", n).select("path", F.when(F.col("n") == 1, F.col("name")).otherwise(capped_name(F.concat("name", F.lit("."), F.col("n") - 1))).alias("name"))


class TrashNames:
    """Distinct trash names for a stream of paths, in order: a taken name gets ``.1``, ``.2`` and so on."""

    def __init__(self):
        self.taken: set[str] = set()
        self.next: dict[str, int] = {}

    def name(self, path: str) -> str:
        base = capped(path.replace("/", "_").removeprefix("_"))
        name = base
        while name in self.taken:
            n = self.next[base] = self.next.get(base, 0) + 1
            name = capped(f"{base}.{n}")
        self.taken.add(name)
        return name


def trash_names(paths: Iterable[str]) -> list[str]:
    names = TrashNames()
    return [names.name(p) for p in paths]


def deletion_line(path: Column, trash: Column, hard: bool) -> Column:
    """The script line that removes a path, or moves it into the trash."""
    if hard:
        return F.concat(F.lit('rm "'), shell_quote(path), F.lit('"'))
    return F.concat(F.lit('mv "'), shell_quote(path), F.lit('" "$BIN/'), shell_quote(trash), F.lit('"'))
