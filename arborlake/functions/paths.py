"""Columns over '/'-separated paths, and extension lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a name without an extension.
NO_EXTENSION = "(none)"


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension_of(name: Column) -> Column:
    """Lower-cased text after the last dot; NO_EXTENSION if there is no dot, or it is first or last."""
    found = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_EXTENSION))


def parent_of(path: Column) -> Column:
    """The containing folder; '/' for entries of the root, null for the root itself and for bare names."""
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return F.when(~F.contains(path, F.lit("/")) | (path == "/"), None).when(cut == "", "/").otherwise(cut)


def folders_up_to(folder: Column, root: str) -> Column:
    """The folder and all its ancestors, from ``root`` down; empty for folders not under ``root``."""
    if root == "/":
        parts = F.filter(F.split(folder, "/"), lambda x: x != "")
        deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
        return F.when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), deeper))
    parts = F.split(F.substring(folder, F.lit(len(root) + 2), F.length(folder)), "/")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(folder == root, F.array(F.lit(root))).when(folder.startswith(root + "/"), F.concat(F.array(F.lit(root)), deeper)).otherwise(F.array().cast("array<string>"))


def in_excluded_folder(path: Column, names: list[str]) -> Column:
    """Whether some folder on the way (not the file itself) has one of the names, by exact case."""
    folders = F.split(path, "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, names))) if names else F.lit(False)


def parse_extensions(raw: str | None) -> frozenset[str] | None:
    """Extensions of a comma-separated list, None for all.

    Blank lists, lists of blanks and any ``*`` mean all; one leading dot and case do not matter; ``none`` is
    NO_EXTENSION (a real extension of that name cannot be asked for, nor can ``.*``, which is literal).
    """
    tokens = [t.strip() for t in (raw or "").split(",")]
    if "*" in tokens:
        return None
    out = {t.removeprefix(".").lower() for t in tokens if t}
    out = {NO_EXTENSION if t == "none" else t for t in out if t}
    return frozenset(out) or None


def display_extensions(extensions: frozenset[str] | None) -> str:
    return "[*]" if extensions is None else f"[{', '.join(sorted(extensions))}]"


def parse_excluded(raw: str | None) -> list[str]:
    """Folder names of a comma-separated list, in order, with ``.git`` always among them."""
    names = list(dict.fromkeys(t.strip() for t in (raw or "").split(",") if t.strip()))
    return names if ".git" in names else [*names, ".git"]
