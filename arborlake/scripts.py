"""Clean-up scripts that are read before they are run: nothing is deleted by this package itself."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable, Iterator
from datetime import datetime

from arborlake.functions.shell import TrashNames, quoted
from arborlake.functions.sizes import bytes_text

#: Minutes after which a script says that its list is old.
OLD_AFTER = 10

_HEAD = """#!/usr/bin/env bash
set -euo pipefail

# Clean-up list of arborlake ({consumer}), {at}.
#   tree  {root}
#   list  {what}
#   does  {does}
# Commands follow the question at the end of this head. Go through them and strike out what should stay.

age_note() {{
  local minutes=$(( ($(date +%s) - {created}) / 60 )) on='' off=''
  (( minutes > {old} )) || return 0
  [[ -t 2 && -z ${{NO_COLOR-}} ]] && on=$'\\e[33m' && off=$'\\e[0m'
  printf '%sNote: this list is %d minutes old. Files may have changed; a new scan makes a new list.%s\\n' "$on" "$minutes" "$off" >&2
}}

consent() {{
  local reply=''
  printf '%s\\n' "$1"
  read -r -p "$2 " reply || true
  [[ $reply == "$3" ]] && return 0
  echo "Left everything as it is."
  exit 1
}}

age_note
consent "{files} files, {size}: {effect}" "{question}" "{answer}"
{trash}"""

_TRASH = """
BIN=$(dirname -- "$(readlink -f -- "${BASH_SOURCE[0]}")")/trash
[[ -d $BIN ]] || mkdir -p -- "$BIN"
"""

# per mode: what the head says, what happens, the question and its answer
_SOFT = ("mv, into the folder trash beside this script", "they go to the trash folder, from where they can be taken back.", "Move them? (y)", "y")
_HARD = ("rm", "they will be gone for good.", "Remove them? Answer DELETE to go on:", "DELETE")


def preamble(consumer: str, root: str, what: str, files: int, size: int, hard: bool, created: int | None = None) -> str:
    """Everything before the first command: what the list is, its age, the question, and the trash folder once agreed."""
    created = int(time.time()) if created is None else created
    # a line end in the tree's name must not end the comment
    root = os.path.abspath(root).replace("\n", "?").replace("\r", "?")
    does, effect, question, answer = _HARD if hard else _SOFT
    return _HEAD.format(
        consumer=consumer, at=f"{datetime.fromtimestamp(created):%d %b %Y %H:%M}", root=root, what=what, does=does, created=created, old=OLD_AFTER,
        files=files, size=bytes_text(size), effect=effect, question=question, answer=answer, trash="" if hard else _TRASH,
    ) + "\n"


def deletion(path: str, names: TrashNames, hard: bool) -> str:
    return f'rm "{quoted(path)}"\n' if hard else f'mv "{quoted(path)}" "$BIN/{quoted(names.name(path))}"\n'


def _write(file: str, parts: Iterable[str]) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
    with open(file, "w", encoding="utf-8") as out:
        out.writelines(parts)


def write_delete_script(file: str, root: str, paths: Iterable[str], files: int, size: int, hard: bool) -> None:
    """A script for all ``paths``, which may be a stream."""
    names = TrashNames()
    what = f"{files} files, {bytes_text(size)}"
    _write(file, (x for parts in ([preamble("filemanager", root, what, files, size, hard)], (deletion(p, names, hard) for p in paths)) for x in parts))


def write_duplicate_script(file: str, root: str, members: Iterable[tuple[int, str, int, int, str]], groups: int, files: int, size: int, hard: bool) -> None:
    """A script from (size, digest, position, group's number of paths, path) rows, group by group in order of position."""

    def lines() -> Iterator[str]:
        names = TrashNames()
        for each, _, position, n, path in members:
            if position == 1:
                yield f"\n# {n} copies of {bytes_text(each)} each, {bytes_text((n - 1) * each)} to gain\n"
                stays = quoted(path).replace("\n", "?").replace("\r", "?")
                yield f'# KEPT: "{stays}"\n'
            else:
                yield deletion(path, names, hard)

    what = f"{files} copies beyond the first, in {groups} groups"
    _write(file, (x for parts in ([preamble("duplicates", root, what, files, size, hard)], lines()) for x in parts))
