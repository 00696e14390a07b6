"""Batch folders merged in levels, so that a long stream leaves few of them.

A stream writes a folder per batch. When ``FANOUT`` of them are closed they are merged into one of
the first level, as many of a level into one of the next. What counts is listed in a small
file, a new one for every merge: the newest names the merged folders and the batch from
which on single folders count. It appears in one step, so a merge that breaks off anywhere
changes nothing; what it left is overwritten or deleted by the next one. Folders that the newest
list no longer names go when the list after it is out, so a reader of the last one still finds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import SparkSession

from yardstats.session import Files

FANOUT = 10
LISTS = "_live"  # readers of plain Parquet pass over names that begin so


class Live(NamedTuple):
    number: int  # of the list; 0: there is none
    until: int  # batches below are in merged folders
    merged: list[tuple[int, str]]  # level and name


def _numbers(files: Files) -> list[int]:
    return [int(n.removesuffix(".json")) for n in files.names(LISTS) if n.endswith(".json")]


def _list(files: Files, number: int) -> Live:
    if not number:
        return Live(0, 0, [])
    stored = json.loads(files.read(f"{LISTS}/{number:08d}.json"))
    return Live(number, stored["until"], [tuple(x) for x in stored["merged"]])


def newest(files: Files) -> Live:
    return _list(files, max(_numbers(files), default=0))


def _batches(files: Files) -> list[int]:
    """Batches whose folders are complete."""
    ids = (int(n.removeprefix("batch=")) for n in files.names() if n.startswith("batch="))
    return sorted(i for i in ids if files.exists(f"batch={i}/_SUCCESS"))


def live_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders whose rows count, each row once."""
    files = Files(spark, path)
    live = newest(files)
    names = [name for _, name in live.merged] + [f"batch={i}" for i in _batches(files) if i >= live.until]
    return [f"{path.rstrip('/')}/{name}" for name in names]


def compact(spark: SparkSession, path: str, before: int, merge: Callable[[list[str], str], None], fanout: int = FANOUT) -> bool:
    """Merge the closed batches below ``before`` if there are enough; True if it did.

    ``merge(sources, target)`` writes what the source folders add up to, overwriting the target.
    """
    files = Files(spark, path)
    live = newest(files)
    if before < live.until:
        raise ValueError(f"batch {before} of {path} is merged already: this is another stream's folder")
    closed = [i for i in _batches(files) if live.until <= i < before]
    if len(closed) < fanout:
        return False
    sources, merged, level = [f"batch={i}" for i in closed], list(live.merged), 1
    while len(alike := [x for x in merged if x[0] == level]) + 1 >= fanout:
        sources = [name for _, name in alike] + sources
        merged = [x for x in merged if x[0] != level]
        level += 1
    base, name = path.rstrip("/"), f"merged-{live.number + 1:08d}"
    merge([f"{base}/{s}" for s in sources], f"{base}/{name}")
    after = Live(live.number + 1, closed[-1] + 1, [*merged, (level, name)])
    files.publish(f"{LISTS}/{after.number:08d}.json", json.dumps({"until": after.until, "merged": after.merged}))
    _clean(files, live, after)
    return True


def _clean(files: Files, before: Live, now: Live) -> None:
    """Delete the folders and lists that neither of the last two lists needs."""
    named = {name for _, name in (*before.merged, *now.merged)}
    for name in files.names():
        merged_away = name.startswith("batch=") and int(name.removeprefix("batch=")) < before.until
        if merged_away or (name.startswith("merged-") and name not in named):
            files.delete(name)
    for number in _numbers(files):
        if number < before.number:
            files.delete(f"{LISTS}/{number:08d}.json")
