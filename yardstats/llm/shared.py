"""Small helpers of this subpackage: reading tables, words, row keys."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.session import write_through

WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "ascii_lower", "count_words", "fresh", "give_back", "giving_back", "groups", "read", "write_through"]


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def count_words(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A to Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def give_back() -> None:
    """Return what this worker's allocators keep for themselves to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most systems has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of an iterator of batches, whose task gives its memory back to the system when it ends.

    Workers are used again by later tasks; what their allocators keep for themselves adds
    up over the stages of a long job, beside the memory of the executor.
    """

    @functools.wraps(run)
    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return released


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows with the bounds of the whole groups in them, of batches sorted by the integer columns ``names``.

    Only the group in which a batch ends is kept for the next, so a task holds one batch
    and one group.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        keys = np.stack([rows[c].to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        if len(cuts) > 1:
            yield rows, list(zip(cuts[:-1], cuts[1:]))
        held = rows.slice(cuts[-1])
    if held is not None:
        yield held, [(0, held.num_rows)]
