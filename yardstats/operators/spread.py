"""Joins and numbering that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.session import write_through


def left_join_sparse_key(
    left: DataFrame, right: DataFrame, key: str, spread_by: list[str], slots: int = 64
) -> DataFrame:
    """Left join on a key that may be null in a large share of the left rows.

    A null key matches nothing, yet all such rows would hash to one task. They
    get a slot number as a second key, so they travel to many tasks. The right
    side is not copied. Its slot is written as a test of the key because a bare
    literal would be folded away and take the second key with it.
    """
    left_slot = F.when(F.col(key).isNull(), F.pmod(F.hash(*spread_by), F.lit(slots))).otherwise(0)
    right_slot = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(0)
    return (
        left.withColumn("_slot", left_slot)
        .join(right.withColumn("_slot", right_slot), [key, "_slot"], "left")
        .drop("_slot")
    )


def skew_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join whose left side may hold very many rows of one key, the right side few of each.

    A plain equi-join: adaptive execution splits a partition that a hot key makes too
    large and copies the few right rows of it to each piece, at every size alike.
    ``null_safe`` lets null keys match null keys.
    """
    same = [
        F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if null_safe else F.col(f"l.{k}") == F.col(f"r.{k}")
        for k in keys
    ]
    matched = many.alias("l").join(few.alias("r"), reduce(Column.__and__, same), how)
    kept = [F.col(f"l.{c}") for c in many.columns]
    added = [F.col(f"r.{c}") for c in few.columns if c not in keys]
    return matched.select(*kept, *added)


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of each row in a total order, without a one-task window.

    The rows are range-sorted and written to the shared folder once, with their
    place inside their partition; only the partition sizes (one row per sort
    partition) are summed up in order.
    """
    placed = write_through(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(offsets, "_part").select(*df.columns, place.alias(name))


def paged_arrays(
    numbered: DataFrame, columns: list[str], page_size: int = 1000, by: list[str] | None = None
) -> DataFrame:
    """Parallel arrays in position order, one row per page of ``page_size`` rows.

    A report of ordinary size is one page; a larger one continues on further
    pages, so no array grows with the data.
    """
    page = F.floor((F.col("position") - 1) / page_size).cast("long").alias("page")
    entry = F.struct("position", *columns)
    pages = numbered.groupBy(*(by or []), page).agg(
        F.array_sort(F.collect_list(entry)).alias("_rows")
    )
    return pages.select(*(by or []), "page", *[F.col(f"_rows.{c}").alias(c) for c in columns])
