"""A table of daily totals that is kept up to date month by month.

Beside the totals lies a list of the fact files they were made from. A refresh compares it
with the files there are now: months in which a file is new or gone are aggregated again, out of those
months only, and only their part of the table is replaced. Sold rows can also change because an
invoice came: the months in which an invoice of a new file is sold from are done too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.functions.modes import mode_of
from yardstats.functions.periods import month_column
from yardstats.operators.calendar import Facts, calendar_totals
from yardstats.session import Files, write_through

MONTH = "month_start"
FILES = "fact string, file string, month date"  # the list of files
_BY = {"year": "year", "month": "month", "day": "day"}


class Refreshed(NamedTuple):
    months: list  # that were aggregated again
    gone: list  # of these, the ones without any row now


def _listed(facts: Facts, parts: bool) -> DataFrame:
    """fact, file, month of the stored facts. No column is read but the month, which is in the files' names."""

    def of(rows: DataFrame, fact: str, moment: str) -> DataFrame:
        month = month_column(moment)
        if month not in rows.columns:
            raise ValueError(f"{fact} is not laid out by month: see write_by_month")
        return rows.select(F.lit(fact).alias("fact"), F.col("_metadata.file_path").alias("file"), F.col(month).alias("month")).distinct()

    found = of(facts.invoice, "invoice", "datecreated")
    return found.union(of(facts.sold, "sold", "solddate")) if parts else found


def _touched(facts: Facts, changed: DataFrame, parts: bool) -> DataFrame:
    """Months whose totals may differ, as ``month``."""
    own = changed.filter(F.col("fact") == ("sold" if parts else "invoice")).select("month")
    if not parts:
        return own.distinct()
    files = changed.filter("fact = 'invoice'").select("file")
    late = facts.invoice.select("invoice_id", F.col("_metadata.file_path").alias("file")).join(files, "file", "left_semi")
    month = F.col(month_column("solddate")).alias("month")
    moved = facts.sold.filter("issold").select("invoice_id", month).join(late.select("invoice_id"), "invoice_id", "left_semi")
    return own.union(moved.select("month")).distinct()


def refresh_days(spark: SparkSession, path: str, facts: Facts, dimension: str, mode: str) -> Refreshed:
    """Bring the table under ``path`` up to date with ``facts``, which lie as ``write_by_month`` stores them.

    The first call makes the table. Months that no file touches keep their files. A refresh that breaks off is
    made up by the next one, because the list of files is replaced last. One writer at a time. Files that were rewritten count as
    gone and new. The driver holds the months that are touched, nothing else.
    """
    parts = mode_of(mode) == "parts"
    files = Files(spark, path)
    now = write_through(_listed(facts, parts), "fact-files")
    generation = max((int(n.removeprefix("files-")) for n in files.names() if n.startswith("files-") and files.exists(f"{n}/_SUCCESS")), default=0)
    known = spark.read.schema(FILES).parquet(f"{path}/files-{generation}") if generation else spark.createDataFrame([], FILES)
    changed = now.exceptAll(known).union(known.exceptAll(now))
    months = sorted((r.month for r in _touched(facts, write_through(changed, "changed-files"), parts).collect()), key=lambda m: (m is None, m))
    gone: list = []
    if months:
        gone = _replace(spark, f"{path}/days", facts, dimension, mode, months)
    now.write.mode("overwrite").parquet(f"{path}/files-{generation + 1}")
    for name in files.names():
        if name.startswith("files-") and int(name.removeprefix("files-")) < generation:
            files.delete(name)
    return Refreshed(months, gone)


def _replace(spark: SparkSession, path: str, facts: Facts, dimension: str, mode: str, months: list) -> list:
    """Aggregate the months again and put them in the place of what is stored of them."""
    parts = mode_of(mode) == "parts"
    column = month_column("solddate" if parts else "datecreated")
    wanted = F.col(column).isin([m for m in months if m is not None])
    wanted = wanted | F.col(column).isNull() if None in months else wanted
    own = facts._replace(sold=facts.sold.filter(wanted)) if parts else facts._replace(invoice=facts.invoice.filter(wanted))
    totals = calendar_totals(own, mode, dimension, _BY)
    totals = write_through(totals.withColumn(MONTH, F.make_date("year", "month", F.lit(1))), "day-totals")
    left = {r[0] for r in totals.select(MONTH).distinct().collect()}
    totals.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    gone = [m for m in months if m not in left]
    files = Files(spark, path)
    for month in gone:  # an overwrite leaves a month alone of which it has no row
        files.delete(f"{MONTH}={'__HIVE_DEFAULT_PARTITION__' if month is None else month.isoformat()}")
    return gone


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """``entity, year, month, day, value`` as the last refresh left it, with ``month_start`` to prune by."""
    return spark.read.schema(f"entity string, year int, month int, day int, value double, {MONTH} date").parquet(f"{path}/days")
