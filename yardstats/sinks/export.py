"""Exports as delimited text with display headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.functions.periods import month_column
from yardstats.operators import audit, opportunity
from yardstats.session import overwrite_table  # noqa: F401  (a sink, used by operators too)


FILES_PER_MONTH = 8
_PLAIN = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header; a quote inside a value is doubled, blanks stay."""
    df.write.mode("overwrite").options(header=True, **_PLAIN).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` wrote, all columns as text; an empty value is null."""
    return spark.read.options(header=True, multiLine=True, **_PLAIN).csv(path)


def export_search(found: DataFrame, path: str) -> None:
    write_csv(opportunity.export_rows(found.orderBy("position")), path)


def export_audit(log: DataFrame, path: str) -> None:
    """Part files are in order: the first holds the newest rows."""
    write_csv(audit.export_rows(log), path)


def write_by_month(df: DataFrame, path: str, moment: str, mode: str = "overwrite") -> None:
    """Store a table laid out by the month of ``moment``; ``mode="append"`` adds files to it.

    Period reports on it read the files of their months only. A month's rows are dealt
    out over a few tasks by day, so that it has few files and no task has it alone.
    """
    month = F.trunc(F.col(moment), "MM").alias(month_column(moment))
    rows = df.select("*", month).repartition(month_column(moment), F.dayofmonth(moment) % FILES_PER_MONTH)
    rows.write.mode(mode).partitionBy(month_column(moment)).parquet(path)
