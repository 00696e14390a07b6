"""Read facts that are stored in the buckets of their join key."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstats.functions.periods import month_column
from yardstats.schemas import INVOICE, SOLD

KEY, SLOT = "invoice_id", "invoice_slot"


def table_name(path: str) -> str:
    return f"yardstats_{hashlib.sha1(path.encode()).hexdigest()}"


def layout_path(base: str) -> str:
    return f"{base.rstrip('/')}/layout"


def _read(spark: SparkSession, path: str, schema: T.StructType, buckets: int, month: str | None) -> DataFrame:
    """Name the files as a table of the session, which is what makes Spark see their buckets."""
    name = table_name(path)
    columns = [(f.name, f.dataType.simpleString()) for f in schema] + [(SLOT, "int")] + ([(month, "date")] if month else [])
    listed = ", ".join(f"`{column}` {kind}" for column, kind in columns)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({listed}) USING parquet {f'PARTITIONED BY ({month})' if month else ''} "
        f"CLUSTERED BY ({KEY}, {SLOT}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if month:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(sold, invoice) as ``write_bucketed`` stored them.

    Both carry ``invoice_slot``; an invoice that is stored once per slot counts once, in slot 0.
    """
    base = base.rstrip("/")
    buckets = spark.read.schema("buckets int").json(layout_path(base)).first().buckets
    sold = _read(spark, f"{base}/sold", SOLD, buckets, month_column("solddate"))
    return sold, _read(spark, f"{base}/invoice", INVOICE, buckets, None)


def once(invoice: DataFrame) -> DataFrame:
    """Each invoice once, however it is stored."""
    return invoice.filter(F.col(SLOT) == 0) if SLOT in invoice.columns else invoice
