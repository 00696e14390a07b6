"""Both facts stored in the buckets of their join key, so that joining them moves no row.

A bucket is chosen by the invoice and a slot. Rows of the null invoice, and of one that would fill
a bucket alone, are dealt out over slots; the invoice row of the latter is stored once
per slot. So no bucket holds a key's third of all rows, and a join on both columns finds the same pairs
as one on the invoice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.functions.periods import month_column
from yardstats.session import write_through
from yardstats.sources.buckets import KEY, SLOT, layout_path, table_name

SLOTS = 64


def _write(rows: DataFrame, path: str, buckets: int, month: str | None) -> None:
    """One file per bucket (and month): a task writes one bucket, under the hash that buckets have."""
    name = table_name(path) + "_written"
    writer = rows.repartition(buckets, KEY, SLOT).write.mode("overwrite").bucketBy(buckets, KEY, SLOT).sortBy(KEY)
    if month:
        writer = writer.partitionBy(month)
    writer.option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # its files stay; a reader names them anew


def write_bucketed(sold: DataFrame, invoice: DataFrame, base: str, buckets: int, slots: int = SLOTS) -> None:
    """Store ``sold`` (by month of ``solddate`` too) and ``invoice`` under ``base``.

    Take so many ``buckets`` that one of them, of one month, is a task's work.
    """
    spark: SparkSession = sold.sparkSession
    counts = sold.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))
    counts = write_through(counts, "rows-per-invoice")
    share = (counts.agg(F.sum("rows")).first()[0] or 0) / buckets
    # Fewer than ``buckets`` invoices can have more rows than an average bucket.
    heavy = write_through(counts.filter(F.col("rows") > share).select(KEY, F.lit(True).alias("_heavy")), "heavy-invoices")

    dealt = F.pmod(F.xxhash64("invnumber", "itemtype_id", "solddate"), F.lit(slots)).cast("int")
    slot = F.when(F.col(KEY).isNull() | F.col("_heavy"), dealt).otherwise(0)
    month = month_column("solddate")
    rows = sold.drop(month).join(heavy, KEY, "left").withColumn(SLOT, slot).drop("_heavy")
    _write(rows.withColumn(month, F.trunc("solddate", "MM")), f"{base}/sold", buckets, month)

    each = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(F.array(F.lit(0)))
    rows = invoice.join(heavy, KEY, "left").withColumn(SLOT, F.explode(each)).drop("_heavy")
    _write(rows, f"{base}/invoice", buckets, None)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(layout_path(base))
