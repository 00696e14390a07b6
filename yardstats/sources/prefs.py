"""Preference stores kept as JSON text, one object per file or per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_store(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """``raw`` JSON text. A file missing from its folder reads as no rows."""
    folder, _, name = path.rpartition("/")
    text = spark.read.option("pathGlobFilter", name).text(folder or ".", wholetext=not one_per_line)
    return text.select(F.col("value").alias("raw"))
