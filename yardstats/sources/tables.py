"""Stored tables and the delimited catalogue file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstats.schemas import CATALOGUE, CATALOGUE_NAMES, TABLES


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A business table stored as Parquet under ``base``; the schema is not inferred."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{base.rstrip('/')}/{name}")


def jdbc_options(
    url: str, table: str, key: str, low: int, high: int, parts: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options of a database scan cut into ``parts`` key ranges read side by side."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(parts),
        "fetchsize": str(fetch_size),
    }


def read_jdbc_table(spark: SparkSession, **options) -> DataFrame:
    """A table behind a database connection; date filters are pushed into it."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_catalogue(spark: SparkSession, path: str, line_breaks_in_values: bool = False) -> DataFrame:
    """The catalogue from delimited text with a header, with its row order.

    Columns are found by their names in the header, in any order and among any others;
    a file that lacks one is refused. A value that is not of its column's type is null.

    ``row_id`` sorts rows by file, block in the file and place in the block:
    the order in which a single reader would have met them. Whole numbers may be
    written with a fraction (``3.0``), as files with gaps often have them. Line
    breaks inside quoted values keep a file from being split, so they have to be
    asked for.
    """
    # Without a schema and inference only the header is looked at; all columns are text.
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=line_breaks_in_values).csv(path)
    missing = [name for name in CATALOGUE_NAMES if name not in raw.columns]
    if missing:
        raise ValueError(f"the catalogue lacks {', '.join(missing)}")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    types = {f.name: f.dataType for f in CATALOGUE.fields}

    def typed(name: str, column: str) -> Column:
        text = F.col(f"`{name}`")
        value = text.try_cast(types[column])
        if isinstance(types[column], T.IntegralType):
            value = F.coalesce(value, text.try_cast("double").try_cast(types[column]))  # 3.0 is a whole number
        return value.alias(column)

    return raw.select(place.alias("row_id"), *[typed(n, c) for n, c in CATALOGUE_NAMES.items()])
