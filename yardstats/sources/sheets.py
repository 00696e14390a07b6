"""Spreadsheet grids stored as JSON lines: ``row_idx``, ``cells``, ``fills``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from yardstats.schemas import SHEET_GRID


def read_sheet_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHEET_GRID).json(path)
