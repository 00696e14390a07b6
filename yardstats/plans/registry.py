"""Registered queries: each with the oracle SQL that must give the same rows.

``ordered`` marks a result whose row order is part of its meaning; the tests
compare those row by row against the oracle's ORDER BY.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from yardstats.plans.sample import Sample


class Query(NamedTuple):
    run: Callable[[Sample], DataFrame]
    sql: str | None
    ordered: bool


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ordered: bool = False):
    def register(run: Callable[[Sample], DataFrame]):
        REGISTRY[name] = Query(run, sql, ordered)
        return run

    return register


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be missing, in the one form all clients show alike."""
    return df.withColumns({n: df[n].cast("double") for n in names})


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates as ISO text, for the same reason."""
    return df.withColumns({n: df[n].cast("string") for n in names})


def load() -> dict[str, Query]:
    from yardstats.plans import (  # noqa: F401  (registers on import)
        queries_listings,
        queries_lookup,
        queries_parts,
        queries_prefs,
        queries_stats,
    )

    return REGISTRY


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    run = load()[name].run
    return lambda spark, base: run(Sample(spark, base))
