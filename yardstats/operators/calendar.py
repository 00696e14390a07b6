"""Month and day series. Only months and days with data appear; none is filled in.

One aggregation serves every entity, so a dashboard of N entities costs one scan
instead of N.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstats.functions.modes import dimension_of, mode_of
from yardstats.functions.periods import Period, month_label, month_period, year_period
from yardstats.operators.entities import (
    invoiced_in,
    net,
    parts_by_entity,
    sales_by_entity,
    sold_in,
)


class Facts(NamedTuple):
    """The tables a report reads."""

    invoice: DataFrame
    sold: DataFrame | None = None
    users: DataFrame | None = None
    itemtype: DataFrame | None = None


def calendar_totals(
    facts: Facts,
    mode: str,
    dimension: str,
    by: dict[str, str],
    period: Period | None = None,
    entity: str | None = None,
) -> DataFrame:
    """``entity, <by>, value`` over calendar fields such as ``{"month": "month"}``.

    ``by`` maps output names to the calendar field to take (year, month, day).
    """
    parts = mode_of(mode) == "parts"
    moment = F.col("solddate" if parts else "datecreated")
    fields: dict[str, Column] = {n: _FIELDS[f](moment).cast("int") for n, f in by.items()}
    if parts:
        rows = sold_in(facts.sold, period) if period else facts.sold.filter(F.col("issold"))
        totals = parts_by_entity(
            rows, facts.invoice, dimension, {"value": F.col("invnumber")}, facts.users, fields,
            entity=entity, labelled=True,
        )
    else:
        rows = invoiced_in(facts.invoice, period) if period else facts.invoice
        totals = sales_by_entity(rows, dimension, {"value": net()}, facts.users, fields)
        if entity is not None:
            totals = totals.filter(F.col("entity") == F.lit(entity))
    return totals.select("entity", *by, F.col("value").cast("double")).orderBy(
        F.asc_nulls_last("entity"), *by
    )


_FIELDS = {"year": F.year, "month": F.month, "day": F.dayofmonth}


def monthly_series(
    facts: Facts, year: int, dimension: str, mode: str, entity: str | None = None
) -> DataFrame:
    """``entity, month, label, value`` for the months of one year that have data."""
    totals = calendar_totals(facts, mode, dimension, {"month": "month"}, year_period(year), entity)
    return totals.select("entity", "month", month_label(F.col("month")).alias("label"), "value")


def daily_series(
    facts: Facts, year: int, month: int, dimension: str, mode: str, entity: str | None = None
) -> DataFrame:
    """``entity, day, label, value`` for the days of one month that have data."""
    totals = calendar_totals(facts, mode, dimension, {"day": "day"}, month_period(year, month), entity)
    return totals.select("entity", "day", F.col("day").cast("string").alias("label"), "value")


def calendar_all(facts: Facts, dimension: str, mode: str, daily: bool = True) -> DataFrame:
    """Every entity, every year and month (and day) there is."""
    by = {"year": "year", "month": "month"} | ({"day": "day"} if daily else {})
    return calendar_totals(facts, mode, dimension_of(dimension), by)
