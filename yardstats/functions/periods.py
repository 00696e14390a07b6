"""Reporting periods: half-open date ranges ``[start, end)``.

The parameters of a report are resolved on the driver (two dates), so the scan
gets date literals to push down. The column forms do the same arithmetic for a
whole table of dates. ``today`` is always an argument.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_DAY = timedelta(days=1)

# Period names and the labels shown for them.
PERIOD_LABELS = {
    "today": "Today",
    "yesterday": "Yesterday",
    "this_month": "This Month",
    "last_month": "Last Month",
    "custom": "Custom",
}


class Period(NamedTuple):
    start: date
    end: date


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def resolve_period(
    name: str, today: date, start: str | None = None, end: str | None = None
) -> Period:
    """Named period to a date range; the custom end day is included.

    An unknown name, or a custom period lacking a bound, means today.
    """
    month_start = today.replace(day=1)
    if name == "custom" and start and end:
        return Period(date.fromisoformat(start), date.fromisoformat(end) + ONE_DAY)
    if name == "yesterday":
        return Period(today - ONE_DAY, today)
    if name == "this_month":
        return Period(month_start, _next_month(today))
    if name == "last_month":
        return Period((month_start - ONE_DAY).replace(day=1), month_start)
    return Period(today, today + ONE_DAY)


def month_back(day: date) -> date:
    """Same day one calendar month earlier, clamped to that month's last day."""
    last_of_previous = day.replace(day=1) - ONE_DAY
    return last_of_previous.replace(day=min(day.day, last_of_previous.day))


def previous_period(period: Period) -> Period:
    return Period(month_back(period.start), month_back(period.end))


def describe_period(name: str, start: date | None, end: date | None) -> str:
    if not start or not end:
        return "All Time"
    days = dict.fromkeys([start, end - ONE_DAY])
    text = " - ".join(day.strftime("%d/%m/%Y") for day in days)
    return f"{PERIOD_LABELS.get(name, 'Custom')} ({text})"


def year_period(year: int) -> Period:
    return Period(date(year, 1, 1), date(year + 1, 1, 1))


def month_period(year: int, month: int) -> Period:
    start = date(year, month, 1)
    return Period(start, _next_month(start))


def in_period(moment: Column, period: Period) -> Column:
    """Plain comparison with date literals: reaches Parquet as a pushed filter."""
    return (moment >= F.lit(period.start)) & (moment < F.lit(period.end))


def month_column(moment: str) -> str:
    """Name of the partition column a table laid out by month carries."""
    return f"{moment}_month"


def dated(rows: DataFrame, moment: str, *periods: Period) -> DataFrame:
    """Rows in any of the periods; whole months are pruned if the table is laid out so."""
    kept = rows.filter(reduce(Column.__or__, [in_period(F.col(moment), p) for p in periods]))
    month = month_column(moment)
    if month not in rows.columns:
        return kept
    spans = [
        F.col(month).between(F.lit(p.start.replace(day=1)), F.lit((p.end - ONE_DAY).replace(day=1)))
        for p in periods
    ]
    return kept.filter(reduce(Column.__or__, spans))


# The same rules over a column of dates.


def period_bounds(name: str, today: Column) -> tuple[Column, Column]:
    month_start = F.trunc(today, "MM")
    if name == "yesterday":
        return F.date_sub(today, 1), today
    if name == "this_month":
        return month_start, F.add_months(month_start, 1)
    if name == "last_month":
        return F.add_months(month_start, -1), month_start
    return today, F.date_add(today, 1)


def previous_bound(day: Column) -> Column:
    return F.add_months(day, -1)


def period_text(name: str, start: Column, end: Column) -> Column:
    first = F.date_format(start, "dd/MM/yyyy")
    last = F.date_format(F.date_sub(end, 1), "dd/MM/yyyy")
    days = F.when(first == last, first).otherwise(F.concat(first, F.lit(" - "), last))
    return F.when(start.isNull() | end.isNull(), F.lit("All Time")).otherwise(
        F.concat(F.lit(PERIOD_LABELS.get(name, "Custom") + " ("), days, F.lit(")"))
    )


def month_label(month: Column) -> Column:
    """1..12 to ``Jan``..``Dec``."""
    return F.date_format(F.make_date(F.lit(1900), month, F.lit(1)), "MMM")
