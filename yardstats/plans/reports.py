"""What a user of the library calls: whole reports put together from operators."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.functions.modes import dimension_of, mode_of, report_labels
from yardstats.functions.periods import Period, describe_period, resolve_period
from yardstats.operators import audit, calendar, entities, listings, opportunity, prefs, sheets, stats
from yardstats.operators.calendar import Facts
from yardstats.sources.pages import Selectors, complete_listings, extract_listings


class StatsReport(NamedTuple):
    """Lazy parts of a statistics report, with its labels."""

    rows: DataFrame
    totals: DataFrame
    entities: DataFrame
    labels: dict[str, str]

    def charts(self, page_size: int = 1000) -> DataFrame:
        return stats.chart_arrays(self.rows, page_size)

    def data_rows(self) -> DataFrame:
        """Rows under the names of the data feed, which are the same in every mode."""
        shown = self.rows.select("entity", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "total_vat")])
        return shown.withColumnRenamed("entity", "department")


def period_stats(
    facts: Facts,
    name: str,
    today: date,
    start: str | None = None,
    end: str | None = None,
    mode: str = "sales",
    dimension: str = "department",
    exclude: list[str] | DataFrame | None = None,
    order: list[str] | DataFrame | None = None,
) -> StatsReport:
    """Statistics of a named period. ``rows``: ``entity, total, total_vat, saved_position``."""
    period = resolve_period(name, today, start, end)
    every = stats.stats_rows(facts, period, mode, dimension, exact=True)
    kept = stats.exclude_entities(every, exclude)
    labels = report_labels(mode, dimension) | {"date_range_label": describe_period(name, *period)}
    return StatsReport(
        stats.in_saved_order(stats.as_shown(kept), order), stats.stats_totals(kept), stats.stats_entities(every), labels
    )


class Breakdown(NamedTuple):
    items: DataFrame
    total: DataFrame
    dimension: str
    date_range_label: str
    entity: str

    def payload(self, page_size: int = 1000) -> DataFrame:
        """``entity, dimension, date_range_label, page, items, total``; page 0 is there also without items."""
        paged = stats.breakdown_payload(self.items, page_size)
        paged = paged.join(self.total, "entity").select("page", "items", F.col("total").cast("long"), F.lit(1).alias("real"))
        kinds = {f.name: f.dataType for f in paged.schema.fields}
        none = paged.sparkSession.range(1).select(
            F.lit(0).cast(kinds["page"]).alias("page"), F.array().cast(kinds["items"]).alias("items"),
            F.lit(0).cast("long").alias("total"), F.lit(0).alias("real"),
        )
        pages = paged.union(none).groupBy("page").agg(F.max_by(F.struct("items", "total"), "real").alias("v"))
        return pages.select(
            F.lit(self.entity).alias("entity"), F.lit(self.dimension).alias("dimension"),
            F.lit(self.date_range_label).alias("date_range_label"), "page", "v.items", "v.total",
        )


def breakdown_report(
    facts: Facts,
    name: str,
    today: date,
    entity: str,
    start: str | None = None,
    end: str | None = None,
    mode: str = "parts",
    dimension: str = "department",
) -> Breakdown:
    """Item breakdown of one entity; there is one in parts mode only."""
    if mode_of(mode) != "parts":
        raise ValueError("a breakdown exists in parts mode only")
    if not entity:
        raise ValueError("a breakdown needs an entity")
    period: Period = resolve_period(name, today, start, end)
    items = entities.parts_breakdown(
        facts.sold, facts.invoice, facts.itemtype, period, dimension, entity, facts.users
    )
    return Breakdown(
        items, entities.breakdown_total(items), dimension_of(dimension), describe_period(name, *period), entity
    )


class SearchResult(NamedTuple):
    parts: DataFrame
    sheet_rows: DataFrame | None


def part_search(
    catalogue: DataFrame,
    model: str,
    year: int,
    engine_code: str = "",
    min_price: str | None = None,
    min_opportunity: str | None = None,
    excluding: bool = False,
    grid: DataFrame | None = None,
    header: list[str] | None = None,
) -> SearchResult:
    """Part search, with the sheet rows for the engine code if one is given."""
    parts = opportunity.search_parts(
        catalogue, model, year, engine_code, min_price, min_opportunity,
        opportunity.EXCLUDED_PARTS if excluding else None,
    )
    code = engine_code.strip()
    rows = sheets.sheet_matches(grid, header, code) if code and grid is not None else None
    return SearchResult(parts, rows)


def series_report(
    facts: Facts, year: int, entity: str, month: int | None = None, mode: str = "sales", dimension: str = "department"
) -> DataFrame:
    """Month series of a year, or day series of one of its months, as chart arrays."""
    if month is None:
        series = calendar.monthly_series(facts, year, dimension, mode, entity)
        return stats.series_payload(series, "month", year)
    return stats.series_payload(calendar.daily_series(facts, year, month, dimension, mode, entity), "day", year, month)


def audit_report(
    log: DataFrame, name: str, today: date, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Log rows of a named period.

    Other than in the statistics, the end of a custom period is not included
    here, and a custom period lacking a bound means the latest rows.
    """
    if name != "custom":
        return audit.audit_range(log, *resolve_period(name, today))
    bounds = [date.fromisoformat(text) if text else None for text in (start, end)]
    return audit.audit_range(log, *bounds)


def saved_stats(
    facts: Facts,
    orders: DataFrame,
    exclusions: DataFrame,
    user: str | None,
    name: str,
    today: date,
    exclude: list[str] | None = None,
    mode: str = "sales",
    dimension: str = "department",
    **bounds: str,
) -> StatsReport:
    """A user's statistics: in their saved order, without their saved exclusions.

    An exclusion list in the request replaces the saved one.
    """
    saved = prefs.load_exclusions(exclusions, user, dimension_of(dimension))
    return period_stats(
        facts, name, today, mode=mode, dimension=dimension,
        exclude=stats.effective_exclusions(exclude or [], saved),
        order=prefs.load_order(orders, user), **bounds,
    )


def listing_report(pages: DataFrame, selectors: Selectors = Selectors()) -> DataFrame:
    """Stored pages to priced listings in bands, dearest first."""
    found = complete_listings(extract_listings(pages, selectors))
    # The sort looks through its rows twice, once for its bounds: out of a shuffle, so pages are read once.
    banded = listings.price_bands(listings.priced(found)).repartition("page_id", "position")
    return listings.dearest_first(banded, "page_id", "position", "title")
