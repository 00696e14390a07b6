"""Period statistics: rows per entity, totals, chart arrays, saved order, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.functions.modes import dimension_of, mode_of
from yardstats.functions.periods import Period, in_period, previous_period
from yardstats.functions.text import label
from yardstats.operators.calendar import Facts
from yardstats.operators.entities import entity_sales, parts_by_entity, sold_in
from yardstats.operators.spread import number_rows, paged_arrays, skew_join


def parts_comparison(facts: Facts, period: Period, dimension: str = "department") -> DataFrame:
    """``entity, total, total_vat``: parts sold now and in the previous period.

    Both periods come out of one scan and one join, as conditional counts. An
    entity is listed when it has a row in the current period, even if none of
    its rows has a number.
    """
    before = previous_period(period)
    when_now = in_period(F.col("solddate"), period)
    when_before = in_period(F.col("solddate"), before)
    totals = parts_by_entity(
        sold_in(facts.sold, period, before),
        facts.invoice,
        dimension,
        {
            "now": F.when(when_now, F.col("invnumber")),
            "now_rows": F.when(when_now, F.lit(1)),
            "before": F.when(when_before, F.col("invnumber")),
            "before_rows": F.when(when_before, F.lit(1)),
        },
        facts.users,
    )
    # The previous period is looked up by label, and the last row of a label
    # counts. At most two groups share one: the missing name and a literal one.
    shown = totals.select(label(F.col("entity")).alias("entity"), F.col("entity").alias("raw"), "now", "now_rows", "before", "before_rows")
    same_label = W.partitionBy("entity")
    before_value = F.max_by(
        F.when(F.col("before_rows") > 0, F.col("before")),
        F.when(F.col("before_rows") > 0, F.col("raw").isNull().cast("int")),
    ).over(same_label)
    return (
        shown.withColumn("total_vat", F.coalesce(before_value, F.lit(0)))
        .filter(F.col("now_rows") > 0)
        .select("entity", F.col("now").cast("double").alias("total"), F.col("total_vat").cast("double"))
    )


def stats_rows(facts: Facts, period: Period, mode: str, dimension: str, exact: bool = False) -> DataFrame:
    """``entity, total, total_vat`` before exclusion, in no particular order.

    ``exact`` keeps sums of money as decimals, to be added up further.
    """
    if mode_of(mode) == "parts":
        return parts_comparison(facts, period, dimension)
    sales = entity_sales(facts.invoice, period, dimension_of(dimension), facts.users, exact)
    return sales.select("entity", F.col("sum_total").alias("total"), F.col("sum_total_vat").alias("total_vat"))


def name_list(spark: SparkSession, names: list[str]) -> DataFrame:
    """``place, entity`` of a request's names, as a relation whose size Catalyst knows."""
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return spark.range(1).select(F.posexplode(listed).alias("place", "entity"))


def exclude_entities(rows: DataFrame, exclude: list[str] | DataFrame | None) -> DataFrame:
    """Drop the listed entities; a missing name is never listed and stays.

    An anti join, not ``NOT IN``: a null in the list must not empty the result.
    """
    if exclude is None:
        return rows
    if not isinstance(exclude, DataFrame):
        if not exclude:
            return rows
        exclude = name_list(rows.sparkSession, exclude).select("entity")
    return rows.join(exclude.select("entity"), "entity", "left_anti")


def effective_exclusions(
    requested: list[str], saved: list[str] | DataFrame
) -> list[str] | DataFrame:
    """A request list replaces the saved one; an empty request falls back to it."""
    return requested or saved


def saved_positions(order: DataFrame) -> DataFrame:
    """``entity, saved_position`` of an ``items`` array; a repeated name keeps its last place."""
    places = order.select(F.posexplode("items").alias("place", "entity"))
    return places.groupBy("entity").agg(F.max("place").alias("saved_position"))


def in_saved_order(rows: DataFrame, order: DataFrame | list[str] | None) -> DataFrame:
    """Saved names first, in their saved order; then the others by name."""
    if not isinstance(order, DataFrame):
        positions = name_list(rows.sparkSession, order or []).groupBy("entity").agg(
            F.max("place").alias("saved_position")
        )
    else:
        positions = saved_positions(order)
    placed = rows.join(positions, "entity", "left")
    return placed.orderBy(F.asc_nulls_last("saved_position"), F.asc_nulls_last("entity"), F.desc("total"))


def stats_totals(rows: DataFrame) -> DataFrame:
    """Grand totals of the rows that are left; a missing value counts as nothing."""
    return rows.agg(
        F.coalesce(F.sum(_money("total")), F.lit(0)).cast("double").alias("sum_total"),
        F.coalesce(F.sum(_money("total_vat")), F.lit(0)).cast("double").alias("sum_total_vat"),
    )


def _money(name: str):
    # Totals are exact to the third decimal; add them up as such.
    return F.col(name).cast("decimal(38,3)")


def as_shown(rows: DataFrame) -> DataFrame:
    """Totals as doubles, after all sums are done."""
    return rows.withColumns({c: F.col(c).cast("double") for c in ("total", "total_vat")})


def stats_entities(rows: DataFrame) -> DataFrame:
    """Names to offer in the exclusion list: all of them, before exclusion."""
    return rows.select("entity").distinct().orderBy(F.asc_nulls_last("entity"))


def chart_arrays(ordered: DataFrame, page_size: int = 1000) -> DataFrame:
    """``page, chart_labels, chart_values``: parallel arrays in report order."""
    order = [F.asc_nulls_last("saved_position"), F.asc_nulls_last("entity"), F.desc("total")]
    numbered = number_rows(ordered, order)
    pages = paged_arrays(
        numbered.select(
            "position",
            F.col("entity").alias("chart_labels"),
            F.coalesce(F.col("total"), F.lit(0.0)).alias("chart_values"),
        ),
        ["chart_labels", "chart_values"],
        page_size,
    )
    return pages


def series_payload(series: DataFrame, field: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """``entity, labels, values, <field>s``: parallel arrays of a month or day series.

    With the ``year`` and ``month`` they are of, where given. A series has at most 12
    months or 31 days, so the arrays are short.
    """
    points = F.array_sort(F.collect_list(F.struct(field, "label", "value"))).alias("points")
    asked = [F.lit(v).alias(n) for n, v in (("year", year), ("month", month)) if v is not None]
    return series.groupBy("entity").agg(points).select(
        "entity",
        *asked,
        F.col("points.label").alias("labels"),
        F.col("points.value").alias("values"),
        F.col(f"points.{field}").alias(f"{field}s"),
    )


def breakdown_payload(breakdown: DataFrame, page_size: int = 1000) -> DataFrame:
    """``entity, page, items`` with items as ``{itemname, count}`` in report order."""
    order = [F.asc("entity"), F.desc("parts_sold"), F.asc("itemname")]
    numbered = number_rows(breakdown, order, "at")
    firsts = numbered.groupBy("entity").agg(F.min("at").alias("first"))
    placed = skew_join(numbered, firsts, ["entity"]).select(
        "entity",
        (F.col("at") - F.col("first") + 1).alias("position"),
        F.struct("itemname", F.col("parts_sold").alias("count")).alias("items"),
    )
    return paged_arrays(placed, ["items"], page_size, by=["entity"])
