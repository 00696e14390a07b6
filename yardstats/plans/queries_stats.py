"""Registered queries: sales, parts sold, comparisons, series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.functions import periods
from yardstats.functions.text import item_label, label, label_is, month_param, strip
from yardstats.operators import calendar, daytable, entities, stats
from yardstats.plans.registry import as_double, as_text, query
from yardstats.plans.reports import breakdown_report, period_stats, saved_stats, series_report
from yardstats.plans.sample import Sample
from yardstats.plans.views import over
from yardstats.session import work_path
from yardstats.sinks.buckets import write_bucketed
from yardstats.sinks.export import write_by_month
from yardstats.sources.buckets import read_bucketed
from yardstats.sources.tables import read_table
from yardstats.streaming import live

MARCH = periods.Period(date(1997, 3, 1), date(1997, 4, 1))
IN_MARCH = "{0} >= DATE '1997-03-01' AND {0} < DATE '1997-04-01'"
IN_FEBRUARY = "{0} >= DATE '1997-02-01' AND {0} < DATE '1997-03-01'"
TODAY = date(1997, 3, 14)
SAVED_ORDER = ["MACHINERY", "BUILDING", "NOWHERE", "MACHINERY"]
EXCLUDED = ["HOUSEHOLD", "Unknown", "NOWHERE"]


def _texts(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# Sums and counts per entity


@query(
    "department_sales",
    over("v_invoice", f"""
SELECT departmentname AS entity, CAST(sum(total) AS DOUBLE) AS sum_total, CAST(sum(total + totaltax1) AS DOUBLE) AS sum_total_vat
FROM v_invoice WHERE {IN_MARCH.format('datecreated')} GROUP BY 1 ORDER BY entity NULLS LAST"""),
    ordered=True,
)
def department_sales(s: Sample) -> DataFrame:
    return entities.entity_sales(s.invoice(), MARCH)


@query(
    "user_sales",
    over("v_invoice v_users", f"""
SELECT shortname AS entity, CAST(sum(total) AS DOUBLE) AS sum_total, CAST(sum(total + totaltax1) AS DOUBLE) AS sum_total_vat
FROM v_invoice JOIN v_users ON user_id = whocreated_id
WHERE {IN_MARCH.format('datecreated')} GROUP BY 1 ORDER BY entity NULLS LAST"""),
    ordered=True,
)
def user_sales(s: Sample) -> DataFrame:
    return entities.entity_sales(s.invoice(), MARCH, "user", s.users())


@query(
    "department_parts",
    over("v_owned", f"""
SELECT coalesce(departmentname, 'Unknown') AS entity, count(invnumber) AS parts_sold
FROM v_owned WHERE issold AND {IN_MARCH.format('solddate')}
GROUP BY v_owned.departmentname ORDER BY 1"""),
    ordered=True,
)
def department_parts(s: Sample) -> DataFrame:
    return entities.entity_parts(s.sold(), s.invoice(), MARCH)


def _bucketed(s: Sample) -> tuple[DataFrame, DataFrame]:
    """(sold, invoice) stored in buckets of the invoice, as a cluster would hold them."""
    base = work_path(s.spark, "bucketed")
    write_bucketed(s.sold(), s.invoice(), base, buckets=8)
    return read_bucketed(s.spark, base)


_PARTS = """
SELECT coalesce({0}, 'Unknown') AS entity, count(invnumber) AS parts_sold
FROM v_owned WHERE issold AND {1} GROUP BY v_owned.{0} ORDER BY {2}"""


@query("department_parts_bucketed", over("v_owned", _PARTS.format("departmentname", IN_MARCH.format("solddate"), "1")), ordered=True)
def department_parts_bucketed(s: Sample) -> DataFrame:
    return entities.entity_parts(*_bucketed(s), MARCH)


@query(
    "user_parts_bucketed",
    over("v_owned", _PARTS.format("shortname", IN_MARCH.format("solddate"), "v_owned.shortname NULLS LAST")),
    ordered=True,
)
def user_parts_bucketed(s: Sample) -> DataFrame:
    return entities.entity_parts(*_bucketed(s), MARCH, "user", s.users())


@query(
    "user_parts",
    over("v_owned", f"""
SELECT coalesce(shortname, 'Unknown') AS entity, count(invnumber) AS parts_sold
FROM v_owned WHERE issold AND {IN_MARCH.format('solddate')}
GROUP BY v_owned.shortname ORDER BY v_owned.shortname NULLS LAST"""),
    ordered=True,
)
def user_parts(s: Sample) -> DataFrame:
    return entities.entity_parts(s.sold(), s.invoice(), MARCH, "user", s.users())


def _breakdown_sql(name: str, test: str, views: str = "v_owned v_itemtype") -> str:
    return over(views, f"""
SELECT entity, coalesce(replace(replace(replace(raw, '[', ''), ']', ''), '_', ' '), 'Unknown') AS itemname, parts_sold FROM (
 SELECT coalesce(o.{name}, 'Unknown') AS entity, t.itemname AS raw, count(o.invnumber) AS parts_sold
 FROM v_owned o LEFT JOIN v_itemtype t ON t.itemtype_id = o.itemtype_id
 WHERE o.issold AND {IN_MARCH.format('o.solddate')} AND {test} GROUP BY 1, 2)
ORDER BY parts_sold DESC, itemname, entity""")


@query("parts_breakdown", _breakdown_sql("departmentname", "coalesce(o.departmentname, 'Unknown') = 'Unknown'"), ordered=True)
def parts_breakdown(s: Sample) -> DataFrame:
    return entities.parts_breakdown(s.sold(), s.invoice(), s.itemtype(), MARCH, entity="Unknown")


@query("parts_breakdown_user", _breakdown_sql("shortname", "o.shortname = (SELECT min(shortname) FROM v_users WHERE user_id = 7)"), ordered=True)
def parts_breakdown_user(s: Sample) -> DataFrame:
    seventh = s.users().filter("user_id = 7").first()["shortname"]
    return entities.parts_breakdown(s.sold(), s.invoice(), s.itemtype(), MARCH, "user", seventh, s.users())


@query("parts_breakdown_all", _breakdown_sql("departmentname", "true"), ordered=True)
def parts_breakdown_all(s: Sample) -> DataFrame:
    return entities.parts_breakdown(s.sold(), s.invoice(), s.itemtype(), MARCH)


@query("parts_breakdown_bucketed", _breakdown_sql("departmentname", "true"), ordered=True)
def parts_breakdown_bucketed(s: Sample) -> DataFrame:
    sold, invoice = _bucketed(s)
    return entities.parts_breakdown(sold, invoice, s.itemtype(), MARCH)


@query(
    "breakdown_total",
    over("v_owned", f"""
SELECT coalesce(departmentname, 'Unknown') AS entity, count(invnumber) AS total
FROM v_owned WHERE issold AND {IN_MARCH.format('solddate')} AND departmentname = 'BUILDING' GROUP BY 1"""),
)
def breakdown_total(s: Sample) -> DataFrame:
    return breakdown_report(s.facts(), "this_month", TODAY, "BUILDING").total.withColumn(
        "total", F.col("total").cast("long")
    )


@query(
    "breakdown_payload",
    over("v_owned v_itemtype", f"""
SELECT entity, (place - 1) // 40 AS page, string_agg(itemname || '=' || CAST(parts_sold AS VARCHAR), '|' ORDER BY place) AS items FROM (
 SELECT *, row_number() OVER (PARTITION BY entity ORDER BY parts_sold DESC, itemname) AS place FROM (
  SELECT coalesce(o.departmentname, 'Unknown') AS entity,
   coalesce(replace(replace(replace(t.itemname, '[', ''), ']', ''), '_', ' '), 'Unknown') AS itemname, count(o.invnumber) AS parts_sold
  FROM v_owned o LEFT JOIN v_itemtype t ON t.itemtype_id = o.itemtype_id
  WHERE o.issold AND {IN_MARCH.format('o.solddate')} GROUP BY 1, t.itemname))
GROUP BY 1, 2"""),
)
def breakdown_payload(s: Sample) -> DataFrame:
    pages = stats.breakdown_payload(parts_breakdown_all(s), page_size=40)
    shown = F.transform("items", lambda i: F.concat(i["itemname"], F.lit("="), i["count"].cast("string")))
    return pages.select("entity", "page", F.array_join(shown, "|").alias("items"))


# Period comparison and report composition

_COMPARISON = over("v_owned", f"""
SELECT c.entity, CAST(c.n AS DOUBLE) AS total, CAST(coalesce(p.n, 0) AS DOUBLE) AS total_vat
FROM (SELECT coalesce({{name}}, 'Unknown') AS entity, count(invnumber) AS n FROM v_owned
      WHERE issold AND {IN_MARCH.format('solddate')} GROUP BY 1) c
LEFT JOIN (SELECT coalesce({{name}}, 'Unknown') AS entity, count(invnumber) AS n FROM v_owned
      WHERE issold AND {IN_FEBRUARY.format('solddate')} GROUP BY 1) p ON p.entity = c.entity""")


@query("parts_period_comparison", _COMPARISON.format(name="departmentname"))
def parts_period_comparison(s: Sample) -> DataFrame:
    return stats.parts_comparison(s.facts(), MARCH)


@query("parts_period_comparison_user", _COMPARISON.format(name="shortname"))
def parts_period_comparison_user(s: Sample) -> DataFrame:
    return stats.parts_comparison(s.facts(), MARCH, "user")


_SALES = f"""SELECT departmentname AS entity, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(total + totaltax1) AS DOUBLE) AS total_vat
FROM v_invoice WHERE {IN_MARCH.format('datecreated')} GROUP BY 1"""


@query(
    "stats_exclude_entities",
    over("v_invoice", f"SELECT * FROM ({_SALES}) WHERE entity IS NULL OR entity NOT IN ({_texts(EXCLUDED)})"),
)
def stats_exclude_entities(s: Sample) -> DataFrame:
    return stats.exclude_entities(stats.stats_rows(s.facts(), MARCH, "sales", "department"), EXCLUDED)


@query(
    "stats_custom_order",
    over("v_invoice", f"""
SELECT entity, total, total_vat, CAST(CASE entity WHEN 'MACHINERY' THEN 3 WHEN 'BUILDING' THEN 1 END AS DOUBLE) AS saved_position
FROM ({_SALES}) ORDER BY saved_position NULLS LAST, entity NULLS LAST"""),
    ordered=True,
)
def stats_custom_order(s: Sample) -> DataFrame:
    rows = period_stats(s.facts(), "this_month", TODAY, order=SAVED_ORDER).rows
    return as_double(rows, "saved_position")


@query(
    "stats_totals",
    over("v_invoice", f"""
SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) AS sum_total, CAST(coalesce(sum(total + totaltax1), 0) AS DOUBLE) AS sum_total_vat
FROM v_invoice WHERE {IN_MARCH.format('datecreated')} AND (departmentname IS NULL OR departmentname NOT IN ({_texts(EXCLUDED)}))"""),
)
def stats_totals(s: Sample) -> DataFrame:
    return period_stats(s.facts(), "custom", TODAY, "1997-03-01", "1997-03-31", exclude=EXCLUDED).totals


@query(
    "stats_totals_parts",
    over("v_owned", f"""
SELECT CAST(count(CASE WHEN {IN_MARCH.format('solddate')} THEN invnumber END) AS DOUBLE) AS sum_total,
 CAST(count(CASE WHEN {IN_FEBRUARY.format('solddate')} THEN invnumber END) AS DOUBLE) AS sum_total_vat
FROM v_owned WHERE issold AND coalesce(departmentname, 'Unknown') NOT IN ({_texts(EXCLUDED)})"""),
)
def stats_totals_parts(s: Sample) -> DataFrame:
    return period_stats(s.facts(), "this_month", TODAY, mode="parts", exclude=EXCLUDED).totals


@query(
    "stats_entities",
    over("v_owned", f"""
SELECT DISTINCT coalesce(shortname, 'Unknown') AS entity FROM v_owned
WHERE issold AND {IN_MARCH.format('solddate')} ORDER BY 1"""),
    ordered=True,
)
def stats_entities(s: Sample) -> DataFrame:
    report = period_stats(s.facts(), "last_month", date(1997, 4, 2), mode="parts", dimension="user", exclude=["Unknown"])
    return report.entities


@query(
    "stats_chart_arrays",
    over("v_owned", f"""
SELECT (place - 1) // 8 AS page, string_agg(entity, '|' ORDER BY place) AS chart_labels, string_agg(CAST(n AS VARCHAR), '|' ORDER BY place) AS chart_values
FROM (SELECT *, row_number() OVER (ORDER BY entity) AS place FROM (
 SELECT coalesce(shortname, 'Unknown') AS entity, count(invnumber) AS n FROM v_owned
 WHERE issold AND {IN_MARCH.format('solddate')} GROUP BY 1)) GROUP BY 1"""),
)
def stats_chart_arrays(s: Sample) -> DataFrame:
    charts = period_stats(s.facts(), "this_month", TODAY, mode="parts", dimension="user").charts(page_size=8)
    values = F.transform("chart_values", lambda v: v.cast("long").cast("string"))
    return charts.select(
        "page", F.array_join("chart_labels", "|").alias("chart_labels"), F.array_join(values, "|").alias("chart_values")
    )


@query(
    "stats_data",
    over("v_invoice", f"SELECT entity AS department, coalesce(total, 0) AS total, coalesce(total_vat, 0) AS total_vat FROM ({_SALES}) ORDER BY department NULLS LAST"),
    ordered=True,
)
def stats_data(s: Sample) -> DataFrame:
    return period_stats(s.facts(), "this_month", TODAY).data_rows()


def saved_prefs(s: Sample) -> tuple[DataFrame, DataFrame]:
    """Saved orders and exclusions of every customer, as users."""
    orders = s.raw("customer").select(
        F.col("c_name").alias("username"), F.array(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("items")
    )
    exclusions = s.raw("customer").select(
        F.col("c_name").alias("username"),
        F.lit("department").alias("dimension"),
        F.array(F.col("c_mktsegment"), F.lit("Unknown")).alias("items"),
    )
    return orders, exclusions


@query(
    "stats_saved_prefs",
    over("v_owned", f"""
SELECT entity, total, 0.0::DOUBLE + total_vat AS total_vat, CAST(CASE WHEN entity = 'MACHINERY' THEN 1 WHEN entity = mine THEN 0 END AS DOUBLE) AS saved_position
FROM (SELECT coalesce(departmentname, 'Unknown') AS entity, CAST(count(CASE WHEN {IN_MARCH.format('solddate')} THEN invnumber END) AS DOUBLE) AS total,
  CAST(count(CASE WHEN {IN_FEBRUARY.format('solddate')} THEN invnumber END) AS DOUBLE) AS total_vat
  FROM v_owned WHERE issold GROUP BY 1), (SELECT c_mktsegment AS mine FROM customer WHERE c_name = 'Customer#000000003')
WHERE entity <> mine AND entity <> 'Unknown' ORDER BY saved_position NULLS LAST, entity"""),
    ordered=True,
)
def stats_saved_prefs(s: Sample) -> DataFrame:
    orders, exclusions = saved_prefs(s)
    report = saved_stats(
        s.facts(), orders, exclusions, "Customer#000000003", "custom", TODAY, mode="parts", start="1997-03-01", end="1997-03-31"
    )
    return as_double(report.rows, "saved_position")


# Month and day series

_MONTH = "CAST(month({0}) AS INTEGER) AS month, strftime({0}, '%b') AS label"
_DAY = "CAST(day({0}) AS INTEGER) AS day, CAST(day({0}) AS VARCHAR) AS label"


def _series_sql(mode: str, dimension: str, daily: bool, entity: str) -> str:
    moment = "solddate" if mode == "parts" else "datecreated"
    name = "shortname" if dimension == "user" else "departmentname"
    fields = (_DAY if daily else _MONTH).format(moment)
    start, end = ("1997-12-01", "1998-01-01") if daily else ("1997-01-01", "1998-01-01")
    window = f"{moment} >= DATE '{start}' AND {moment} < DATE '{end}'"
    if mode == "parts":
        body = f"""SELECT coalesce({name}, 'Unknown') AS entity, {fields}, CAST(count(invnumber) AS DOUBLE) AS value
FROM v_owned WHERE issold AND {window} AND coalesce({name}, 'Unknown') = {entity} GROUP BY 1, 2, 3 ORDER BY 2"""
        return over("v_owned", body)
    source = "v_invoice JOIN v_users ON user_id = whocreated_id" if dimension == "user" else "v_invoice"
    body = f"""SELECT {name} AS entity, {fields}, CAST(sum(total) AS DOUBLE) AS value
FROM {source} WHERE {window} AND {name} = {entity} GROUP BY 1, 2, 3 ORDER BY 2"""
    return over("v_invoice v_users", body)


_SEVENTH = "(SELECT min(shortname) FROM v_users WHERE user_id = 7)"


def _seventh(s: Sample) -> str:
    return s.users().filter("user_id = 7").first()["shortname"]


def _register_series(name: str, mode: str, dimension: str, daily: bool, entity: str | None) -> None:
    wanted = _SEVENTH if entity is None else f"'{entity}'"

    def run(s: Sample) -> DataFrame:
        who = _seventh(s) if entity is None else entity
        if daily:
            return calendar.daily_series(s.facts(), 1997, 12, dimension, mode, who)
        return calendar.monthly_series(s.facts(), 1997, dimension, mode, who)

    query(name, _series_sql(mode, dimension, daily, wanted), ordered=True)(run)


_register_series("department_monthly", "sales", "department", False, "BUILDING")
_register_series("department_parts_monthly", "parts", "department", False, "Unknown")
_register_series("user_monthly", "sales", "user", False, None)
_register_series("user_parts_monthly", "parts", "user", False, None)
_register_series("department_daily", "sales", "department", True, "BUILDING")
_register_series("department_parts_daily", "parts", "department", True, "Unknown")
_register_series("user_daily", "sales", "user", True, None)
_register_series("user_parts_daily", "parts", "user", True, "Unknown")


@query(
    "breakdown_report",
    over("v_owned v_itemtype", f"""
SELECT 'BUILDING' AS entity, 'department' AS dimension, '{periods.describe_period("this_month", *MARCH)}' AS date_range_label,
 (place - 1) // 40 AS page, string_agg(itemname || '=' || CAST(parts_sold AS VARCHAR), '|' ORDER BY place) AS items, any_value(total) AS total
FROM (SELECT *, row_number() OVER (ORDER BY parts_sold DESC, itemname) AS place, CAST(sum(parts_sold) OVER () AS BIGINT) AS total FROM (
  SELECT coalesce(replace(replace(replace(t.itemname, '[', ''), ']', ''), '_', ' '), 'Unknown') AS itemname, count(o.invnumber) AS parts_sold
  FROM v_owned o LEFT JOIN v_itemtype t ON t.itemtype_id = o.itemtype_id
  WHERE o.issold AND {IN_MARCH.format('o.solddate')} AND o.departmentname = 'BUILDING' GROUP BY t.itemname))
GROUP BY 4"""),
)
def breakdown_report_payload(s: Sample) -> DataFrame:
    pages = breakdown_report(s.facts(), "this_month", TODAY, "BUILDING").payload(page_size=40)
    shown = F.transform("items", lambda i: F.concat(i["itemname"], F.lit("="), i["count"].cast("string")))
    return pages.withColumn("items", F.array_join(shown, "|")).withColumn("total", F.col("total").cast("long"))


@query(
    "series_report",
    over("v_owned", """
SELECT coalesce(departmentname, 'Unknown') AS entity, CAST(1997 AS INTEGER) AS year, CAST(3 AS INTEGER) AS month,
 string_agg(CAST(d AS VARCHAR), '|' ORDER BY d) AS labels, string_agg(CAST(n AS VARCHAR), '|' ORDER BY d) AS values
FROM (SELECT departmentname, day(solddate) AS d, count(invnumber) AS n FROM v_owned
 WHERE issold AND departmentname = 'BUILDING' AND year(solddate) = 1997 AND month(solddate) = 3 GROUP BY 1, 2) GROUP BY 1"""),
)
def series_report_payload(s: Sample) -> DataFrame:
    found = series_report(s.facts(), 1997, "BUILDING", month=3, mode="parts")
    values = F.transform("values", lambda v: v.cast("long").cast("string"))
    return found.select(
        "entity", "year", "month", F.array_join("labels", "|").alias("labels"), F.array_join(values, "|").alias("values")
    )


@query(
    "series_payload",
    over("v_owned", """
SELECT entity, string_agg(label, '|' ORDER BY month) AS labels, string_agg(CAST(n AS VARCHAR), '|' ORDER BY month) AS values,
 string_agg(CAST(month AS VARCHAR), '|' ORDER BY month) AS months
FROM (SELECT coalesce(departmentname, 'Unknown') AS entity, month(solddate) AS month, strftime(solddate, '%b') AS label, count(invnumber) AS n
 FROM v_owned WHERE issold AND year(solddate) = 1997 GROUP BY 1, 2, 3) GROUP BY 1"""),
)
def series_payload(s: Sample) -> DataFrame:
    arrays = stats.series_payload(calendar.monthly_series(s.facts(), 1997, "department", "parts"), "month")
    texts = {
        "labels": F.col("labels"),
        "values": F.transform("values", lambda v: v.cast("long").cast("string")),
        "months": F.transform("months", lambda m: m.cast("string")),
    }
    return arrays.select("entity", *[F.array_join(c, "|").alias(n) for n, c in texts.items()])


@query(
    "sales_calendar_all",
    over("v_invoice", """
SELECT departmentname AS entity, CAST(year(datecreated) AS INTEGER) AS year, CAST(month(datecreated) AS INTEGER) AS month,
 CAST(day(datecreated) AS INTEGER) AS day, CAST(sum(total) AS DOUBLE) AS value
FROM v_invoice GROUP BY 1, 2, 3, 4 ORDER BY entity NULLS LAST, year, month, day"""),
    ordered=True,
)
def sales_calendar_all(s: Sample) -> DataFrame:
    return calendar.calendar_all(s.facts(), "department", "sales")


@query(
    "parts_calendar_all",
    over("v_owned", """
SELECT coalesce(shortname, 'Unknown') AS entity, CAST(year(solddate) AS INTEGER) AS year, CAST(month(solddate) AS INTEGER) AS month,
 CAST(count(invnumber) AS DOUBLE) AS value
FROM v_owned WHERE issold GROUP BY 1, 2, 3 ORDER BY 1, 2, 3"""),
    ordered=True,
)
def parts_calendar_all(s: Sample) -> DataFrame:
    return calendar.calendar_all(s.facts(), "user", "parts", daily=False)


def _kept_up_to_date(s: Sample, dimension: str, mode: str) -> DataFrame:
    """The day table after a first load, and a refresh behind files of late rows in some of its months."""
    base, table = work_path(s.spark, "facts"), work_path(s.spark, "day-table")
    for late in (False, True):
        # Late are some sold rows of one year, and some invoices, many of them of rows that are stored already.
        sold_late = (F.year("solddate") == 1997) & (F.col("itemtype_id") % 10 == 3)
        invoice_late = (F.year("datecreated") == 1997) & (F.col("invoice_id") % 7 == 2)
        for rows, name, moment, test in ((s.sold(), "sold", "solddate", sold_late), (s.invoice(), "invoice", "datecreated", invoice_late)):
            test = F.coalesce(test, F.lit(False))
            write_by_month(rows.filter(test if late else ~test), f"{base}/{name}", moment, "append")
        facts = calendar.Facts(s.spark.read.parquet(f"{base}/invoice"), s.spark.read.parquet(f"{base}/sold"), s.users())
        daytable.refresh_days(s.spark, table, facts, dimension, mode)
    return daytable.read_days(s.spark, table).drop(daytable.MONTH)


@query(
    "sales_days_refreshed",
    over("v_invoice", """
SELECT departmentname AS entity, CAST(year(datecreated) AS INTEGER) AS year, CAST(month(datecreated) AS INTEGER) AS month,
 CAST(day(datecreated) AS INTEGER) AS day, CAST(sum(total) AS DOUBLE) AS value FROM v_invoice GROUP BY 1, 2, 3, 4"""),
)
def sales_days_refreshed(s: Sample) -> DataFrame:
    return _kept_up_to_date(s, "department", "sales")


@query(
    "parts_days_refreshed",
    over("v_owned", """
SELECT coalesce(shortname, 'Unknown') AS entity, CAST(year(solddate) AS INTEGER) AS year, CAST(month(solddate) AS INTEGER) AS month,
 CAST(day(solddate) AS INTEGER) AS day, CAST(count(invnumber) AS DOUBLE) AS value FROM v_owned WHERE issold GROUP BY 1, 2, 3, 4"""),
)
def parts_days_refreshed(s: Sample) -> DataFrame:
    return _kept_up_to_date(s, "user", "parts")


# Scalars and plain filters of this area


@query(
    "date_range_filter",
    over("v_invoice", f"SELECT invoice_id, CAST(total AS DOUBLE) AS total FROM v_invoice WHERE {IN_MARCH.format('datecreated')}"),
)
def date_range_filter(s: Sample) -> DataFrame:
    return entities.invoiced_in(s.invoice(), MARCH).select("invoice_id", F.col("total").cast("double"))


@query("flag_filter", over("v_sold", "SELECT CAST(invoice_id AS VARCHAR) AS invoice_id, CAST(invnumber AS VARCHAR) AS invnumber, itemtype_id FROM v_sold WHERE issold"))
def flag_filter(s: Sample) -> DataFrame:
    return as_text(s.sold().filter("issold").select("invoice_id", "invnumber", "itemtype_id"), "invoice_id", "invnumber")


@query(
    "entity_filter_unknown",
    over("v_invoice", "SELECT invoice_id, coalesce(departmentname, 'Unknown') AS entity FROM v_invoice WHERE coalesce(departmentname, 'Unknown') = 'Unknown'"),
)
def entity_filter_unknown(s: Sample) -> DataFrame:
    name = F.col("departmentname")
    return s.invoice().filter(label_is(name, "Unknown")).select("invoice_id", label(name).alias("entity"))


@query("table_scan", over("v_sold", """
SELECT CAST(invoice_id AS VARCHAR) AS invoice_id, CAST(invnumber AS VARCHAR) AS invnumber, itemtype_id, solddate, CAST(issold AS VARCHAR) AS issold
FROM v_sold"""))
def table_scan(s: Sample) -> DataFrame:
    """Stored by month and read back as a business table."""
    base = work_path(s.spark, "tables")
    write_by_month(s.sold(), f"{base}/sold", "solddate")
    rows = read_table(s.spark, base, "sold").select("invoice_id", "invnumber", "itemtype_id", "solddate", F.col("issold").cast("string"))
    return as_text(rows, "invoice_id", "invnumber")


@query(
    "item_name_clean",
    over("v_sold v_itemtype", """
SELECT CAST(s.invnumber AS VARCHAR) AS invnumber, coalesce(replace(replace(replace(t.itemname, '[', ''), ']', ''), '_', ' '), 'Unknown') AS itemname
FROM v_sold s LEFT JOIN v_itemtype t ON t.itemtype_id = s.itemtype_id"""),
)
def item_name_clean(s: Sample) -> DataFrame:
    named = s.sold().join(s.itemtype(), "itemtype_id", "left")
    return as_text(named.select("invnumber", item_label(F.col("itemname")).alias("itemname")), "invnumber")


@query(
    "clean_inputs",
    """
SELECT event_id, concat('user', CAST(user_id AS VARCHAR)) AS cleaned,
 CAST(CASE event_id % 3 WHEN 0 THEN user_id ELSE 1 END AS INTEGER) AS month FROM events""",
)
def clean_inputs(s: Sample) -> DataFrame:
    user = F.col("user_id").cast("string")
    noisy = F.concat(F.lit(" \t user"), user, F.lit(" \n"))
    month = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), user)).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("x"), user)
    )
    return s.raw("events").select("event_id", strip(noisy).alias("cleaned"), month_param(month).alias("month"))


_PERIODS = """
SELECT day, 'today' AS period, day AS start, CAST(day + INTERVAL 1 DAY AS DATE) AS "end" FROM days
UNION ALL SELECT day, 'yesterday', CAST(day - INTERVAL 1 DAY AS DATE), day FROM days
UNION ALL SELECT day, 'this_month', CAST(date_trunc('month', day) AS DATE), CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) FROM days
UNION ALL SELECT day, 'last_month', CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE), CAST(date_trunc('month', day) AS DATE) FROM days"""


@query(
    "period_table",
    f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), bounds AS ({_PERIODS})
SELECT CAST(day AS VARCHAR) AS day, period, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", CASE period WHEN 'today' THEN 'Today' WHEN 'yesterday' THEN 'Yesterday' WHEN 'this_month' THEN 'This Month' ELSE 'Last Month' END
 || ' (' || strftime(start, '%d/%m/%Y') || CASE WHEN start = CAST("end" - INTERVAL 1 DAY AS DATE) THEN '' ELSE ' - ' || strftime("end" - INTERVAL 1 DAY, '%d/%m/%Y') END || ')' AS label
FROM bounds""",
)
def period_table(s: Sample) -> DataFrame:
    day = F.col("day")
    bounds = []
    for name in ("today", "yesterday", "this_month", "last_month"):
        start, end = periods.period_bounds(name, day)
        text = periods.period_text(name, start, end)
        bounds.append(F.struct(F.lit(name).alias("period"), start.alias("start"), end.alias("end"), text.alias("label")))
    days = s.raw("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    rows = days.select("day", F.explode(F.array(*bounds)).alias("b")).select("day", "b.*")
    return as_text(rows, "day", "start", "end")


@query(
    "previous_period",
    """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
 CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_back FROM orders""",
)
def previous_period(s: Sample) -> DataFrame:
    days = s.raw("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return as_text(days.select("day", periods.previous_bound(F.col("day")).alias("month_back")), "day", "month_back")


@query(
    "month_labels",
    """
SELECT DISTINCT CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%b') AS label,
 CAST(day(o_orderdate) AS INTEGER) AS day, CAST(day(o_orderdate) AS VARCHAR) AS day_label FROM orders""",
)
def month_labels(s: Sample) -> DataFrame:
    day = F.dayofmonth("o_orderdate")
    months = s.raw("orders").select(F.month("o_orderdate").alias("month"), day.alias("day")).distinct()
    return months.select(
        "month", periods.month_label(F.col("month")).alias("label"), "day", F.col("day").cast("string").alias("day_label")
    )


# Live statistics, run to the end of the stored files


def _newest_first(s: Sample, rows: DataFrame, moment: str) -> DataFrame:
    """The rows as a stream of several files, the newest years first, one file per batch."""
    inbox = work_path(s.spark, "live-inbox")
    year = F.year(moment)
    for part in (year >= 2000, year.between(1997, 1999), (year < 1997) | year.isNull()):
        rows.filter(part).coalesce(1).write.mode("append").parquet(inbox)
    return s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)


def _drained(s: Sample, rows: DataFrame) -> DataFrame:
    path, checkpoint = work_path(s.spark, "live-increments"), work_path(s.spark, "live-state")
    live.write_increments(rows, path, checkpoint).awaitTermination()
    return as_text(live.read_totals(s.spark, path, rows), "day")


@query(
    "live_daily_totals",
    over("v_invoice", """
SELECT CAST(CAST(datecreated AS DATE) AS VARCHAR) AS day, departmentname AS entity, CAST(sum(total) AS DOUBLE) AS sum_total,
 CAST(sum(total + totaltax1) AS DOUBLE) AS sum_total_vat FROM v_invoice GROUP BY 1, 2"""),
)
def live_daily_totals(s: Sample) -> DataFrame:
    return _drained(s, live.live_rows(_newest_first(s, s.invoice(), "datecreated")))


@query(
    "live_daily_parts",
    over("v_owned", """
SELECT CAST(CAST(solddate AS DATE) AS VARCHAR) AS day, coalesce(shortname, 'Unknown') AS entity, count(invnumber) AS parts_sold
FROM v_owned WHERE issold GROUP BY 1, 2"""),
)
def live_daily_parts(s: Sample) -> DataFrame:
    """Sold rows and invoices arrive side by side, each the newest first, so most sold rows wait for their invoice."""
    sold, invoice = _newest_first(s, s.sold(), "solddate"), _newest_first(s, s.invoice(), "datecreated")
    return _drained(s, live.live_parts(sold, invoice, "user", s.users()))


@query(
    "live_department_parts",
    over("v_owned", """
SELECT CAST(CAST(solddate AS DATE) AS VARCHAR) AS day, coalesce(departmentname, 'Unknown') AS entity, count(invnumber) AS parts_sold
FROM v_owned WHERE issold GROUP BY 1, 2"""),
)
def live_department_parts(s: Sample) -> DataFrame:
    arriving = _newest_first(s, s.sold(), "solddate")
    return _drained(s, live.live_rows(arriving, "department", "parts", invoice=s.invoice()))
