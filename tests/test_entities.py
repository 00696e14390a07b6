"""Sales and parts statistics on small hand-made tables."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from yardstats.functions.periods import Period
from yardstats.operators import calendar, entities, stats
from yardstats.operators.calendar import Facts
from yardstats.plans.reports import breakdown_report, period_stats, saved_stats, series_report
from yardstats.plans.sample import Sample
from yardstats.schemas import INVOICE, ITEMTYPE, SOLD, USERS

MARCH = Period(date(2024, 3, 1), date(2024, 4, 1))


def at(day, hour=12):
    return datetime(2024, int(day[:2]), int(day[3:]), hour)


@pytest.fixture
def facts(spark):
    d = Decimal
    invoice = [
        (1, "A", 10, at("03-01", 0), d("1.00"), d("0.200")),
        (2, "A", 10, at("03-31", 23), d("2.00"), None),
        (3, None, 11, at("03-15"), d("4.00"), d("0.800")),
        (4, "Unknown", 99, at("03-15"), d("8.00"), d("1.600")),
        (5, "B", 10, at("04-01", 0), d("16.00"), d("3.200")),
        (6, "C", 11, at("03-02"), d("32.00"), None),
    ]
    sold = [
        (1, 100, 1001, True, at("03-05")),
        (1, 101, None, True, at("03-05")),
        (1, 100, 1003, None, at("03-05")),
        (1, 100, 1004, False, at("03-05")),
        (3, 102, 1005, True, at("03-31", 23)),
        (3, 103, 1006, True, at("04-01", 0)),
        (4, 104, 1007, True, at("03-06")),
        (4, 104, 1008, True, at("02-06")),
        (None, 105, 1009, True, at("03-07")),
        (None, 100, 1010, True, at("02-07")),
        (None, 100, 1011, True, at("02-08")),
        (5, 100, 1012, True, at("02-09")),
        (6, 100, None, True, at("03-09")),
        (77, 100, 1013, True, at("03-09")),
    ]
    users = [(10, "ann"), (11, "bob")]
    itemtype = [(100, "[Front_Door]"), (101, "Front Door"), (102, "Lamp"), (104, "[Lamp]")]
    return Facts(
        spark.createDataFrame(invoice, INVOICE),
        spark.createDataFrame(sold, SOLD),
        spark.createDataFrame(users, USERS),
        spark.createDataFrame(itemtype, ITEMTYPE),
    )


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_department_sales(facts):
    # The row without tax counts in the net sum only; a missing name sorts last.
    assert tuples(entities.entity_sales(facts.invoice, MARCH)) == [
        ("A", 3.0, 1.2),
        ("C", 32.0, None),
        ("Unknown", 8.0, 9.6),
        (None, 4.0, 4.8),
    ]


def test_user_sales_drop_unknown_users(facts):
    assert tuples(entities.entity_sales(facts.invoice, MARCH, "user", facts.users)) == [
        ("ann", 3.0, 1.2),
        ("bob", 36.0, 4.8),
    ]


def test_department_parts_keep_raw_groups_apart(facts):
    # C has a row without a number: listed, with a count of 0.
    got = tuples(entities.entity_parts(facts.sold, facts.invoice, MARCH))
    assert got == [("A", 1), ("C", 0), ("Unknown", 1), ("Unknown", 3)]
    merged = tuples(entities.entity_parts(facts.sold, facts.invoice, MARCH, merge_labels=True))
    assert merged == [("A", 1), ("C", 0), ("Unknown", 4)]


def test_user_parts(facts):
    got = tuples(entities.entity_parts(facts.sold, facts.invoice, MARCH, "user", facts.users))
    assert got == [("ann", 1), ("bob", 1), ("Unknown", 3)]


def test_breakdown(facts):
    got = tuples(entities.parts_breakdown(facts.sold, facts.invoice, facts.itemtype, MARCH, entity="A"))
    assert got == [("A", "Front Door", 1), ("A", "Front Door", 0)]
    merged = entities.parts_breakdown(
        facts.sold, facts.invoice, facts.itemtype, MARCH, entity="A", merge_labels=True
    )
    assert tuples(merged) == [("A", "Front Door", 1)]
    unknown = tuples(entities.parts_breakdown(facts.sold, facts.invoice, facts.itemtype, MARCH, entity="Unknown"))
    assert unknown == [("Unknown", "Front Door", 1), ("Unknown", "Lamp", 1), ("Unknown", "Lamp", 1), ("Unknown", "Unknown", 1)]
    user = entities.parts_breakdown(facts.sold, facts.invoice, facts.itemtype, MARCH, "user", "bob", facts.users)
    assert tuples(user) == [("bob", "Lamp", 1), ("bob", "Front Door", 0)]


def test_breakdown_sums_to_entity_parts(facts):
    every = entities.parts_breakdown(facts.sold, facts.invoice, facts.itemtype, MARCH)
    totals = {r.entity: r.total for r in entities.breakdown_total(every).collect()}
    merged = {r.entity: r.parts_sold for r in entities.entity_parts(facts.sold, facts.invoice, MARCH, merge_labels=True).collect()}
    assert totals == merged


def test_comparison(facts):
    # Previous month: Unknown (literal) 1, missing name 2, B 1. B is not listed
    # now; both rows labelled Unknown show the last previous row, the missing name's.
    got = sorted(tuples(stats.parts_comparison(facts, MARCH)))
    assert got == [("A", 1.0, 0.0), ("C", 0.0, 0.0), ("Unknown", 1.0, 2.0), ("Unknown", 3.0, 2.0)]


def test_comparison_where_the_missing_name_has_no_previous_row(facts):
    only_named = facts._replace(sold=facts.sold.filter("invoice_id IS NOT NULL OR solddate >= '2024-03-01'"))
    got = sorted(tuples(stats.parts_comparison(only_named, MARCH)))
    assert got[-2:] == [("Unknown", 1.0, 1.0), ("Unknown", 3.0, 1.0)]


def test_comparison_of_a_long_period_overlaps_itself(facts):
    long = Period(date(2024, 2, 1), date(2024, 4, 1))
    got = {r.entity: (r.total, r.total_vat) for r in stats.parts_comparison(facts, long).collect() if r.entity != "Unknown"}
    assert got == {"A": (1.0, 0.0), "B": (1.0, 1.0), "C": (0.0, 0.0)}


def test_exclusion_keeps_the_missing_name(facts):
    rows = stats.stats_rows(facts, MARCH, "sales", "department")
    kept = {r.entity for r in stats.exclude_entities(rows, ["A", "Unknown"]).collect()}
    assert kept == {"C", None}
    assert stats.exclude_entities(rows, []) is rows
    listed = rows.sparkSession.createDataFrame([("A",), (None,)], "entity string")
    assert {r.entity for r in stats.exclude_entities(rows, listed).collect()} == {"C", "Unknown", None}


def test_exclusion_lists():
    assert stats.effective_exclusions(["x"], ["y"]) == ["x"]
    assert stats.effective_exclusions([], ["y"]) == ["y"]


def test_report(facts):
    report = period_stats(facts, "this_month", date(2024, 3, 9), exclude=["A"], order=["Unknown", "A", "Unknown"])
    assert [r.entity for r in report.rows.collect()] == ["Unknown", "C", None]
    assert tuples(report.totals) == [(44.0, 14.4)]
    assert [r.entity for r in report.entities.collect()] == ["A", "C", "Unknown", None]
    assert report.labels["date_range_label"] == "This Month (01/03/2024 - 31/03/2024)"
    assert tuples(report.charts()) == [(0, ["Unknown", "C", None], [8.0, 32.0, 4.0])]
    assert tuples(report.charts(page_size=2).orderBy("page")) == [
        (0, ["Unknown", "C"], [8.0, 32.0]),
        (1, [None], [4.0]),
    ]


def test_report_with_saved_preferences(facts, spark):
    orders = spark.createDataFrame([("ann", ["Unknown", "A"]), ("__default__", ["C"])], "username string, items array<string>")
    exclusions = spark.createDataFrame([("ann", "department", ["C"]), ("ann", "user", ["A"])], "username string, dimension string, items array<string>")

    def names(user, exclude=None):
        report = saved_stats(facts, orders, exclusions, user, "this_month", date(2024, 3, 9), exclude)
        return [r.entity for r in report.rows.collect()]

    assert names("ann") == ["Unknown", "A", None]
    assert names("ann", ["A"]) == ["Unknown", "C", None]
    assert names("ann", []) == ["Unknown", "A", None]
    assert names("zoe") == names(None) == ["C", "A", "Unknown", None]


def test_data_feed(facts):
    feed = period_stats(facts, "this_month", date(2024, 3, 9)).data_rows()
    assert feed.columns == ["department", "total", "total_vat"]
    assert tuples(feed)[1] == ("C", 32.0, 0.0)


def test_series_report(facts):
    got = series_report(facts, 2024, "Unknown", mode="parts").first()
    assert (got.labels, got["values"], got.months) == (["Feb", "Mar", "Apr"], [3.0, 4.0, 1.0], [2, 3, 4])
    assert got.year == 2024
    day = series_report(facts, 2024, "A", month=3).first()
    assert (day.year, day.month, day.labels) == (2024, 3, ["1", "31"])


def test_report_of_an_empty_period(facts):
    report = period_stats(facts, "today", date(2030, 1, 1), mode="parts")
    assert report.rows.count() == 0
    assert tuples(report.totals) == [(0.0, 0.0)]


def test_repeated_name_in_the_order_keeps_its_last_place(facts, spark):
    rows = stats.stats_rows(facts, MARCH, "sales", "department")
    as_table = spark.createDataFrame([(["C", "A", "C"],)], "items array<string>")
    for order in (["C", "A", "C"], as_table):
        placed = stats.in_saved_order(rows, order)
        got = {r.entity: r.saved_position for r in placed.collect()}
        assert got["C"] == 2 and got["A"] == 1
    assert stats.in_saved_order(rows, None).first().entity == "A"


def test_breakdown_report(facts):
    report = breakdown_report(facts, "this_month", date(2024, 3, 9), "Unknown")
    assert tuples(report.total) == [("Unknown", 4)]
    payload = tuples(report.payload())
    assert len(payload) == 1 and payload[0][:4] == ("Unknown", "department", report.date_range_label, 0) and payload[0][5] == 4
    empty = breakdown_report(facts, "this_month", date(2024, 3, 9), "nobody").payload().collect()
    assert [(r.entity, r["items"], r.total) for r in empty] == [("nobody", [], 0)]
    assert [(i["itemname"], i["count"]) for i in payload[0][4]] == [("Front Door", 1), ("Lamp", 1), ("Lamp", 1), ("Unknown", 1)]
    with pytest.raises(ValueError):
        breakdown_report(facts, "today", date(2024, 3, 9), "A", mode="sales")
    with pytest.raises(ValueError):
        breakdown_report(facts, "today", date(2024, 3, 9), "")


def test_series(facts):
    monthly = calendar.monthly_series(facts, 2024, "department", "parts", "Unknown")
    assert tuples(monthly) == [("Unknown", 2, "Feb", 3.0), ("Unknown", 3, "Mar", 4.0), ("Unknown", 4, "Apr", 1.0)]
    daily = calendar.daily_series(facts, 2024, 3, "department", "sales", "A")
    assert tuples(daily) == [("A", 1, "1", 1.0), ("A", 31, "31", 2.0)]
    assert calendar.daily_series(facts, 2024, 3, "department", "sales", "Unknown").count() == 1
    user = calendar.monthly_series(facts, 2024, "user", "parts", "ann")
    assert tuples(user) == [("ann", 2, "Feb", 1.0), ("ann", 3, "Mar", 1.0)]
    assert calendar.monthly_series(facts, 2023, "user", "sales", "ann").count() == 0


def test_calendar_sums_to_the_period(spark):
    s = Sample(spark, "/root/testdata/sf0.001")
    month = Period(date(1997, 3, 1), date(1997, 4, 1))
    days = calendar.calendar_all(s.facts(), "department", "sales").filter("year = 1997 AND month = 3")
    summed = {r.entity: round(r.v, 2) for r in days.groupBy("entity").agg(F.sum("value").alias("v")).collect()}
    assert summed == {r.entity: round(r.sum_total, 2) for r in entities.entity_sales(s.invoice(), month).collect()}


def test_excluding_equals_total_minus_excluded(spark):
    s = Sample(spark, "/root/testdata/sf0.001")
    month = Period(date(1997, 3, 1), date(1997, 4, 1))
    rows = stats.stats_rows(s.facts(), month, "parts", "user")
    name = rows.orderBy("entity").first()
    whole, rest = stats.stats_totals(rows).first(), stats.stats_totals(stats.exclude_entities(rows, [name.entity])).first()
    assert rest.sum_total == whole.sum_total - name.total


def test_totals_stay_exact_beyond_the_precision_of_doubles(spark):
    when = datetime(2024, 3, 10)
    money = [(i, f"d{i}", 1, when, Decimal("99999999999999.99"), Decimal("0.010")) for i in range(1, 400)]
    facts = Facts(spark.createDataFrame(money, INVOICE), None)
    totals = period_stats(facts, "custom", date(2024, 3, 20), "2024-03-01", "2024-03-31").totals.first()
    assert totals.sum_total == float(399 * Decimal("99999999999999.99"))
    assert totals.sum_total_vat == float(399 * Decimal("100000000000000.000"))
