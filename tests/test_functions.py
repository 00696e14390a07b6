import calendar
import math
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yardstats.functions import modes, periods, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


PRICES = {
    "£12.50": 12.5,
    " £ 7 ": 7.0,
    "£10.00 to £20.00": 10.0,
    "£10.00to£20.00": None,
    "£1,200.00": None,
    "12.5f": None,
    "12.5d": None,
    "1_000": 1000.0,
    "_1": None,
    "1e2": 100.0,
    "5.": 5.0,
    ".5": 0.5,
    "+3": 3.0,
    "-3": -3.0,
    "0x10": None,
    "": None,
    "£": None,
    "free": None,
    "nan": None,
    "inf": math.inf,
    "-Infinity": -math.inf,
    " £3 each": 3.0,
    None: None,
}


def test_prices(spark):
    df = spark.createDataFrame(list(PRICES.items()), "t string, want double")
    for row in df.select("t", "want", text.parse_price(F.col("t")).alias("got")).collect():
        assert row.got == row.want, row


def by_hand(price_text):
    words = price_text.replace("£", "").split()
    try:
        price = float(words[0]) if words else None
    except ValueError:
        return None
    return None if price is None or math.isnan(price) else price


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,_eE+-£ \tinfa\x1c", max_size=8), min_size=1, max_size=200))
def test_prices_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", text.parse_price(F.col("t")).alias("got")).collect():
        assert row.got == by_hand(row.t), repr(row.t)


@pytest.mark.parametrize("value", ["  a b\t\n", " x　", "\x1cq\x1f", "", "plain"])
def test_strip_like_python(spark, value):
    assert one(spark, text.strip, value) == value.strip()


def test_item_label(spark):
    assert one(spark, text.item_label, "[Big_Red]_[Door]") == "Big Red Door"
    assert one(spark, text.item_label, None) == "Unknown"


def test_label_is_matches_label(spark):
    df = spark.createDataFrame([("a",), ("Unknown",), (None,)], "v string")
    for wanted in ("a", "Unknown", "b"):
        left = df.filter(text.label_is(F.col("v"), wanted)).count()
        assert left == df.filter(text.label(F.col("v")) == wanted).count()


def test_rgb_hex(spark):
    schema = "v struct<red:double,green:double,blue:double>"
    data = [((1.0, 0.5, 0.0),), ((None, 0.999, None),), ((0.2, 0.4, 0.6),), ((None, None, None),)]
    got = [r[0] for r in spark.createDataFrame(data, schema).select(text.rgb_hex(F.col("v"))).collect()]
    assert got == ["#FF7F00", "#FFFEFF", "#336699", "#FFFFFF"]


URLS = {
    "http://a/b": "http://a/b",
    "https://a": "https://a",
    "HTTP://a": "http://base/x/HTTP://a",
    "//p/q.jpg": "http://base/x/p/q.jpg",
    "p": "http://base/x/p",
    "": "http://base/x/",
}


@pytest.mark.parametrize("base", ["http://base/x", "http://base/x/", "http://base/x//"])
def test_urls(spark, base):
    df = spark.createDataFrame([(u,) for u in URLS], "v string")
    got = {r[0]: r[1] for r in df.select("v", text.absolute_url(F.col("v"), base)).collect()}
    assert got == URLS


def test_month_param(spark):
    for value, want in {"3": 3, " 12 ": 12, "x": 1, None: 1, "": 1, "13": 13, "1.5": 1, "1_0": 10}.items():
        assert one(spark, text.month_param, value) == want


def test_contains_is_literal_and_ignores_case(spark):
    df = spark.createDataFrame([("A.C (x)",), ("abc",), (None,)], "v string")
    assert df.filter(text.contains_ignore_case(F.col("v"), "a.c")).count() == 1
    assert df.filter(text.contains_ignore_case(F.col("v"), "C (X")).count() == 1


# Periods


def test_resolve_period():
    p = periods.Period
    day = date(2024, 3, 31)
    assert periods.resolve_period("today", day) == p(day, date(2024, 4, 1))
    assert periods.resolve_period("yesterday", day) == p(date(2024, 3, 30), day)
    assert periods.resolve_period("this_month", day) == p(date(2024, 3, 1), date(2024, 4, 1))
    assert periods.resolve_period("this_month", date(2023, 12, 5)) == p(date(2023, 12, 1), date(2024, 1, 1))
    assert periods.resolve_period("last_month", date(2024, 1, 9)) == p(date(2023, 12, 1), date(2024, 1, 1))
    assert periods.resolve_period("custom", day, "2024-02-01", "2024-02-29") == p(date(2024, 2, 1), date(2024, 3, 1))
    assert periods.resolve_period("custom", day, "20240201", "20240202") == p(date(2024, 2, 1), date(2024, 2, 3))
    assert periods.resolve_period("custom", day, "2024-02-01", "") == p(day, date(2024, 4, 1))
    assert periods.resolve_period("no such", day) == p(day, date(2024, 4, 1))


@settings(max_examples=300, deadline=None)
@given(st.dates(date(1900, 1, 1), date(2100, 12, 31)))
def test_month_back(day):
    back = periods.month_back(day)
    assert (back.year * 12 + back.month) == (day.year * 12 + day.month) - 1
    assert back.day == min(day.day, calendar.monthrange(back.year, back.month)[1])


def test_previous_period_of_a_month_is_the_month_before():
    assert periods.previous_period(periods.month_period(2024, 3)) == periods.month_period(2024, 2)
    assert periods.month_back(date(2024, 3, 31)) == date(2024, 2, 29)


def test_describe_period():
    day = date(2024, 2, 29)
    assert periods.describe_period("today", day, day + timedelta(1)) == "Today (29/02/2024)"
    assert periods.describe_period("this_month", date(2024, 2, 1), date(2024, 3, 1)) == "This Month (01/02/2024 - 29/02/2024)"
    assert periods.describe_period("other", day, day + timedelta(1)) == "Custom (29/02/2024)"
    assert periods.describe_period("today", None, day) == "All Time"


def test_column_periods_agree_with_the_driver(spark):
    days = [date(2024, 1, 1) + timedelta(n) for n in range(0, 800, 7)] + [date(2024, 2, 29), date(2023, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    for name in ("today", "yesterday", "this_month", "last_month"):
        start, end = periods.period_bounds(name, F.col("day"))
        text_column = periods.period_text(name, start, end)
        for row in df.select("day", start.alias("s"), end.alias("e"), text_column.alias("t")).collect():
            want = periods.resolve_period(name, row.day)
            assert (row.s, row.e) == tuple(want)
            assert row.t == periods.describe_period(name, *want)
    for row in df.select("day", periods.previous_bound(F.col("day")).alias("b")).collect():
        assert row.b == periods.month_back(row.day)


def test_period_text_without_a_bound(spark):
    none = F.lit(None).cast("date")
    row = spark.range(1).select(periods.period_text("today", none, none)).first()
    assert row[0] == "All Time"


def test_month_labels(spark):
    got = [r[0] for r in spark.range(1, 13).select(periods.month_label(F.col("id").cast("int"))).collect()]
    assert got == list(calendar.month_abbr)[1:]


# Modes


def test_modes():
    assert [modes.mode_of(m) for m in ("PARTS", "sales", "", None, 3)] == ["parts"] + ["sales"] * 4
    assert [modes.dimension_of(d) for d in ("User", "department", None)] == ["user", "department", "department"]
    labels = modes.report_labels("parts", "user")
    assert labels["value_vat_label"] == "Parts Sold (Prev Period)"
    assert labels["value_format"] == "count"
    assert labels["entity_label_plural"] == "Users"
    assert modes.report_labels("x", "y")["value_label"] == "Sales Total"
