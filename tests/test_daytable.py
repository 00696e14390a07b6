"""Daily totals kept up to date: equal to a full recompute, untouched months left alone."""

import os
from datetime import date, datetime
from decimal import Decimal

import pytest

from yardstats.operators import daytable
from yardstats.operators.calendar import Facts, calendar_all
from yardstats.schemas import INVOICE, SOLD, USERS
from yardstats.sinks.export import write_by_month


def month_files(path):
    return {d: sorted(os.listdir(f"{path}/days/{d}")) for d in os.listdir(f"{path}/days") if d.startswith(daytable.MONTH)}


@pytest.fixture
def world(spark, tmp_path):
    """Facts by month that grow by files."""
    base = str(tmp_path)

    def add(sold=(), invoice=()):
        for name, rows, schema, moment in (("sold", sold, SOLD, "solddate"), ("invoice", invoice, INVOICE, "datecreated")):
            if rows:
                write_by_month(spark.createDataFrame(list(rows), schema), f"{base}/{name}", moment, "append")
        users = spark.createDataFrame([(1, "ann"), (2, "bob")], USERS)
        return Facts(spark.read.parquet(f"{base}/invoice"), spark.read.parquet(f"{base}/sold"), users)

    return add, f"{base}/table"


def invoice(key, department, user, when):
    return (key, department, user, when, Decimal("2.00"), Decimal("0.400"))


MARCH, APRIL, MAY = (datetime(2024, m, 5, 12) for m in (3, 4, 5))


@pytest.mark.parametrize("dimension,mode", [("department", "parts"), ("user", "parts"), ("department", "sales"), ("user", "sales")])
def test_refresh_equals_recompute(spark, world, dimension, mode):
    add, path = world
    parts = mode == "parts"

    def check(facts, months, kept):
        before = month_files(path) if os.path.isdir(f"{path}/days") else {}
        done = daytable.refresh_days(spark, path, facts, dimension, mode)
        assert [m.month for m in done.months] == months
        columns = ["entity", "year", "month", "day", "value"]
        got = daytable.read_days(spark, path).select(*columns)
        want = calendar_all(facts, dimension, mode).select(*columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        after = month_files(path)
        for month in kept:
            name = f"{daytable.MONTH}=2024-0{month}-01"
            assert before[name] == after[name]

    facts = add([(1, 5, 10, True, MARCH), (2, 5, 11, True, APRIL), (9, 5, 12, True, MAY)], [invoice(1, "A", 1, MARCH), invoice(2, "B", 2, APRIL)])
    check(facts, [3, 4, 5] if parts else [3, 4], [])
    check(facts, [], [3, 4])  # nothing new
    # A late sold row of March, and the invoice of what was sold in May
    facts = add([(2, 5, 13, True, MARCH)], [invoice(9, "B", 2, APRIL)])
    check(facts, [3, 5] if parts else [4], [4] if parts else [3])
    facts = add([], [invoice(20, None, None, MAY)])
    check(facts, [] if parts else [5], [3, 4])


def test_a_month_can_vanish_and_a_broken_refresh_is_made_up(spark, world, monkeypatch):
    add, path = world
    facts = add([(1, 5, 10, True, MARCH), (1, 5, 11, True, APRIL)], [invoice(1, "A", 1, MARCH)])
    daytable.refresh_days(spark, path, facts, "department", "parts")
    facts = facts._replace(sold=facts.sold.filter("solddate_month = date'2024-04-01'"))

    with monkeypatch.context() as patched:
        def stop(*args):
            raise RuntimeError("stopped")

        patched.setattr(daytable, "_replace", stop)
        with pytest.raises(RuntimeError):
            daytable.refresh_days(spark, path, facts, "department", "parts")
    done = daytable.refresh_days(spark, path, facts, "department", "parts")
    assert done == ([date(2024, 3, 1)], [date(2024, 3, 1)])
    assert [(r.entity, r.month, r.value) for r in daytable.read_days(spark, path).collect()] == [("A", 4, 1.0)]


def test_facts_without_months_are_refused(spark, tmp_path):
    spark.createDataFrame([invoice(1, "A", 1, MARCH)], INVOICE).write.parquet(str(tmp_path / "invoice"))
    with pytest.raises(ValueError, match="laid out by month"):
        daytable.refresh_days(spark, str(tmp_path / "t"), Facts(spark.read.parquet(str(tmp_path / "invoice"))), "department", "sales")
