"""Facts in buckets: the same reports, joined where they lie."""

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_plans import BASE, MARCH, NO_BROADCAST, conf, plan
from yardstats.operators import entities
from yardstats.plans.sample import Sample
from yardstats.schemas import INVOICE, SOLD
from yardstats.sinks.buckets import write_bucketed
from yardstats.sources.buckets import read_bucketed


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("bucketed"))
    s = Sample(spark, BASE)
    write_bucketed(s.sold(), s.invoice(), base, buckets=5)
    return s, *read_bucketed(spark, base)


def reports(s, sold, invoice):
    return {
        "department": entities.entity_parts(sold, invoice, MARCH),
        "user": entities.entity_parts(sold, invoice, MARCH, "user", s.users()),
        "items": entities.parts_breakdown(sold, invoice, s.itemtype(), MARCH),
        "sales": entities.entity_sales(invoice, MARCH),
    }


def test_same_reports(stored):
    s, sold, invoice = stored
    plain = reports(s, s.sold(), s.invoice())
    for name, got in reports(s, sold, invoice).items():
        assert got.collect() == plain[name].collect(), name


@pytest.mark.parametrize("name", ["department", "user", "items"])
def test_no_fact_is_shuffled_by_invoice(spark, stored, name):
    s, sold, invoice = stored
    with conf(spark, **NO_BROADCAST):
        text = plan(reports(s, sold, invoice)[name])
        assert "SortMergeJoin" in text and not re.search(r"Exchange hashpartitioning\(invoice", text)
        assert re.search(r"Exchange hashpartitioning\(invoice", plan(reports(s, s.sold(), s.invoice())[name]))


def test_only_the_period_is_read(stored):
    _, sold, invoice = stored
    text = stored[0].spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    shown = entities.entity_parts(sold, invoice, MARCH)._jdf.queryExecution().explainString(text)
    assert re.search(r"PartitionFilters: \[.*solddate_month", shown)
    assert "SelectedBucketsCount: 5 out of 5" in shown


def test_null_and_hot_invoices_are_dealt_out(spark, tmp_path):
    when = datetime(1997, 3, 10)
    sold = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i, i, True, when) for i in range(3000)]
    sold = spark.createDataFrame([(a, c, b, e, d) for a, b, c, e, d in sold], SOLD)
    money = Decimal("1.00")
    invoice = spark.createDataFrame([(i, "A" if i == 7 else "B", 1, when, money, money) for i in range(3000)], INVOICE)
    write_bucketed(sold, invoice, str(tmp_path), buckets=8, slots=32)
    kept, owners = read_bucketed(spark, str(tmp_path))
    assert kept.count() == 3000 and owners.count() == 3000 + 31
    file = F.regexp_extract("_metadata.file_name", r"_(\d+)\.c", 1)
    sizes = [r["count"] for r in kept.groupBy(file.alias("bucket")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8
    got = {tuple(r) for r in entities.entity_parts(kept, owners, MARCH).collect()}
    assert got == {("A", 1000), ("B", 1000), ("Unknown", 1000)}
    assert entities.entity_sales(owners, MARCH).filter("entity = 'A'").first().sum_total == 1.0


def test_written_again_with_other_buckets_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], SOLD), spark.createDataFrame([], INVOICE)
    for buckets in (3, 4):
        write_bucketed(*empty, str(tmp_path), buckets=buckets)
        sold, invoice = read_bucketed(spark, str(tmp_path))
        assert sold.count() == 0 and entities.entity_parts(sold, invoice, MARCH).count() == 0
    one = spark.createDataFrame([(1, 2, 3, True, datetime(1997, 3, 2))], SOLD)
    write_bucketed(one, empty[1], str(tmp_path), buckets=2)
    sold, invoice = read_bucketed(spark, str(tmp_path))
    assert [tuple(r) for r in entities.entity_parts(sold, invoice, MARCH).collect()] == [("Unknown", 1)]
    assert sold.first().solddate_month == date(1997, 3, 1)
