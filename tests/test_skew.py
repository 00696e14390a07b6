"""One key with a third of all rows: same results, and the rows do not pile up."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from yardstats.functions.periods import Period
from yardstats.operators import calendar, entities, lookup, stats
from yardstats.operators.calendar import Facts
from yardstats.operators.spread import (
    left_join_sparse_key,
    number_rows,
    paged_arrays,
    skew_join,
)

ROWS = 30_000
YEAR = Period(date(2024, 1, 1), date(2025, 1, 1))


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the sold rows have no invoice, a third share invoice 1."""
    n = F.col("id")
    sold = spark.range(ROWS).select(
        F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, F.lit(1)).otherwise(n).cast("long").alias("invoice_id"),
        (n % 50).alias("itemtype_id"),
        F.when(n % 11 != 0, n).alias("invnumber"),
        F.lit(True).alias("issold"),
        F.date_add(F.lit(date(2024, 1, 1)), (n % 366).cast("int")).cast("timestamp_ntz").alias("solddate"),
    )
    invoice = spark.range(ROWS).select(
        n.alias("invoice_id"),
        F.concat(F.lit("D"), (n % 4).cast("string")).alias("departmentname"),
        F.when(n % 3 == 0, F.lit(7)).otherwise(n % 5).cast("long").alias("whocreated_id"),
        F.lit(date(2024, 5, 1)).cast("timestamp_ntz").alias("datecreated"),
        F.lit(1).cast("decimal(18,2)").alias("total"),
        F.lit(0).cast("decimal(18,3)").alias("totaltax1"),
    )
    users = spark.range(8).select(n.alias("user_id"), F.concat(F.lit("U"), n.cast("string")).alias("shortname"))
    itemtype = spark.range(40).select(n.alias("itemtype_id"), F.concat(F.lit("I"), n.cast("string")).alias("itemname"))
    return Facts(invoice, sold, users, itemtype)


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, spark):
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def plain(facts, dimension):
    """The same counts by the obvious joins."""
    owned = facts.sold.join(facts.invoice.drop("datecreated"), "invoice_id", "left")
    owned = owned.join(facts.users, F.col("whocreated_id") == F.col("user_id"), "left")
    name = F.coalesce(F.col("shortname" if dimension == "user" else "departmentname"), F.lit("Unknown"))
    return owned.withColumn("entity", name)


@pytest.mark.parametrize("dimension", ["department", "user"])
def test_counts(facts, joins, dimension):
    got = {tuple(r) for r in entities.entity_parts(facts.sold, facts.invoice, YEAR, dimension, facts.users).collect()}
    assert got == {tuple(r) for r in plain(facts, dimension).groupBy("entity").agg(F.count("invnumber")).collect()}


def test_breakdown_and_series(facts, joins):
    owned = plain(facts, "user").join(facts.itemtype, "itemtype_id", "left")
    item = F.coalesce("itemname", F.lit("Unknown"))
    want = {tuple(r) for r in owned.groupBy("entity", item).agg(F.count("invnumber")).collect()}
    got = entities.parts_breakdown(facts.sold, facts.invoice, facts.itemtype, YEAR, "user", None, facts.users)
    assert {tuple(r) for r in got.collect()} == want
    days = calendar.calendar_all(facts, "user", "parts").collect()
    want = plain(facts, "user").groupBy("entity", F.year("solddate"), F.month("solddate"), F.dayofmonth("solddate"))
    assert {tuple(r) for r in days} == {tuple(r) for r in want.agg(F.count("invnumber").cast("double")).collect()}


def test_null_keys_travel_to_many_tasks(spark, facts, joins):
    left = facts.sold.repartition(4, "itemtype_id")
    joined = left_join_sparse_key(left, facts.invoice.select("invoice_id", "departmentname"), "invoice_id", ["itemtype_id", "solddate"])
    assert joined.count() == ROWS
    assert joined.filter("invoice_id IS NULL AND departmentname IS NOT NULL").isEmpty()
    plain_join = left.join(facts.invoice.select("invoice_id", "departmentname"), "invoice_id", "left")
    assert joined.select(plain_join.columns).exceptAll(plain_join).isEmpty()


def test_null_slots_survive_the_optimizer(spark, facts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = facts.invoice.withColumn("invoice_id", F.when(F.col("invoice_id") >= 0, F.col("invoice_id")))
        joined = left_join_sparse_key(facts.sold, stored, "invoice_id", ["itemtype_id"])
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("_slot") > 4 and "hashpartitioning(invoice_id" in text
    assert all("_slot" in line for line in text.splitlines() if "hashpartitioning(invoice_id" in line)


def test_skew_join(spark, joins):
    many = spark.range(ROWS).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("k"))
    few = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    nulls = few.union(spark.range(1).select(F.lit(None).cast("long"), F.lit(-1).cast("long")))
    got = skew_join(many, nulls, ["k"], null_safe=True)
    want = many.alias("m").join(nulls.alias("f"), F.col("m.k").eqNullSafe(F.col("f.k")), "left").select("m.n", "m.k", "f.v")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    narrow = few.withColumn("k", F.col("k").cast("int"))
    assert skew_join(many, narrow, ["k"], how="inner").count() == many.join(few, "k").count()


def test_a_hot_key_is_split_by_adaptive_execution(spark):
    many = spark.range(400_000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    few = many.select("k").distinct().withColumn("v", F.length("k"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = skew_join(many.repartition(8, "n"), few, ["k"]).withColumn("p", F.spark_partition_id())
        tasks = joined.filter("k = 'hot'").groupBy("p").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(t["count"] for t in tasks) == 133_334 and len(tasks) > 1


def test_everyone_asks_for_the_same_blank_number(spark, joins):
    n = F.col("id")
    vehicle = spark.range(3000).select(n.alias("stocknumber_id"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("R"), n)).alias("regnumber"), F.lit(1).cast("long").alias("location_id"))
    stock = spark.range(3000).select(n.alias("stocknumber_id"), F.concat(F.lit("S"), n).alias("vstockno"))
    location = spark.range(3).select(n.alias("location_id"), F.lit("b").alias("bin"))
    asked = spark.range(3000).select(n.alias("request_id"), F.when(n % 3 != 1, " ").otherwise(F.concat(F.lit("R"), n)).alias("registration"), F.concat(F.lit("S"), n + 1500).alias("stock_number"))
    got = {r.request_id: r.stocknumber_id for r in lookup.lookup_vehicles(vehicle, stock, location, asked).collect()}
    assert len(got) == 3000
    for i in range(3000):
        hits = [0] if i % 3 != 1 else [i]
        hits += [i + 1500] if i < 1500 else []
        assert got[i] == min(hits)


def test_numbering(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 100).alias("k"), "id").repartition(7)
    got = [(r.k, r.id, r.position) for r in number_rows(df, [F.desc("k"), F.asc("id")]).collect()]
    got.sort(key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(1, 5001))
    assert [r[:2] for r in got] == sorted((r[:2] for r in got), key=lambda r: (-r[0], r[1]))
    assert number_rows(df.filter("false"), [F.asc("id")]).count() == 0


def test_pages_of_arrays(spark):
    numbered = spark.range(1, 2501).select(F.col("id").alias("position"), F.concat(F.lit("n"), "id").alias("name"))
    pages = paged_arrays(numbered.repartition(5), ["name"], 1000).orderBy("page").collect()
    assert [len(p["name"]) for p in pages] == [1000, 1000, 500]
    assert [n for p in pages for n in p["name"]] == [f"n{i}" for i in range(1, 2501)]


def test_payload_pages_per_entity(spark):
    every = spark.range(300).select(
        F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 3)).alias("entity"),
        F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("itemname"),
        (F.col("id") % 5).alias("parts_sold"),
    )
    pages = stats.breakdown_payload(every, 64).orderBy("entity", "page").collect()
    hot = [i for p in pages if p.entity == "hot" for i in p["items"]]
    assert len(hot) == 200 and [len(p["items"]) for p in pages if p.entity == "hot"] == [64, 64, 64, 8]
    assert [(-i["count"], i["itemname"]) for i in hot] == sorted((-i["count"], i["itemname"]) for i in hot)
    assert {p.entity for p in pages} == {"hot", "e0", "e1", "e2"}
