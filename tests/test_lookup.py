from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from yardstats.operators import audit, lookup
from yardstats.plans.reports import audit_report
from yardstats.schemas import AUDIT, IMAGE, LOCATION, STOCKNUMBER, VEHICLE
from yardstats.sinks.export import export_audit, overwrite_table

BASE = "http://base/"


@pytest.fixture
def tables(spark):
    vehicle = [(1, "AB1", 5), (2, "AB2", 6), (3, "AB3", None), (4, "", 5), (5, "AB1", 5), (6, "AB6", 5), (7, None, 5)]
    stock = [(1, "S1"), (2, "S2"), (3, "S3"), (4, "S4"), (5, ""), (7, "S7")]
    return (
        spark.createDataFrame(vehicle, VEHICLE),
        spark.createDataFrame(stock, STOCKNUMBER),
        spark.createDataFrame([(5, "bin5")], LOCATION),
    )


def test_one_vehicle(tables):
    def keys(reg, stock):
        return [r.stocknumber_id for r in lookup.find_vehicle(*tables, reg, stock).collect()]

    assert keys(" AB1 ", "S2") == [1, 2, 5]
    assert keys("AB6", "") == [5]  # 6 has no stock number; blank matches blank
    assert keys("", "nothing") == [4]
    assert keys("ab1", "nothing") == []
    first = lookup.lookup_vehicle(*tables, "AB2", "S1").first()
    assert (first.stocknumber_id, first.bin) == (1, "bin5")
    assert lookup.lookup_vehicle(*tables, "AB2", "x").first().bin is None


def test_batch_lookup_equals_single_lookups(tables, spark):
    requests = [(1, " AB1", "S2"), (2, "AB6", ""), (3, "", "x"), (4, "ab1", "x"), (5, "AB3", "S3 "), (6, None, "S7"), (7, None, None)]
    asked = spark.createDataFrame(requests, "request_id long, registration string, stock_number string")
    got = {r.request_id: r for r in lookup.lookup_vehicles(*tables, asked).collect()}
    assert len(got) == len(requests)
    for request_id, reg, stock in requests[:5]:
        want = lookup.lookup_vehicle(*tables, reg, stock).first()
        assert got[request_id].stocknumber_id == (want.stocknumber_id if want else None)
        assert got[request_id].status == ("FOUND" if want else "NOT FOUND")
    assert got[6].stocknumber_id == 7 and got[7].status == "NOT FOUND"
    log = lookup.lookup_log(lookup.lookup_vehicles(*tables, asked), "me", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    row = log.filter("log_id = 1").first()
    assert (row.action, row.regnumber, row.stocknumber, row.vstockno, row.location) == ("SEARCH", "AB1", "S2", "S1", "bin5")


def test_relocation(tables, spark):
    moves = spark.createDataFrame([(1, 10), (1, 11), (99, 12)], "stocknumber_id long, moved_at long")
    got = {r.stocknumber_id: r.location_id for r in lookup.relocate(tables[0], moves).collect()}
    assert got == {1: lookup.CRUSHED_LOCATION, 2: 6, 3: None, 4: 5, 5: 5, 6: 5, 7: 5}
    where = spark.createDataFrame([(1, 11, 8), (1, 10, 9), (3, 1, 7)], "stocknumber_id long, moved_at long, location_id long")
    got = {r.stocknumber_id: r.location_id for r in lookup.relocate(tables[0], where).collect()}
    assert got[1] == 8 and got[3] == 7
    log = lookup.relocation_log(moves, "me", first_id=10).collect()
    assert sorted((r.event_time, r.log_id) for r in log) == [(10, 10), (11, 11), (12, 12)]


def test_relocation_keeps_columns_and_settles_ties(tables, spark):
    schema = "stocknumber_id long, moved_at long, location_id long, move_id long"
    moves = [(1, None, 21, 1), (2, 5, 22, 1), (2, 5, 23, 2), (3, 5, 24, 1), (3, None, 25, 9), (4, 7, None, 1), (None, 1, 26, 1)]
    vehicle = tables[0].withColumn("colour", F.lit("red"))
    moved = lookup.relocate(vehicle, spark.createDataFrame(moves, schema))
    assert moved.schema == vehicle.schema
    got = {r.stocknumber_id: (r.location_id, r.colour) for r in moved.collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [21, 23, 24, 5] and {c for _, c in got.values()} == {"red"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_looked_for_in_the_scans(tables, spark, tmp_path):
    stored = []
    for k, table in enumerate(tables):
        table.write.parquet(f"{tmp_path}/{k}")
        stored.append(spark.read.parquet(f"{tmp_path}/{k}"))
    plan = _plan(lookup.find_vehicle(*stored, "AB1", "S2"))
    assert "EqualTo(regnumber,AB1)" in plan and "EqualTo(vstockno,S2)" in plan


def test_relocated_table_replaces_the_stored_one(tables, spark, tmp_path):
    path = str(tmp_path / "vehicle")
    tables[0].write.parquet(path)
    moves = spark.createDataFrame([(2, 1)], "stocknumber_id long, moved_at long")
    overwrite_table(lookup.relocate(spark.read.parquet(path), moves), path)
    got = {r.stocknumber_id: r.location_id for r in spark.read.parquet(path).collect()}
    assert got[2] == lookup.CRUSHED_LOCATION and len(got) == 7


def test_gallery(spark):
    images = [
        ("T1", "/b.jpg", None, None), ("T1", "a.jpg", 0, False), ("T1", "http://h/z.jpg", -1, False),
        ("T1", "t.jpg", 0, True), ("T2", "//c.jpg", 3, False), ("T1", "d.jpg", 1, False),
    ]
    df = spark.createDataFrame(images, IMAGE)
    one = [(r.url, r.displayorder) for r in lookup.image_gallery(df, BASE, " T1 ").collect()]
    # A missing display order sorts as 0, then by stored path.
    assert one == [("http://h/z.jpg", -1), (BASE + "b.jpg", None), (BASE + "a.jpg", 0), (BASE + "d.jpg", 1)]
    every = [(r.barcode, r.url) for r in lookup.image_gallery(df, BASE).collect()]
    assert [u for b, u in every if b == "T1"] == [u for u, _ in one]
    assert every[-1] == ("T2", BASE + "c.jpg")
    assert lookup.image_gallery(df, BASE, "T9").count() == 0


# Audit log


def events(spark, n=250):
    data = [(datetime(2024, 1, 1 + i // 100, i % 24, 0, i % 60), i, f"u{i}", "SEARCH", None, None, None, None, "FOUND") for i in range(n)]
    return spark.createDataFrame(data, AUDIT)


def test_audit_append_and_range(spark, tmp_path):
    path = str(tmp_path / "log")
    audit.append_audit(events(spark).filter("log_id < 100"), path)
    audit.append_audit(events(spark).filter("log_id >= 100"), path)
    partial = spark.createDataFrame([(datetime(2024, 2, 1), 900, "CRUSH")], "event_time timestamp_ntz, log_id long, action string")
    audit.append_audit(partial, path)
    log = spark.read.parquet(path)
    assert log.count() == 251
    assert log.filter("log_id = 900").first().username is None

    day = audit.audit_range(log, date(2024, 1, 2), date(2024, 1, 3))
    assert day.columns == list(audit.LOG_HEADERS)
    got = day.collect()
    assert len(got) == 100
    assert [r.timestamp for r in got] == sorted((r.timestamp for r in got), reverse=True)
    assert got[0].timestamp.startswith("02.01.2024 23:")
    both = audit.audit_range(log, date(2024, 1, 2), date(2024, 1, 3), end_inclusive=True)
    assert both.count() == 150
    plan = day._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    latest = audit.audit_range(log)
    assert latest.count() == 100 and latest.first().timestamp == "01.02.2024 00:00:00"
    assert audit.audit_range(log, None, date(2024, 1, 3), limit=7).count() == 7


def test_audit_ties_go_by_id(spark):
    same = events(spark, 5).withColumn("event_time", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    assert [r.username for r in audit.audit_range(same).collect()] == ["u4", "u3", "u2", "u1", "u0"]


def test_audit_export(spark, tmp_path):
    export_audit(events(spark), str(tmp_path / "x"))
    back = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert back.columns == list(audit.LOG_HEADERS.values())
    assert back.count() == 250


def test_audit_report(spark):
    log, today = events(spark), date(2024, 1, 3)

    def days(*args):
        return {r.timestamp[:10] for r in audit_report(log, *args).collect()}

    assert days("today", today) == {"03.01.2024"}
    assert days("yesterday", today) == days("custom", today, "2024-01-02", "2024-01-03") == {"02.01.2024"}
    assert days("this_month", today) == {"01.01.2024", "02.01.2024", "03.01.2024"}
    assert days("last_month", today) == set()
    assert days("no such", today) == {"03.01.2024"}
    assert audit_report(log, "custom", today, "2024-01-02", None).count() == 100


def test_audit_event_fields():
    event = audit.audit_event("SEARCH", "me", regnumber="R")
    assert event["regnumber"] == "R" and event["status"] is None
    assert len(event) == 7
