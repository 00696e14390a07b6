import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from yardstats.operators.audit import append_audit, append_audit_once, audit_range
from yardstats.schemas import AUDIT, INVOICE, SOLD, USERS
from yardstats.streaming import live


def invoices(spark, *rows):
    return spark.createDataFrame([(i, d, u, t, Decimal(x), Decimal(y)) for i, d, u, t, x, y in rows], INVOICE).coalesce(1)


def current(spark, rows, path):
    got = live.read_totals(spark, path, rows)
    return {(r.day, r.entity): tuple(r)[2:] for r in got.collect()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_totals_follow_arriving_files(spark, tmp_path, zone):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    a = datetime(2024, 3, 10, 0, 30)
    b = datetime(2024, 3, 10, 23, 59)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        invoices(spark, (1, "A", 1, a, "1.00", "0.200"), (2, None, 1, b, "2.00", "0.400")).write.parquet(inbox)
        totals = live.live_rows(spark.readStream.schema(INVOICE).parquet(inbox))
        live.write_increments(totals, out, state).awaitTermination()
        day = date(2024, 3, 10)
        assert current(spark, totals, out) == {(day, "A"): (1.0, 1.2), (day, None): (2.0, 2.4)}

        invoices(spark, (3, "A", 1, b, "4.00", "0.800")).write.mode("append").parquet(inbox)
        live.write_increments(totals, out, state).awaitTermination()
        assert current(spark, totals, out) == {(day, "A"): (5.0, 6.0), (day, None): (2.0, 2.4)}

        # Starting again without new files changes nothing.
        live.write_increments(totals, out, state).awaitTermination()
        assert current(spark, totals, out)[(day, "A")] == (5.0, 6.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_no_row_is_too_late(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = live.live_rows(_stream(spark, inbox))
    for day in (20, 21, 3, 20):
        invoices(spark, (day, "A", 1, datetime(2024, 3, day, 12), "1.00", "0.000")).write.mode("append").parquet(inbox)
        live.write_increments(rows, out, state).awaitTermination()
    assert {d.day: v for (d, _), v in current(spark, rows, out).items()} == {20: (2.0, 2.0), 21: (1.0, 1.0), 3: (1.0, 1.0)}


def _stream(spark, inbox):
    spark.createDataFrame([], INVOICE).write.parquet(inbox)
    return spark.readStream.schema(INVOICE).parquet(inbox)


@pytest.mark.parametrize("dimension", ["department", "user"])
def test_live_parts(spark, tmp_path, dimension):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    when = datetime(2024, 3, 10, 12)
    sold = [(1, 5, 10, True, when), (1, 5, None, True, when), (None, 5, 11, True, when), (2, 5, 12, False, when), (2, 5, 13, None, when), (9, 5, 14, True, when)]
    spark.createDataFrame(sold, SOLD).write.parquet(inbox)
    owners = invoices(spark, (1, "A", 1, when, "1.00", "0.000"), (2, "B", 2, when, "1.00", "0.000"))
    users = spark.createDataFrame([(1, "ann")], USERS)
    stream = spark.readStream.schema(SOLD).parquet(inbox)
    totals = live.live_rows(stream, dimension, "parts", invoice=owners, users=users)
    live.write_increments(totals, out, state).awaitTermination()
    name = "A" if dimension == "department" else "ann"
    assert current(spark, totals, out) == {(date(2024, 3, 10), name): (1,), (date(2024, 3, 10), "Unknown"): (2,)}


@pytest.mark.parametrize("dimension", ["department", "user"])
def test_sold_rows_move_when_their_invoice_comes(spark, tmp_path, dimension):
    sold_in, invoice_in, out, state = (str(tmp_path / n) for n in ("sold", "invoice", "out", "state"))
    a, b = datetime(2024, 3, 10, 0, 30), datetime(2024, 3, 11, 23)
    users = spark.createDataFrame([(1, "ann"), (2, "bob")], USERS)

    def arrive(sold=(), invoice=()):
        """Both may come at once; then the stream runs to its end, as if started anew."""
        spark.createDataFrame(list(sold), SOLD).coalesce(1).write.mode("append").parquet(sold_in)
        invoices(spark, *[(i, d, u, a, "1.00", "0.000") for i, d, u in invoice]).write.mode("append").parquet(invoice_in) if invoice else (
            spark.createDataFrame([], INVOICE).coalesce(1).write.mode("append").parquet(invoice_in)
        )
        streams = [spark.readStream.schema(k).parquet(p) for k, p in ((SOLD, sold_in), (INVOICE, invoice_in))]
        rows = live.live_parts(*streams, dimension, users)
        live.write_increments(rows, out, state).awaitTermination()
        return {(d.day, e): n for (d, e), (n,) in current(spark, rows, out).items()}

    one, two = ("A", "B") if dimension == "department" else ("ann", "bob")
    rows = [(1, 5, 10, True, a), (1, 5, None, True, a), (1, 5, 11, True, b), (None, 5, 12, True, a), (2, 5, 13, False, a), (3, 5, 14, None, a)]
    assert arrive(rows) == {(10, "Unknown"): 2, (11, "Unknown"): 1}
    assert arrive(rows[:1], [(1, "A", 1)]) == {(10, one): 2, (11, one): 1, (10, "Unknown"): 1}
    assert arrive() == {(10, one): 2, (11, one): 1, (10, "Unknown"): 1}
    # An invoice that came first, one that comes again, one without names, a row that waits further on
    assert arrive([(4, 5, None, True, b), (9, 5, 20, True, b)], [(2, "B", 2), (1, "A", 1), (4, None, None)]) == {
        (10, one): 2, (11, one): 1, (10, "Unknown"): 1, (11, "Unknown"): 1,
    }
    assert arrive([(2, 5, 15, True, b)], [(9, "B", 2)]) == {(10, one): 2, (11, one): 1, (10, "Unknown"): 1, (11, two): 2, (11, "Unknown"): 0}


def test_live_user_sales_drop_unknown_users(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    when = datetime(2024, 3, 10, 12)
    invoices(spark, (1, "A", 1, when, "1.00", "0.000"), (2, "A", 2, when, "2.00", "0.000")).write.parquet(inbox)
    users = spark.createDataFrame([(1, "ann")], USERS)
    totals = live.live_rows(spark.readStream.schema(INVOICE).parquet(inbox), "user", "sales", users=users)
    live.write_increments(totals, out, state).awaitTermination()
    assert current(spark, totals, out) == {(date(2024, 3, 10), "ann"): (1.0, 1.0)}


def test_a_repeated_batch_is_not_doubled(spark, tmp_path):
    # The folder of a batch is replaced, as after a crash between write and commit.
    out = str(tmp_path / "out")
    schema = "day date, entity string, sum_total decimal(18,2)"
    for batch, times in ((0, 1), (1, 2)):
        rows = spark.createDataFrame([(date(2024, 1, 1), "A", Decimal(batch + 1))], schema)
        for _ in range(times):
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    assert [tuple(r) for r in live.read_totals(spark, out, rows).collect()] == [(date(2024, 1, 1), "A", 3.0)]


def test_audit_stream(spark, tmp_path):
    inbox, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    rows = [(datetime(2024, 1, 1 + i % 3, 5), i, "u", "SEARCH", None, None, None, None, "FOUND") for i in range(30)]
    df = spark.createDataFrame(rows, AUDIT)
    df.filter("log_id < 10").write.parquet(inbox)
    stream = spark.readStream.schema(AUDIT).parquet(inbox)
    live.stream_audit(stream, log, state).awaitTermination()
    df.filter("log_id >= 10").write.mode("append").parquet(inbox)
    live.stream_audit(stream, log, state).awaitTermination()
    stored = spark.read.parquet(log)
    assert stored.drop("event_date").exceptAll(df).isEmpty() and stored.count() == 30


def test_an_event_is_logged_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(datetime(2024, 1, 1 + i % 3, 5), i, "u", "SEARCH", None, None, None, None, "FOUND") for i in range(9)]
    rows += [(None, 90, "u", "SEARCH", None, None, None, None, "FOUND"), (datetime(2024, 1, 2), None, "u", "SEARCH", None, None, None, None, None)]
    df = spark.createDataFrame(rows, AUDIT)
    append_audit_once(df.filter("log_id < 5"), log)
    files = {r.f for r in spark.read.parquet(log).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    append_audit_once(df.union(df.filter("log_id is not null")), log)
    assert spark.read.parquet(log).drop("event_date").exceptAll(df).isEmpty() and spark.read.parquet(log).count() == 11
    append_audit_once(df.filter("log_id is not null"), log)  # all of it once more, later
    stored = spark.read.parquet(log)
    assert stored.count() == 11 and files <= {r.f for r in stored.select(F.col("_metadata.file_path").alias("f")).collect()}


def test_latest_rows_open_the_newest_days_only(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(datetime(2024, 1, 1 + i // 10, 5, i % 10), i, "u", "SEARCH", None, None, None, None, "FOUND") for i in range(200)]
    rows.append((None, 500, "u", "SEARCH", None, None, None, None, "FOUND"))
    append_audit(spark.createDataFrame(rows, AUDIT), log)
    stored = spark.read.parquet(log)
    found = audit_range(stored, limit=25)
    whole = audit_range(stored.drop("event_date"), limit=25)
    assert found.collect() == whole.collect() and found.count() == 25
    assert re.search(r"PartitionFilters: \[.*event_date#\d+ >= 2024-01-17", found._jdf.queryExecution().executedPlan().toString())
    assert audit_range(stored, limit=1000).collect() == audit_range(stored.drop("event_date"), limit=1000).collect()
