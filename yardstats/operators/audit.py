"""Audit log: append, range query, latest rows, export."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from yardstats.schemas import AUDIT
from yardstats.session import Files, write_through

# The log columns in display order, their headers, the time format.
LOG_HEADERS = {
    "timestamp": "Timestamp",
    "username": "User",
    "action": "Action",
    "regnumber": "Registration",
    "stocknumber": "Stock Number",
    "vstockno": "vStockNo",
    "location": "Location",
    "status": "Status",
}
FILES_PER_DAY = 4
TIME_FORMAT = "dd.MM.yyyy HH:mm:ss"


def audit_event(
    action: str,
    username: str,
    regnumber: str | None = None,
    stocknumber: str | None = None,
    vstockno: str | None = None,
    location: str | None = None,
    status: str | None = None,
) -> dict[str, str | None]:
    """One event by its seven fields; time and id are set when it is stored."""
    return dict(
        action=action, username=username, regnumber=regnumber, stocknumber=stocknumber,
        vstockno=vstockno, location=location, status=status,
    )


def as_audit_rows(events: DataFrame) -> DataFrame:
    """Bring rows to the log's columns; what an event lacks is null."""
    return events.select(
        *[
            (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in AUDIT.fields
        ]
    )


def by_day(rows: DataFrame) -> DataFrame:
    """Rows with their ``event_date``, each day dealt out over a few tasks only."""
    dated = rows.withColumn("event_date", F.to_date("event_time"))
    return dated.repartition("event_date", F.pmod(F.xxhash64("log_id"), F.lit(FILES_PER_DAY)))


def append_audit(events: DataFrame, path: str) -> None:
    """Append to the log, laid out by day so that a range query reads only its days.

    An append adds at most ``FILES_PER_DAY`` files to a day.
    """
    by_day(as_audit_rows(events)).write.mode("append").partitionBy("event_date").parquet(path)


def append_audit_once(events: DataFrame, path: str) -> None:
    """Append the events that the log does not hold yet, however often and however late they are delivered.

    An event is known by its id within its day, so only the days that the events fall on are
    looked through. Of equal ids in one delivery the first by time counts. An event without an id is always new.
    """
    spark = events.sparkSession
    rows = write_through(by_day(as_audit_rows(events)), "audit-delivery")
    alone = W.partitionBy("event_date", "log_id").orderBy("event_time", *[c for c in rows.columns if c not in ("event_time", "log_id", "event_date")])
    named = rows.filter("log_id is not null").withColumn("_place", F.row_number().over(alone)).filter("_place = 1").drop("_place")
    if Files(spark, path).names():
        days = [r.event_date for r in rows.select("event_date").distinct().collect()]
        stored = spark.read.schema(_stored_schema()).parquet(path)
        touched = F.col("event_date").isin([d for d in days if d is not None])
        stored = stored.filter(touched | F.col("event_date").isNull() if None in days else touched).select("event_date", "log_id")
        same = named["event_date"].eqNullSafe(stored["event_date"]) & (named["log_id"] == stored["log_id"])
        named = named.join(stored, same, "left_anti")
    new = named.union(rows.filter("log_id is null").select(named.columns))
    new.repartition("event_date", F.pmod(F.xxhash64("log_id"), F.lit(FILES_PER_DAY))).write.mode("append").partitionBy("event_date").parquet(path)


def _stored_schema() -> T.StructType:
    return T.StructType([*AUDIT.fields, T.StructField("event_date", T.DateType())])


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("event_time"), F.desc("log_id")]


def _shown(log: DataFrame) -> DataFrame:
    present = set(log.columns)
    cells = [
        F.col(c) if c in present else F.lit(None).cast("string").alias(c)
        for c in LOG_HEADERS
        if c != "timestamp"
    ]
    return log.select(F.date_format("event_time", TIME_FORMAT).alias("timestamp"), *cells)


def audit_range(
    log: DataFrame,
    start: date | None = None,
    end: date | None = None,
    end_inclusive: bool = False,
    limit: int = 100,
) -> DataFrame:
    """Log rows of ``[start, end)``, newest first, in the 8 display columns.

    Without both bounds: the latest ``limit`` rows, of a log laid out by day out of its
    newest days only. ``end_inclusive`` adds the end day, as the named periods of the other reports do.
    """
    if start is None or end is None:
        log = _newest_days(log, limit) if "event_date" in log.columns else log
        return _shown(log.orderBy(*newest_first()).limit(limit))
    stop = end + timedelta(days=1) if end_inclusive else end
    rows = log.filter((F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(stop)))
    if "event_date" in log.columns:
        rows = rows.filter(F.col("event_date").between(F.lit(start), F.lit(stop)))
    return _shown(rows.orderBy(*newest_first()))


def _newest_days(log: DataFrame, limit: int) -> DataFrame:
    """The newest days of a log that hold ``limit`` rows, if there are so many.

    Which days there are is read off the names of the files. Twice as many days are counted each time, from
    the newest on, until the rows suffice; rows without a time are the last and in no named day.
    """
    found = {m[1] for name in log.inputFiles() if (m := re.search(r"/event_date=(\d{4,}-\d\d-\d\d)/", name))}
    days, taken = sorted(map(date.fromisoformat, found), reverse=True), 1
    while taken < len(days):
        newest = log.filter(F.col("event_date") >= F.lit(days[taken - 1]))
        if newest.count() >= limit:
            return newest
        taken *= 2
    return log


def export_rows(log: DataFrame) -> DataFrame:
    """The whole log, newest first, under the display headers."""
    rows = _shown(log.orderBy(*newest_first()))
    return rows.select(*[F.col(c).alias(h) for c, h in LOG_HEADERS.items()])
