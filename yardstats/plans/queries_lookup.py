"""Registered queries: vehicles, images, audit log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.functions.text import absolute_url
from yardstats.operators import audit, lookup
from yardstats.plans.registry import as_double, query
from yardstats.plans.reports import audit_report
from yardstats.plans.sample import Sample
from yardstats.plans.views import over
from yardstats.session import work_path
from yardstats.sinks.export import export_audit, read_csv
from yardstats.streaming import live

IMAGE_BASE = "http://images.example.org/hosted/"

_URL = f"""CASE WHEN starts_with(relativeurl, 'http://') OR starts_with(relativeurl, 'https://') THEN relativeurl
 ELSE '{IMAGE_BASE}' || ltrim(relativeurl, '/') END"""


@query(
    "vehicle_lookup",
    over("v_stocked", """
SELECT stocknumber_id, regnumber, vstockno, bin FROM v_stocked
WHERE regnumber = 'Customer#000000021' OR vstockno = 'S40' ORDER BY stocknumber_id"""),
    ordered=True,
)
def vehicle_lookup(s: Sample) -> DataFrame:
    return lookup.find_vehicle(s.vehicle(), s.stocknumber(), s.location(), " Customer#000000021", "S40 ")


@query(
    "vehicle_lookup_first",
    over("v_stocked", """
SELECT stocknumber_id, regnumber, vstockno, bin FROM v_stocked
WHERE regnumber = 'Customer#000000021' OR vstockno = 'S19' ORDER BY stocknumber_id LIMIT 1"""),
)
def vehicle_lookup_first(s: Sample) -> DataFrame:
    return lookup.lookup_vehicle(s.vehicle(), s.stocknumber(), s.location(), "Customer#000000021", "S19")


def _asked(s: Sample) -> DataFrame:
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    return s.raw("orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("Customer#"), key, F.lit(" ")))
        .alias("registration"),
        F.concat(F.lit(" S"), (F.col("o_custkey") + 1).cast("string")).alias("stock_number"),
    )


_MATCHED = """
matched AS (SELECT a.request_id, v.stocknumber_id FROM v_asked a JOIN v_stocked v ON v.regnumber = a.registration
 UNION SELECT a.request_id, v.stocknumber_id FROM v_asked a JOIN v_stocked v ON v.vstockno = a.stock_number),
first_hit AS (SELECT request_id, min(stocknumber_id) AS stocknumber_id FROM matched GROUP BY 1),
outcome AS (SELECT a.*, v.stocknumber_id, v.regnumber, v.vstockno, v.bin FROM v_asked a
 LEFT JOIN first_hit f ON f.request_id = a.request_id LEFT JOIN v_stocked v ON v.stocknumber_id = f.stocknumber_id)"""


def _outcome_sql(body: str) -> str:
    ctes, _, _ = over("v_asked v_stocked", "SELECT").rpartition("\nSELECT")
    return f"{ctes},{_MATCHED}\n{body}"


@query(
    "vehicle_lookup_batch",
    _outcome_sql("SELECT request_id, stocknumber_id, regnumber, vstockno, bin FROM outcome WHERE stocknumber_id IS NOT NULL"),
)
def vehicle_lookup_batch(s: Sample) -> DataFrame:
    found = lookup.lookup_vehicles(s.vehicle(), s.stocknumber(), s.location(), _asked(s))
    return found.filter("status = 'FOUND'").select("request_id", *lookup.VEHICLE_COLUMNS)


@query(
    "vehicle_lookup_outcomes",
    _outcome_sql("""
SELECT row_number() OVER (ORDER BY request_id) AS log_id, 'clerk' AS username, 'SEARCH' AS action, registration AS regnumber, stock_number AS stocknumber,
 vstockno, bin AS location, CASE WHEN stocknumber_id IS NULL THEN 'NOT FOUND' ELSE 'FOUND' END AS status FROM outcome"""),
)
def vehicle_lookup_outcomes(s: Sample) -> DataFrame:
    found = lookup.lookup_vehicles(s.vehicle(), s.stocknumber(), s.location(), _asked(s))
    return lookup.lookup_log(found, "clerk", F.to_timestamp_ntz(F.lit("2024-01-05 10:00:00"))).drop("event_time")


@query(
    "vehicle_relocate",
    over("v_vehicle", """
SELECT v.stocknumber_id, v.regnumber, coalesce(m.location_id, v.location_id) AS location_id, 'c' || v.stocknumber_id AS colour
FROM v_vehicle v LEFT JOIN (SELECT o_custkey, location_id FROM (
 SELECT o_custkey, 100 + o_orderkey % 7 AS location_id, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey // 100 END DESC NULLS LAST, o_orderkey DESC) AS place
 FROM orders WHERE o_orderkey % 10 <> 0) WHERE place = 1) m ON m.o_custkey = v.stocknumber_id"""),
)
def vehicle_relocate(s: Sample) -> DataFrame:
    key = F.col("o_orderkey")
    moves = s.raw("orders").select(
        # Every tenth move names a vehicle that does not exist, every third has no time.
        F.when(key % 10 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("stocknumber_id"),
        F.when(key % 3 != 0, F.floor(key / 100)).alias("moved_at"),
        key.alias("move_id"),
        (100 + key % 7).alias("location_id"),
    )
    colour = F.concat(F.lit("c"), F.col("stocknumber_id").cast("string"))
    return lookup.relocate(s.vehicle().withColumn("colour", colour), moves)


@query(
    "vehicle_crush",
    over("v_vehicle", """
SELECT stocknumber_id, regnumber, CASE WHEN stocknumber_id IN (SELECT o_custkey FROM orders) THEN 11045 ELSE location_id END AS location_id
FROM v_vehicle"""),
)
def vehicle_crush(s: Sample) -> DataFrame:
    moves = s.raw("orders").select(F.col("o_custkey").alias("stocknumber_id"), F.col("o_orderdate").alias("moved_at"))
    return lookup.relocate(s.vehicle(), moves)


@query(
    "relocation_log",
    """
SELECT o_orderdate AS event_time, row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderkey) AS log_id, 'clerk' AS username,
 'CRUSH' AS action, CAST(NULL AS VARCHAR) AS regnumber, 'CRUSHED SUCCESSFULLY' AS status FROM orders""",
)
def relocation_log(s: Sample) -> DataFrame:
    moves = s.raw("orders").select(
        F.col("o_custkey").alias("stocknumber_id"), F.col("o_orderdate").alias("moved_at"), F.col("o_orderkey").alias("move_id")
    )
    return lookup.relocation_log(moves, "clerk").drop("stocknumber", "vstockno", "location")


@query(
    "image_gallery",
    over("v_image", f"""
SELECT barcode, {_URL} AS url, CAST(displayorder AS DOUBLE) AS displayorder FROM v_image WHERE coalesce(thumbnail, false) = false
ORDER BY barcode, coalesce(v_image.displayorder, 0), relativeurl"""),
    ordered=True,
)
def image_gallery(s: Sample) -> DataFrame:
    return as_double(lookup.image_gallery(s.image(), IMAGE_BASE), "displayorder")


@query(
    "image_gallery_one",
    over("v_image", f"""
SELECT barcode, {_URL} AS url, CAST(displayorder AS DOUBLE) AS displayorder FROM v_image WHERE coalesce(thumbnail, false) = false AND barcode = 'T5'
ORDER BY coalesce(v_image.displayorder, 0), relativeurl"""),
    ordered=True,
)
def image_gallery_one(s: Sample) -> DataFrame:
    return as_double(lookup.image_gallery(s.image(), IMAGE_BASE, " T5 "), "displayorder")


@query("image_urls", over("v_image", f"SELECT barcode, relativeurl, {_URL} AS url FROM v_image"))
def image_urls(s: Sample) -> DataFrame:
    return s.image().select("barcode", "relativeurl", absolute_url(F.col("relativeurl"), IMAGE_BASE).alias("url"))


_LOG = "timestamp, username, action, regnumber, stocknumber, vstockno, location, status"


@query(
    "audit_log_range",
    over("v_shown_log", f"""
SELECT {_LOG} FROM v_shown_log WHERE event_time >= DATE '2024-01-05' AND event_time < DATE '2024-01-06'
ORDER BY event_time DESC, log_id DESC"""),
    ordered=True,
)
def audit_log_range(s: Sample) -> DataFrame:
    return audit.audit_range(s.audit_log(), date(2024, 1, 5), date(2024, 1, 6))


@query(
    "audit_report",
    over("v_shown_log", f"""
SELECT {_LOG} FROM v_shown_log WHERE event_time >= DATE '2024-01-08' AND event_time < DATE '2024-01-09'
ORDER BY event_time DESC, log_id DESC"""),
    ordered=True,
)
def audit_of_yesterday(s: Sample) -> DataFrame:
    return audit_report(s.audit_log(), "yesterday", date(2024, 1, 9))


@query(
    "audit_log_latest",
    over("v_shown_log", f"SELECT {_LOG} FROM v_shown_log ORDER BY event_time DESC, log_id DESC LIMIT 100"),
    ordered=True,
)
def audit_log_latest(s: Sample) -> DataFrame:
    return audit.audit_range(s.audit_log(), start=date(2024, 1, 5))


@query(
    "audit_latest_by_day",
    over("v_shown_log", f"SELECT {_LOG} FROM v_shown_log ORDER BY event_time DESC, log_id DESC LIMIT 100"),
    ordered=True,
)
def audit_latest_by_day(s: Sample) -> DataFrame:
    """Out of a log laid out by day, of which the newest days are read."""
    path = work_path(s.spark, "audit")
    audit.append_audit(s.audit_log(), path)
    return audit.audit_range(s.spark.read.parquet(path))


@query(
    "audit_export",
    over("v_shown_log", """
SELECT timestamp AS "Timestamp", username AS "User", action AS "Action", regnumber AS "Registration", stocknumber AS "Stock Number",
 vstockno AS "vStockNo", location AS "Location", status AS "Status" FROM v_shown_log ORDER BY event_time DESC, log_id DESC"""),
    ordered=True,
)
def audit_export(s: Sample) -> DataFrame:
    """Written and read back, with the rows in the order of the files."""
    path = work_path(s.spark, "audit-export")
    export_audit(s.audit_log(), path)
    place = [F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    back = read_csv(s.spark, path)
    return back.withColumns({f"_{i}": c for i, c in enumerate(place)}).orderBy("_0", "_1", "_2").drop("_0", "_1", "_2")


_STORED = over("v_shown_log", "SELECT event_time, log_id, username, action, regnumber, status FROM v_shown_log")


def _stored(s: Sample, path: str) -> DataFrame:
    return s.spark.read.parquet(path).select("event_time", "log_id", "username", "action", "regnumber", "status")


@query("audit_append", _STORED)
def audit_append(s: Sample) -> DataFrame:
    path = work_path(s.spark, "audit")
    events = s.audit_log()
    audit.append_audit(events.filter("action <> 'ERROR'"), path)
    audit.append_audit(events.filter("action = 'ERROR'"), path)
    return _stored(s, path)


@query("audit_append_once", _STORED)
def audit_append_once(s: Sample) -> DataFrame:
    """Deliveries that overlap, and one that comes again as a whole."""
    path = work_path(s.spark, "audit")
    events = s.audit_log()
    audit.append_audit_once(events.filter("action <> 'ERROR'"), path)
    audit.append_audit_once(events.filter("action <> 'VIEW'").union(events.filter("action = 'ERROR'")), path)
    audit.append_audit_once(events, path)
    return _stored(s, path)


@query("audit_stream_once", _STORED)
def audit_stream_once(s: Sample) -> DataFrame:
    """The same file arrives in two batches."""
    inbox, path, checkpoint = (work_path(s.spark, name) for name in ("audit-inbox", "audit", "audit-state"))
    events = s.audit_log()
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(inbox)
    arriving = s.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    live.stream_audit_once(arriving, path, checkpoint).awaitTermination()
    return _stored(s, path)


@query("audit_stream", _STORED)
def audit_stream(s: Sample) -> DataFrame:
    path, checkpoint = work_path(s.spark, "audit"), work_path(s.spark, "audit-state")
    arriving = Sample(s.spark, s.base, streamed=("events",)).audit_log()
    live.stream_audit(arriving, path, checkpoint).awaitTermination()
    return _stored(s, path)
