"""Live statistics and the streaming audit log."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from yardstats.functions.modes import dimension_of, mode_of
from yardstats.functions.text import label
from yardstats.operators.audit import append_audit_once, as_audit_rows, by_day
from yardstats.operators.entities import gross, net
from yardstats.operators.spread import left_join_sparse_key
from yardstats.streaming.generations import FANOUT, compact, live_folders


def utc_instant(moment: Column) -> Column:
    """A zone-less timestamp as the same clock time in UTC.

    Event time must be an instant; a plain cast would shift it by the session
    zone and move rows to other days.
    """
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, moment))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def live_rows(
    stream: DataFrame,
    dimension: str = "department",
    mode: str = "sales",
    invoice: DataFrame | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """Arriving invoices or sold rows as ``day, entity`` and what they add to a total.

    ``invoice`` and ``users`` are stored tables joined to every batch of the stream;
    pass the months of ``invoice`` that can still be sold from, not its whole history. Where
    invoices arrive as well, take ``live_parts``: it moves sold rows that came first.
    The added columns: ``sum_total, sum_total_vat`` as decimals, or ``parts_sold``.
    """
    parts = mode_of(mode) == "parts"
    by_user = dimension_of(dimension) == "user"
    moment = "solddate" if parts else "datecreated"
    rows = stream.filter("issold") if parts else stream
    if parts:
        owners = invoice.select("invoice_id", "departmentname", "whocreated_id")
        rows = left_join_sparse_key(rows, owners, "invoice_id", spread_by=["itemtype_id", moment])
    if by_user:
        named = users.select(F.col("user_id").alias("whocreated_id"), "shortname")
        rows = rows.join(named, "whocreated_id", "left" if parts else "inner")
    name = F.col("shortname" if by_user else "departmentname")
    day = utc_day(utc_instant(F.col(moment))).alias("day")
    if parts:
        return rows.select(day, label(name).alias("entity"), F.col("invnumber").isNotNull().cast("long").alias("parts_sold"))
    return rows.select(day, name.alias("entity"), net().alias("sum_total"), gross().alias("sum_total_vat"))


KEYS = ["day", "entity"]
SLOTS = 64  # over which sold rows without any invoice are dealt out
ROWS = "sold_rows"  # how many rows are behind a total; a total without any is none

BLOCK_BITS = 8  # 256 invoices of consecutive ids, which often come together, share one state

# A name or user is text behind "=", and empty where it is null: frames without missing values are put together much faster.
_EVENT = "block long, slot int, invoice_id long, owner boolean, day int, department string, who string, parts_sold long, sold_rows long"
_ADDED = "day int, department string, who string, parts_sold long, sold_rows long"
_STATE = (
    "invoices array<long>, departments array<string>, whos array<string>, "
    "waiting array<long>, days array<int>, parts array<long>, sold_rows array<long>"
)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal events of an Arrow batch as one, so that a hot invoice is a few rows before it is shuffled."""
    for batch in batches:
        keys = [n for n in batch.schema.names if n not in ("parts_sold", ROWS)]
        added = pa.table(batch).group_by(keys).aggregate([("parts_sold", "sum"), (ROWS, "sum")])
        yield from added.rename_columns([*keys, "parts_sold", ROWS]).select(batch.schema.names).to_batches()


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(column) for column in zip(*rows)] if rows else [[] for _ in range(width)]


def _corrected(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the events of a block of invoices add to the totals, moving what had come before its invoice.

    Until an invoice is known its rows count under no owner, and their days wait in the state. Of several
    rows of one invoice the last in the order of department and user counts, as long as no earlier batch had one.
    """
    stored = state.get if state.exists else [[]] * 7
    owners = dict(zip(stored[0], zip(stored[1], stored[2])))
    waiting: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for invoice, day, parts, rows in zip(*stored[3:]):
        waiting[invoice][day] = [parts, rows]
    came: dict[int, tuple[str, str]] = {}
    days: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for part in events:
        columns = (part[c].tolist() for c in ("invoice_id", "owner", "day", "department", "who", "parts_sold", ROWS))
        for invoice, is_owner, day, name, user, parts, rows in zip(*columns):
            if is_owner:
                came[invoice] = max(came.get(invoice, ("", "")), (name, user))
            else:
                days[invoice, day][0] += parts
                days[invoice, day][1] += rows
    added: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])

    def add(day: int, owner: tuple[str, str], parts: int, rows: int) -> None:
        total = added[day, *owner]
        total[0] += parts
        total[1] += rows

    nobody = ("", "")
    for invoice, owner in came.items():
        if invoice not in owners:
            owners[invoice] = owner
            for day, (parts, rows) in waiting.pop(invoice, {}).items():
                add(day, nobody, -parts, -rows)
                add(day, owner, parts, rows)
    known = key[0] is not None and key[0] == key[0]
    for (invoice, day), (parts, rows) in days.items():
        add(day, owners.get(invoice, nobody) if known else nobody, parts, rows)
        if known and invoice not in owners:
            total = waiting[invoice][day]
            total[0] += parts
            total[1] += rows
    if known:  # a sold row without invoice waits for none
        left = [(i, d, *total) for i, own in sorted(waiting.items()) for d, total in sorted(own.items())]
        listed = [(i, *owner) for i, owner in sorted(owners.items())]
        state.update((*_columns(listed, 3), *_columns(left, 4)))
    if added:
        out = [(*k, *v) for k, v in added.items()]
        kinds = {"day": np.int32, "department": object, "who": object, "parts_sold": np.int64, ROWS: np.int64}
        yield pd.DataFrame({name: np.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*out))}, copy=False)


def live_parts(sold: DataFrame, invoice: DataFrame, dimension: str = "department", users: DataFrame | None = None) -> DataFrame:
    """Arriving sold rows and arriving invoices, in any order, as ``day, entity`` and what they add.

    A sold row that comes before its invoice counts under "Unknown" until the invoice comes, in whatever batch; then
    a negative and a positive increment move it. Its days wait in the stream's state by invoice, and so do
    the owners of invoices that came, a block of consecutive ids to a state: keep the state in RocksDB where invoices are many. ``users`` is a stored table.
    Added are ``parts_sold`` and ``sold_rows``, the number of rows behind it.
    """
    day = F.unix_date(utc_day(utc_instant(F.col("solddate"))))
    zero, none = F.lit(0).cast("long"), F.lit("")
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), none)
    plain = lambda c: F.when(F.col(c) != "", F.substring(F.col(c), F.lit(2), F.length(c)))
    slot = F.when(F.col("invoice_id").isNull(), F.pmod(F.xxhash64("invnumber", "itemtype_id", "solddate"), F.lit(SLOTS)).cast("int")).otherwise(0)
    block = F.shiftright("invoice_id", BLOCK_BITS).alias("block")
    rows = sold.filter("issold").select(
        block, slot.alias("slot"), "invoice_id", F.lit(False).alias("owner"), day.alias("day"), none.alias("department"), none.alias("who"),
        F.col("invnumber").isNotNull().cast("long").alias("parts_sold"), F.lit(1).cast("long").alias(ROWS),
    )
    owners = invoice.filter("invoice_id is not null").select(
        block, F.lit(0).alias("slot"), "invoice_id", F.lit(True).alias("owner"), F.lit(0).alias("day"),
        marked("departmentname").alias("department"), marked("whocreated_id").alias("who"), zero.alias("parts_sold"), zero.alias(ROWS),
    )
    events = rows.union(owners).mapInArrow(_combined, _EVENT)
    added = events.groupBy("block", "slot").applyInPandasWithState(_corrected, _ADDED, _STATE, "append", "NoTimeout")
    name = plain("department")
    if dimension_of(dimension) == "user":
        named = users.select(F.col("user_id").alias("user_id"), "shortname")
        added, name = added.join(named, plain("who").cast("long") == F.col("user_id"), "left"), F.col("shortname")
    return added.select(F.date_from_unix_date("day").alias("day"), label(name).alias("entity"), "parts_sold", ROWS)


def _wide(rows: DataFrame) -> T.StructType:
    """The columns of stored increments: money has room for all sums."""
    fields = [
        T.StructField(f.name, T.DecimalType(38, f.dataType.scale)) if isinstance(f.dataType, T.DecimalType) else f
        for f in rows.schema.fields
    ]
    return T.StructType(fields)


def _summed(rows: DataFrame) -> DataFrame:
    wide = _wide(rows)
    values = [f for f in wide if f.name not in KEYS]
    sums = rows.groupBy(*KEYS).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in values])
    return sums.select(*wide.names)


def write_increments(rows: DataFrame, path: str, checkpoint: str, fanout: int = FANOUT, **trigger) -> StreamingQuery:
    """Keep what every batch adds, one row per day and entity, in a folder per batch.

    No row is too late: files may arrive in any order. A batch that is run again after
    a failure overwrites its own folder, so nothing is counted twice. Every ``fanout`` closed
    folders are merged into one, and as many merged ones again. One stream writes to a ``path``.
    """
    schema = _wide(rows)

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def merge(sources: list[str], target: str) -> None:
            _summed(spark.read.schema(schema).parquet(*sources)).write.mode("overwrite").parquet(target)

        compact(spark, path, batch_id, merge, fanout)
        _summed(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(keep)
        .start()
    )


def read_totals(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The totals of all batches so far: ``day, entity`` and the sums, money as doubles.

    ``rows`` is the stream that was written; it gives the columns. Before the first batch there are no rows.
    A total that corrections have left without any row behind it is not there.
    """
    wide = _wide(rows)
    folders = live_folders(spark, path)
    stored = spark.read.schema(wide).parquet(*folders) if folders else spark.createDataFrame([], wide)
    totals = _summed(stored)
    if ROWS in wide.names:
        totals = totals.filter(F.col(ROWS) > 0).drop(ROWS)
    money = {f.name for f in wide if isinstance(f.dataType, T.DecimalType)}
    return totals.select(*[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in totals.columns])


def stream_audit(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append arriving events to the log, laid out by day like the batch append.

    The rows of a day meet in few tasks first, or every task would write a file per day.
    """
    return (
        by_day(as_audit_rows(events)).writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def stream_audit_once(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """As ``stream_audit``, for a source that may deliver an event again, at any time later.

    Each batch is compared with the days of the log that it falls on. Nothing is held in
    memory between batches and nothing is lost, however late it is; a batch that is run again adds what is missing.
    """
    return (
        events.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, _: append_audit_once(batch, path))
        .start()
    )
