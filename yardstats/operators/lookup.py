"""Vehicle lookup and relocation, image galleries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstats.functions.text import absolute_url, strip
from yardstats.operators.spread import number_rows, skew_join

VEHICLE_COLUMNS = ["stocknumber_id", "regnumber", "vstockno", "bin"]

# Fixed value: the location a crushed vehicle is moved to.
CRUSHED_LOCATION = 11045


def stocked_vehicles(vehicle: DataFrame, stocknumber: DataFrame, location: DataFrame) -> DataFrame:
    """Vehicles that have a stock number, with the bin they stand in if known."""
    return (
        vehicle.join(stocknumber.select("stocknumber_id", "vstockno"), "stocknumber_id")
        .join(location.select("location_id", "bin"), "location_id", "left")
        .select(*VEHICLE_COLUMNS)
    )


def find_vehicle(
    vehicle: DataFrame, stocknumber: DataFrame, location: DataFrame, registration: str, stock_number: str
) -> DataFrame:
    """All vehicles with that registration or that stock number, by key.

    Each number filters its own scan; bins are looked up for the hits only.
    """
    by_reg = vehicle.filter(F.col("regnumber") == registration.strip())
    by_stock = stocknumber.filter(F.col("vstockno") == stock_number.strip())
    hits = stocked_vehicles(by_reg, stocknumber, location).union(stocked_vehicles(vehicle, by_stock, location))
    return hits.dropDuplicates(VEHICLE_COLUMNS).orderBy("stocknumber_id")


def lookup_vehicle(
    vehicle: DataFrame, stocknumber: DataFrame, location: DataFrame, registration: str, stock_number: str
) -> DataFrame:
    """The first match, by key, of either number."""
    return find_vehicle(vehicle, stocknumber, location, registration, stock_number).limit(1)


def _first_keys(rows: DataFrame, number: str, hit: str, wanted: DataFrame) -> DataFrame:
    """Lowest key of each wanted number: ``number`` and ``hit``.

    Rows of other numbers go before anything is grouped, and a number that very many
    rows share is reduced where it is read.
    """
    wanted = wanted.filter(F.col("number").isNotNull()).distinct()
    asked = rows.select(F.col(number).alias("number"), "stocknumber_id").join(wanted, "number", "left_semi")
    return asked.groupBy("number").agg(F.min("stocknumber_id").alias(hit))


def lookup_vehicles(
    vehicle: DataFrame, stocknumber: DataFrame, location: DataFrame, requests: DataFrame
) -> DataFrame:
    """Many lookups at once; every request yields a row.

    ``requests``: ``request_id, registration, stock_number``. An "or" between two
    keys cannot be hashed, so each number is matched by its own equi-join and the
    earlier of the two vehicles is taken. Result: the request, the vehicle
    columns (null without a match) and ``status``.
    """
    asked = requests.select(
        "request_id",
        strip(F.col("registration")).alias("registration"),
        strip(F.col("stock_number")).alias("stock_number"),
    )
    known = vehicle.select("stocknumber_id", "regnumber").join(stocknumber.select("stocknumber_id", "vstockno"), "stocknumber_id")
    by_reg = _first_keys(known, "regnumber", "reg_hit", asked.select(F.col("registration").alias("number")))
    by_stock = _first_keys(known, "vstockno", "stock_hit", asked.select(F.col("stock_number").alias("number")))
    matched = skew_join(asked, by_reg.withColumnRenamed("number", "registration"), ["registration"])
    matched = skew_join(matched, by_stock.withColumnRenamed("number", "stock_number"), ["stock_number"])
    matched = matched.withColumn("stocknumber_id", F.least("reg_hit", "stock_hit"))
    hits = matched.select("stocknumber_id").distinct()
    found = stocked_vehicles(vehicle.join(hits, "stocknumber_id", "left_semi"), stocknumber, location)
    first = found.groupBy("stocknumber_id").agg(F.min(F.struct(*VEHICLE_COLUMNS)).alias("v"))
    answered = skew_join(matched, first, ["stocknumber_id"])
    return answered.select(
        "request_id",
        "registration",
        "stock_number",
        *[F.col("v")[c].alias(c) for c in VEHICLE_COLUMNS],
        F.when(F.col("v").isNotNull(), "FOUND").otherwise("NOT FOUND").alias("status"),
    )


def lookup_log(outcomes: DataFrame, username: str, when: Column, first_id: int = 1) -> DataFrame:
    """The audit rows a batch of lookups leaves behind, one per request.

    ``log_id`` counts on from ``first_id`` in the order of the requests, so ids of one
    batch never meet; pass the number behind the log's last one.
    """
    numbered = number_rows(outcomes, [F.asc("request_id"), F.asc("registration"), F.asc("stock_number")], "_place")
    return numbered.select(
        when.alias("event_time"),
        (F.col("_place") + (first_id - 1)).alias("log_id"),
        F.lit(username).alias("username"),
        F.lit("SEARCH").alias("action"),
        F.col("registration").alias("regnumber"),
        F.col("stock_number").alias("stocknumber"),
        "vstockno",
        F.col("bin").alias("location"),
        "status",
    )


def relocate(vehicle: DataFrame, relocations: DataFrame, location_id: int = CRUSHED_LOCATION) -> DataFrame:
    """The vehicle table, with all its columns, after a batch of moves.

    Moves: ``stocknumber_id, moved_at[, location_id][, move_id]``. The latest move of a
    vehicle wins; one without a time is older than all others, and of moves at one time
    that with the greatest ``move_id``, then location, wins. A move of an unknown
    vehicle, or without a vehicle, has no effect; one to no location changes nothing.
    """
    target = F.col("location_id") if "location_id" in relocations.columns else F.lit(location_id)
    own = [F.col("move_id")] if "move_id" in relocations.columns else []
    moves = relocations.select(
        F.col("stocknumber_id").alias("_moved"), F.struct("moved_at", *own, target.cast("long").alias("to")).alias("move")
    ).filter("move.to IS NOT NULL AND _moved IS NOT NULL")
    # Nulls are the least in a struct's order.
    latest = moves.groupBy("_moved").agg(F.max("move").alias("move"))
    moved = vehicle.join(latest, vehicle["stocknumber_id"] == F.col("_moved"), "left")
    place = F.coalesce(F.col("move.to"), vehicle["location_id"]).cast(vehicle.schema["location_id"].dataType)
    return moved.select(*[place.alias(c) if c == "location_id" else vehicle[c] for c in vehicle.columns])


def relocation_log(relocations: DataFrame, username: str, first_id: int = 1) -> DataFrame:
    """Audit rows of a batch of moves: one each, whether or not the vehicle exists.

    Ids as in ``lookup_log``, in the order of time, vehicle and, where there is one, move.
    """
    nothing = F.lit(None).cast("string")
    own = [F.asc("move_id")] if "move_id" in relocations.columns else []
    numbered = number_rows(relocations, [F.asc("moved_at"), F.asc("stocknumber_id"), *own], "_place")
    return numbered.select(
        F.col("moved_at").alias("event_time"),
        (F.col("_place") + (first_id - 1)).alias("log_id"),
        F.lit(username).alias("username"),
        F.lit("CRUSH").alias("action"),
        *[nothing.alias(c) for c in ("regnumber", "stocknumber", "vstockno", "location")],
        F.lit("CRUSHED SUCCESSFULLY").alias("status"),
    )


def image_gallery(image: DataFrame, base_url: str, barcode: str | None = None) -> DataFrame:
    """``barcode, url, displayorder`` of full-size images in display order.

    Without a barcode: the galleries of all tags, as one range-partitioned sort,
    so a tag with very many images is spread over several tasks.
    """
    shown = image.filter(~F.coalesce("thumbnail", F.lit(False)))
    if barcode is not None:
        shown = shown.filter(F.col("barcode") == barcode.strip())
    return shown.orderBy("barcode", F.coalesce("displayorder", F.lit(0)), "relativeurl").select(
        "barcode", absolute_url(F.col("relativeurl"), base_url).alias("url"), "displayorder"
    )
