"""Per-user preferences: the saved order and the saved exclusions.

A store is a table ``username, dimension, items, saved_at``. The saved order uses
the dimension ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.session import overwrite_table, settle_table

DEFAULT_USER = "__default__"
ORDER = "order"
EXCLUSION_DIMENSIONS = ("department", "user")


def _texts(json_list: Column) -> Column:
    """A JSON list as text items (a null item reads "None"); anything but a list is null."""
    is_list = F.startswith(F.ltrim(json_list), F.lit("["))
    items = F.from_json(json_list, "array<string>")
    return F.when(is_list, F.transform(items, lambda i: F.coalesce(i, F.lit("None"))))


def _last_entries(stores: DataFrame, entries: Column) -> DataFrame:
    """``username, value`` of the entries of each store; of a repeated name, the last one."""
    numbered = stores.select(F.monotonically_increasing_id().alias("store"), F.map_entries(entries).alias("entries"))
    placed = numbered.select("store", F.posexplode("entries"))
    last = placed.groupBy("store", F.col("col.key").alias("username")).agg(F.max_by("col.value", "pos").alias("value"))
    return last.select("username", "value")


def normalise_orders(stores: DataFrame) -> DataFrame:
    """``username, items`` from JSON text ``raw``: one row per usable entry.

    A bare list is everybody's order. In an object, entries that are not lists
    are dropped one by one, after the last entry of each name was taken. Anything else,
    or broken text, holds nothing.
    """
    everybody = F.create_map(F.lit(DEFAULT_USER), F.col("raw"))
    # Values stay text here; parsing them as lists at once would let a single
    # bad entry null the whole map.
    by_user = F.from_json("raw", "map<string,string>")
    entries = F.when(F.startswith(F.ltrim("raw"), F.lit("[")), everybody).otherwise(by_user)
    rows = _last_entries(stores, entries).select("username", _texts(F.col("value")).alias("items"))
    return rows.filter(F.col("items").isNotNull())


def normalise_exclusions(stores: DataFrame) -> DataFrame:
    """``username, dimension, items`` from JSON text: two rows per user entry.

    A user whose entry is not an object is dropped; a dimension that is missing
    is an empty list. Of repeated names and dimensions the last one counts.
    """
    users = _last_entries(stores, F.from_json("raw", "map<string,string>"))
    users = users.filter(F.startswith(F.ltrim("value"), F.lit("{")))
    lists = F.map_entries(F.from_json("value", "map<string,string>"))
    rows = users.select("username", lists.alias("lists")).filter(F.col("lists").isNotNull())

    def named(dimension: str) -> Column:
        same = F.filter("lists", lambda entry: entry["key"] == dimension)
        items = _texts(F.get(same, F.size(same) - 1)["value"])
        return F.struct(
            F.lit(dimension).alias("dimension"), F.coalesce(items, F.array().cast("array<string>")).alias("items")
        )

    entry = F.explode(F.array(*map(named, EXCLUSION_DIMENSIONS))).alias("entry")
    return rows.select("username", entry).select("username", "entry.*")


def read_prefs(spark: SparkSession, path: str) -> DataFrame:
    """The stored table that ``save_prefs`` keeps."""
    return spark.read.schema("username string, dimension string, items array<string>, saved_at long").parquet(path)


def load_order(orders: DataFrame, user: str | None = None) -> DataFrame:
    """``items`` of the user, else of everybody; at most one row.

    A saved empty list is a saved list: it wins over the default.
    """
    wanted = [user, DEFAULT_USER] if user else [DEFAULT_USER]
    own = (F.col("dimension") == ORDER) if "dimension" in orders.columns else F.lit(True)
    return (
        orders.filter(F.col("username").isin(wanted) & own)
        .agg(F.max_by("items", F.col("username") == F.lit(user or DEFAULT_USER)).alias("items"))
        .filter(F.col("items").isNotNull())
    )


def load_exclusions(exclusions: DataFrame, user: str | None, dimension: str) -> DataFrame:
    """``entity`` rows excluded by the user; there is no default for a named user."""
    mine = (F.col("username") == F.lit(user or DEFAULT_USER)) & (F.col("dimension") == dimension)
    return exclusions.filter(mine).select(F.explode("items").alias("entity"))


def upsert_prefs(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after the changes: the latest list per user and dimension.

    Changes replace a list as a whole and leave all others alone. A blank user
    means everybody. Of changes saved at one time the greatest list counts.
    """
    columns = ["username", "dimension", "items", "saved_at"]
    name = F.when(F.coalesce("username", F.lit("")) == "", F.lit(DEFAULT_USER)).otherwise(F.col("username"))
    both = store.select(*columns, F.lit(0).alias("newer")).union(
        changes.select(*columns, F.lit(1).alias("newer"))
    )
    latest = F.max_by(F.struct("items", "saved_at"), F.struct("newer", "saved_at", "items")).alias("kept")
    return (
        both.withColumn("username", name)
        .groupBy("username", "dimension")
        .agg(latest)
        .select("username", "dimension", "kept.items", "kept.saved_at")
    )


def normalise_items(items: object) -> list[str]:
    """A list as it is saved: each item as stripped text, blank ones left out."""
    if not isinstance(items, list):
        raise ValueError("a saved order or exclusion is a list")
    return [text for text in (str(item).strip() for item in items) if text]


def save_prefs(spark: SparkSession, path: str, user: str | None, dimension: str, items: object, saved_at: int) -> list[str]:
    """Save one list of one user in the stored table at ``path``; returns it as saved.

    Anything but a list is refused and leaves the table as it is, and so is a dimension
    other than ``order`` and those of exclusions.
    """
    if dimension not in (ORDER, *EXCLUSION_DIMENSIONS):
        raise ValueError(f"unknown dimension {dimension!r}")
    kept = normalise_items(items)
    settle_table(spark, path)
    store = read_prefs(spark, path)
    change = spark.createDataFrame([(user, dimension, kept, saved_at)], "username string, dimension string, items array<string>, saved_at long")
    overwrite_table(upsert_prefs(store, change), path)
    return kept
