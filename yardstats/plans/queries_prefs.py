"""Registered queries: preference stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.functions import modes
from yardstats.operators import prefs
from yardstats.plans.registry import query
from yardstats.plans.sample import Sample
from yardstats.session import work_path


def order_stores(s: Sample) -> DataFrame:
    """One JSON text per customer: an object, a bare list, or something broken."""
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    items = F.concat(F.lit('["'), segment, F.lit('", '), key, F.lit("]"))
    text = (
        F.when(F.col("c_custkey") % 5 == 0, items)
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("{"), items))
        .when(F.col("c_custkey") % 5 == 2, F.concat(F.lit('{"'), name, F.lit('": [], "x": "'), segment, F.lit('"}')))
        # A name that is repeated: its last list counts.
        .otherwise(F.concat(F.lit('{"'), name, F.lit('": ["old"], "'), name, F.lit('": '), items, F.lit(', "n": 5}')))
    )
    return s.raw("customer").select("c_custkey", text.alias("raw"))


@query(
    "prefs_normalise",
    """
SELECT CASE WHEN c_custkey % 5 = 0 THEN '__default__' ELSE c_name END AS username,
 CASE WHEN c_custkey % 5 = 2 THEN '' ELSE c_mktsegment || '|' || CAST(c_custkey AS VARCHAR) END AS items
FROM customer WHERE c_custkey % 5 <> 1""",
)
def prefs_normalise(s: Sample) -> DataFrame:
    return prefs.normalise_orders(order_stores(s)).select("username", F.array_join("items", "|").alias("items"))


@query(
    "exclusions_normalise",
    """
SELECT c_name AS username, d AS dimension, CASE WHEN d = 'user' THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS items
FROM customer, (VALUES ('department'), ('user')) AS t(d) WHERE c_custkey % 4 <> 1""",
)
def exclusions_normalise(s: Sample) -> DataFrame:
    entry = F.when(F.col("c_custkey") % 4 == 1, F.lit('["not an object"]')).otherwise(
        F.concat(F.lit('{"user": ['), F.col("c_custkey").cast("string"), F.lit("]}"))
    )
    raw = F.concat(F.lit('{"'), F.col("c_name"), F.lit('": '), entry, F.lit("}"))
    rows = prefs.normalise_exclusions(s.raw("customer").select(raw.alias("raw")))
    return rows.select("username", "dimension", F.array_join("items", "|").alias("items"))


@query(
    "prefs_load",
    """
SELECT 'own' AS asked, c_mktsegment || '|' || CAST(c_custkey AS VARCHAR) AS items FROM customer WHERE c_custkey = 8
UNION ALL
SELECT 'default', arg_max(c_mktsegment || '|' || CAST(c_custkey AS VARCHAR), c_custkey) FROM customer WHERE c_custkey % 5 = 0""",
)
def prefs_load(s: Sample) -> DataFrame:
    """A user's own order, and everybody's for one who saved none, out of the saved store."""
    entries = prefs.normalise_orders(order_stores(s)).withColumn("dimension", F.lit(prefs.ORDER))
    # The second item is the customer's number; it stands for the time of saving.
    entries = entries.withColumn("saved_at", F.get("items", 1).try_cast("long"))
    path = work_path(s.spark, "prefs")
    prefs.upsert_prefs(entries.limit(0), entries).write.parquet(path)
    orders = prefs.read_prefs(s.spark, path)

    def asked(name: str, user: str) -> DataFrame:
        return prefs.load_order(orders, user).select(F.lit(name).alias("asked"), F.array_join("items", "|").alias("items"))

    return asked("own", "Customer#000000008").union(asked("default", "nobody"))


@query(
    "prefs_upsert",
    """
WITH changes AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN '__default__' ELSE c_name END AS username,
  o_orderpriority || '|' || o_orderstatus AS items, o_orderkey AS saved_at
  FROM orders JOIN customer ON c_custkey = o_custkey),
latest AS (SELECT username, arg_max(items, saved_at) AS items FROM changes GROUP BY 1)
SELECT coalesce(l.username, c.c_name) AS username, 'department' AS dimension, coalesce(l.items, c.c_mktsegment) AS items
FROM customer c FULL JOIN latest l ON l.username = c.c_name""",
)
def prefs_upsert(s: Sample) -> DataFrame:
    store = s.raw("customer").select(
        F.col("c_name").alias("username"),
        F.lit("department").alias("dimension"),
        F.array("c_mktsegment").alias("items"),
        F.lit(10**12).alias("saved_at"),
    )
    changes = (
        s.raw("orders")
        .join(s.raw("customer"), F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(F.col("c_name")).alias("username"),
            F.lit("department").alias("dimension"),
            F.array("o_orderpriority", "o_orderstatus").alias("items"),
            F.col("o_orderkey").alias("saved_at"),
        )
    )
    kept = prefs.upsert_prefs(store, changes)
    return kept.select("username", "dimension", F.array_join("items", "|").alias("items"))


@query(
    "prefs_save",
    """
SELECT CASE WHEN r_regionkey % 3 = 0 THEN '__default__' ELSE 'u' || CAST(r_regionkey % 3 AS VARCHAR) END AS username,
 CASE r_regionkey % 2 WHEN 0 THEN 'order' ELSE 'department' END AS dimension,
 arg_max(trim(r_name) || '|' || CAST(r_regionkey AS VARCHAR), r_regionkey) AS items, CAST(max(r_regionkey) AS BIGINT) AS saved_at
FROM region GROUP BY 1, 2""",
)
def prefs_save(s: Sample) -> DataFrame:
    """Lists of several users, and of everybody, saved one after another and read back."""
    path = work_path(s.spark, "prefs")
    s.spark.createDataFrame([], "username string, dimension string, items array<string>, saved_at long").write.parquet(path)
    for row in s.raw("region").orderBy("r_regionkey").collect():
        user = f"u{row.r_regionkey % 3}" if row.r_regionkey % 3 else None
        dimension = "department" if row.r_regionkey % 2 else "order"
        prefs.save_prefs(s.spark, path, user, dimension, [f" {row.r_name} ", " ", row.r_regionkey], row.r_regionkey)
    return prefs.read_prefs(s.spark, path).withColumn("items", F.array_join("items", "|"))


@query(
    "mode_labels",
    """
SELECT DISTINCT m.mode, d.dimension, m.mode_label, m.value_format, m.value_label, m.value_vat_label, d.entity_label, d.entity_label_plural
FROM (SELECT DISTINCT n_nationkey % 4 AS k FROM nation) n
JOIN (VALUES (0, 'sales', 'Sales', 'currency', 'Sales Total', 'Total with VAT'), (1, 'PARTS', 'Parts Sold', 'count', 'Parts Sold', 'Parts Sold (Prev Period)'),
 (2, 'other', 'Sales', 'currency', 'Sales Total', 'Total with VAT'), (3, 'Parts', 'Parts Sold', 'count', 'Parts Sold', 'Parts Sold (Prev Period)'))
 m(k, mode, mode_label, value_format, value_label, value_vat_label) ON m.k = n.k
CROSS JOIN (VALUES ('department', 'Department', 'Departments'), ('USER', 'User', 'Users'), ('other', 'Department', 'Departments')) d(dimension, entity_label, entity_label_plural)""",
)
def mode_labels(s: Sample) -> DataFrame:
    """What a report of each mode and dimension calls its values, for the modes that the rows ask for."""
    names = F.array(*[F.lit(m) for m in ("sales", "PARTS", "other", "Parts")])
    asked = s.raw("nation").select(F.get(names, (F.col("n_nationkey") % 4).cast("int")).alias("mode")).distinct()
    known = [
        (mode, dimension, *modes.report_labels(mode, dimension).values())
        for mode in ("sales", "PARTS", "other", "Parts") for dimension in ("department", "USER", "other")
    ]
    columns = ["mode", "dimension", *modes.report_labels("sales", "user")]
    return asked.join(s.spark.createDataFrame(known, columns), "mode")
