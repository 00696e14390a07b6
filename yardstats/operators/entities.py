"""Sales and parts sold per department or user: the facts under every report.

Two rules shape all plans here.

* For plain totals rows are collapsed on the join key before the join. A key that owns
  a large share of the rows (one invoice, one user, the null invoice) is reduced to a
  handful of rows by the map-side aggregation, before anything is shuffled. By item or
  day that reduces nothing, so there the rows are joined as they are: null invoices are
  dealt out, and adaptive joins split a hot one.
* Groups are formed on the raw name; the label for a missing name is put on
  afterwards. A null department and one literally called "Unknown" are two
  groups with one label, unless ``merge_labels`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstats.functions.modes import dimension_of
from yardstats.functions.periods import Period, dated
from yardstats.functions.text import item_label, label, label_is
from yardstats.operators.spread import left_join_sparse_key
from yardstats.sources.buckets import KEY, SLOT, once


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def sales_by_entity(
    invoice: DataFrame,
    dimension: str,
    measures: dict[str, Column],
    users: DataFrame | None = None,
    by: dict[str, Column] | None = None,
) -> DataFrame:
    """Summed ``measures`` of invoices per ``entity`` (raw name) and ``by``.

    Invoices of an unknown user are not anyone's sales and drop out of the user
    dimension.
    """
    by = by or {}
    invoice = once(invoice)
    keys = [c.alias(n) for n, c in by.items()]
    aggs = [F.sum(c).alias(n) for n, c in measures.items()]
    if dimension_of(dimension) == "department":
        return invoice.groupBy(F.col("departmentname").alias("entity"), *keys).agg(*aggs)
    per_user = invoice.groupBy(F.col("whocreated_id").alias("user_id"), *keys).agg(*aggs)
    named = per_user.join(users.select("user_id", "shortname"), "user_id")
    return named.groupBy(F.col("shortname").alias("entity"), *by).agg(*_sums(list(measures)))


def parts_by_entity(
    sold: DataFrame,
    invoice: DataFrame,
    dimension: str,
    measures: dict[str, Column],
    users: DataFrame | None = None,
    by: dict[str, Column] | None = None,
    entity: str | None = None,
    labelled: bool = False,
) -> DataFrame:
    """Counted ``measures`` of sold rows per ``entity`` (raw name) and ``by``.

    Sold rows without an invoice, and invoices without a known user, stay under
    a null entity. ``entity`` keeps the rows of one label; ``labelled`` groups on
    the label instead of the raw name. Facts stored in buckets are joined where they lie.
    """
    by = by or {}
    names = list(measures)

    def finish(named: DataFrame, name: str) -> DataFrame:
        kept = named if entity is None else named.filter(label_is(F.col(name), entity))
        shown = label(F.col(name)) if labelled else F.col(name)
        return kept.groupBy(shown.alias("entity"), *by).agg(*_sums(names))

    to_user = dimension_of(dimension) == "user"
    owner = F.col("whocreated_id").alias("user_id") if to_user else F.col("departmentname")
    # Stored in buckets, null and hot invoices have been dealt out already.
    bucketed = SLOT in sold.columns and SLOT in invoice.columns
    on = [KEY, SLOT] if bucketed else [KEY]
    owners = (invoice if bucketed else once(invoice)).select(*on, owner)
    if by:
        # A sold row is nearly alone with its invoice and item or day: grouping on them
        # would be a shuffle that reduces nothing. The rows are shuffled once, for the join.
        counted = [c.isNotNull().cast("long").alias(n) for n, c in measures.items()]
        keys = [c.alias(n) for n, c in by.items()]
        if bucketed:
            owned = sold.select(*on, *keys, *counted).join(owners, on, "left")
        else:
            spread = F.xxhash64("invnumber", "itemtype_id", "solddate").alias("_spread")
            rows = sold.select(KEY, *keys, *counted, spread)
            owned = left_join_sparse_key(rows, owners, KEY, spread_by=["_spread"]).drop("_spread")
    else:
        aggs = [F.count(c).alias(n) for n, c in measures.items()]
        # One row per invoice is left, already partitioned on the join key.
        owned = sold.groupBy(*on).agg(*aggs).join(owners, on, "left")
    if not to_user:
        return finish(owned, "departmentname")
    per_user = owned.groupBy("user_id", *by).agg(*_sums(names))
    known = users.select("user_id", "shortname")
    if by:
        named = left_join_sparse_key(per_user, known, "user_id", spread_by=list(by))
    else:
        named = per_user.join(known, "user_id", "left")
    return finish(named, "shortname")


def sold_in(sold: DataFrame, *periods: Period) -> DataFrame:
    """Rows flagged as sold (a null flag is not sold) in any of the periods."""
    return dated(sold.filter("issold"), "solddate", *periods)


def invoiced_in(invoice: DataFrame, period: Period) -> DataFrame:
    return dated(invoice, "datecreated", period)


def net() -> Column:
    return F.col("total")


def gross() -> Column:
    """A row without tax has no gross value, though it keeps its net value."""
    return F.col("total") + F.col("totaltax1")


def entity_sales(
    invoice: DataFrame,
    period: Period,
    dimension: str = "department",
    users: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """``entity, sum_total, sum_total_vat`` of a period, by name, missing name last.

    ``exact`` keeps the sums as decimals.
    """
    totals = sales_by_entity(
        invoiced_in(invoice, period), dimension, {"sum_total": net(), "sum_total_vat": gross()}, users
    )
    sums = [F.col(c) if exact else F.col(c).cast("double") for c in ("sum_total", "sum_total_vat")]
    return totals.select("entity", *sums).orderBy(F.asc_nulls_last("entity"))


def entity_parts(
    sold: DataFrame,
    invoice: DataFrame,
    period: Period,
    dimension: str = "department",
    users: DataFrame | None = None,
    merge_labels: bool = False,
) -> DataFrame:
    """``entity, parts_sold`` of a period. A group whose rows all lack a number counts 0."""
    totals = parts_by_entity(
        sold_in(sold, period),
        invoice,
        dimension,
        {"parts_sold": F.col("invnumber")},
        users,
        labelled=merge_labels,
    )
    if merge_labels:
        return totals.orderBy("entity")
    # Departments sort by the shown label, users by the stored name.
    shown = label(F.col("raw"))
    first = [F.asc_nulls_last("raw")] if dimension_of(dimension) == "user" else [shown, F.asc_nulls_last("raw")]
    return (
        totals.withColumnRenamed("entity", "raw")
        .orderBy(*first)
        .select(shown.alias("entity"), "parts_sold")
    )


def parts_breakdown(
    sold: DataFrame,
    invoice: DataFrame,
    itemtype: DataFrame,
    period: Period,
    dimension: str = "department",
    entity: str | None = None,
    users: DataFrame | None = None,
    merge_labels: bool = False,
) -> DataFrame:
    """Parts sold per item, for one entity or (``entity=None``) for all of them.

    Result: ``entity, itemname, parts_sold``, most sold first. Items group on
    the stored name, so two spellings that show alike stay two rows unless
    ``merge_labels``.
    """
    per_item = parts_by_entity(
        sold_in(sold, period),
        invoice,
        dimension,
        {"parts_sold": F.col("invnumber")},
        users,
        by={"itemtype_id": F.col("itemtype_id")},
        entity=entity,
        labelled=True,
    )
    named = left_join_sparse_key(
        per_item, itemtype.select("itemtype_id", "itemname"), "itemtype_id", spread_by=["entity"]
    )
    raw = named.groupBy("entity", F.col("itemname").alias("raw")).agg(F.sum("parts_sold").alias("parts_sold"))
    items = raw.select("entity", item_label(F.col("raw")).alias("itemname"), "parts_sold", "raw")
    if merge_labels:
        return (
            items.groupBy("entity", "itemname")
            .agg(F.sum("parts_sold").alias("parts_sold"))
            .orderBy(F.desc("parts_sold"), "itemname", "entity")
        )
    return items.orderBy(
        F.desc("parts_sold"), "itemname", "entity", F.asc_nulls_last("raw")
    ).drop("raw")


def breakdown_total(breakdown: DataFrame) -> DataFrame:
    return breakdown.groupBy("entity").agg(F.sum("parts_sold").alias("total"))
