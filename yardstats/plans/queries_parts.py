"""Registered queries: catalogue, opportunity search, autocomplete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.operators import opportunity
from yardstats.plans.registry import query
from yardstats.plans.sample import Sample
from yardstats.plans.views import over
from yardstats.schemas import CATALOGUE_NAMES, SEARCH_COLUMNS
from yardstats.session import work_path
from yardstats.sinks.export import export_search, read_csv, write_csv
from yardstats.sources.tables import read_catalogue

_COLUMNS = ", ".join(SEARCH_COLUMNS)
_BEST = "backorders DESC NULLS LAST, opportunity_score DESC NULLS LAST, row_id"


@query(
    "catalogue_scan",
    over("v_parts", f"SELECT {', '.join(CATALOGUE_NAMES.values())} FROM v_parts"),
)
def catalogue_scan(s: Sample) -> DataFrame:
    """Of a file with more columns, in another order."""
    path = work_path(s.spark, "catalogue")
    columns = [F.col(c).alias(n) for n, c in CATALOGUE_NAMES.items()]
    stored = s.catalogue().select(F.lit("extra").alias("Shelf"), *reversed(columns), F.lit(7).alias("Rank"))
    write_csv(stored, path)
    return read_catalogue(s.spark, path).drop("row_id")


@query("filter_model", over("v_parts", "SELECT row_id, model FROM v_parts WHERE lower(model) = 'brand#7'"))
def filter_model(s: Sample) -> DataFrame:
    return s.catalogue().filter(opportunity.model_is("bRAND#7")).select("row_id", "model")


@query(
    "filter_year",
    over("v_parts", "SELECT row_id, ic_start_year, ic_end_year FROM v_parts WHERE 1998 BETWEEN ic_start_year AND ic_end_year"),
)
def filter_year(s: Sample) -> DataFrame:
    return s.catalogue().filter(opportunity.covers_year(1998)).select("row_id", "ic_start_year", "ic_end_year")


@query(
    "filter_engine_code",
    over("v_parts", """
SELECT row_id, ic_description FROM v_parts
WHERE ic_description IS NULL OR NOT contains(lower(ic_description), 'engine code') OR contains(lower(ic_description), 'small')"""),
)
def filter_engine_code(s: Sample) -> DataFrame:
    return s.catalogue().filter(opportunity.fits_engine_code(F.lit("SMALL"))).select("row_id", "ic_description")


_RENAMED = """replace(replace(CASE WHEN row_id % 4 = 0 THEN replace(part, ' ', '_') WHEN row_id % 4 = 1 THEN NULL ELSE part END,
 'RING', 'Engine'), 'BOLT', 'a/c_compressor')"""


@query(
    "filter_exclude_keywords",
    over("v_parts", rf"""
SELECT row_id, part FROM (SELECT row_id, {_RENAMED} AS part FROM v_parts)
WHERE part IS NULL OR NOT regexp_matches(part, '(?i)\b({"|".join(opportunity.EXCLUDED_PARTS)})\b')"""),
)
def filter_exclude_keywords(s: Sample) -> DataFrame:
    return _renamed(s).filter(opportunity.has_no_keyword()).select("row_id", "part")


def _renamed(s: Sample) -> DataFrame:
    """The catalogue with keywords in some names, and some names missing."""
    key = F.col("row_id")
    part = F.when(key % 4 == 0, F.replace("part", F.lit(" "), F.lit("_"))).when(key % 4 != 1, F.col("part"))
    part = F.replace(F.replace(part, F.lit("RING"), F.lit("Engine")), F.lit("BOLT"), F.lit("a/c_compressor"))
    return s.catalogue().withColumn("part", part)


@query(
    "opportunity_scores",
    over("v_scored", "SELECT row_id, potential_profit, sales_speed, opportunity_score FROM v_scored"),
)
def opportunity_scores(s: Sample) -> DataFrame:
    return opportunity.with_scores(s.catalogue()).select(
        "row_id", "potential_profit", "sales_speed", "opportunity_score"
    )


@query(
    "filter_thresholds",
    over("v_scored", "SELECT row_id, b_price, opportunity_score FROM v_scored WHERE b_price >= 905.5 AND opportunity_score >= 10000"),
)
def filter_thresholds(s: Sample) -> DataFrame:
    scored = opportunity.with_scores(s.catalogue())
    kept = reduce(DataFrame.filter, opportunity.above_minimums("905.50", "10000"), scored)
    return kept.select("row_id", "b_price", "opportunity_score")


def _search_sql(columns: str) -> str:
    return over("v_scored", f"""
SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {_BEST}) AS position FROM v_scored
 WHERE lower(model) = 'brand#7' AND 1998 BETWEEN ic_start_year AND ic_end_year
 AND (ic_description IS NULL OR NOT contains(lower(ic_description), 'engine code') OR contains(lower(ic_description), 'small')))
WHERE position <= 50 ORDER BY position""")


@query("opportunity_search", _search_sql(f"position, {_COLUMNS}"), ordered=True)
def opportunity_search(s: Sample) -> DataFrame:
    found = opportunity.search_parts(s.catalogue(), "brand#7", 1998, " small ")
    return found.withColumn("position", F.col("position").cast("long"))


_SHEET_TEST = "l_linenumber <> 7 AND contains(lower(concat('EC', CAST(l_suppkey AS VARCHAR))), 'ec3')"


@query(
    "part_search",
    over("v_scored", f"""
SELECT 'part' AS result, position AS place, part AS text, opportunity_score AS score FROM (
 SELECT *, row_number() OVER (ORDER BY {_BEST}) AS position FROM v_scored
 WHERE lower(model) = 'brand#7' AND 1998 BETWEEN ic_start_year AND ic_end_year AND b_price >= 910
 AND (ic_description IS NULL OR NOT contains(lower(ic_description), 'engine code') OR contains(lower(ic_description), 'ec3')))
WHERE position <= 50
UNION ALL SELECT 'sheet', l_orderkey * 10 + l_linenumber, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM lineitem WHERE {_SHEET_TEST}"""),
)
def part_search(s: Sample) -> DataFrame:
    """The whole search: the parts, and the sheet rows that hold the engine code."""
    from yardstats.plans.queries_listings import HEADER, sheet_grid
    from yardstats.plans.reports import part_search as search

    found = search(s.catalogue(), "brand#7", 1998, " EC3 ", min_price="910", grid=sheet_grid(s), header=HEADER)
    parts = found.parts.select(F.lit("part").alias("result"), F.col("position").cast("long").alias("place"), F.col("part").alias("text"), F.col("opportunity_score").alias("score"))
    rows = found.sheet_rows.select(F.lit("sheet"), F.col("row_idx").cast("long"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    return parts.union(rows)


_SHOWN = {ours: theirs for theirs, ours in CATALOGUE_NAMES.items()} | {
    "potential_profit": "Potential_Profit", "sales_speed": "Sales_Speed", "opportunity_score": "Opportunity_Score",
}


_TEXT = {"part", "ic_description"}
_EXPORTED = ", ".join(
    f"""'  a "' || {c} || '", b ' AS "{_SHOWN[c]}\"""" if c in _TEXT else f'CAST({c} AS DOUBLE) AS "{_SHOWN[c]}"'
    for c in SEARCH_COLUMNS
)


@query("opportunity_export", _search_sql(_EXPORTED))
def opportunity_export(s: Sample) -> DataFrame:
    """Written and read back, with blanks, quotes and commas in the texts."""
    path = work_path(s.spark, "search-export")
    found = opportunity_search(s)
    noisy = {c: F.concat(F.lit('  a "'), F.col(c), F.lit('", b ')) for c in _TEXT}
    export_search(found.withColumns(noisy), path)
    back = read_csv(s.spark, path)
    return back.withColumns({_SHOWN[c]: F.col(f"`{_SHOWN[c]}`").cast("double") for c in SEARCH_COLUMNS if c not in _TEXT})


@query(
    "opportunity_display",
    over("v_scored", """
SELECT part AS "Part", ic_start_year AS "IC Start Year", ic_end_year AS "IC End Year", ic_description AS "IC Description",
 CAST(round(CAST(CAST(b_price AS VARCHAR) AS DECIMAL(38, 16)), 2) AS DOUBLE) AS "B Price", parts_in_stock AS "Parts in Stock", backorders AS "Backorders", parts_sold_all AS "Parts Sold All",
 not_found_180 AS "Not Found 180 days", CAST(round(CAST(CAST(potential_profit AS VARCHAR) AS DECIMAL(38, 16)), 2) AS DOUBLE) AS "Potential_Profit",
 CAST(round(CAST(CAST(sales_speed AS VARCHAR) AS DECIMAL(38, 16)), 2) AS DOUBLE) AS "Sales_Speed",
 CAST(round(CAST(CAST(opportunity_score AS VARCHAR) AS DECIMAL(38, 16)), 2) AS DOUBLE) AS "Opportunity_Score", backorders > 0 AS "Highlight" FROM v_scored"""),
)
def opportunity_display(s: Sample) -> DataFrame:
    return opportunity.display_rows(opportunity.with_scores(s.catalogue()))


@query(
    "opportunity_batch",
    over("v_scored v_requests", rf"""
SELECT request_id, position, {_COLUMNS} FROM (
 SELECT r.request_id, p.*, row_number() OVER (PARTITION BY r.request_id ORDER BY {_BEST}) AS position
 FROM v_requests r JOIN (SELECT * REPLACE ({_RENAMED} AS part) FROM v_scored) p
  ON lower(p.model) = lower(r.model) AND r.year BETWEEN p.ic_start_year AND p.ic_end_year
 WHERE (coalesce(r.engine_code, '') = '' OR p.ic_description IS NULL OR NOT contains(lower(p.ic_description), 'engine code')
        OR contains(lower(p.ic_description), r.engine_code))
 AND (r.min_price IS NULL OR p.b_price >= r.min_price)
 AND (r.min_opportunity IS NULL OR p.opportunity_score >= r.min_opportunity)
 AND (r.request_id % 6 <> 0 OR p.part IS NULL OR NOT regexp_matches(p.part, '(?i)\b({"|".join(opportunity.EXCLUDED_PARTS)})\b')))
WHERE position <= 50"""),
)
def opportunity_batch(s: Sample) -> DataFrame:
    key = F.col("c_custkey")
    code = F.when(key % 4 == 0, "  ").when(key % 4 == 1, " Small").when(key % 4 == 2, "ECONOMY")
    requests = s.raw("customer").select(
        key.alias("request_id"),
        F.concat(F.lit("BRAND#"), (key % 25 + 1).cast("string")).alias("model"),
        (1990 + key % 20).cast("int").alias("year"),
        code.alias("engine_code"),
        F.when(key % 5 == 0, (900 + key % 100).cast("double")).alias("min_price"),
        F.when(key % 7 == 0, F.lit(5000.0)).alias("min_opportunity"),
        (key % 6 == 0).alias("exclude"),
    )
    found = opportunity.search_parts_batch(_renamed(s), requests)
    return found.withColumn("position", F.col("position").cast("long"))


@query(
    "model_autocomplete",
    over("v_parts", """
SELECT model, min(row_id) AS first_row FROM v_parts WHERE contains(lower(model), 'nd#1') GROUP BY model ORDER BY first_row"""),
    ordered=True,
)
def model_autocomplete(s: Sample) -> DataFrame:
    return opportunity.autocomplete(s.catalogue(), "ND#1")


@query(
    "column_contains_filter",
    over("v_parts", """
SELECT row_id, part, ic_description, ic_start_year FROM v_parts
WHERE contains(lower(part), 'ri') AND contains(lower(part), 'small') AND contains(lower(coalesce(ic_description, '')), 'code s')
 AND contains(CAST(ic_start_year AS VARCHAR), '199')"""),
)
def column_contains_filter(s: Sample) -> DataFrame:
    searches = {"part": "RI small", "ic_description": '"code s"', "ic_start_year": "199", "model": ""}
    kept = opportunity.contains_filters(s.catalogue(), searches)
    return kept.select("row_id", "part", "ic_description", "ic_start_year")


@query(
    "result_page",
    over("v_scored", f"""
SELECT position, part, opportunity_score FROM (SELECT *, row_number() OVER (ORDER BY {_BEST}) AS position FROM v_scored)
WHERE position BETWEEN 26 AND 50 ORDER BY position"""),
    ordered=True,
)
def result_page(s: Sample) -> DataFrame:
    rows = opportunity.with_scores(s.catalogue())
    return opportunity.result_page(rows, opportunity.best_first(), page=1).select("position", "part", "opportunity_score")


@query(
    "result_search_sorted",
    over("v_parts", """
SELECT position, row_id, part, b_price FROM (SELECT *, row_number() OVER (ORDER BY b_price DESC NULLS LAST, row_id) AS position FROM v_parts
 WHERE (contains(lower(model), '3') OR contains(lower(part), '3') OR contains(lower(coalesce(ic_description, '')), '3') OR contains(CAST(ic_start_year AS VARCHAR), '3'))
 AND (contains(lower(model), 'small') OR contains(lower(part), 'small') OR contains(lower(coalesce(ic_description, '')), 'small') OR contains(CAST(ic_start_year AS VARCHAR), 'small')))
WHERE position <= 25 ORDER BY position"""),
    ordered=True,
)
def result_search_sorted(s: Sample) -> DataFrame:
    found = opportunity.search_box(s.catalogue(), "3 Small", ["model", "part", "ic_description", "ic_start_year"])
    page = opportunity.result_page(found, opportunity.sorted_by("b_price", descending=True), page=0)
    return page.select("position", "row_id", "part", "b_price")
