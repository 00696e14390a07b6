"""Registered queries: market listings and sheet rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.functions.text import parse_price, rgb_hex
from yardstats.operators import listings, sheets
from yardstats.plans.registry import query
from yardstats.plans.reports import listing_report
from yardstats.plans.sample import Sample
from yardstats.plans.views import over
from yardstats.sources.pages import Selectors, complete_listings, extract_listings

_GLUED = "CASE WHEN listing_id % 5 = 0 THEN price_text || 'each' ELSE price_text END"
_TITLE = "CASE WHEN listing_id % 3 = 0 THEN 'New' || title ELSE title END"
_LINK = "'/i?a=1&n=' || CAST(listing_id AS VARCHAR)"


@query(
    "page_listings",
    over("v_listing", f"""
SELECT * EXCLUDE (price_missing) FROM (
 SELECT listing_id // 10 AS page_id, CAST(row_number() OVER (PARTITION BY listing_id // 10 ORDER BY listing_id, title, price_text NULLS FIRST) AS INTEGER) AS position,
  {_TITLE} AS title, {_GLUED} AS price_text, {_LINK} AS link, price_text IS NULL AS price_missing FROM v_listing) WHERE NOT price_missing"""),
)
def page_listings(s: Sample) -> DataFrame:
    return complete_listings(extract_listings(s.market_pages()))


@query(
    "page_links",
    r"""
SELECT page_id, CAST(u.position AS INTEGER) AS position, u.pair[2] AS title, u.pair[1] AS link FROM (
 SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'),
  lambda x, i: {'position': i, 'pair': [regexp_extract(x, 'href="([^"]*)"', 1), regexp_extract(x, '">([^<]*)<', 1)]})) AS u
 FROM pages)""",
)
def page_links(s: Sample) -> DataFrame:
    links = extract_listings(s.raw("pages"), Selectors(item="li", title="a", price=None, link="a"))
    return complete_listings(links).select("page_id", "position", "title", "link")


@query("price_parse", over("v_listing", """
SELECT listing_id, TRY_CAST(split_part(replace(price_text, '£', ''), ' ', 1) AS DOUBLE) AS price FROM v_listing"""))
def price_parse(s: Sample) -> DataFrame:
    return s.listing().select("listing_id", parse_price(F.col("price_text")).alias("price"))


@query("listing_price_bands", over("v_banded", "SELECT listing_id, title, price, band FROM v_banded"))
def listing_price_bands(s: Sample) -> DataFrame:
    banded = listings.price_bands(listings.priced(s.listing()))
    return banded.select("listing_id", "title", "price", "band")


@query(
    "listing_sorted",
    over("v_banded", "SELECT band, price, listing_id, title FROM v_banded ORDER BY band, price DESC, listing_id, title"),
    ordered=True,
)
def listing_sorted(s: Sample) -> DataFrame:
    return listings.band_report(s.listing(), ["listing_id", "title"]).select("band", "price", "listing_id", "title")


@query(
    "listing_report",
    over("v_listing", f"""
SELECT band, price, page_id, title, link FROM (
 SELECT listing_id // 10 AS page_id, listing_id, title AS plain, price_text, {_TITLE} AS title, {_LINK} AS link,
  TRY_CAST(split_part(replace({_GLUED}, '£', ''), ' ', 1) AS DOUBLE) AS price FROM v_listing) p
JOIN (VALUES ('small', -1e300, 50.0), ('medium', 50.0, 500.0), ('large', 499.999, 1e300)) AS b(band, low, high) ON price > low AND price <= high
ORDER BY band, price DESC, page_id, p.listing_id, plain, price_text"""),
    ordered=True,
)
def report_of_pages(s: Sample) -> DataFrame:
    return listing_report(s.market_pages()).select("band", "price", "page_id", "title", "link")


# A sheet of 20 columns; two share a name and one row in seven is short.
HEADER = [f"c{i}" for i in range(20)]
HEADER[9] = "c3"
HEADER[16] = "c3"
_SHEET_CELLS = [
    "CAST(l_orderkey AS STRING)", "CAST(l_partkey AS STRING)", "CAST(l_suppkey AS STRING)", "l_returnflag",
    "l_linestatus", "NULL", "CAST(l_linenumber AS STRING)", "'x'", "'y'", "concat('n', l_linestatus)",
    "'Mixed Case'", "'a'", "'b'", "'c'", "'d'", "'e'", "concat('last', l_returnflag)",
    "concat('EC', CAST(l_suppkey AS STRING))", "'hidden'", "concat('z', l_returnflag)",
]


def sheet_grid(s: Sample) -> DataFrame:
    cells = F.expr(f"array({', '.join(_SHEET_CELLS)})")
    fill = F.when(
        F.col("l_linenumber") != 5,
        F.struct(
            F.when(F.col("l_linenumber") != 6, F.col("l_discount")).alias("red"),
            (F.col("l_quantity") / 50).alias("green"),
            F.col("l_tax").alias("blue"),
        ),
    )
    return s.raw("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"),
        F.when(F.col("l_linenumber") == 7, F.slice(cells, 1, 12)).otherwise(cells).alias("cells"),
        F.array_repeat(fill, 20).alias("fills"),
    )


_MATCH = "l_linenumber <> 7 AND contains(lower(concat('EC', CAST(l_suppkey AS VARCHAR))), 'ec3')"


@query(
    "sheet_any_cell_match",
    f"SELECT l_orderkey * 10 + l_linenumber AS row_idx FROM lineitem WHERE {_MATCH}",
)
def sheet_any_cell_match(s: Sample) -> DataFrame:
    return sheet_grid(s).filter(sheets.any_cell_contains(F.col("cells"), "Ec3")).select("row_idx")


def _sheet_sql() -> str:
    shown: dict[str, str] = {}
    for place, (name, cell) in enumerate(zip(HEADER, _SHEET_CELLS)):
        if place not in sheets.HIDDEN_COLUMNS:
            shown[name] = cell
    parts = [
        f"SELECT l_orderkey * 10 + l_linenumber AS row_idx, '{name}' AS name, CAST({cell} AS VARCHAR) AS value, {_BG} AS bg FROM lineitem WHERE {_MATCH}"
        for name, cell in shown.items()
    ]
    return "\nUNION ALL ".join(parts)


def _channel(sql: str) -> str:
    return f"CAST(trunc({sql} * 255) AS INTEGER)"


_BG = f"""CASE WHEN l_linenumber = 5 THEN '#FFFFFF' ELSE printf('#%02X%02X%02X',
 CASE WHEN l_linenumber = 6 THEN 255 ELSE {_channel('l_discount')} END, {_channel('(l_quantity / 50)')}, {_channel('l_tax')}) END"""


@query("sheet_rows", _sheet_sql())
def sheet_rows(s: Sample) -> DataFrame:
    return sheets.long_cells(sheets.sheet_matches(sheet_grid(s), HEADER, "eC3"))


@query(
    "rgb_hex",
    f"SELECT l_orderkey, l_linenumber, {_BG.replace('l_linenumber = 5', 'false')} AS colour FROM lineitem",
)
def colours(s: Sample) -> DataFrame:
    colour = F.struct(
        F.when(F.col("l_linenumber") != 6, F.col("l_discount")).alias("red"),
        (F.col("l_quantity") / 50).alias("green"),
        F.col("l_tax").alias("blue"),
    )
    return s.raw("lineitem").select("l_orderkey", "l_linenumber", rgb_hex(colour).alias("colour"))
