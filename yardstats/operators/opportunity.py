"""Part opportunity search: which parts of a model are worth buying in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.functions.text import contains_ignore_case, equals_ignore_case, strip
from yardstats.operators.spread import skew_join
from yardstats.schemas import CATALOGUE_NAMES, SCORE_NAMES, SEARCH_COLUMNS
from yardstats.session import write_through

# Part names left out of an excluding search.
EXCLUDED_PARTS = [
    "ENGINE", "TRANS/GEARBOX", "TURBOCHARGER", "SUPERCHARGER", "THROTTLE_BODY",
    "ALTERNATOR", "STARTER", "A/C_COMPRESSOR", "Cylinder_head",
    "FUEL_INJECTOR", "Injector_rail", "COIL/COIL_PACK",
    "Injector_pump", "OIL_PAN/SUMP", "EGR_VALVE/COOLER",
]

ENGINE_CODE_MARK = "engine code"


def model_is(model: str) -> Column:
    return equals_ignore_case(F.col("model"), model)


def covers_year(year: int | Column) -> Column:
    wanted = F.lit(year) if isinstance(year, int) else year
    return wanted.between(F.col("ic_start_year"), F.col("ic_end_year"))


def fits_engine_code(code: Column) -> Column:
    """Only a description that speaks of an engine code has to contain the code."""
    description = F.coalesce(F.col("ic_description"), F.lit(""))
    return ~contains_ignore_case(description, ENGINE_CODE_MARK) | contains_ignore_case(description, code)


def has_no_keyword(keywords: list[str] = EXCLUDED_PARTS) -> Column:
    """Part name free of the keywords as whole words; ``_`` is a word character.

    A keyword is literal text. No keywords exclude nothing.
    """
    if not keywords:
        return F.lit(True)
    quoted = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keywords)
    return ~F.coalesce(F.col("part").rlike(rf"(?i)\b(?:{quoted})\b"), F.lit(False))


def _null_if_nan(value: Column) -> Column:
    # A NaN would pass every minimum and sort first; a missing value does neither.
    return F.when(~F.isnan(value), value)


def with_scores(parts: DataFrame) -> DataFrame:
    """Potential profit, sales speed and their product.

    With one part "missing" from stock (-1) the speed is infinite with the sign
    of the sales, and missing when there were no sales either.
    """
    sold = F.col("parts_sold_all").cast("double")
    slots = (F.col("parts_in_stock") + 1).cast("double")
    speed = (
        F.when(slots != 0, F.try_divide(sold, slots))
        .when(sold > 0, F.lit(float("inf")))
        .when(sold < 0, F.lit(float("-inf")))
    )
    wanted = F.col("backorders") + F.col("not_found_180")
    return (
        parts.withColumn("potential_profit", _null_if_nan(wanted * F.col("b_price")))
        .withColumn("sales_speed", speed)
        .withColumn("opportunity_score", _null_if_nan(F.col("potential_profit") * F.col("sales_speed")))
    )


def above_minimums(min_price: str | float | None, min_opportunity: str | float | None) -> list[Column]:
    """Thresholds that were given: text counts when not empty, so "0" does."""
    given = []
    if min_price not in (None, ""):
        given.append(F.col("b_price") >= float(min_price))
    if min_opportunity not in (None, ""):
        given.append(F.col("opportunity_score") >= float(min_opportunity))
    return given



def best_first() -> list[Column]:
    """Most backorders, then best score, missing last, ties in catalogue order."""
    return [F.desc_nulls_last("backorders"), F.desc_nulls_last("opportunity_score"), F.asc("row_id")]


def search_parts(
    catalogue: DataFrame,
    model: str,
    year: int,
    engine_code: str = "",
    min_price: str | float | None = None,
    min_opportunity: str | float | None = None,
    exclude: list[str] | None = None,
    limit: int = 50,
) -> DataFrame:
    """Best parts for one model and year: ``position`` and the 12 search columns."""
    parts = catalogue.filter(model_is(model) & covers_year(year))
    if engine_code.strip():
        parts = parts.filter(fits_engine_code(F.lit(engine_code.strip())))
    if exclude is not None:
        parts = parts.filter(has_no_keyword(exclude))
    scored = with_scores(parts)
    scored = reduce(DataFrame.filter, above_minimums(min_price, min_opportunity), scored)
    # Top-k first; numbering then sees at most ``limit`` rows.
    top = scored.orderBy(*best_first()).limit(limit)
    place = F.row_number().over(W.orderBy(*best_first()))
    return top.select(place.alias("position"), *SEARCH_COLUMNS).orderBy("position")


_LEVELS = 32  # of spans of years: 1, 2, 4 ... of them
_HANDS = 16  # parts that a popular key's candidates are cut in, before they meet in one task
_SEARCH = ["model_key", "year", "code_key", "min_price", "min_opportunity", "exclude"]


def _span(level: int, index: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), index.alias("index"))


def _spans_of_year(year: Column) -> Column:
    """The span of each size that the year lies in."""
    return F.array(*[_span(level, F.shiftright(year.cast("long"), level)) for level in range(_LEVELS)])


def _spans_of_range(first: Column, last: Column) -> Column:
    """The fewest spans that make up a range of years: two of a size at most, none for a reversed range.

    A span of 2^k years begins at a multiple of it. Of each size the range takes the span at its left or
    right end that has no partner inside the range to make up the next size with.
    """
    first, behind = first.cast("long"), last.cast("long") + 1
    found = []
    for level in range(_LEVELS):
        low, high = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(behind, level)
        found.append(F.when((low < high) & (low.bitwiseAND(F.lit(1)) == 1), _span(level, low)))
        found.append(F.when((low < high) & (high.bitwiseAND(F.lit(1)) == 1), _span(level, high - 1)))
    return F.array_compact(F.array(*found))


def _request_spans(rows: DataFrame) -> DataFrame:
    return rows.withColumn("span", F.explode(_spans_of_year(F.col("year"))))


def _part_spans(catalogue: DataFrame) -> DataFrame:
    """Scored parts, once per span of years that their range is made of.

    The spans of a range do not overlap, so a part meets a year in one span, whatever the width of the range.
    """
    first, last = F.col("ic_start_year"), F.col("ic_end_year")
    return (
        with_scores(catalogue.filter(F.col("model").isNotNull() & (first <= last)))
        .withColumn("model_key", F.lower("model"))
        .withColumn("span", F.explode(_spans_of_range(first, last)))
        .select("model_key", "span", "row_id", *SEARCH_COLUMNS)
    )


def _fits_search() -> Column:
    return (
        ((F.col("code_key") == "") | fits_engine_code(F.col("code_key")))
        & (~F.col("exclude") | has_no_keyword())
        & (F.col("min_price").isNull() | (F.col("b_price") >= F.col("min_price")))
        & (F.col("min_opportunity").isNull() | (F.col("opportunity_score") >= F.col("min_opportunity")))
    )


def _best_of(rows: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows per key, numbered.

    The rows of a key are dealt out by part and cut to the limit there, so the task
    that has a popular key takes ``_HANDS`` times the limit at most.
    """
    hand = F.pmod(F.xxhash64("row_id"), F.lit(_HANDS))
    by_hand = F.row_number().over(W.partitionBy(*keys, "_hand").orderBy(*best_first()))
    rows = rows.withColumn("_hand", hand).withColumn("_place", by_hand)
    rows = rows.filter(F.col("_place") <= limit).drop("_hand", "_place")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*best_first()))
    return rows.withColumn(name, place).filter(F.col(name) <= limit)


def _short_searches(searches: DataFrame, quick: DataFrame, limit: int) -> DataFrame:
    """Searches with fewer hits than the limit, and how many they have."""
    hits = quick.groupBy(*_SEARCH).agg(F.max("position").alias("hits")).alias("h")
    same = reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in _SEARCH])
    counted = searches.alias("s").join(hits, same, "left")
    return counted.select("s.*", F.coalesce("hits", F.lit(0)).alias("hits")).filter(F.col("hits") < limit)


def search_parts_batch(
    catalogue: DataFrame, requests: DataFrame, limit: int = 50, shortlist: int = 1000
) -> DataFrame:
    """Many searches in one job: ``request_id, position`` and the search columns.

    Equal searches are run once and handed back to all their requests. Parts are
    ranked alike in every search, so most searches are answered from the best
    ``shortlist`` parts of their model and year: once ``limit`` of these fit, no
    other part can rank above them. Only a search that stays short of ``limit``
    although its shortlist was cut is run against all parts of its model and
    year. No search is paired with a whole popular model otherwise.

    The shortlists and first results are written to the shared folder, since
    both are read more than once.
    """
    asked = requests.select(
        "request_id",
        F.lower("model").alias("model_key"),
        "year",
        F.lower(strip(F.coalesce("engine_code", F.lit("")))).alias("code_key"),
        # Adding zero turns -0.0 into 0.0: they are equal, but hash apart.
        (F.col("min_price") + 0.0).alias("min_price"),
        (F.col("min_opportunity") + 0.0).alias("min_opportunity"),
        F.coalesce("exclude", F.lit(False)).alias("exclude"),
    )
    searches = asked.filter("model_key IS NOT NULL AND year IS NOT NULL").select(*_SEARCH).distinct()
    parts = _part_spans(catalogue)

    years = _request_spans(searches.select("model_key", "year").distinct())
    covered = parts.join(years, ["model_key", "span"]).drop("span")
    ranked = write_through(_best_of(covered, ["model_key", "year"], shortlist, "rank"), "shortlists")
    quick = searches.join(ranked, ["model_key", "year"]).filter(_fits_search())
    quick = _best_of(quick, _SEARCH, limit, "position").select(*_SEARCH, "position", *SEARCH_COLUMNS)
    quick = write_through(quick, "search-results")

    cut = ranked.filter(F.col("rank") == shortlist).select("model_key", "year")
    short = _short_searches(searches.join(cut, ["model_key", "year"], "left_semi"), quick, limit)
    # The hits there are stay first; only those after them are added.
    full = parts.join(_request_spans(short), ["model_key", "span"]).filter(_fits_search())
    full = _best_of(full, _SEARCH, limit, "position").filter(F.col("position") > F.col("hits"))
    found = quick.unionByName(full.select(*quick.columns))
    answers = skew_join(asked, found, _SEARCH, how="inner", null_safe=True)
    return answers.select("request_id", "position", *SEARCH_COLUMNS)


def autocomplete(catalogue: DataFrame, query: str) -> DataFrame:
    """Models containing the text, each once, in the order they first appear."""
    found = F.lit(False) if not query else contains_ignore_case(F.col("model"), query)
    return (
        catalogue.filter(found)
        .groupBy("model")
        .agg(F.min("row_id").alias("first_row"))
        .orderBy("first_row")
    )


def _search_words(text: str) -> list[str]:
    """Words of a column search box; a quoted phrase stays together."""
    pieces = text.split('"')
    phrases = [p for p in pieces[1::2] if p]
    return phrases + " ".join(pieces[0::2]).split()


def contains_filters(df: DataFrame, searches: dict[str, str]) -> DataFrame:
    """Column search boxes over a result table: every word must occur in its column."""
    tests = [
        contains_ignore_case(F.coalesce(F.col(name).cast("string"), F.lit("")), word)
        for name, text in searches.items()
        for word in _search_words(text)
    ]
    return reduce(DataFrame.filter, tests, df)


def search_box(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """The search box over a whole result table: every word must occur in some column."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]
    tests = [
        reduce(Column.__or__, [contains_ignore_case(cell, word) for cell in shown]) for word in _search_words(text)
    ]
    return reduce(DataFrame.filter, tests, df)


def sorted_by(column: str, descending: bool = False) -> list[Column]:
    """Order of a result table by a chosen column, missing values last, ties in catalogue order."""
    chosen = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return [chosen, F.asc("row_id")]


def result_page(rows: DataFrame, order: list[Column], page: int, page_size: int = 25) -> DataFrame:
    """One page of a result: the rows in order with their ``position``.

    Only the rows up to the end of the page are sorted out and numbered.
    """
    first = page * page_size
    top = rows.orderBy(*order).limit(first + page_size)
    numbered = top.withColumn("position", F.row_number().over(W.orderBy(*order)).cast("long"))
    return numbered.filter(F.col("position") > first).orderBy("position")


def display_rows(found: DataFrame) -> DataFrame:
    """Display names, money and ratios to two decimals, and the highlight flag."""
    rounded = {"b_price", "potential_profit", "sales_speed", "opportunity_score"}
    shown = {ours: theirs for theirs, ours in (CATALOGUE_NAMES | SCORE_NAMES).items()}
    cells = [
        (F.round(c, 2) if c in rounded else F.col(c)).alias(shown[c]) for c in SEARCH_COLUMNS
    ]
    return found.select(*cells, (F.coalesce(F.col("backorders"), F.lit(0)) > 0).alias("Highlight"))


def export_rows(found: DataFrame) -> DataFrame:
    """The 12 search columns under their display names, values untouched."""
    shown = {ours: theirs for theirs, ours in (CATALOGUE_NAMES | SCORE_NAMES).items()}
    return found.select(*[F.col(c).alias(shown[c]) for c in SEARCH_COLUMNS])
