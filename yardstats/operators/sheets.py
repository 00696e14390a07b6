"""Rows of a spreadsheet grid that mention an engine code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstats.functions.text import contains_ignore_case, rgb_hex

HIDDEN_COLUMNS = (17, 18)


def sheet_header(grid: DataFrame) -> list[str]:
    """Names in the first row of the grid (one row is read)."""
    first = grid.filter(F.col("row_idx") == 0).select("cells").first()
    return list(first["cells"]) if first else []


_BETWEEN = "\u0000"


def any_cell_contains(cells: Column, text: str) -> Column:
    """True if a cell contains the text; hidden columns count, missing cells do not.

    The cells are joined by a character the text does not have, so one search
    over the row equals a search in every cell.
    """
    if _BETWEEN in text:
        return F.exists(cells, lambda c: contains_ignore_case(F.coalesce(c, F.lit("")), text))
    return contains_ignore_case(F.array_join(cells, _BETWEEN), text)


def sheet_cells(grid: DataFrame, header: list[str], hidden: tuple[int, ...] = HIDDEN_COLUMNS) -> DataFrame:
    """``row_idx, cells`` with cells as a map: column name -> ``{value, bg}``.

    Rows may be short: what they lack is absent from the map. Of columns sharing
    a name the last one present counts. Cells beyond the header have no name and
    are left out; a cell without a fill is white.
    """
    places: dict[str, list[int]] = {}
    for place, name in enumerate(header):
        if place not in hidden:
            places.setdefault(name, []).append(place)
    entries: list[Column] = []
    for name, columns in places.items():
        cell = F.coalesce(*[_cell(p) for p in reversed(columns)])
        entries += [F.lit(name), cell]
    named = F.map_filter(F.create_map(*entries), lambda _, cell: cell.isNotNull())
    return grid.filter(F.col("row_idx") > 0).select("row_idx", named.alias("cells"))


def _cell(place: int) -> Column:
    fill = F.get(F.col("fills"), F.lit(place))
    shown = F.struct(
        F.get(F.col("cells"), F.lit(place)).alias("value"), rgb_hex(fill).alias("bg")
    )
    return F.when(F.size("cells") > place, shown)


def sheet_matches(
    grid: DataFrame, header: list[str], engine_code: str, hidden: tuple[int, ...] = HIDDEN_COLUMNS
) -> DataFrame:
    """Rows with the code in any cell, as named cells; no code, no rows."""
    if not engine_code:
        return sheet_cells(grid.filter(F.lit(False)), header, hidden)
    hits = grid.filter(any_cell_contains(F.col("cells"), engine_code))
    return sheet_cells(hits.orderBy("row_idx"), header, hidden)


def long_cells(named: DataFrame) -> DataFrame:
    """``row_idx, name, value, bg``: one row per named cell.

    The outer form of explode: the plain one would have the optimizer test every
    row's map for emptiness first, which means building all of it twice.
    """
    cells = named.select("row_idx", F.explode_outer("cells").alias("name", "cell"))
    return cells.filter(F.col("name").isNotNull()).select("row_idx", "name", "cell.*")
