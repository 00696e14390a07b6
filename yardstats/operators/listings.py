"""Market listings: out of stored web pages, into price bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstats.functions.text import parse_price

@dataclass(frozen=True)
class Band:
    """A price band; a missing bound is open."""

    name: str
    low: float | None = None
    low_included: bool = False
    high: float | None = None

    def holds(self, price: Column) -> Column:
        test = price.isNotNull() & ~F.isnan(price)
        if self.low is not None:
            test = test & (price >= self.low if self.low_included else price > self.low)
        if self.high is not None:
            test = test & (price <= self.high)
        return test


# The bands overlap at exactly 500.
BANDS = [
    Band("small", high=50.0),
    Band("medium", low=50.0, high=500.0),
    Band("large", low=500.0, low_included=True),
]


def price_bands(listings: DataFrame, bands: list[Band] = BANDS) -> DataFrame:
    """One row per listing and band it belongs to; needs a ``price`` column.

    The bands of a row are worked out in place and exploded, so the listings are
    scanned once for all bands.
    """
    names = F.array_compact(F.array(*[F.when(b.holds(F.col("price")), F.lit(b.name)) for b in bands]))
    return listings.withColumn("band", F.explode(names))


def priced(listings: DataFrame) -> DataFrame:
    """Listings with a readable price. The price is made in a step of its own, so that the filter does not parse it again."""
    price = F.explode(F.array(parse_price(F.col("price_text"))))
    return listings.withColumn("price", price).filter(F.col("price").isNotNull())


def dearest_first(banded: DataFrame, *tie_break: str) -> DataFrame:
    """Within a band by price, highest first; equal prices in page order."""
    return banded.orderBy("band", F.desc("price"), *tie_break)


def band_report(listings: DataFrame, tie_break: list[str], bands: list[Band] = BANDS) -> DataFrame:
    """Priced listings of all bands, dearest first."""
    return dearest_first(price_bands(priced(listings), bands), *tie_break)
