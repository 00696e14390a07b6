"""String expressions: all of them run inside the JVM, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# White space as Python's str.strip and str.split see it.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf(?:inity)?))"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def equals_ignore_case(text: Column, wanted: str) -> Column:
    return F.lower(text) == F.lit(wanted.lower())


def contains_ignore_case(text: Column, wanted: str | Column) -> Column:
    """Literal (never regex) substring test on lower-cased text."""
    needle = F.lit(wanted.lower()) if isinstance(wanted, str) else F.lower(wanted)
    return F.contains(F.lower(text), needle)


def label(name: Column) -> Column:
    """A missing entity or item is shown under a fixed label."""
    return F.coalesce(name, F.lit(UNKNOWN))


def label_is(name: Column, wanted: str) -> Column:
    """``label(name) = wanted`` written so that Catalyst can use it.

    For an ordinary label the test rejects nulls, which lets the optimizer turn
    the outer join that produced ``name`` into an inner join and push the
    predicate into the scan of the joined table.
    """
    if wanted == UNKNOWN:
        return name.isNull() | (name == F.lit(UNKNOWN))
    return name == F.lit(wanted)


def item_label(raw_name: Column) -> Column:
    """Stored item names carry brackets and underscores; show them as words."""
    return label(F.translate(raw_name, "_[]", " "))


def parse_price(price_text: Column) -> Column:
    """Price text to double, null when there is no usable number.

    The pound sign is dropped and the first word is read. Thousands commas and
    other decoration make the word unreadable, so such a price is null. One
    pattern finds the word and guards the cast: on its own the cast would accept
    Java suffixes such as ``12.5f``, and ``nan``, which fits no price band.
    """
    plain = F.replace(price_text, F.lit("£"), F.lit(""))
    word = F.regexp_extract(plain, rf"^{_SPACE}*({_NUMBER})(?:{_SPACE}|\z)", 1)
    return F.replace(F.nullif(word, F.lit("")), F.lit("_"), F.lit("")).try_cast("double")


def rgb_hex(colour: Column) -> Column:
    """``struct<red,green,blue>`` of 0..1 channels to ``#RRGGBB``, truncating."""

    def channel(name: str) -> Column:
        level = (F.coalesce(colour[name], F.lit(1.0)) * 255).cast("int")
        return F.when(level < 16, F.concat(F.lit("0"), F.hex(level))).otherwise(F.hex(level))

    return F.concat(F.lit("#"), channel("red"), channel("green"), channel("blue"))


def absolute_url(path: Column, base_url: str) -> Column:
    """Keep a full web address; put any other path under ``base_url``."""
    full = path.startswith("http://") | path.startswith("https://")
    joined = F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))
    return F.when(full, path).otherwise(joined)


def month_param(text: Column) -> Column:
    """Month request text to int; unreadable text means January."""
    whole = F.when(strip(text).rlike(rf"^[+-]?{_DIGITS}$"), F.replace(strip(text), F.lit("_"), F.lit("")))
    return F.coalesce(whole.try_cast("int"), F.lit(1))
