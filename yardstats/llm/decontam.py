"""Benchmark decontamination by canonical templates. DataFrame functions only.

Numbers, names and units in a text become typed placeholders; punctuation, case and line breaks go.
Windows of five template words are joined by hash with those of the benchmark; windows
of hardly anything but placeholders are joined by their values, and count by template
where other windows align. The hits of one document, item and offset, or of neighbouring
offsets, are one alignment. Enough windows with the item's own values are a leak as they
are; beyond that slots must be consistent: one value of the item stands for one value of
the document throughout. So a question with other numbers and names is caught, and a text
that only has the same outline of placeholders is not.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.llm.shared import write_through

WINDOW = 5
LITERALS = 3  # words that are no placeholders, in a window that is joined by its template
SPREAD = 16  # offsets of one alignment lie closer than this, or than the item's windows
SIMILARITY = 0.8  # share of an item's windows
RUN = 13  # or so many words in a row
PART_ROWS = 500_000  # windows of the benchmark that are looked for in one pass

# Each pattern starts with a character that is quickly looked for. A name stands behind a
# word or comma, so that the first word of a sentence is none; several in a row are one.
# Repeated groups are possessive: Java matches these in a loop, others by a call for each
# round, which ends an executor by its stack where thousands of names or numbers are in a row.
NAMES = r"\x20(?=\p{Lu})(?<=[\p{Ll}\p{N},;:]\x20{1,3})(\p{Lu}[\p{L}'’-]*+(?: \p{Lu}[\p{L}'’-]*+)*+)"
UNITS = (
    r"(\d) ?((?i:km|cm|mm|kg|mg|lbs?|oz|ml|mph|kmh|miles?|met(?:er|re)s?|feet|foot|inch(?:es)?|lit(?:er|re)s?|"
    r"grams?|pounds?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent|%|dollars?|cents?|euros?|usd|eur|"
    r"m|g|l|s|h))(?![\p{L}\p{N}])"
)
NUMBERS = r"(\d++(?:[.,]\d++)*+)"
TOKENS = r"(<[^>]*>|[\p{L}\p{N}]+)"


def _valued_words(text: Column) -> Column:
    """The words of a text's template, placeholders with their values: ``<name tom>``."""
    plain = F.translate(F.coalesce(text, F.lit("")), "<>\n\r\t", "     ")
    named = F.regexp_replace(plain, NAMES, " <name $1> ")
    with_units = F.regexp_replace(named, UNITS, "$1 <unit $2> ")
    numbered = F.regexp_replace(with_units, NUMBERS, " <number $1> ")
    return F.regexp_extract_all(F.lower(numbered), F.lit(TOKENS), F.lit(1))


def _kinds(valued: Column) -> Column:
    return F.transform(valued, lambda w: F.when(w.startswith("<"), F.concat(F.substring_index(w, " ", 1), F.lit(">"))).otherwise(w))


def template_words(text: Column) -> Column:
    """The words of a text's template, as an array. Null and empty texts: no words."""
    return _kinds(_valued_words(text))


def _hash(words: str, at: Column, width: int) -> Column:
    """Hash of the ``width`` words from place ``at`` on; no array is made of them."""
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(width)])


def _by_width(widths: list[int], of: Callable[[int], Column]) -> Column:
    """``of`` the row's own width."""
    return F.coalesce(*[F.when(F.col("width") == width, of(width)) for width in widths])


def _literal(words: str, at: Column, width: int) -> Column:
    """Whether a window has enough words that are no placeholders."""
    plain = [(~F.get(F.col(words), at + k).startswith("<")).cast("int") for k in range(width)]
    return reduce(Column.__add__, plain) >= min(width, LITERALS)


def _placeholders(valued: str, at: Column, width: Column) -> Column:
    """(pos, word) of the placeholders of a window; null where there is none."""
    def one(k: int) -> Column:
        word = F.get(F.col(valued), at + k)
        return F.when((width > k) & word.startswith("<"), F.struct((at + k).alias("pos"), word.alias("word")))

    return F.array(*[one(k) for k in range(WINDOW)])


def _keyed(texts: DataFrame, name: str, key: str) -> DataFrame:
    """The texts under a key that is never null, so that rows without id or sharing one stay apart."""
    return texts.select(F.struct(F.col(key), F.xxhash64("text").alias("mark")).alias(name), "text")


def _variants(items: DataFrame) -> DataFrame:
    """item, variant, lead, valued, words, width: each item as it stands alone, and with its first word as a name.

    Behind a comma, colon or lower-case word the first capital word is a name, alone it is not.
    ``lead`` is the first word where it became one name with the next ones, else empty.
    """
    behind = _valued_words(F.concat(F.lit("x, "), F.ltrim(F.coalesce("text", F.lit("")))))
    both = items.select("item", _valued_words(F.col("text")).alias("alone"), behind.alias("behind"))
    behind = F.slice("behind", F.lit(2), F.size("behind") - 1)
    rows = both.select("item", F.get("alone", F.lit(0)).alias("first"), F.posexplode(F.array_distinct(F.array("alone", behind))).alias("variant", "valued"))
    rows = rows.filter(F.size("valued") > 0).withColumn("words", _kinds(F.col("valued")))
    merged = (F.col("variant") == 1) & F.get("valued", F.lit(0)).startswith(F.concat(F.lit("<name "), F.col("first"), F.lit(" ")))
    rows = rows.withColumn("lead", F.when(merged, F.col("first")).otherwise(""))
    return rows.withColumn("width", F.least(F.size("words"), F.lit(WINDOW)))


PAIR = ["doc", "item", "variant"]
OFFSET = [*PAIR, "offset"]
ALIGNMENT = [*PAIR, "grid", "band"]


def _without(lead: str, value: str) -> Column:
    """The name behind its first word, where that is ``lead``."""
    start = F.concat(F.lit("<name "), F.col(lead), F.lit(" "))
    behind = F.concat(F.lit("<name "), F.substring(F.col(value), F.length(start) + 1, F.length(value)))
    return F.when((F.col(lead) != "") & F.col(value).startswith(start), behind).otherwise(F.col(value))


def _grids(hits: DataFrame) -> DataFrame:
    """Each hit in three alignments: its exact offset (grid 0), and two grids of bands that overlap by half.

    Offsets that differ by less than half a band are in one band of one grid, so a word
    more or less does not part a leak, and a band is no longer than the item.
    """
    size = F.greatest(F.lit(SPREAD), F.col("item_windows"))
    half = F.floor((F.col("offset") + F.floor(size / 2)) / size)
    grids = [(0, F.col("offset")), (1, F.floor(F.col("offset") / size)), (2, half)]
    each = F.array(*[F.struct(F.lit(grid).alias("grid"), band.cast("long").alias("band")) for grid, band in grids])
    return hits.withColumn("in", F.explode(each)).select("*", "in.grid", "in.band").drop("in")


def _slot_counts(pieces: DataFrame, found: DataFrame, variants: DataFrame) -> DataFrame:
    """Per alignment with slots: slots, changed_slots, values (the most that one value of the item stands for).

    ``pieces``: alignment, offset, start and end of each stretch of words that match. Their placeholders
    are those of the windows in ``found``, so no text is read for them.
    """
    own = found.join(pieces.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode("slots").alias("slot"))
    own = own.filter("slot is not null").select("doc", "slot.pos", F.col("slot.word").alias("value")).distinct()
    own = own.withColumn("kind", F.substring_index("value", " ", 1))
    theirs = variants.join(pieces.select("item").distinct(), "item", "left_semi")
    theirs = theirs.select("item", "variant", "lead", F.posexplode("valued").alias("item_pos", "item_value"))
    theirs = theirs.filter(F.col("item_value").startswith("<")).withColumn("item_kind", F.substring_index("item_value", " ", 1))
    theirs = theirs.withColumn("lead", F.when(F.col("item_pos") == 0, F.col("lead")).otherwise(""))
    met = pieces.join(own, "doc").filter(F.col("pos").between(F.col("start"), F.col("end")))
    met = met.withColumn("item_pos", F.col("pos") - F.col("offset")).join(theirs, ["item", "variant", "item_pos"])
    met = met.withColumn("value", _without("lead", "value")).withColumn("item_value", _without("lead", "item_value"))
    met = met.filter("kind = item_kind").select(*ALIGNMENT, "pos", "item_pos", "kind", "value", "item_value").distinct()
    met = met.groupBy(*ALIGNMENT, "kind", "item_value").agg(
        F.count(F.lit(1)).alias("slots"), F.sum((F.col("value") != F.col("item_value")).cast("long")).alias("changed_slots"),
        F.countDistinct("value").alias("values"),
    )
    return met.groupBy(*ALIGNMENT).agg(
        F.sum("slots").alias("slots"), F.sum("changed_slots").alias("changed_slots"), F.max("values").alias("values")
    )


def _windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc, valued, width, pos, hash: all windows of the documents, one after another.

    The words stay beside each window as they are in their document's row, and are not copied
    before a join that keeps few windows.
    """
    rows = docs.select("doc", _valued_words(F.col("text")).alias("valued"))
    rows = rows.select("doc", "valued", _kinds(F.col("valued")).alias("words")).filter(F.size("valued") > 0)
    rows = rows.select("doc", "valued", "words", F.explode(F.sequence(F.lit(0), F.size("valued") - 1)).alias("pos"))
    fits = lambda width: F.col("pos") + width <= F.size("valued")
    if len(widths) == 1:
        rows = rows.filter(fits(widths[0])).withColumn("width", F.lit(widths[0]))
    else:
        each = F.explode(F.array(*[F.when(fits(width), F.lit(width)) for width in widths])).alias("width")
        rows = rows.select("*", each).filter("width is not null")
    return rows.withColumn("hash", _by_width(widths, lambda width: _hash("words", F.col("pos"), width))).drop("words")


def _found(docs: DataFrame, places: DataFrame, widths: list[int]) -> DataFrame:
    """doc, width, pos, hash, literal, raw, slots: the windows of documents that an item has too.

    One pass over the texts for each ``PART_ROWS`` windows of the benchmark, which are broadcast; no text is moved.
    A window that many items share is met once. Equal rows of ``docs`` count once.
    """
    known = write_through(places.select("width", "hash", "literal").distinct(), "benchmark-known")
    parts = max(1, math.ceil(known.count() / PART_ROWS))
    hits = []
    for part in range(parts):
        own = known if parts == 1 else known.filter(F.pmod(F.xxhash64("hash"), F.lit(parts)) == part)
        hits.append(_windows(docs, widths).join(F.broadcast(own), ["width", "hash"]))
    hit = reduce(DataFrame.union, hits)
    pos = F.col("pos")
    raw = _by_width(widths, lambda width: _hash("valued", pos, width))
    hit = hit.select("doc", "width", "pos", "hash", "literal", raw.alias("raw"), _placeholders("valued", pos, F.col("width")).alias("slots"))
    return write_through(hit.dropDuplicates(["doc", "width", "pos"]), "benchmark-hits")


def _places(variants: DataFrame) -> DataFrame:
    """item, variant, width, item_windows, item_pos, hash, raw, literal: all windows of the items."""
    every = list(range(1, WINDOW + 1))
    at = F.col("item_pos")
    rows = variants.withColumn("item_windows", F.size("words") - F.col("width") + 1)
    rows = rows.withColumn("item_pos", F.explode(F.sequence(F.lit(0), F.col("item_windows") - 1)))
    return rows.select(
        "item", "variant", "width", "item_windows", "item_pos",
        _by_width(every, lambda width: _hash("words", at, width)).alias("hash"),
        _by_width(every, lambda width: _hash("valued", at, width)).alias("raw"),
        _by_width(every, lambda width: _literal("words", at, width)).alias("literal"),
    )


def _hits(found: DataFrame, places: DataFrame) -> DataFrame:
    """doc, item, variant, offset, pos, item_pos, width, item_windows, same: each window of an item in a document.

    ``same``: the values agree too. A window of few literal words counts where its values
    agree, or where another window has the same offset.
    """
    found = found.drop("slots")
    key = F.when(F.col("literal"), F.col("hash")).otherwise(F.col("raw"))
    theirs = places.withColumn("key", key).withColumnRenamed("raw", "item_raw").drop("hash")
    columns = [*OFFSET, "pos", "item_pos", "width", "item_windows", (F.col("raw") == F.col("item_raw")).alias("same")]
    sure = found.withColumn("key", key).drop("hash").join(theirs, ["width", "literal", "key"])
    sure = write_through(sure.withColumn("offset", F.col("pos") - F.col("item_pos")).select(*columns), "benchmark-sure")
    heavy = places.filter("not literal").withColumnRenamed("raw", "item_raw").drop("literal")
    more = sure.select(*OFFSET).distinct().join(heavy, ["item", "variant"]).withColumn("pos", F.col("offset") + F.col("item_pos"))
    more = more.join(found.drop("literal"), ["doc", "pos", "width", "hash"]).select(*columns)
    return sure.union(more).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, run: int = RUN) -> DataFrame:
    """doc_id, mark, item_id, windows, share, longest_run, slots, changed_slots: one row per leak.

    A row means that a document holds a benchmark item: at one offset, or at neighbouring
    ones, it has at least ``similarity`` of the item's windows, or ``run`` of its words in
    a row, either with the item's own values or with consistent slots. ``share`` is that of
    the windows; ``changed_slots`` is the number of slots with another value than the
    item's, 0 for a plain copy. ``mark`` is a hash of the text, for rows that share an id.
    Of several alignments the best one counts.

    An item of less than five words is one window of its own length. Null and empty items
    match nothing. Documents that leak nothing have no row. Repeated rows count once.
    """
    docs, items = _keyed(docs, "doc", "doc_id"), _keyed(benchmark, "item", "item_id").distinct()
    variants = _variants(items)
    places = write_through(_places(variants), "benchmark-windows")
    widths = sorted(r.width for r in places.select("width").distinct().collect()) or [WINDOW]  # 1 to WINDOW
    found = _found(docs, places, widths)
    hits = _hits(found, places)
    order = lambda *more: W.partitionBy(*OFFSET, *more).orderBy("pos")
    hits = hits.withColumn("stretch", F.col("pos") - F.row_number().over(order()))
    hits = hits.withColumn("same_stretch", F.col("pos") - F.row_number().over(order("same")))
    hits = hits.withColumn("run", F.row_number().over(order("stretch")) + F.col("width") - 1)
    same_run = F.row_number().over(order("same", "same_stretch")) + F.col("width") - 1
    hits = hits.withColumn("same_run", F.when(F.col("same"), same_run).otherwise(0))
    hits = _grids(write_through(hits, "benchmark-runs"))
    aligned = hits.groupBy(*ALIGNMENT).agg(
        F.countDistinct("item_pos").alias("windows"), F.countDistinct(F.when(F.col("same"), F.col("item_pos"))).alias("same_windows"),
        F.max("run").alias("longest_run"), F.max("same_run").alias("same_run"),
        F.first("item_windows").alias("item_windows"), F.min("offset").alias("offset"),
    )
    aligned = aligned.withColumn("share", F.col("windows") / F.col("item_windows"))
    aligned = aligned.filter((F.col("share") >= similarity) | ((F.col("longest_run") >= run) & (F.col("grid") == 0)))
    aligned = write_through(aligned, "benchmark-alignments")

    pieces = hits.join(aligned.select(*ALIGNMENT), ALIGNMENT, "left_semi").groupBy(*ALIGNMENT, "offset", "stretch").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("width") - 1).alias("end")
    )
    checked = aligned.join(_slot_counts(pieces, found, variants), ALIGNMENT, "left")
    plain = (F.col("same_windows") / F.col("item_windows") >= similarity) | (F.col("same_run") >= run)
    checked = checked.filter(plain | (F.coalesce("values", F.lit(1)) == 1))
    zero = F.lit(0).cast("long")
    best = F.struct(
        "share", "longest_run", "windows", F.negative("offset").alias("before"),
        F.coalesce("slots", zero).alias("slots"), F.coalesce("changed_slots", zero).alias("changed_slots"),
    )
    leaks = checked.groupBy("doc", "item.item_id").agg(F.max(best).alias("best"))
    return leaks.select(
        "doc.doc_id", "doc.mark", "item_id", "best.windows", "best.share", "best.longest_run", "best.slots",
        "best.changed_slots",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    leaks = find_contamination(docs.select("doc_id", "text"), benchmark, **limits)
    leaks = write_through(leaks.select("doc_id", "mark").distinct(), "leaks").alias("leak")
    same = F.col("doc.doc_id").eqNullSafe(F.col("leak.doc_id")) & (F.xxhash64("doc.text") == F.col("leak.mark"))
    return docs.alias("doc").join(leaks, same, "left_anti")
