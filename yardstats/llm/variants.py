"""Spelling variants: words one edit apart, grouped under the most frequent of them.

Two words one edit apart agree in the first half of the shorter one, or in its last. So words meet
by their halves; a group that is too large is parted again by halves of what is left between, down to gaps
of two characters. In a group the words are a sorted list, and its common prefixes make ranges.
Each range has one banded row of the edit matrix per word that is looked up, derived from the row of
the range around it, so a prefix that words share is compared once; a range whose row
exceeds one edit throughout is left with all its words. The second halves' words are read backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstats.llm.shared import ascii_lower, giving_back, groups, write_through

LETTERS = r"[a-zÀ-ÿ]"  # of a lower-cased word
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5  # times as frequent is the form of a word, at least
DAMAGED = 199  # one run of so many loses a character
GROUP_ROWS = 4096  # words that meet in one group, unless all but two characters of them agree
ASKED = 1 << 14  # words that are looked up together
CELLS = 1 << 22  # characters of the lists that are looked at together, unless one group has more


def word_counts(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """word, n: the words of whole texts and how often they occur, null texts have none.

    Of the runs whose checksum with the document's id is divisible by ``damaged`` one character
    is left out; a null id counts as empty.
    """
    runs = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    check = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("check") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("check", check).select(F.when(F.col("check") % damaged == 0, without).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _parted(rows: DataFrame) -> DataFrame:
    """Each row twice, with the first half of its gap agreed upon, and with its last; adds ``key``."""
    gap = F.col("m") - F.col("left") - F.col("right")
    half = F.floor(gap / 2).cast("int")
    ways = [(F.col("left") + half, F.col("right")), (F.col("left"), F.col("right") + gap - half)]
    each = F.explode(F.array(*[F.struct(left.alias("left"), right.alias("right")) for left, right in ways]))
    rows = rows.select("word", "n", "m", each.alias("way")).select("word", "n", "m", "way.*")
    first = F.substring("word", F.lit(1), F.col("left"))
    last = F.substring(F.col("word"), F.length("word") - F.col("right") + 1, F.col("right"))
    return rows.withColumn("key", F.xxhash64("m", "left", "right", first, last))


def _lists(words: list[str], group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order of the words, sorted in their groups; their code points, lengths and prefixes shared with the word before."""
    order = np.array(sorted(range(len(words)), key=lambda i: (group[i], words[i])), np.int64)
    ordered = [words[i] for i in order]
    length = np.fromiter(map(len, ordered), np.int64, len(ordered))
    wide = int(length.max())
    codes = np.zeros((len(ordered), wide + 3), np.uint32)
    flat = np.frombuffer("".join(ordered).encode("utf-32-le"), np.uint32)
    codes[np.repeat(np.arange(len(ordered)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    differ = np.ones((len(ordered), wide + 3), bool)
    differ[1:] = codes[1:] != codes[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    shared[np.append(True, group[order][1:] != group[order][:-1])] = -1
    return order, codes, length, shared


def _near(codes: np.ndarray, length: np.ndarray, shared: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked word, listed word) of one list that are one edit apart.

    ``band`` holds the matrix at the diagonal and beside it, 2 standing for more than one edit.
    Ranges of depth d are the words that share their first d characters; ``starts`` are their first words.
    """
    starts = np.flatnonzero(shared == -1)
    node = np.searchsorted(starts, asked, "right") - 1
    word, band = asked, np.tile(np.array([2, 0, 1], np.int8), (len(asked), 1))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(word):
        ends = np.append(starts[1:], len(length))
        listed = starts[node]  # the shortest word of a range is its first
        beside = length[word] - depth + 1
        hit = (length[listed] == depth) & (beside >= 0) & (beside <= 2)
        hit[hit] = band[hit, beside[hit]] == 1
        out.append((word[hit], listed[hit]))

        inner = np.flatnonzero((shared <= depth) & (length > depth))
        low, high = np.searchsorted(inner, starts[node]), np.searchsorted(inner, ends[node])
        count = high - low
        word, band = np.repeat(word, count), np.repeat(band, count, axis=0)
        node = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(word))
        letter = codes[inner[node], depth]
        differs = [letter != (codes[word, depth + k] if depth + k >= 0 else 0) for k in (-1, 0, 1)]
        new = np.empty_like(band)
        new[:, 0] = np.minimum(band[:, 0] + differs[0], band[:, 1] + 1)
        new[:, 1] = np.minimum(np.minimum(band[:, 1] + differs[1], band[:, 2] + 1), new[:, 0] + 1)
        new[:, 2] = np.minimum(band[:, 2] + differs[2], new[:, 1] + 1)
        for k in (0, 1, 2):  # behind the end of the word
            new[depth + k > length[word], k] = 2
        alive = new.min(axis=1) <= 1
        word, node, band = word[alive], node[alive], np.minimum(new[alive], 2)
        starts, depth = inner, depth + 1
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _scan(rows: DataFrame) -> DataFrame:
    """word, near, near_n: words of a group that are one edit apart, both ways."""

    def linked(part: pa.Table) -> pa.RecordBatch:
        words, group, least = part["word"].to_pylist(), part["key"].to_numpy(), part["m"].to_numpy()
        read = [w[::-1] if back else w for w, back in zip(words, part["back"].to_pylist())]
        order, codes, length, shared = _lists(read, group)
        found = [_near(codes, length, shared, np.arange(low, min(low + ASKED, len(words)))) for low in range(0, len(words), ASKED)]
        word, near = (np.concatenate(x) for x in zip(*found))
        own = np.minimum(length[word], length[near]) == least[order[word]]  # others meet in a group of their length
        word, near = order[word[own]], order[near[own]]
        taken = part["word"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [taken.take(pa.array(word)), taken.take(pa.array(near)), pa.array(part["n"].to_numpy()[near])], ["word", "near", "near_n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, bounds in groups(batches, ["key"]):
            longest = pc.utf8_length(held["word"]).to_numpy()
            low, wide = bounds[0][0], 0
            for first, until in bounds:
                own = int(longest[first:until].max())
                if first > low and (until - low) * max(wide, own) > CELLS:
                    yield linked(held.slice(low, first - low))
                    low, wide = first, 0
                wide = max(wide, own)
            yield linked(held.slice(low, bounds[-1][1] - low))

    rows = rows.select("key", (F.col("right") > F.col("left")).alias("back"), "m", "word", "n")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(giving_back(run), "word string, near string, near_n long")


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n; each word once) that are one edit apart, both ways.

    An edit is an inserted, deleted or replaced code point. Groups of more than
    ``group_rows`` words are parted again; that changes no result.
    """
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))  # of the shorter word of a pair
    rows = words.select("word", "n", lengths.alias("m"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    rows, found = _parted(rows.filter("m > 0")), None
    while True:
        rows = write_through(rows, "variant-groups")
        large = rows.filter("m - left - right > 1").groupBy("key").count().filter(F.col("count") > group_rows)
        large = write_through(large.select("key"), "variant-large")
        last = large.isEmpty()
        links = _scan(rows if last else rows.join(large, "key", "left_anti"))
        found = links if found is None else found.union(links)
        if last:
            return found.distinct()
        rows = _parted(rows.join(large, "key", "left_semi").drop("key"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead in the end; each round doubles the steps."""
    roots = write_through(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        joined = roots.join(further, "root", "left")
        roots = write_through(joined.select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, damaged: int = DAMAGED) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of at least 6 code points and ``least_count`` occurrences.

    ``form`` is the most frequent word one edit apart, the smallest of equals, if it is at least ``ratio`` times
    as frequent, else null; ``root`` is where forms lead in the end. Null and empty texts
    have no words, an empty table no rows; repeated rows count each time. Texts of any length are read whole, and
    words of any length are compared whole. Other columns are not read.
    """
    words = write_through(word_counts(docs, damaged).filter(F.col("n") >= least_count), "variant-words")
    best = F.min(F.struct(F.negative("near_n").alias("rank"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    enough = F.negative("best.rank") >= F.col("n") * ratio
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.negative("best.rank")).alias("form_n"),
    )
    found = write_through(found, "variant-forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


VARIANTS_SQL = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), long_runs AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS line FROM runs WHERE length(run) >= 6
), checked AS (
  SELECT run, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(line)), lambda i: ('0x' || substr(hex(encode(line)), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM long_runs, tab
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM checked
), vocabulary AS (
  SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), shorter AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM vocabulary, unnest(range(length(word))) t(i)
), links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM links GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word
), path(word, here, k) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT p.word, f.form, k + 1 FROM path p JOIN forms f ON f.word = p.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root
FROM forms f JOIN (SELECT word, arg_max(here, k) AS root FROM path GROUP BY word) r USING (word)
"""
