"""How the vocabulary of each source differs from the others of its language.

Texts are cut into terms, coded by a dictionary and counted with Arrow where they are read;
only partial counts travel. Merged counts lie in shards, each with the counts of some
terms of one language for all its sources. A shard makes a table of terms by sources, block
after block, and returns partial sums per pair of sources and its own largest terms.

Frequencies are whole numbers of billionths, smoothed by 5 occurrences of each term, so all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.llm.shared import giving_back, write_through

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # between terms
LEAST_DOCS = 30  # of its language, that hold a kept term
ADDED = 5  # to each count
SCALE = 1_000_000_000
TOP = 50
HELD_ROWS = 1 << 19  # partial counts that a task holds before it merges them
TEXT_BYTES = 1 << 22  # of texts that are cut into terms together, unless one text is longer
SHARD_ROWS = 1 << 17  # counts of one shard, about
CELLS = 1 << 20  # of a block of terms by sources, unless one term has more sources

GROUP = ["lang", "source"]


def _of_batch(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of the texts of one batch, counted over codes of a dictionary."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), BREAKS)
    terms = pc.list_flatten(lists).dictionary_encode()
    rows = pc.list_parent_indices(lists)
    none = pc.index_in(pa.array([""], terms.type.value_type), terms.dictionary)[0]
    group = pa.StructArray.from_arrays([pc.fill_null(batch.column(c), "") for c in GROUP], GROUP)
    names = pa.table({c: group.field(c) for c in GROUP}).append_column("row", pa.array(np.arange(len(group))))
    names = names.group_by(GROUP).aggregate([("row", "list")])
    members = names["row_list"].combine_chunks()
    code = np.zeros(len(group), np.int32)
    code[members.flatten().to_numpy()] = np.repeat(np.arange(len(members)), members.value_lengths().to_numpy())
    found = pa.table({"row": rows, "term": terms.indices})
    if none.is_valid:
        found = found.filter(pc.not_equal(found["term"], none))
    found = found.group_by(["row", "term"]).aggregate([([], "count_all")])
    found = found.append_column("group", pa.array(code[found["row"].to_numpy()]))
    found = found.group_by(["group", "term"]).aggregate([("count_all", "sum"), ([], "count_all")])
    names = names.select(GROUP).take(found["group"])
    return pa.table([*names.columns, terms.dictionary.take(found["term"].combine_chunks()), found["count_all_sum"], found["count_all"]], COUNTS)


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``TEXT_BYTES`` of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _merged(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table(merged.columns, COUNTS)


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of terms, and of the documents that hold them.

    A group of which no text has a term has one row with a null term. Rows of a task are merged whenever there are ``HELD_ROWS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, set()
        for batch in (part for whole in batches for part in _parts(whole)):
            found = _of_batch(batch)
            held.append(found)
            rows += found.num_rows
            groups = zip(*(pc.fill_null(batch.column(c), "").to_pylist() for c in GROUP))
            new = sorted(set(groups) - seen)
            if new:  # every group is seen, also one without terms
                seen.update(new)
                langs, sources = (pa.array(list(x), pa.string()) for x in zip(*new))
                nothing = pa.array([0] * len(new), pa.int64())
                yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(new), pa.string()), nothing, nothing], schema=COUNTS)
            if rows >= HELD_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows >= HELD_ROWS // 2:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(1 << 16)

    return docs.select("text", *GROUP).mapInArrow(giving_back(run), "lang string, source string, term string, n long, docs long")


def _billionths(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for 0 <= counts <= total < 2^53, digit group by digit group."""
    out, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _shard(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial results of a shard: ``rows`` (lang, source, term, n), ``groups`` (lang, source, total, lang_total, kept) of its language."""
    sources = groups["source"].to_pylist()
    place = {name: i for i, name in enumerate(sources)}
    lang, size = groups["lang"][0].as_py(), len(sources)
    kept = groups["kept"][0].as_py()
    totals = groups["total"].to_numpy() + ADDED * kept
    whole = groups["lang_total"][0].as_py() + ADDED * kept
    coded = rows["term"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.string()).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    owner = np.fromiter((place[x] for x in rows["source"].to_pylist()), np.int64, rows.num_rows)
    order = np.argsort(code, kind="stable")
    code, owner, counts = code[order], owner[order], rows["n"].to_numpy()[order]
    differ = np.zeros((size, size), np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in sources]
    block = max(1, CELLS // size)
    for low in range(0, len(terms), block):
        high = min(low + block, len(terms))
        own = slice(*np.searchsorted(code, [low, high]))
        table = np.zeros((high - low, size), np.int64)
        table[code[own] - low, owner[own]] = counts[own]
        p = _billionths(table + ADDED, totals)
        q = _billionths(table.sum(axis=1) + ADDED, whole)
        for one in range(size):
            differ[one] += np.abs(p - p[:, one : one + 1]).sum(axis=0)
            over = np.where(table[:, one] > 0, p[:, one] - q, 0)
            found = np.flatnonzero(over > 0)
            if len(found) > TOP:  # all that are as large as the last one of the top
                found = found[over[found] >= np.partition(over[found], -TOP)[-TOP]]
            best[one] += [(int(-over[x]), x + low) for x in found]
    out: list[tuple] = []
    for one, name in enumerate(sources):
        out += [(name, "pair", other, int(differ[one, i])) for i, other in enumerate(sources) if i != one]
        ranked = sorted((value, terms[at].as_py().encode()) for value, at in best[one])
        out += [(name, "term", term.decode(), -value) for value, term in ranked[:TOP]]
    columns = list(zip(*out)) or [[]] * 4
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.Table.from_arrays(
        [pa.array([lang] * len(out), pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
        ["lang", "source", "part", "item", "value"],
    )


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs, and by which terms.

    Part ``pair``: the sum of the differences of all kept terms' frequencies, for each other
    source. Part ``term``: the 50 terms that are most above their frequency in the language. Kept
    are a language's terms in at least ``least_docs`` of its documents. Null text, lang and source
    are empty; a language without kept terms has pairs of value 0, one with one source has none.
    Ties are ranked by the item's bytes; repeated rows count as often as they are there. Texts of any length are counted whole.
    Pairs are as many as the result has: the square of a language's sources.
    """
    counts = count_terms(docs).repartition("lang", "term")  # of all that follows up to the kept terms
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumn("lang_docs", F.sum("docs").over(W.partitionBy("lang", "term")))
    counts = counts.filter(F.col("term").isNull() | (F.col("lang_docs") >= least_docs))
    counts = write_through(counts.select(*GROUP, "term", "n"), "kept-terms")

    kept = counts.filter(F.col("term").isNotNull())
    groups = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    langs = langs.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept"), F.sum("rows").alias("rows"))
    groups = groups.join(langs, "lang", "left").na.fill(0, ["lang_total", "kept", "rows"])
    groups = write_through(groups.withColumn("shards", F.floor(F.col("rows") / SHARD_ROWS) + 1), "audit-groups")

    shards = groups.select("lang", "shards").distinct()
    kept = kept.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards"))
    each = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    found = kept.select("lang", "shard", "source", "term", "n").groupBy("lang", "shard").cogroup(
        each.select("lang", "shard", "source", "total", "lang_total", "kept").groupBy("lang", "shard")
    )
    found = found.applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    found = found.groupBy(*GROUP, "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), counted AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0::HUGEINT) AS n, v.v
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p,
    (sum(n) OVER (PARTITION BY lang, term))::HUGEINT AS ln, (sum(n) OVER (PARTITION BY lang))::HUGEINT AS ltotal, v
  FROM cells
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM (
    SELECT *, 1 + (1000000000::HUGEINT * (ln + 5)) // (ltotal + 5 * v) AS q FROM p
  ) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
) WHERE part = 'pair' OR rank <= 50
"""
