"""Documents scored by the difference of two cross-entropies.

Two bigram models, one of a target corpus and one of all documents, are exact counts of
words and word pairs, under 64-bit hashes, over whole texts. A token's probability is
that of the pair, smoothed by that of the word; both models smooth over one vocabulary, all words there are.
A document's own counts are taken out of both models before it is scored, or those that a
model has seen would look close to it.

Texts are dealt into chunks of bounded size in the order they are read, and each chunk is counted.
Its sorted keys are cut into shards; what a chunk has in a shard is one compressed row, keys as
differences and counts as bytes. A shard adds up its rows and answers each of them with
what all other chunks have of its keys, in the same order, so an answer needs no keys. No task holds a whole model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstats.llm.shared import give_back, giving_back, write_through
from yardstats.llm.words import WordReader, mix

CHUNK = 1 << 22  # bytes of text that are counted and scored together, unless one text is longer
SHARD = 1 << 23  # bytes of text whose share of all keys is added up together
WEIGHT = 50.0  # how many tokens the word's probability counts for behind a context
ADDED = 0.5  # to the count of each word
BROADCAST_ROWS = 1_000_000  # of target ids; more of them are joined by a shuffle, and its result is stored


def _pairs(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each pair of neighbouring words of one text, and the place of its second word."""
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return mix(hashes[second - 1] * np.uint64(0x9FB21C651E98DF25) + hashes[second]), second


def mark_target(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, target: whether the id is among ``target_ids`` (doc_id). Null ids are not."""
    ids = target_ids.select("doc_id").dropna().distinct().select(F.col("doc_id").alias("target_id"))
    few = ids.count() <= BROADCAST_ROWS
    joined = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("target_id"), "left")
    marked = joined.select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    return marked if few else write_through(marked, "lm-texts")  # a shuffle's rows have another order each time


def _in_chunks(marked: DataFrame) -> DataFrame:
    """The rows with a ``chunk`` each: about ``CHUNK`` bytes of text that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = held + np.cumsum(sizes)
            chunk = first + np.maximum(ends - 1, 0) // CHUNK
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64())], [*batch.schema.names, "chunk"])

    return marked.mapInArrow(run, T.StructType(list(marked.schema.fields)).add("chunk", "long"))


def _tally(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs at all (row 0) and among the chosen (row 1)."""
    found, place = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(place, minlength=len(found)), np.bincount(place[chosen], minlength=len(found))])


def _tokens(reader: WordReader, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all words."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, found, own in reader.read(texts):
        hashes.append(found), owner.append(first + own)
    return np.concatenate(hashes), np.concatenate(owner)


def _count(reader: WordReader, texts: pa.Array, target: np.ndarray):
    """Hashes and owners of the words, hashes and places of the pairs, and the tallies of both."""
    hashes, owner = _tokens(reader, texts)
    pairs, second = _pairs(hashes, owner)
    chosen = target[owner]
    return hashes, owner, pairs, second, _tally(hashes, chosen), _tally(pairs, chosen[second])


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all of them first, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(block: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin among sorted ones, and their end."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _mark(hashes: np.ndarray) -> int:
    """The same for the same texts in any order."""
    return int((hashes.sum(dtype=np.uint64) + np.uint64(len(hashes))).view(np.int64))


COUNTED = "shard long, chunk long, words int, pairs int, keys binary, counts binary, tokens long, target_tokens long, mark long"
ANSWERS = "shard long, chunk long, words int, pairs int, others binary, tokens long, target_tokens long, mark long, vocabulary long"


def count_chunks(chunked: DataFrame, shards: int) -> DataFrame:
    """``COUNTED``: a row per chunk and shard with the keys and counts of its words, then of its pairs.

    The number of tokens and the mark of a chunk are in its first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, chunk = WordReader(), [], None

        def counted() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            target = rows["target"].to_numpy().astype(bool)
            hashes, owner, _, _, *tallies = _count(reader, _one(rows["text"]), target)
            cuts = [_cuts(found, shards) for found, _ in tallies]
            totals = (len(hashes), int(target[owner].sum()), _mark(hashes))
            out = []
            for shard in range(shards):
                parts = [slice(cut[shard], cut[shard + 1]) for cut in cuts]
                sizes = [part.stop - part.start for part in parts]
                if sum(sizes):
                    keys = [np.diff(found[part], prepend=np.uint64(0)) for (found, _), part in zip(tallies, parts)]
                    counts = [own[:, part] for (_, own), part in zip(tallies, parts)]
                    counts = np.concatenate(counts, axis=1).astype(np.uint64).ravel()
                    out.append((shard, int(chunk), *map(int, sizes), _packed(np.concatenate(keys)), _packed(counts), *totals))
                    totals = (0, 0, None)
            if out:
                yield _batch(out, COUNTED)

        for batch in batches:
            names = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if held and names[low] != chunk:
                    yield from counted()
                    held.clear()
                chunk = names[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from counted()

    return chunked.select("chunk", "text", "target").mapInArrow(giving_back(run), COUNTED)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _add_up(rows: pa.Table) -> pa.Table:
    """``ANSWERS`` to the rows of one shard; its words are counted in its first row."""
    given = rows.to_pylist()
    keys, counts = [], []
    for row in given:
        found, own = _unpacked(row["keys"], np.uint64), _unpacked(row["counts"], np.uint64).reshape(2, -1)
        words = row["words"]
        keys.append((np.cumsum(found[:words], dtype=np.uint64), np.cumsum(found[words:], dtype=np.uint64)))
        counts.append((own[:, :words], own[:, words:]))
    others, vocabulary = [], 0
    for kind in (0, 1):
        distinct, place = np.unique(np.concatenate([k[kind] for k in keys]), return_inverse=True)
        own = np.concatenate([c[kind] for c in counts], axis=1)
        sums = np.zeros((2, len(distinct)), np.uint64)
        for row in (0, 1):
            np.add.at(sums[row], place, own[row])
        vocabulary = vocabulary or len(distinct)
        ends = np.cumsum([len(k[kind]) for k in keys])
        others.append(np.split(sums[:, place] - own, ends[:-1], axis=1))
    out = []
    for at, row in enumerate(given):
        answer = np.concatenate([others[0][at], others[1][at]], axis=1).ravel()
        same = [row[name] for name in ("shard", "chunk", "words", "pairs")]
        out.append((*same, _packed(answer), row["tokens"], row["target_tokens"], row["mark"], 0 if at else vocabulary))
    del given, keys, counts, others
    give_back()
    return pa.Table.from_batches([_batch(out, ANSWERS)])


def count_models(chunked: DataFrame, shards: int) -> DataFrame:
    """``ANSWERS``: what all other chunks have of each chunk's keys."""
    return count_chunks(chunked, shards).groupBy("shard").applyInArrow(_add_up, ANSWERS)


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _losses(word_counts: np.ndarray, pair_counts: np.ndarray, total: float, vocabulary: int, words, pairs, second, own_words, own_pairs, own_total) -> np.ndarray:
    """Loss of each token, with the document's own counts taken out; ``words`` and ``pairs`` are places in the counts."""
    left = word_counts[words] - own_words
    word = (left + ADDED) / (total - own_total + ADDED * vocabulary)
    context, pair = np.zeros(len(words)), np.zeros(len(words))
    context[second] = left[second - 1]
    pair[second] = np.minimum(pair_counts[pairs] - own_pairs, context[second])
    return -np.log((pair + WEIGHT * word) / (context + WEIGHT))


def _own(ids: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """How often each id occurs in its own text."""
    _, place, count = np.unique(owner * (size + 1) + ids, return_inverse=True, return_counts=True)
    return count[place].astype(np.float64)


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score: one row per row of ``docs``.

    Losses are means per token in nats; ``score`` is background less target, so more is
    closer to the target. Null and empty texts: 0 tokens and null losses. An empty
    target, or none but the document itself, is a model of evenly likely words.

    The texts are read twice, and have to be dealt into the same chunks both times: a table that is read
    from files is. Of one that is not, the query fails rather than score against counts of other texts; store it first.
    """
    chunked = _in_chunks(mark_target(docs, target_ids))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = write_through(count_models(chunked, size // SHARD + 1), "lm-answers")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "target_tokens", "vocabulary")]).first()
    totals, vocabulary = (float(sums.tokens), float(sums.target_tokens)), sums.vocabulary

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        size = rows.num_rows
        if not size:
            raise ValueError("the texts were dealt into other chunks when they were read again")
        target = rows["target"].to_numpy().astype(bool)
        hashes, owner, pairs, second, *tallies = _count(WordReader(), _one(rows["text"]), target)
        given = answers.sort_by("shard").to_pylist()
        if [row["mark"] for row in given if row["mark"] is not None] != [_mark(hashes)] * bool(len(hashes)):
            raise ValueError("the texts were dealt into other chunks when they were read again")
        others = [_unpacked(row["others"], np.uint64).reshape(2, -1) for row in given]
        parts = [[o[:, : row["words"]] for o, row in zip(others, given)], [o[:, row["words"] :] for o, row in zip(others, given)]]
        counts, places = [], []
        for (found, own), part, tokens in zip(tallies, parts, (hashes, pairs)):
            counts.append((own + np.concatenate(part, axis=1) if part else own).astype(np.float64))
            places.append(np.searchsorted(found, tokens))
        own_words = _own(places[0], owner, len(tallies[0][0]))
        own_pairs = _own(places[1], owner[second], len(tallies[1][0]))
        tokens = np.bincount(owner, minlength=size)
        out = [np.ones(size), target.astype(np.float64)]
        mean = []
        for row in (0, 1):
            share = out[row][owner]
            losses = _losses(
                counts[0][row], counts[1][row], totals[row], vocabulary, *places, second,
                own_words * share, own_pairs * share[second], tokens[owner] * share,
            )
            mean.append(np.bincount(owner, losses, minlength=size) / np.maximum(tokens, 1))
        empty = tokens == 0
        arrays = [
            rows["doc_id"], pa.array(tokens.astype(np.int64)), pa.array(mean[1], mask=empty),
            pa.array(mean[0], mask=empty), pa.array(mean[0] - mean[1], mask=empty),
        ]
        return pa.Table.from_arrays(arrays, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_tokens", "long")
    for name in ("target_loss", "background_loss", "score"):
        schema = schema.add(name, "double")
    answers = answers.select("chunk", "shard", "words", "others", "mark")
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
