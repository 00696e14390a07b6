"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Learned filters run over
the bytes of a chunk and are max-pooled, a small layer turns the maxima into a chunk
score, and mean, largest and smallest chunk score are combined into one probability.

The network is fitted on a bounded sample of labelled rows (``SAMPLE`` per class, of
texts up to ``SAMPLE_CHARS``); every text of every row is scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from yardstats.llm.shared import fresh, giving_back

SAMPLE = 1200
SAMPLE_CHARS = 1 << 16
STEPS = 1500
BATCH = 64
CHUNK, STRIDE = 256, 224
WIDTH, EMBED, FILTERS, HIDDEN = 6, 8, 32, 16
PAD = 256  # stands for the bytes a short text lacks

Model = dict[str, np.ndarray]


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all chunks; every text has one, and the last ends where the text ends."""
    counts = np.maximum(1, -(-(sizes - CHUNK) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, np.minimum(place * STRIDE, np.maximum(0, sizes[text] - CHUNK))


def chunk_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of chunks that start at ``begin``, of texts that end at ``end``."""
    at = begin[:, None] + np.arange(CHUNK)
    found = np.full(at.shape, PAD, np.int64)
    inside = at < end[:, None]
    found[inside] = data[at[inside]]
    return found


def _pooled(model: Model, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter maxima of each chunk, before the bias, and where they are."""
    tables = np.einsum("be,wef->wbf", model["embed"], model["filters"])
    windows = CHUNK - WIDTH + 1
    found = tables[0][chunks[:, :windows]]
    for shift in range(1, WIDTH):
        found += tables[shift][chunks[:, shift : shift + windows]]
    place = found.argmax(axis=1)
    return np.take_along_axis(found, place[:, None, :], axis=1)[:, 0], place


def _inputs(pooled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    fill = np.log1p(np.minimum(sizes, CHUNK)) / np.log1p(CHUNK)
    return np.concatenate([np.maximum(pooled, 0), fill[:, None]], axis=1, dtype=np.float32)


def _combine(logits: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Per text: mean, largest and smallest chunk score. Chunks stand in text order."""
    first = np.searchsorted(text, np.arange(count))
    sums = np.add.reduceat(logits, first)
    mean = sums / np.bincount(text, minlength=count)
    return np.stack([mean, np.maximum.reduceat(logits, first), np.minimum.reduceat(logits, first)], axis=1)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def score_texts(model: Model, texts: pa.Array, block: int = 32) -> np.ndarray:
    """Probability of the label 1 for each text; null counts as empty."""
    if not len(texts):
        return np.zeros(0)
    if not model:
        return np.full(len(texts), 0.5)
    data, at = _buffers(texts)
    sizes = np.diff(at)
    text, start = chunk_starts(sizes)
    tables = np.einsum("be,wef->wbf", model["embed"], model["filters"]).astype(np.float32)
    windows, logits = CHUNK - WIDTH + 1, np.empty(len(text))
    found, part = np.empty((block, windows, FILTERS), np.float32), np.empty((block, windows, FILTERS), np.float32)
    for low in range(0, len(text), block):
        own = text[low : low + block]
        chunks = chunk_bytes(data, at[own] + start[low : low + block], at[own + 1])
        rows = len(own)
        np.take(tables[0], chunks[:, :windows], axis=0, out=found[:rows], mode="clip")
        for shift in range(1, WIDTH):
            np.take(tables[shift], chunks[:, shift : shift + windows], axis=0, out=part[:rows], mode="clip")
            found[:rows] += part[:rows]
        inputs = _inputs(found[:rows].max(axis=1) + model["bias"], sizes[own])
        hidden = np.maximum(inputs @ model["inner"] + model["inner_bias"], 0)
        logits[low : low + block] = hidden @ model["outer"] + model["outer_bias"]
    combined = _combine(logits, text, len(texts)) @ model["combine"] + model["combine_bias"]
    return 1 / (1 + np.exp(-np.clip(combined, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    weights, bias = np.array([1.0, 0.0, 0.0]), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y
        weights -= 0.05 * (x.T @ error / len(y) + decay * (weights - np.array([1.0, 0.0, 0.0])))
        bias -= 0.05 * error.mean()
    return weights, bias


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 8, steps: int = STEPS) -> Model:
    """The network for these texts and labels (0 or 1); an empty one where a label is missing.

    Steps and batch are fixed, so the work does not depend on the sample. Both labels
    weigh the same: a batch takes half of its chunks from texts of each.
    """
    if len(set(labels.tolist())) < 2:
        return {}
    rng = np.random.default_rng(seed)
    model = {
        "embed": rng.normal(0, 0.5, (257, EMBED)), "filters": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "inner": rng.normal(0, 0.25, (FILTERS + 1, HIDDEN)), "inner_bias": np.zeros(HIDDEN),
        "outer": rng.normal(0, 0.25, HIDDEN), "outer_bias": np.zeros(()),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    model["embed"][PAD] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    data, at = _buffers(texts)
    sizes = np.diff(at)
    text, start = chunk_starts(sizes)
    first, counts = np.searchsorted(text, np.arange(len(texts))), np.bincount(text, minlength=len(texts))
    by_label = [np.flatnonzero(labels == k) for k in (0, 1)]
    truth = np.repeat([0.0, 1.0], BATCH // 2)
    for step in range(1, steps + 1):
        own = np.concatenate([rng.choice(rows, BATCH // 2) for rows in by_label])
        chosen = first[own] + (rng.random(BATCH) * counts[own]).astype(np.int64)
        chunks = chunk_bytes(data, at[own] + start[chosen], at[own + 1])
        raw, place = _pooled(model, chunks)
        inputs = _inputs(raw + model["bias"], sizes[own])
        inner = inputs @ model["inner"] + model["inner_bias"]
        hidden = np.maximum(inner, 0)
        logit = hidden @ model["outer"] + model["outer_bias"]
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth) / BATCH).astype(np.float32)

        grad = {"outer": hidden.T @ error, "outer_bias": error.sum()}
        back = np.outer(error, model["outer"]) * (inner > 0)
        grad["inner"], grad["inner_bias"] = inputs.T @ back, back.sum(axis=0)
        pooled = (back @ model["inner"].T)[:, :FILTERS] * (inputs[:, :FILTERS] > 0)
        grad["bias"] = pooled.sum(axis=0)
        windows = np.take_along_axis(chunks[:, :, None], place[:, None, :] + np.arange(WIDTH)[None, :, None], axis=1)
        seen = model["embed"][windows]  # batch, width, filter, embed
        grad["filters"] = np.einsum("bf,bwfe->wef", pooled, seen)
        grad["embed"] = np.zeros_like(model["embed"])
        np.add.at(grad["embed"], windows, np.einsum("bf,wef->bwfe", pooled, model["filters"]))
        grad["embed"][PAD] = 0
        for key, value in grad.items():
            mean, square = moments[key]
            mean += 0.1 * (value - mean)
            square += 0.001 * (value * value - square)
            rate = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            model[key] = (model[key] - rate * mean / (np.sqrt(square) + 1e-7)).astype(np.float32)
    model |= {"combine": np.array([1.0, 0.0, 0.0]), "combine_bias": np.zeros(())}
    weights, bias = _fit_logistic(_chunk_scores(model, texts), labels)
    return model | {"combine": weights, "combine_bias": np.asarray(bias)}


def _chunk_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean, largest and smallest chunk score of each text."""
    eye = np.eye(3)
    logit = lambda p: np.log(p) - np.log1p(-p)
    return np.stack([logit(score_texts(model | {"combine": row}, texts)) for row in eye], axis=1)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, seed: int = 8) -> Model:
    """Fit on at most ``SAMPLE`` labelled rows of each class, chosen by a hash of the id.

    Held-out rows are never used, nor are labels that are null. Where a document has
    several labels the mean decides, 0.5 for 1.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")
    good, bad = (usable.filter(F.col("label") == label).orderBy(*order).limit(SAMPLE) for label in (1, 0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.filter(F.length("text") <= SAMPLE_CHARS)
    # At most 2 * SAMPLE ids: texts stay where they are read.
    rows = texts.join(F.broadcast(good.union(bad)), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label").toArrow()
    rows = rows.combine_chunks().sort_by("doc_id")
    texts = rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string())
    return fit(texts, rows["label"].to_numpy(), seed)


def score(model: Model, text: Column) -> Column:
    """Probability between 0 and 1 that a text is good. Null and empty texts score alike."""

    @arrow_udf(T.DoubleType())
    @giving_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score_texts(model, batch), pa.float64())

    return run(text)


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``, whole texts.

    Without labels of both kinds all texts score 0.5, which predicts 1.
    """
    rated = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(learn(docs, labels), F.col("text")).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts 1 for, with all their columns."""
    name = fresh(docs, "score")
    rated = docs.withColumn(name, score(learn(docs, labels), docs["text"]))
    return rated.filter(F.col(name) >= 0.5).select(*docs.columns)
