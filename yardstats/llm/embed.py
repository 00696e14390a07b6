"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of the rotated unit
vectors make balanced binary codes. Codes are cut into chunks; vectors that agree
in a chunk meet in its table, and meeting pairs are compared by their original vectors
in double precision. A pair that meets in several tables is counted in the first only.

A bucket is cut into blocks that meet one another, so no task holds more than two
blocks, whatever share of the vectors one bucket has. A task returns counts per vector
and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstats.llm.components import connected_components
from yardstats.llm.shared import groups, write_through

SAMPLE = 4096  # vectors that the rotations are learned on
ROUNDS = 20
BLOCK = 512  # classes of equal vectors per block
MISSED = 0.002  # expected share of pairs at the threshold that meet in no table


def learn_rotations(vectors: np.ndarray, count: int, seed: int = 3) -> list[np.ndarray]:
    """``count`` rotations of the sample's principal axes, each learned from its own random start.

    One round takes the signs of the rotated sample and then the rotation that brings
    the sample nearest to them (orthogonal Procrustes).
    """
    rng = np.random.default_rng(seed)
    size = vectors.shape[1]
    axes = np.linalg.svd(vectors, full_matrices=False)[2] if len(vectors) > size else np.eye(size)
    projected = vectors @ axes.T
    learned = []
    for _ in range(count):
        rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
            rotation = (left @ right).T
        learned.append(axes.T @ rotation)
    return learned


def plan_tables(vectors: int, size: int, cosine: float) -> tuple[int, int, int]:
    """Bits per chunk, chunks and rotations.

    A chunk has about log2(vectors) bits, as multi-index hashing prescribes, so buckets
    stay small as the table grows. A bit differs with the chance angle / pi; there are as
    many chunks as let at most ``MISSED`` of the pairs at the threshold meet nowhere.
    """
    bits = int(np.clip(np.ceil(np.log2(max(vectors, 2))) - 3, 4, min(size, 60)))
    same = (1 - np.arccos(cosine) / np.pi) ** bits
    chunks = int(np.ceil(np.log(MISSED) / np.log1p(-same)))
    return bits, chunks, -(-chunks // (size // bits))


def chunk_keys(unit: np.ndarray, rotations: list[np.ndarray], bits: int, chunks: int) -> np.ndarray:
    """The chunks of the code of each vector, as numbers.

    The vectors are not centred: the signs have to follow the angle at the origin, also
    where most vectors point the same way.
    """
    per = unit.shape[1] // bits
    weights = 1 << np.arange(bits, dtype=np.int64)
    keys = np.empty((len(unit), len(rotations) * per), np.int64)
    for place, rotation in enumerate(rotations):
        signs = (unit @ rotation >= 0)[:, : per * bits].reshape(len(unit), per, bits)
        keys[:, place * per : (place + 1) * per] = signs @ weights
    return keys[:, :chunks]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision, scaled first so that no square overflows or vanishes."""
    with np.errstate(all="ignore"):
        value = raw.astype(np.float64)
        value = value / np.abs(value).max(axis=-1, keepdims=True)
        return value / np.sqrt((value * value).sum(axis=-1, keepdims=True))


def _kind(vectors: DataFrame) -> str:
    element = vectors.schema["embedding"].dataType.elementType
    return "f4" if isinstance(element, T.FloatType) else "f8"


def _raw(vectors: DataFrame) -> DataFrame:
    """vec_id and ``raw``: the components as bytes, null where the vector links with nothing."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.column(1).to_pylist():
                value = np.array(row, kind) if row and None not in row else np.zeros(1, kind)
                rows.append(value.tobytes() if np.isfinite(_unit(value)).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["vec_id", "raw"])

    chosen = vectors.select("vec_id", "embedding")
    return chosen.mapInArrow(run, T.StructType([chosen.schema["vec_id"]]).add("raw", "binary"))


def _stack(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return _unit(np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1))


def _keyed(classes: DataFrame, size: int, kind: str, cosine: float) -> DataFrame:
    """class, raw, weight and the chunks ``keys`` of the classes of one length."""
    bits, chunks, rotations = plan_tables(classes.count(), size, cosine)
    vectors = _stack(classes.orderBy("class").limit(SAMPLE).select("raw").toArrow()["raw"], kind)
    learned = learn_rotations(vectors, rotations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_stack(batch.column("raw"), kind), learned, bits, chunks)
                column = pa.array(list(keys), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], ["class", "raw", "weight", "keys"])

    return classes.select("class", "raw", "weight").mapInArrow(run, "class binary, raw binary, weight long, keys array<long>")


def _compare(keyed: DataFrame, kind: str, cosine: float) -> DataFrame:
    """class, links, other: how many vectors of other classes a class links with, and links that span them.

    At most two rows per class, block and table: ``links`` over the pairs that meet in
    this table first, and ``other``, a class to connect with.
    """
    rows = keyed.select("class", "raw", "weight", "keys", F.posexplode("keys").alias("table", "key"))
    sizes = keyed.select(F.posexplode("keys").alias("table", "key")).groupBy("table", "key").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.filter("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    rows = rows.join(sizes, ["table", "key"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "table", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own",
        "class", "raw", "weight", "keys",
    )
    place = ["table", "key", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bounds in groups(batches, place):
            own, weight, table, x, y = (block[c].to_numpy() for c in ("own", "weight", "table", "x", "y"))
            names, unit = block["class"].to_pylist(), _stack(block["raw"], kind)
            lists = block["keys"].combine_chunks()
            keys = lists.flatten().to_numpy().reshape(len(lists), -1)
            out = [], [], []
            for low, high in bounds:
                left = low + np.flatnonzero(own[low:high] == x[low])
                right = left if x[low] == y[low] else low + np.flatnonzero(own[low:high] == y[low])
                near = unit[left] @ unit[right].T >= cosine
                if x[low] == y[low]:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                for before in range(table[low]):  # a pair counts in the first table in which it meets
                    near &= keys[left, before][:, None] != keys[right, before][None, :]
                links = np.zeros(high - low, np.int64)
                links[left - low] += near @ weight[right]
                if x[low] != y[low]:
                    links[right - low] += weight[left] @ near
                for row in np.flatnonzero(links):
                    out[0].append(names[low + row]), out[1].append(int(links[row])), out[2].append(None)
                for a, b in _forest(near, left - low, right - low, high - low):
                    out[0].append(names[low + a]), out[1].append(0), out[2].append(names[low + b])
            kinds = pa.binary(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["class", "links", "other"])

    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "class binary, links long, other binary")


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Links that connect what all links of a block connect."""
    label, edges = np.arange(size), []
    for place in np.flatnonzero(near.any(axis=1)):
        mine = left[place]
        against = right[near[place]]
        fresh, first = np.unique(label[against], return_index=True)
        for name, at in zip(fresh, first):
            if name != label[mine]:
                edges.append((int(mine), int(against[at])))
                label[label == name] = label[mine]
    return edges


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    ``n_links`` counts the other rows that link directly, ``component_id`` is the smallest
    vec_id reachable by links, ``kept`` is vec_id = component_id. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are kept;
    so do vectors of different lengths. Equal vectors are one class with a weight; they
    always link. A null id is never the smallest; where all ids of a component are null,
    so is ``component_id``, and the rows are kept. No rows give no rows.
    """
    kind = _kind(vectors)
    units = write_through(_raw(vectors).withColumn("class", F.unhex(F.md5("raw"))), "vectors")
    classes = units.filter("raw is not null").groupBy("class").agg(
        F.first("raw").alias("raw"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id")
    )
    classes = write_through(classes, "vector-classes")
    length, found = F.octet_length("raw"), []
    for (size,) in classes.select(length).distinct().collect():  # one row per length, as a rule one
        keyed = write_through(_keyed(classes.filter(length == size), size // int(kind[1]), kind, cosine), "vector-keys")
        found.append(write_through(_compare(keyed, kind, cosine), "vector-links"))
    if not found:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    label = connected_components(links.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.join(label, classes["class"] == label["node"], "left").join(counted, "class", "left").select(
        "class", "weight", "least_id", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).alias("links")
    )
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select(
        "class", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links")
    )
    joined = units.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    joined = joined.withColumn("component_id", component)
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
