"""Near-duplicates by HyperMinHash.

A document's set of word shingles is hashed once. Each of 256 buckets keeps its
smallest hash as a register: the number of leading zeros and ten bits behind the first
one. Bands of registers find candidates, registers estimate the Jaccard similarity,
corrected for chance collisions, and candidates that may reach the threshold are
verified on the full sets of whole texts.

Documents with equal sets are one node. Nodes that share a band are not compared all
with all. First every node is compared with one node of its bucket, so that a large
group of near copies becomes one component at about one comparison per member. What
then still is apart in a bucket is estimated in blocks, each pair in the first band it
shares only; the nodes that may link travel on with their texts, and the task that has
a block compares the full sets of pairs that nothing connects yet. It returns links that
connect something, at most one per node, and so does not emit the pairs of a group. No
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstats.llm.components import connected_components
from yardstats.llm.shared import fresh, giving_back, groups, write_through
from yardstats.llm.words import WordReader, mix, shingle_sets

REGISTERS = 256
MANTISSA = 10
WIDTH = 5
STAR_ROUNDS = 2
BLOCK = 2048  # nodes of a bucket that are compared with as many others by their registers
TEXT_BLOCK = 256  # and by their texts

#: Registers per band, by threshold. From 27 % on, a pair at the threshold misses all bands with a
#: chance below 3e-4 (at 85 %: 4e-5); one of a group has as many chances as it has links.
BAND_ROWS = [(85, 8), (80, 7), (75, 6), (65, 4), (50, 3), (0, 2)]
BROADCAST_ROWS = 200_000  # of nodes whose texts are wanted; more are joined by a shuffle
BAND_BITS = 7  # of a key, for the number of its band


def registers(shingles: np.ndarray) -> np.ndarray:
    """256 registers of a sorted set of hashes; 0: the bucket is empty."""
    low = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
    first = np.searchsorted(shingles, low)
    until = np.append(first[1:], len(shingles))
    out = np.zeros(REGISTERS, np.uint16)
    full = until > first
    rest = (shingles[first[full]] << np.uint64(8)) >> np.uint64(16)  # 48 bits, exact as a double
    part, power = np.frexp(rest.astype(np.float64))
    bits = np.where(rest > 0, (part - 0.5) * (2 << MANTISSA), 0).astype(np.int64)
    zeros = 48 - np.where(rest > 0, power, 0)
    out[full] = (zeros << MANTISSA) + bits + 1
    return out


def bands(found: np.ndarray, rows: int) -> np.ndarray:
    """One key per band that is not empty throughout; its last bits are the number of the band."""
    count = REGISTERS // rows
    cut = found[: count * rows].reshape(count, rows).astype(np.uint64)
    keys = np.zeros(count, np.uint64)
    for place in range(rows):
        keys = mix(keys + cut[:, place] + np.uint64(place + 1))
    keys = (mix(keys) << np.uint64(BAND_BITS)) + np.arange(count, dtype=np.uint64)
    return keys[cut.any(axis=1)].view(np.int64)


def first_shared(left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """The first band in which registers ``left`` and ``right`` (both n x 256) agree and are not all empty."""
    count = REGISTERS // rows
    shape = (*right.shape[:-1], count, rows)
    equal = (left == right)[..., : count * rows].reshape(shape).all(axis=-1)
    return (equal & right[..., : count * rows].reshape(shape).any(axis=-1)).argmax(axis=-1)


def _band_rows(percent: int) -> int:
    return next(rows for least, rows in BAND_ROWS if percent >= least)


def collision_rate() -> float:
    """Chance that the registers of two different smallest hashes are equal.

    Both have the same leading zeros with chance 1/3, and the same bits behind.
    """
    return 1 / 3 / (1 << MANTISSA)


def may_reach(left: np.ndarray, right: np.ndarray, percent: int, slack: float = 5.0) -> np.ndarray:
    """Which rows of ``left`` may have the threshold's similarity with those of ``right`` (broadcast).

    The share of equal registers among those not empty in both, less what collides by
    chance, may fall short of the threshold by ``slack`` standard deviations.
    """
    used = ((left != 0) | (right != 0)).sum(axis=-1)
    equal = ((left == right) & (left != 0)).sum(axis=-1)
    chance = collision_rate()
    estimate = (equal / np.maximum(used, 1) - chance) / (1 - chance)
    goal = percent / 100
    return estimate >= goal - slack * np.sqrt(goal * (1 - goal) / np.maximum(used, 1))


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, node, registers, bands: one row per row of ``docs``; whole texts.

    ``node`` is a digest of the set, null when it is empty; ``mark`` a hash of the text.
    """
    rows = _band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        for batch in batches:
            sizes, nodes, found, keys = [], [], [], []
            for shingles in shingle_sets(reader, batch.column(2), WIDTH):
                sizes.append(len(shingles))
                if not len(shingles):
                    nodes.append(None), found.append(None), keys.append([])
                    continue
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                mine = registers(shingles)
                found.append(mine.tobytes())
                keys.append(bands(mine, rows))
            columns = [
                *batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                pa.array(found, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "node", "registers", "bands"])

    chosen = _marked(docs)
    schema = T.StructType([chosen.schema["doc_id"], chosen.schema["mark"]])
    schema = schema.add("n_shingles", "long").add("node", "binary").add("registers", "binary")
    return chosen.mapInArrow(giving_back(run), schema.add("bands", T.ArrayType(T.LongType())))


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, share: int = 64) -> DataFrame:
    """The pairs (a, b) that link: 100 * intersection >= percent * union of the full sets.

    ``texts``: node, text. The texts to compare with one node ``b`` travel in shares of
    about ``share``, so a node that very many are compared with is dealt out. A task
    holds one set and one batch at a time.
    """
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("count"))
    deal = F.pmod(F.xxhash64("a"), F.ceil(F.col("count") / share)).alias("part")
    dealt = write_through(pairs.join(counts, "b").select("a", "b", deal), "minhash-pairs")
    centres = dealt.select("b", "part").distinct()
    side = F.lit(1)
    members = dealt.join(texts, dealt["a"] == texts["node"]).select("b", "part", side.alias("side"), "a", "text")
    centres = centres.join(texts, centres["b"] == texts["node"]).select(
        "b", "part", F.lit(0).alias("side"), F.col("b").alias("a"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, centre, held = WordReader(), None, np.zeros(0, np.uint64)
        for batch in batches:
            linked = [], []
            names = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for b, a, member, shingles in zip(*names, shingle_sets(reader, batch.column(4), WIDTH)):
                if not member:
                    centre, held = b, shingles
                elif b == centre:
                    both = len(np.intersect1d(held, shingles, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(shingles) - both):
                        linked[0].append(a), linked[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in linked], ["a", "b"])

    dealt_texts = members.union(centres).repartition("b", "part").sortWithinPartitions("b", "part", "side")
    return dealt_texts.mapInArrow(giving_back(run), "a binary, b binary")


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """key, node, label: ``label`` is the component found so far."""
    if links is None:
        return members.select("key", "node", F.col("node").alias("label"))
    found = connected_components(links)
    return members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))


def _open(members: DataFrame) -> DataFrame:
    """Members of the keys that hold more than one label; the two of a key of two have been compared."""
    spread = members.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("count")
    )
    return members.join(spread.filter("least <> most and count > 2").select("key"), "key", "left_semi")


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose registers say that they may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3)
            )
            yield batch.select([0, 1]).filter(pa.array(may_reach(left, right, percent)))

    of_a = sketches.select(F.col("node").alias("a"), F.col("registers").alias("ra"))
    of_b = sketches.select(F.col("node").alias("b"), F.col("registers").alias("rb"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "ra", "rb").mapInArrow(giving_back(run), "a binary, b binary")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """key, x, y, node, label, side: the rows of ``members`` in the blocks they are compared in.

    The nodes of a key with its most frequent label are not compared with each other.
    The others (side 0) are cut into blocks that meet one another and the blocks of the
    first (side 1). So a group in which few are apart is copied about once.
    """
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("count"))
    largest = by_label.groupBy("key").agg(
        F.sum("count").alias("all"), F.max(F.struct("count", "label")).alias("top")
    )
    blocks = lambda rows: F.ceil(rows / block).cast("int")
    largest = largest.select(
        "key", F.col("top.label").alias("top"), blocks(F.col("all") - F.col("top.count")).alias("few"),
        blocks(F.col("top.count")).alias("many"),
    ).filter("few > 0")
    placed = members.join(largest, "key").withColumn("side", (F.col("label") == F.col("top")).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("many")).otherwise(F.col("few"))).cast("int")
    placed = placed.withColumn("own", own)
    few = F.sequence(F.lit(0), F.col("few") - 1)
    # Blocks of the many are numbered downwards from -1.
    with_few = F.transform(few, lambda o: F.struct(F.least("own", o).alias("y"), F.greatest("own", o).alias("x")))
    with_many = F.transform(F.sequence(F.lit(1), F.col("many")), lambda o: F.struct((-o).alias("y"), F.col("own").alias("x")))
    from_many = F.transform(few, lambda o: F.struct((-F.col("own") - 1).alias("y"), o.alias("x")))
    meets = F.when(F.col("side") == 1, from_many).otherwise(F.concat(with_few, with_many))
    dealt = placed.select("key", "node", "label", "own", "side", F.explode(meets).alias("met"))
    return dealt.select("key", "met.x", "met.y", "node", "label", "own", "side")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for rows, bounds in groups(batches, ["key", "x", "y"]):
        for low, high in bounds:
            yield rows.slice(low, high - low)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the group's block x, rows of what it meets, whether that is x itself."""
    own, side = group["own"].to_numpy(), group["side"].to_numpy()
    x, y = group["x"][0].as_py(), group["y"][0].as_py()
    left = np.flatnonzero((side == 0) & (own == x))
    right = np.flatnonzero(side == 1) if y < 0 else np.flatnonzero((side == 0) & (own == y))
    return left, right, x == y


def _live(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """key, node of the nodes that may link with a differently labelled one, in the first key they share."""
    rows = _band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            key = group["key"][0].as_py()
            band = key & ((1 << BAND_BITS) - 1)
            left, right, same = _sides(group)
            label = np.unique(np.array(group["label"].to_pylist(), object), return_inverse=True)[1]
            found = np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            live = np.zeros(len(label), bool)
            for place, i in enumerate(left):
                against = right[place + 1 :] if same else right
                against = against[label[against] != label[i]]
                against = against[may_reach(found[i], found[against], percent)]
                if len(against):
                    against = against[first_shared(found[i], found[against], rows) == band]
                live[against] = True
                live[i] |= len(against) > 0
            if live.any():
                nodes = group["node"].combine_chunks().filter(pa.array(live))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(nodes), pa.int64()), nodes], ["key", "node"])

    dealt = _dealt(members, BLOCK).join(sketches.select("node", "registers"), "node")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(giving_back(run), "key long, node binary").distinct()


def _linked_in_blocks(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that connect the nodes of each key, found on full sets of whole texts.

    Within a block, pairs that are already connected are not compared, so a task returns
    fewer links than it has nodes.
    """
    rows = _band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        for group in _groups(batches):
            left, right, same = _sides(group)
            parent = np.unique(np.array(group["label"].to_pylist(), object), return_inverse=True)[1]
            sets = list(shingle_sets(reader, group["text"].combine_chunks(), WIDTH))
            sizes = np.array([len(s) for s in sets])
            found = np.stack([registers(s) for s in sets])
            band = group["key"][0].as_py() & ((1 << BAND_BITS) - 1)
            node, a, b = group["node"], [], []
            for place, i in enumerate(left):
                against = right[place + 1 :] if same else right
                fits = (100 * sizes[against] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[against])
                against = against[fits & (parent[against] != parent[i])]
                against = against[may_reach(found[i], found[against], percent)]
                if len(against):
                    against = against[first_shared(found[i], found[against], rows) == band]
                for j in against:
                    if parent[i] == parent[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        a.append(node[int(i)].as_py()), b.append(node[int(j)].as_py())
                        parent[parent == parent[j]] = parent[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = _dealt(members, TEXT_BLOCK).join(texts, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(giving_back(run), "a binary, b binary")


def _distinct_keys(members: DataFrame) -> DataFrame:
    """Members of one key, that of the first band, for each set of nodes."""
    signed = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"), F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(9), "node")).alias("two"),
    )
    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1))
    kept = signed.filter("count > 1").groupBy("count", "one", "two").agg(F.min(F.struct(band.alias("band"), F.col("key"))).alias("first"))
    return members.join(kept.select("first.key"), "key", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, mark, n_shingles, node, component, component_id, kept: one row per row of ``docs``.

    ``component_id`` is the smallest doc_id among the documents reachable by links, the
    document's own included; ``kept`` is doc_id = component_id. Documents without words
    link with nothing and are kept, also several of them. A null id is never the
    smallest; where all ids of a group are null, so is ``component_id``, and the rows
    are kept. Repeated rows are one node. No rows give no rows. ``mark`` is a hash of the
    text, ``node`` one of its set and ``component`` the smallest node of the group.
    """
    sketches = write_through(sketch(docs, percent), "minhash-sketches")
    nodes = sketches.filter("node is not null")
    first = nodes.groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.max(F.struct("doc_id", "mark", "registers", "bands")).alias("one")
    )
    first = write_through(first.select("node", "least_id", "one.doc_id", "one.mark", "one.registers", "one.bands"), "minhash-nodes")
    keyed = first.select(F.explode("bands").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    members = write_through(keyed.join(shared, "key", "left_semi"), "minhash-shared")
    members = write_through(_distinct_keys(members), "minhash-members")
    candidates = members.select("node").distinct()
    candidates = write_through(first.join(candidates, "node", "left_semi").drop("bands", "least_id"), "minhash-candidates")

    links, apart = None, _labelled(members, None)
    for turn in range(STAR_ROUNDS):
        # One order of nodes for all keys: the keys of a large group agree on a few centres, and a
        # node's pairs with them fall together. An order per key would make a pair per key and node.
        order = F.struct(F.xxhash64(F.lit(turn), "node").alias("order"), "node", "label")
        centres = apart.groupBy("key").agg(F.min(order).alias("centre"))
        pairs = apart.join(centres, "key").filter(F.col("label") != F.col("centre.label"))
        pairs = pairs.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct()
        pairs = write_through(_estimated(pairs, candidates, percent), "minhash-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        found = write_through(_verify(pairs, _texts(docs, candidates, wanted), percent), "minhash-links")
        links = found if links is None else links.union(found)
        apart = write_through(_open(_labelled(members, links)), "minhash-apart")
    live = write_through(_live(apart, candidates, percent), "minhash-live")
    rest = apart.join(live, ["key", "node"], "left_semi")
    found = _linked_in_blocks(rest, _texts(docs, candidates, live.select("node")), percent)
    links = links.union(write_through(found, "minhash-links"))
    label = connected_components(links)
    named = first.select("node", "least_id").join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component", "component_id")
    joined = sketches.select("doc_id", "mark", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    joined = joined.withColumn("component_id", component)
    return joined.select(
        "doc_id", "mark", "n_shingles", "node", "component", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates, with all their columns.

    That with the smallest doc_id stays (null last), of equal ids that with the smaller
    ``mark``, of wholly equal texts under one id any one row. Texts without words stay.
    """
    found = write_through(near_duplicates(docs, percent).filter("node is not null").select("doc_id", "mark", "component"), "minhash-groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    winners = found.groupBy("component").agg(F.min(order).alias("winner"))
    own_id, own_mark = fresh(docs, "kept_id"), fresh(docs, "kept_mark")
    rows = found.groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.join(winners, "component").select(
        F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), "rows",
        (F.col("doc_id").eqNullSafe(F.col("winner.id")) & (F.col("mark") == F.col("winner.mark"))).alias("wins"),
    )
    rows = write_through(rows.filter("not wins or rows > 1"), "minhash-dropped")
    listed = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_mark))
    single = docs.join(listed, same, "left_anti")
    repeated = docs.join(listed.filter("wins"), same).dropDuplicates([own_id, own_mark])
    return single.unionByName(repeated.select(*[docs[c] for c in docs.columns]))


def _texts(docs: DataFrame, candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node), one row each, stored.

    The list is broadcast where it is short, so that the texts stay where they are read;
    beyond that it is joined by a shuffle.
    """
    listed = candidates.join(wanted.distinct(), "node", "left_semi").select("node", "mark", F.col("doc_id").alias("wanted_id"))
    listed = write_through(listed, "minhash-wanted")
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    texts = _marked(docs).join(listed, "mark").filter(F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    return write_through(texts.groupBy("node").agg(F.first("text").alias("text")), "minhash-texts")
