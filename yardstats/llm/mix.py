"""Mixing sources to target weights by repetition rates.

The words of each source are summed, a repetition rate is derived per source, and
every document is emitted floor(rate) times plus once more with the fraction as
probability. That draw is a hash of seed and document id, so reruns agree whatever
the partitioning, also after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardstats.llm.shared import count_words, fresh, write_through

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2.0
SEED = 20


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST
) -> DataFrame:
    """Target words per source; ``sizes``: source, source_size, one row per source.

    ``weights`` go round over the sources in code point order, null last. All targets
    together are ``budget`` times all words. A target stops at ``most`` times its
    source; what lies above is shared among the others by weight until none is above.
    With the sources in the order of cap by weight that is one level: the first
    source whose share of what is left fits under its cap fixes the level for it and
    all that follow. Sources without words, and an empty table, give targets of 0.

    The windows run over one row per source, not over documents.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn % len(weights) + 1))
    ranked = ranked.withColumn("cap", most * F.col("source_size").cast("double"))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    wanted = F.sum("source_size").over(whole).cast("double") * budget
    ranked = ranked.withColumn("level", (wanted - full) / open_weight)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # Levels rise while sources are still filled up, and fall from the first that fits.
    ranked = ranked.withColumn("level", F.max(fits).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, source_size: Column, target: Column, seed: int = SEED) -> Column:
    """How often the mix takes a document: floor(rate), plus 1 with the fraction as chance."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    Null text: size 0. Null source: a source of its own. Rows with one doc_id draw
    alike. Texts are read once: ids and sizes are stored in the shared folder.
    """
    sized = write_through(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, **shares).withColumnRenamed("source", "_source")
    planned = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    taken = copies(F.col("doc_id"), F.col("source_size"), F.col("target"), seed)
    return planned.withColumn("copies", taken)


def emit_mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it.

    The columns of ``docs``, then ``_copy`` (1, 2 ...), which takes the place of one that ``docs`` has. Only the rates, one row per
    source, are joined to the texts; a source's rows are never gathered.
    """
    sizes = docs.select("source", count_words(F.col("text")).alias("_size"))
    sources = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    source, size, target = (fresh(docs, name) for name in ("mix_source", "mix_size", "mix_target"))
    targets = source_targets(sources, **shares).select(
        F.col("source").alias(source), F.col("source_size").alias(size), F.col("target").alias(target)
    )
    targets = write_through(targets, "mix-targets")
    taken = copies(docs["doc_id"], F.col(size), F.col(target), seed)
    numbered = F.explode(F.sequence(F.lit(1), taken.cast("int")))
    joined = docs.join(targets, docs["source"].eqNullSafe(F.col(source))).filter(taken > 0)
    return joined.select(*[docs[c] for c in docs.columns if c.lower() != "_copy"], numbered.alias("_copy"))


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3
  WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, {MOST}::DOUBLE * source_size AS cap FROM sources),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {BUDGET}::DOUBLE - coalesce(sum(cap) OVER
    (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, coalesce(
    (SELECT max(level) FROM levels WHERE level <= cap / weight), 0.0) * weight) AS target FROM levels),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated
"""
