"""Connected components by alternating large-star and small-star rounds.

Each round links the neighbours of a node to the smallest of them and stores the edges
in the shared folder, until all edges lead to a root. Only that answer reaches the
driver. A node with very many neighbours is pre-aggregated for its minimum, and stands on the big side
of the join only, which adaptive joins split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstats.llm.shared import write_through


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node points to one root only, and no root points on."""
    pointing = edges.groupBy("a").agg(F.count(F.lit(1)).alias("edges"))
    roots = edges.select(F.col("b").alias("a")).distinct()
    wrong = pointing.filter("edges > 1").select("a").union(pointing.join(roots, "a", "left_semi").select("a"))
    return wrong.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger (a) to the smaller (b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b of one orderable type, no nulls).

    ``component`` is the smallest node that can be reached. Loops and repeated edges
    change nothing; no edges give no rows. A node with a loop only is not listed.
    """
    pointed = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = write_through(pointed.distinct(), "edges")
    while not _all_stars(edges):
        edges = write_through(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
