"""Connected components of an edge table, by rounds of joins on shrinking edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import materialise


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(a, b)``, one root per component.

    Distributed union-find: in each round a node joins the smallest of itself and its
    neighbours, in the order of a hash so that long chains fold quickly; edges are then
    drawn between the joined nodes only.  The node of the largest hash always goes, and a
    constant share of the others is expected to, so the number of rounds grows with the
    logarithm of the longest chain.  Every round is a written table; a lost executor
    costs tasks, not rounds.  Minima are combined before the shuffle, so a node with very
    many edges is no hot key there, and the join's hot keys are split by skew handling.

    Self-loops and repeated edges don't matter; null ends are left out; no edges, no rows.
    """
    current = materialise(
        edges.where(F.col("a") != F.col("b")).select(*_ordered(F.col("a"), F.col("b"))).distinct(), "edges"
    )
    rounds = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("best"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        joined = materialise(
            best.select(F.col("a").alias("node"), F.least(F.col("best"), own)["n"].alias("root")), "joined"
        )
        rounds.append(joined)
        left = joined.select(F.col("node").alias("a"), F.col("root").alias("to_a"))
        right = joined.select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        current = materialise(
            current.join(left, "a").join(right, "b")
            .where(F.col("to_a") != F.col("to_b"))
            .select(*_ordered(F.col("to_a"), F.col("to_b"))).distinct(),
            "edges",
        )
    if not rounds:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        result = result.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return result
