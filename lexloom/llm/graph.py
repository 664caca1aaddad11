"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no task holds a component and
the number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    ``edges`` has the columns ``a`` and ``b``; loops and repeated edges do no harm and an
    empty input gives an empty result.  The result is a table in the shared folder.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_steps):
        nxt = materialize(_small_star(_large_star(current)), "edges")
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(current)
        current = nxt
        if tuple(state) == seen:
            roots = current.select(F.col("b").alias("node")).distinct()
            labels = current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
            out = materialize(labels, "labels")
            discard(current)
            return out
        seen = tuple(state)
    raise RuntimeError("components did not settle")
