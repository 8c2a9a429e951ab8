"""Connected components by alternating large-star and small-star steps, each written to the shared folder.

Edges never come to the driver; only their number and a checksum do.  A node with very many neighbours is only ever met
by a partial minimum and by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktape.llm.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b")))


def roots(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``links`` (columns ``a`` and ``b``)."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = written(_small_star(_large_star(edges)).where("a <> b").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    # settled: every edge goes from a node straight to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def smallest_in_class(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``node`` and ``smallest``: the least ``smallest`` of all nodes of the same class; lone nodes keep their own."""
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classed.groupBy("root").agg(F.min("smallest").alias("smallest"))
    return written(classed.drop("smallest").join(least, "root").select("node", "smallest"), "classes")
