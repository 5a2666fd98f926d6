"""Connected components by contraction, all on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """For each node that has a link its component: node, component (any one of its nodes).

    Each round hooks every node to the neighbour that comes first in an order drawn anew for the round, twice over, and
    contracts the links, until none is left. In such an order a share of all nodes is not first among its neighbours whatever
    their names are, so the number of rounds grows with the logarithm of the longest path, also of one with names in order. Links of a node
    with very many of them combine before the shuffle; ``edges`` (one, other) need not be distinct."""
    labels, rounds = None, 0
    edges = stage(_distinct(edges), "links")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("other").alias("one"), F.col("one").alias("other")))
        def drawn(node: str, seed: int = rounds) -> Column:
            return F.struct(F.xxhash64(node, F.lit(seed)).alias("draw"), F.col(node).alias("node"))

        parent = both.groupBy("one").agg(F.min(drawn("other")).alias("first")).select(
            F.col("one").alias("node"), F.least(drawn("one"), "first")["node"].alias("up"))
        parent = stage(parent, "parents")
        jump = stage(parent.join(
            parent.select(F.col("node").alias("up"), F.col("up").alias("component")), "up",
        ).select("node", "component"), "jumps")
        if labels is None:
            labels = jump
        else:
            onward = jump.select(F.col("node").alias("component"), F.col("component").alias("next"))
            labels = stage(labels.join(onward, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")), "labels")
        for side in ("one", "other"):
            edges = edges.join(jump.select(F.col("node").alias(side), F.col("component").alias("to")), side)
            edges = edges.withColumn(side, F.col("to")).drop("to")
        edges = stage(_distinct(edges), "links")
        rounds += 1
    return edges.select(F.col("one").alias("node"), F.col("other").alias("component")) if labels is None else labels


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("one <> other").select(
        F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct()
