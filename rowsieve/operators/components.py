"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.operators.lookup import lookup
from rowsieve.plans.storage import store


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component, its smallest node, of every node that edges (a, b) join to another.

    Large-star and small-star steps alternate over stored tables until all that is left are stars around smallest nodes.
    The smallest neighbour of a node is an aggregate, which meets the node's edges by a size-checked lookup: a node
    with very many edges is in no step in one task."""
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = store(ordered.distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.unionAll(edges.select("b", "a"))
        smallest = store(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")), "large-star")
        large = lookup(edges, smallest, ["a"], F.col("b")).select(F.col("m").alias("a"), "b")
        large = store(large.where("a <> b").distinct(), "edges")
        smallest = store(large.groupBy("b").agg(F.min("a").alias("m")), "small-star")
        small = lookup(large, smallest, ["b"], F.col("a")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = store(small.where("a <> b").distinct(), "edges")
        # Torn: a node with several centres. Chained: a centre that has one. Counted, as a join might be broadcast.
        ends = edges.select("b", F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionAll(edges.select("a", F.lit(0), F.lit(1)))
        if ends.groupBy("b").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied + centre > 1 AND tied > 0").isEmpty():
            centres = edges.select("a").distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(centres.select("a", "a"))
