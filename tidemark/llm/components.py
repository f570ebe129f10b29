"""Connected components of a graph whose edges, nodes and hubs may all be too many for one task.

Alternating large and small stars: every round hangs each node's neighbours on the smallest node
it knows. Minima are partial aggregates; they are written before they are joined back, so that
both sides of the join are plain exchanges and adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Loops, repeated and reversed edges are allowed; NULL ends are ignored. No edges, no rows.
    """
    edges = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "low")
        large = written(both.where("b > a").join(lowest, "a")
                        .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        lowest = written(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        hung = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(lowest.select("a", F.col("low").alias("b")).unionAll(hung).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
