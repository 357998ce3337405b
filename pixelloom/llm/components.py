"""Connected components by alternating large-star and small-star, as joins and aggregations.

Defined results: edges with a null end and loops are ignored; no edges give no rows. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Edges of a task, about.
EDGES = 100_000


def tasks(edges: int) -> int:
    """As many tasks as the edges need, so that a handful of them doesn't go through hundreds of tiny files."""
    return max(1, -(-edges // EDGES))


def connected(edges: DataFrame) -> DataFrame:
    """`node` and `component` (the smallest node that it reaches) of every node of edges(a, b) that isn't a component's smallest."""
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = shared.cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(high, low).distinct())
    was, state = None, _state(now)
    while state[0] and state != was:
        few = tasks(state[0])
        now = now.coalesce(few)
        # Large star: every larger neighbour of a node is linked with the smallest of the node and its neighbours.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").coalesce(2 * few).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour of a node, and the node, is linked with the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").coalesce(2 * few)
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = shared.cut(small.coalesce(2 * few).where("u <> v").distinct().coalesce(2 * few))
        was, state = state, _state(now)
    shared.release(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """The number of edges(u, v) and a sum of their hashes; equal before and after a pair of stars when these change nothing more."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """What `connected` gives for the edges behind known(node, component) and edges(a, b) together, from stars over components only."""
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    new = connected(ends).select(F.col("node").alias("_was"), F.col("component").alias("_now"))
    moved = known.join(new, F.col("component") == F.col("_was"), "left").select("node", F.coalesce("_now", "component").alias("component"))
    return shared.cut(moved.unionAll(new.toDF("node", "component")).coalesce(2 * tasks(known.count() + new.count())))
