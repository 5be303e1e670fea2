"""Connected components of a distributed edge list, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex of ``edges``; component is the smallest id that can be reached.

    Each round hooks a vertex to its smallest neighbour, jumps once along the hooks and replaces the edges by those
    between different hooks, so that few rounds remain even for chains. All rounds are joins and aggregates with
    partial sums; what is kept of a round is written to the shared folder. Self loops are allowed and keep a vertex in
    the result; repeated and reversed edges change nothing. No edges: an empty table.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(both.distinct(), "cc-edges")
    hooks: list[DataFrame] = []
    while not hooks or not left.isEmpty():
        hook = left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "id")
        hook = materialize(hook, "cc-hook")
        up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
        hook = materialize(hook.join(up, "to").select("id", F.col("top").alias("to")), "cc-jump")
        hooks.append(hook)
        at_a = hook.select(F.col("id").alias("a"), F.col("to").alias("x"))
        at_b = hook.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = left.where("a < b").join(at_a, "a").join(at_b, "b").where("x != y").select("x", "y").distinct()
        moved = moved.unionByName(moved.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
        left = materialize(moved.select(F.col("x").alias("a"), F.col("y").alias("b")), "cc-edges")
    out = hooks[0].select("id", F.col("to").alias("component"))
    for hook in hooks[1:]:
        up = hook.select(F.col("id").alias("component"), F.col("to").alias("top"))
        out = out.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return out
