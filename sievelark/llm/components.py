"""Connected components by contraction: every round hooks each node to its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelark.plans.shared import write_shared


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for the nodes of ``edges`` (u, v).

    A round is an aggregate with partial sums before its shuffle and two joins; the edges that remain
    join different contracted nodes. A star is done in one round, a path of n nodes in about log n. Each
    round is written to the shared folder, so a lost executor never costs more than a round.
    """
    edges = write_shared(edges.select("u", "v").filter(F.col("u") != F.col("v")), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("up"))
        hooks = write_shared(hooks, "hooks")
        rounds.append(hooks)
        left = edges.join(hooks, "u").select(F.col("up").alias("a"), F.col("v").alias("u"))
        left = left.join(hooks, "u").select("a", F.col("up").alias("b")).filter(F.col("a") != F.col("b"))
        edges = write_shared(
            left.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rounds[0].select(F.col("u").alias("node"), F.col("up").alias("root"))
    for hooks in rounds[1:]:
        further = hooks.select(F.col("u").alias("root"), "up")
        roots = roots.join(further, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return roots
