"""Sums over subtrees and root paths by pointer jumping.

Trees are rows ``(node, parent, …)`` whose roots have no parent. A round doubles the reach of
every node, so the number of rounds is the logarithm of the height, however deep a tree is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.lineage import discard, settle


def _further(now: DataFrame, *cols: str) -> DataFrame:
    """Where each node's pointer points from there, with columns of the node it points to."""
    return now.select(
        F.col("node").alias("_over"), F.col("jump").alias("_jump"), *(F.col(c).alias(f"_{c}") for c in cols)
    )


def over_subtrees(
    tree: DataFrame, sums: Sequence[str] = (), least: Sequence[str] = (), greatest: Sequence[str] = ()
) -> DataFrame:
    """``(node, …)`` with columns summed, or their extremes taken, over each subtree."""
    folds = {c: F.sum for c in sums} | {c: F.min for c in least} | {c: F.max for c in greatest}
    joins = (
        {c: lambda a, b: a + F.coalesce(b, F.lit(0)) for c in sums}
        | dict.fromkeys(least, F.least)
        | dict.fromkeys(greatest, F.greatest)
    )
    now = settle(tree.select("node", F.col("parent").alias("jump"), *folds))
    while not now.where(F.col("jump").isNotNull()).isEmpty():
        below = (
            now.where(F.col("jump").isNotNull())
            .groupBy(F.col("jump").alias("_to"))
            .agg(*(fold(c).alias(f"_{c}") for c, fold in folds.items()))
        )
        raised = settle(
            now.join(below, F.col("node") == F.col("_to"), "left")
            .join(_further(now), F.col("jump") == F.col("_over"), "left")
            .select(
                "node",
                F.col("_jump").alias("jump"),
                *(join(F.col(c), F.col(f"_{c}")).alias(c) for c, join in joins.items()),
            )
        )
        discard(now)
        now = raised
    return now.drop("jump")


def over_paths(tree: DataFrame, col: str) -> DataFrame:
    """``(node, col)`` summed from the root to each node."""
    now = settle(tree.select("node", F.col("parent").alias("jump"), col))
    while not now.where(F.col("jump").isNotNull()).isEmpty():
        summed = settle(
            now.join(_further(now, col), F.col("jump") == F.col("_over"), "left").select(
                "node",
                F.col("_jump").alias("jump"),
                (F.col(col) + F.coalesce(f"_{col}", F.lit(0))).alias(col),
            )
        )
        discard(now)
        now = summed
    return now.drop("jump")


def spanning_forest(adjacency: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, parent)`` by breadth-first search; ``adjacency`` is (v, w) both ways.

    No edge skips a level, so only the last two levels have to be kept from being reached again.
    """
    level = settle(roots.select("node", F.lit(None).cast(dict(roots.dtypes)["node"]).alias("parent")))
    found, seen = [level], level
    while True:
        reached = (
            level.join(adjacency, F.col("node") == F.col("v"))
            .groupBy(F.col("w").alias("node"))
            .agg(F.min("v").alias("parent"))
            .join(seen.select("node"), "node", "left_anti")
        )
        following = settle(reached)
        if following.isEmpty():
            break
        found.append(following)
        seen, level = level.unionByName(following), following
    forest = found[0]
    for part in found[1:]:
        forest = forest.unionByName(part)
    forest = settle(forest)
    discard(*found, following)
    return forest
