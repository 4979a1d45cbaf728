"""Blocks of a graph: what stays connected when any one node goes (Tarjan & Vishkin 1985).

A spanning forest is numbered in preorder. A subtree that reaches outside the range of its
parent's subtree shares a block with it, and so do the ends of edges between subtrees; the
components of these relations are the blocks. Blocks meet in cut nodes only, so whatever
goes from one block to another passes a cut node. In each block a node stands for all that is reached
through it, itself included: its weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.components import connected_components
from tagweave.operators.forest import over_paths, over_subtrees, spanning_forest
from tagweave.operators.lineage import discard, settle


@dataclass(frozen=True)
class Blocks:
    """``members``: (block, node, weight, total), ``total`` being the size of the component.

    ``edges``: (block, v, w, ways), once per pair of neighbours, with its parallel edges counted.
    Nodes without neighbours are in no block.
    """

    members: DataFrame
    edges: DataFrame


def _preorder(forest: DataFrame) -> DataFrame:
    """``(node, parent, size, pre)``: size of the subtree and number of the node in its tree."""
    sizes = over_subtrees(forest.withColumn("size", F.lit(1).cast("long")), ["size"])
    sized = forest.join(sizes, "node")
    earlier = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("parent").isNull(), 0).otherwise(1 + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    # roots are many rows without a parent: they are numbered apart from the window
    inner = sized.where(F.col("parent").isNotNull()).withColumn("pre", step.cast("long"))
    roots = sized.where(F.col("parent").isNull()).withColumn("pre", F.lit(0).cast("long"))
    sized = settle(inner.unionByName(roots))
    tree = settle(sized.drop("pre").join(over_paths(sized, "pre"), "node"))
    discard(sized)
    return tree


def biconnected_blocks(edges: DataFrame, src: str = "src", dst: str = "dst") -> Blocks:
    """The blocks of an undirected graph; loops do not matter."""
    one_way = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("w"))
    pairs = settle(
        one_way.where(F.col("v") < F.col("w")).groupBy("v", "w").agg(F.count("*").alias("ways"))
    )
    adjacency = pairs.select("v", "w").unionByName(pairs.select(F.col("w").alias("v"), F.col("v").alias("w")))
    parts = settle(connected_components(pairs, "v", "w"))
    roots = parts.where(F.col("node") == F.col("component"))
    tree = _preorder(spanning_forest(adjacency, roots))

    def side(end: str) -> DataFrame:
        return tree.select(
            F.col("node").alias(end),
            *(F.col(c).alias(f"{end}_{c}") for c in ("parent", "size", "pre")),
        )

    near = adjacency.join(side("v"), "v").join(tree.select(F.col("node").alias("w"), F.col("pre").alias("w_pre")), "w")
    # what a node's own edges reach, leaving out the one to its parent
    off_tree = near.where(~F.col("w").eqNullSafe(F.col("v_parent")))
    reach = off_tree.groupBy(F.col("v").alias("node")).agg(F.min("w_pre").alias("_low"), F.max("w_pre").alias("_high"))
    seeds = tree.join(reach, "node", "left").select(
        "node",
        "parent",
        F.least("pre", "_low").alias("low"),
        F.greatest("pre", "_high").alias("high"),
    )
    span = over_subtrees(seeds, least=["low"], greatest=["high"])
    across = (
        pairs.join(side("v"), "v")
        .join(side("w"), "w")
        .where(
            (F.col("v_pre") + F.col("v_size") <= F.col("w_pre"))
            | (F.col("w_pre") + F.col("w_size") <= F.col("v_pre"))
        )
        .select(F.col("v").alias("src"), F.col("w").alias("dst"))
    )
    inner = tree.where(F.col("parent").isNotNull())
    beyond = (
        inner.select("node", F.col("parent").alias("v"))
        .join(span, "node")
        .join(side("v"), "v")
        .where(F.col("v_parent").isNotNull())
        .where((F.col("low") < F.col("v_pre")) | (F.col("high") >= F.col("v_pre") + F.col("v_size")))
        .select(F.col("v").alias("src"), F.col("node").alias("dst"))
    )
    joined = connected_components(across.unionByName(beyond))
    block = F.coalesce("component", "node")
    # the block of the edge from each node to its parent
    owned = settle(inner.join(joined, "node", "left").select(block.alias("block"), "node", "parent", "size"))
    totals = parts.groupBy("component").agg(F.count("*").alias("total"))
    totals = parts.join(totals, "component").select("node", "total")
    hanging = owned.groupBy("block", F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
    below = F.coalesce("below", F.lit(0))
    own = owned.select("block", "node", "size").join(hanging, ["block", "node"], "left")
    own = own.join(totals, "node").select("block", "node", (F.col("size") - below).alias("weight"), "total")
    top = hanging.join(owned.select("block", "node"), ["block", "node"], "left_anti").join(totals, "node")
    top = top.select("block", "node", (F.col("total") - F.col("below")).alias("weight"), "total")
    members = settle(own.unionByName(top))

    child = [owned.select(F.col("node").alias(e), F.col("parent").alias(f"{e}_up"), F.col("block").alias(f"{e}_block")) for e in "vw"]
    known = pairs.join(child[0], "v", "left").join(child[1], "w", "left")
    # an edge belongs with its lower end's; of edges between subtrees both ends agree
    which = F.when(F.col("w").eqNullSafe(F.col("v_up")), F.col("v_block")).otherwise(F.col("w_block"))
    return Blocks(members, known.select(which.alias("block"), "v", "w", "ways"))


def cut_nodes(blocks: Blocks) -> DataFrame:
    """``(node, parts)``: nodes without which their component falls into ``parts`` pieces."""
    counted = blocks.members.groupBy("node").agg(F.count("*").alias("parts"))
    return counted.where(F.col("parts") > 1)
