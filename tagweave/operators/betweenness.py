"""Betweenness centrality (Brandes 2001) as joins and aggregations, block by block.

Pairs whose ends lie behind different blocks of a node pass that node for certain, so they are
counted from sizes alone. What is left are paths within blocks of three and more nodes. There each
node stands for all that hangs on it (Puzis et al. 2012), so a search holds one row per node of a
block and node of the same block, never per pair of a component. Trees need no search at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.blocks import Blocks, biconnected_blocks
from tagweave.operators.lineage import discard, settle

PAIRS_PER_BATCH = 500_000_000
HUB = 1000


def betweenness(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    pairs_per_batch: int = PAIRS_PER_BATCH,
    hub: int = HUB,
) -> DataFrame:
    """``(node, betweenness)``: undirected, unweighted, each pair counted once.

    Parallel edges are separate paths. Sources go in as many batches as ``pairs_per_batch`` asks
    for; the neighbours of a node with more than ``hub`` are dealt over several join keys.
    The result is exact.
    """
    edges = settle(edges.select(src, dst))
    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    blocks = biconnected_blocks(edges, src, dst)
    total = settle(
        nodes.join(_between_blocks(blocks), "node", "left").select(
            "node", F.coalesce("part", F.lit(0.0)).alias("part")
        )
    )
    members = _searched(blocks)
    pairs = members.agg(F.sum(F.col("n").cast("double")).alias("p")).first()["p"]
    if pairs is None:
        return total.select("node", F.col("part").alias("betweenness"))
    adjacency = _neighbours(blocks, members, hub)
    n_batches = int(-(-pairs // pairs_per_batch))
    # one running sum, written after each batch
    for batch in range(n_batches):
        starts = members
        if n_batches > 1:
            starts = members.where(F.pmod(F.xxhash64("id"), F.lit(n_batches)) == batch)
        scores = _dependencies(starts, adjacency)
        if scores is None:
            continue
        inside = scores.join(members.select("id", "node"), "id").select("node", (F.col("part") / 2).alias("part"))
        before, total = total, settle(
            total.unionByName(inside).groupBy("node").agg(F.sum("part").alias("part"))
        )
        discard(before)
    return total.select("node", F.col("part").alias("betweenness"))


def _between_blocks(blocks: Blocks) -> DataFrame:
    """Pairs of nodes in different pieces that each node holds together."""
    behind = F.col("total").cast("double") - F.col("weight")
    sums = blocks.members.groupBy("node").agg(
        F.sum(behind).alias("all"), F.sum(behind * behind).alias("squares")
    )
    return sums.select("node", ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("part"))


def _searched(blocks: Blocks) -> DataFrame:
    """``(id, block, node, weight, n)`` of blocks of three or more; a node has an id per block."""
    sizes = blocks.members.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 2)
    return settle(
        blocks.members.join(sizes, "block").select(
            F.monotonically_increasing_id().alias("id"), "block", "node", "weight", "n"
        )
    )


def _neighbours(blocks: Blocks, members: DataFrame, hub: int) -> DataFrame:
    """``(v, w, ways, weight, deal, deals)`` both ways, with the weight of ``v``.

    Rows of a hub are dealt over ``deals`` keys.
    """
    ids = members.select("block", "node", "id", "weight")
    links = blocks.edges
    for end in ("v", "w"):
        links = links.join(
            ids.select("block", F.col("node").alias(end), F.col("id").alias(f"{end}_id"), F.col("weight").alias(f"{end}_weight")),
            ["block", end],
        )
    links = settle(links.select("v_id", "w_id", "ways", "v_weight", "w_weight"))
    both = links.select(F.col("v_id").alias("v"), F.col("w_id").alias("w"), "ways", F.col("v_weight").alias("weight"))
    both = both.unionByName(
        links.select(F.col("w_id").alias("v"), F.col("v_id").alias("w"), "ways", F.col("w_weight").alias("weight"))
    )
    deals = both.groupBy("v").agg(F.ceil(F.count("*") / hub).cast("int").alias("deals"))
    deal = F.pmod(F.xxhash64("w"), F.col("deals")).cast("int")
    return settle(both.join(deals, "v").withColumn("deal", deal))


def _next_to(level: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Rows of a level with the neighbours of their nodes.

    Rows at a hub go to every key over which its neighbours are dealt.
    """
    deals = adjacency.select("v", "deals").distinct()
    spread = level.join(deals, "v").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    return spread.drop("deals").join(adjacency.drop("deals"), ["v", "deal"])


def _dependencies(starts: DataFrame, adjacency: DataFrame) -> DataFrame | None:
    """``(id, part)``: what each node carries for all sources, counted from both ends.

    Forward: the next level is what the last one reaches, less the last two
    levels, as no edge skips a level. Backward: from the far end, each level
    adds up the shares of the level behind it.
    """
    level = settle(
        starts.select(F.col("id").alias("s"), F.col("weight").alias("from"), F.col("id").alias("v"), F.lit(1.0).alias("paths"))
    )
    levels = [level]
    seen = level.select("s", "v")
    while True:
        reached = (
            _next_to(level, adjacency)
            .groupBy("s", "from", F.col("w").alias("v"))
            .agg(F.sum(F.col("paths") * F.col("ways")).alias("paths"))
            .join(seen, ["s", "v"], "left_anti")
        )
        following = settle(reached)
        if following.isEmpty():
            discard(following)
            break
        levels.append(following)
        seen = level.select("s", "v").unionByName(following.select("s", "v"))
        level = following

    result, behind = None, None
    for level in reversed(levels[1:]):
        if behind is None:
            scored = level.withColumn("delta", F.lit(0.0))
        else:
            share = F.col("ways") * (F.col("weight") + F.col("delta")) / F.col("paths")
            shares = (
                _next_to(behind, adjacency)
                .groupBy("s", F.col("w").alias("v"))
                .agg(F.sum(share).alias("share"))
            )
            scored = settle(
                level.join(shares, ["s", "v"], "left").select(
                    "s", "from", "v", "paths",
                    (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta"),
                )
            )
            part = scored.groupBy(F.col("v").alias("id")).agg(F.sum(F.col("delta") * F.col("from")).alias("part"))
            result = part if result is None else result.unionByName(part)
        behind = scored
    if result is None:
        return None
    return settle(result.groupBy("id").agg(F.sum("part").alias("part")))
