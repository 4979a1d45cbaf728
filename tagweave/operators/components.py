"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.lineage import settle


def _star_step(edges: DataFrame, center: str, leaf: str) -> DataFrame:
    """Each row of ``edges`` with the smallest neighbour of its center.

    The minimum is combined before the shuffle and joined back, so that a node
    with very many edges never sits in one task (AQE splits it in the join).
    """
    smallest = edges.groupBy(F.col(center).alias("_c")).agg(F.min(leaf).alias("_m"))
    return edges.join(smallest, F.col(center) == F.col("_c")).drop("_c")


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """``(node, component)``, the component being its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until the
    edges form stars around the smallest node of each component.
    """
    edges = settle(edges.select(src, dst))
    ends = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    # every edge points from the larger to the smaller node
    star = settle(
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .where(F.col("hi") != F.col("lo"))
        .distinct()
    )
    while not _is_star(star):
        both = star.unionByName(star.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        large = (
            _star_step(both, "hi", "lo")
            .where(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.least("hi", "_m").alias("lo"))
            .distinct()
        )
        small = _star_step(large, "hi", "lo").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("_m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("_m").alias("lo")),
                )
            ).alias("e")
        )
        star = settle(
            small.select("e.*").where(F.col("hi") != F.col("lo")).distinct()
        )
    return ends.join(star, F.col("node") == F.col("hi"), "left").select(
        "node", F.coalesce("lo", "node").alias("component")
    )


def _is_star(star: DataFrame) -> bool:
    """No node points to two others, or points while it is pointed to."""
    roles = (
        star.select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("v"), F.lit(1).alias("out")),
                    F.struct(F.col("lo").alias("v"), F.lit(0).alias("out")),
                )
            ).alias("r")
        )
        .groupBy("r.v")
        .agg(F.sum("r.out").alias("n_out"), F.min("r.out").alias("only_out"))
    )
    return roles.where(
        (F.col("n_out") > 1) | ((F.col("n_out") == 1) & (F.col("only_out") == 0))
    ).isEmpty()
