"""A typed graph with its duplicate elements contracted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.components import connected_components
from tagweave.operators.lineage import settle

SAME = "Same"


def same_elements(
    elements: DataFrame, connections: DataFrame, kind: str = "connection_type", same: str = SAME
) -> DataFrame:
    """``(id, representative)``: elements that are one, by the smallest id.

    Elements are one if a connection of type ``same`` joins them, directly or through others, or
    if their labels are equal; null labels are not. Elements with one label are tied to the first
    of them, not to each other, so a label that very many carry adds one row each. Ends that are no
    element are left out.
    """
    known = elements.select("id", "label").where(F.col("id").isNotNull()).distinct()
    first = known.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("first"))
    by_label = known.join(first, "label").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    ids = known.select(F.col("id")).distinct()
    by_type = connections.where(F.col(kind) == same).select(F.col("from").alias("src"), F.col("to").alias("dst"))
    for end in ("src", "dst"):
        by_type = by_type.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    found = connected_components(by_label.unionByName(by_type.distinct()))
    return ids.join(found, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("component", "id").alias("representative")
    )


def contract(
    elements: DataFrame,
    connections: DataFrame,
    kind: str = "connection_type",
    same: str = SAME,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Elements and connections of the quotient graph.

    Elements: ``(id, label, n_elements)``, the smallest label of each class. Connections:
    ``(from, to, kind, *keep, n)``, re-pointed to representatives and counted; those of type ``same``
    and those inside a class vanish, ends that are no element stay as they are.
    """
    classes = settle(same_elements(elements, connections, kind, same))
    merged = (
        classes.join(elements.select("id", "label"), "id")
        .groupBy(F.col("representative").alias("id"))
        .agg(F.min("label").alias("label"), F.count_distinct("id").alias("n_elements"))
    )
    moved = connections.where(~F.col(kind).eqNullSafe(same)).select("from", "to", kind, *keep)
    for end in ("from", "to"):
        names = classes.select(F.col("id").alias("_id"), F.col("representative").alias("_to"))
        moved = (
            moved.join(names, F.col(end) == F.col("_id"), "left")
            .withColumn(end, F.coalesce("_to", end))
            .drop("_id", "_to")
        )
    counted = moved.where(~F.col("from").eqNullSafe(F.col("to"))).groupBy("from", "to", kind, *keep)
    return merged, counted.agg(F.count("*").alias("n"))
