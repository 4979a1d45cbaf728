"""Dense ids, ordered positions and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.lineage import settle

_LOW_33_BITS = (1 << 33) - 1


def dense_id(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "id",
    start: int = 1,
) -> DataFrame:
    """Consecutive ids in the given order, which must not leave ties.

    Rows are range-partitioned and sorted in place, so no task sees more than
    its range. A row's id is its position there (the low bits of the built-in
    increasing id) plus the size of all earlier ranges. That offset table has
    one row per partition, which bounds both the window and the broadcast.
    """
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_skip"))
    )
    position = F.col("_slot").bitwiseAND(F.lit(_LOW_33_BITS))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, position + F.col("_skip") + F.lit(start))
        .drop("_part", "_skip", "_slot")
    )


def shift_id(df: DataFrame, by: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c) + by for c in cols})


def first_n_keywords(
    df: DataFrame,
    item: str = "report_note_number",
    label: str = "new_label",
    n: int = 3,
) -> DataFrame:
    """Columns ``keyword_1`` … ``keyword_n``: first labels in order, repeats kept.

    The filter on the position lets Spark cut each group to ``n`` rows before
    the shuffle, so an item with very many labels is no problem.
    """
    window = Window.partitionBy(item).orderBy(F.col(label).asc_nulls_last())
    ranked = (
        df.select(item, label)
        .withColumn("_pos", F.row_number().over(window))
        .where(F.col("_pos") <= n)
    )
    return ranked.groupBy(item).agg(
        *[
            F.max(F.when(F.col("_pos") == i, F.col(label))).alias(f"keyword_{i}")
            for i in range(1, n + 1)
        ]
    )


def group_size(nodes: DataFrame, group: str = "community") -> DataFrame:
    return nodes.groupBy(group).agg(F.count("*").alias("n"))


def top_by_group(
    nodes: DataFrame, group: str = "community", by: str = "degree", tie: str = "id"
) -> DataFrame:
    """Per group the row with the highest ``by`` (then lowest ``tie``) and its size.

    One aggregation gives both, and combines before the shuffle.
    """
    best = F.min_by(F.struct(*nodes.columns), F.struct(-F.col(by), F.col(tie)))
    return (
        nodes.groupBy(F.col(group).alias("_group"))
        .agg(best.alias("_row"), F.count("*").alias("n"))
        .select("_row.*", "n")
    )


def running_total(df: DataFrame, order: Sequence[Column | str], weight: str, out: str) -> DataFrame:
    """The sum of ``weight`` up to and with each row, in an order without ties.

    Like ``dense_id``: each task sums over its range, and the sums of earlier ranges are added,
    one row per partition.
    """
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = (
        placed.groupBy("_part")
        .agg(F.sum(weight).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_skip"))
    )
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn(out, F.sum(weight).over(upto))
        .join(F.broadcast(skipped), "_part")
        .withColumn(out, F.col(out) + F.col("_skip"))
        .drop("_part", "_skip")
    )


def medians(df: DataFrame, label: str, by: str, out: str = "median") -> DataFrame:
    """Exact median of ``by`` per label; nulls do not count, a label without values has null.

    Equal values are counted before the shuffle and the counts are summed up over all labels in one
    order, so a label's values may lie in many partitions. Of each label the values that cover the middle
    ranks are picked; with an even number the two in the middle are averaged.
    """
    counted = df.groupBy(F.col(label).alias("_label"), F.col(by).cast("double").alias("_value")).agg(
        F.count("*").alias("_n")
    )
    # null and nan labels and values sort in one place each, so the order has no ties
    ranked = settle(running_total(counted.where(F.col("_value").isNotNull()), ["_label", "_value"], "_n", "_upto"))
    spans = ranked.groupBy("_label").agg(
        F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.max("_upto").alias("_end")
    )
    size = F.col("_end") - F.col("_start")
    low = F.col("_start") + F.floor((size - 1) / 2)
    high = F.col("_start") + F.floor(size / 2)
    first = F.col("_upto") - F.col("_n")
    middle = (
        ranked.join(spans.withColumnRenamed("_label", "_of"), F.col("_label").eqNullSafe(F.col("_of")))
        .where((first <= high) & (F.col("_upto") > low))
        .groupBy("_of")
        .agg(((F.min("_value") + F.max("_value")) / 2).alias(out))
    )
    labels = df.select(F.col(label)).distinct()
    return labels.join(middle, F.col(label).eqNullSafe(F.col("_of")), "left").select(label, out)


def order_levels(df: DataFrame, label: str, by: str, out: str = "level") -> DataFrame:
    """Each distinct label with its rank by the median of ``by``, nulls last."""
    levels = medians(df, label, by, "_by")
    ordered = dense_id(
        levels.withColumn("_no_by", F.col("_by").isNull()),
        ["_no_by", "_by", label],
        name=out,
    )
    return ordered.select(label, out)


def every_nth(df: DataFrame, n: int, position: str) -> DataFrame:
    """Rows at positions 1, n + 1, 2n + 1, …"""
    return df.where((F.col(position) - 1) % n == 0)
