"""The given order and document tables, read as a report catalogue.

An order is a paper, the parts on its lines are its keywords, its customer's
market segment is its theme. A document's text is a raw keyword string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.functions.text import explode_keywords

THEME = "HOUSEHOLD"
# labels that act as stop keywords (some exist at one scale only)
STOP = ("cold widget 0", "small ring 0", "large ring 0", "red widget 1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``; how finely it is split is the session's setting."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def line_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(report_note_number, label, new_label)``, one row per order line.

    ``label`` is the part's name, which many parts share; ``new_label`` tells
    the parts apart.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("report_note_number"),
        F.col("p_name").alias("label"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("new_label"),
    )


def line_keywords_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the labels of one brand missing."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("report_note_number"),
        F.when(
            F.col("p_brand") != "Brand#12",
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")),
        ).alias("new_label"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one row per order."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("report_note_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
        F.col("c_name").alias("researcher"),
        F.col("c_mktsegment").alias("new_theme"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias(
            "research_report_title"
        ),
    )


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(report_note_number, theme, key_words)``: orders with their parts as one raw string.

    Every tenth part is spelled like an acronym, the others in the plural with their brand in
    parentheses.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey").cast("string")
    raw = F.when(
        F.col("p_partkey") % 10 == 0, F.upper(F.concat(F.lit("P"), key, F.lit(" "), "p_name"))
    ).otherwise(F.concat(F.lit("("), "p_brand", F.lit(") "), key, F.lit(" and "), "p_name", F.lit("s")))
    strings = (
        lines.join(parts.select("p_partkey", raw.alias("raw")), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(F.array_join(F.sort_array(F.collect_list("raw")), "; ").alias("key_words"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(strings, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("report_note_number"), F.col("o_orderpriority").alias("theme"), "key_words"
    )


def part_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(surface, lemma)``: every third part's cleaned label has a lemma."""
    key = F.col("p_partkey").cast("string")
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_partkey") % 3 == 0)
        .select(
            F.concat(F.lit(" "), key, F.lit(" "), "p_name").alias("surface"),
            F.concat("p_name", F.lit(" numbered "), key).alias("lemma"),
        )
    )


def part_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label)``: parts; those with one name and brand are one thing under several ids."""
    label = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))


def line_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(from, to, connection_type)`` from each line of an order to the next one.

    Neighbours of equal quantity and discount are taken for the same part, others follow.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("from"),
        F.lead("l_partkey").over(order).alias("to"),
        (F.col("l_quantity") == F.lead("l_quantity").over(order)).alias("_quantity"),
        (F.col("l_discount") == F.lead("l_discount").over(order)).alias("_discount"),
    )
    kind = F.when(F.col("_quantity") & F.col("_discount"), "Same").otherwise("Follows")
    return lines.where(F.col("to").isNotNull()).select("from", "to", kind.alias("connection_type"))


def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label)``: each whole document text as a raw keyword string."""
    docs = documents(spark, sf_dir)
    return explode_keywords(docs, "text").select("doc_id", "label")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, n)``: the distinct lower-case words of all documents."""
    docs = documents(spark, sf_dir)
    words = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("label"))
    return words.where(F.col("label") != "").groupBy("label").agg(F.count("*").alias("n"))
