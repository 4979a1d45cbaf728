"""Sources. Every reader states its schema and selects only known columns."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagweave.sources import schemas
from tagweave.sources.quoted import read_quoted_csv


def _read(
    spark: SparkSession, path: str, fmt: str, schema: str, multi_line: bool
) -> DataFrame:
    """CSV columns are found by their names in snake case, wherever they stand.

    A file with line breaks inside fields needs ``multi_line``; it is read by byte ranges
    (:mod:`tagweave.sources.quoted`).
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    if multi_line:
        rows = snake_case_columns(read_quoted_csv(spark, path))
    else:
        rows = snake_case_columns(spark.read.options(header=True, quote='"', escape='"').csv(path))
    fields = StructType.fromDDL(schema).fields
    missing = [f.name for f in fields if f.name not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def read_catalogue(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """One row per report, with its delimited keyword string."""
    return _read(spark, path, fmt, schemas.CATALOGUE, multi_line)


def read_report_keywords(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """One row per report and keyword, as :func:`write_report_keywords` stores it."""
    return _read(spark, path, fmt, schemas.REPORT_KEYWORD, multi_line)


def read_nodes(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """Keyword nodes, as :func:`write_nodes` stores them."""
    return _read(spark, path, fmt, schemas.KEYWORD_NODE, multi_line)


def read_gephi_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.GEPHI_EDGES, header=True)


def read_gephi_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.GEPHI_NODES, header=True)


def read_stored_graph(
    spark: SparkSession,
    edges: str,
    nodes: str | None = None,
    edge_schema: str = schemas.STORED_PAPER_EDGES,
) -> tuple[DataFrame, DataFrame | None]:
    """Result files of earlier runs, as ``(edges, nodes)``; row names dropped."""
    edge_rows = spark.read.csv(edges, schema=edge_schema, header=True).drop("row_name")
    if nodes is None:
        return edge_rows, None
    node_rows = spark.read.csv(
        nodes, schema=schemas.STORED_KEYWORD_NODES, header=True
    )
    # the row name is the node id the edge file refers to
    return edge_rows, node_rows.select(
        F.col("row_name").cast("long").alias("id"), "name", "community"
    )


class KnowledgeGraph(NamedTuple):
    elements: DataFrame
    connections: DataFrame
    map_nodes: DataFrame
    map_edges: DataFrame


def read_knowledge_graph(spark: SparkSession, path: str) -> KnowledgeGraph:
    """Typed graph documents (one JSON object per file) as four flat tables."""
    docs = spark.read.schema(schemas.KNOWLEDGE_GRAPH).json(path, multiLine=True)

    elements = docs.select(F.explode("elements").alias("e")).select(
        F.col("e._id").alias("id"),
        F.col("e.attributes")["label"].alias("label"),
        F.col("e.attributes").alias("attributes"),
    )
    connections = docs.select(F.explode("connections").alias("c")).select(
        F.col("c._id").alias("id"),
        F.col("c.from").alias("from"),
        F.col("c.to").alias("to"),
        F.col("c.direction").alias("direction"),
        F.col("c.delayed").alias("delayed"),
        F.col("c.reversed").alias("reversed"),
        F.col("c.attributes")["label"].alias("label"),
        F.col("c.attributes")["connection type"].alias("connection_type"),
        F.col("c.attributes").alias("attributes"),
    )
    maps = docs.select(F.explode("maps").alias("m"))
    map_nodes = maps.select(
        F.col("m._id").alias("map_id"), F.explode("m.elements").alias("e")
    ).select(
        "map_id",
        F.col("e._id").alias("id"),
        F.col("e.element").alias("element"),
        F.col("e.position.x").alias("x"),
        F.col("e.position.y").alias("y"),
        F.col("e.pinned").alias("pinned"),
    )
    map_edges = maps.select(
        F.col("m._id").alias("map_id"), F.explode("m.connections").alias("c")
    ).select(
        "map_id",
        F.col("c._id").alias("id"),
        F.col("c.connection").alias("connection"),
        F.col("c.curvature").alias("curvature"),
    )
    return KnowledgeGraph(elements, connections, map_nodes, map_edges)


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Column names in lower snake case; repeats get ``_2``, ``_3``, …"""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        name = name.replace("%", "_percent_").replace("#", "_number_")
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
        name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower() or "x"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
