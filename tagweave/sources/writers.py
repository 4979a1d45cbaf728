"""Sinks. Each ``export_*`` has a ``*_table`` twin that gives the rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.graph import Graph
from tagweave.operators.ranking import dense_id, shift_id, top_by_group


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"')
    writer.format(fmt).save(path)


def _write_ordered(df: DataFrame, path: str, mode: str) -> None:
    """CSV of sorted rows: the files read one after the other by name give their order.

    Every file has a header. ``path/_manifest``, which readers of ``path`` skip, holds
    each file's name and number of rows as JSON.
    """
    _write(df, path, "csv", mode)
    manifest(df.sparkSession, path).coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rows)`` of a CSV folder, files without rows left out.

    Rows may hold line breaks; a file is read whole by one task, as one task wrote it.
    """
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return (
        rows.select(F.col("_metadata.file_name").alias("file"))
        .groupBy("file")
        .agg(F.count("*").alias("rows"))
        .orderBy("file")
    )


def write_nodes(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error"
) -> None:
    """Keyword nodes: ``id``, ``nodes``, ``n_reports``, ``label``."""
    _write(df.select("id", "nodes", "n_reports", "label"), path, fmt, mode)


def write_report_keywords(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error"
) -> None:
    """One row per report and keyword; call once per stage (lemmas, stems)."""
    _write(df, path, fmt, mode)


def edge_table(graph: Graph, drop: tuple[str, ...] = ("paper_1", "paper_2")) -> DataFrame:
    """Edges with 1-based ``Source`` and ``Target`` ids and attributes."""
    return graph.edges.drop(*drop).withColumnsRenamed({"src": "Source", "dst": "Target"})


def edge_table_with_row_names(
    graph: Graph, order: tuple[str, ...], drop: tuple[str, ...] = ("paper_1", "paper_2")
) -> DataFrame:
    """The same with the position in ``order``; parallel edges need a tie column."""
    numbered = dense_id(graph.edges, list(order), name="row_name")
    columns = [c for c in graph.edges.columns if c not in drop]
    return numbered.select("row_name", *columns).withColumnsRenamed(
        {"src": "Source", "dst": "Target"}
    )


def export_edge_list(
    graph: Graph,
    path: str,
    row_names: tuple[str, ...] | None = None,
    mode: str = "error",
) -> None:
    """Edge CSV; ``row_names`` gives the order for the unnamed first column.

    Files follow the row names, or the ids of both ends without them.
    """
    if row_names is None:
        table = edge_table(graph).orderBy("Source", "Target")
    else:
        table = edge_table_with_row_names(graph, row_names).orderBy("row_name")
        table = table.withColumnRenamed("row_name", "")
    _write_ordered(table, path, mode)


def node_table(graph: Graph) -> DataFrame:
    """Nodes with their 1-based id last, named ``Id``."""
    rest = [c for c in graph.nodes.columns if c != "id"]
    return graph.nodes.select(*rest, F.col("id").alias("Id"))


def export_node_list(graph: Graph, path: str, mode: str = "error") -> None:
    """Node CSV in order of ``Id``."""
    _write_ordered(node_table(graph).orderBy("Id"), path, mode)


def export_top_papers(graph: Graph, path: str, mode: str = "error") -> None:
    """Per community its best connected paper and its size, in order of communities."""
    _write_ordered(top_by_group(graph.nodes).orderBy("community"), path, mode)


def widget_nodes(graph: Graph, label: str, group: str = "community") -> DataFrame:
    """0-based node records for a force-directed drawing."""
    return shift_id(graph.nodes, -1, "id").select(
        "id", F.col(label).alias("name"), F.col(group).alias("group")
    )


def widget_links(graph: Graph, value: str = "shared_keywords") -> DataFrame:
    """0-based link records for a force-directed drawing."""
    return shift_id(graph.edges, -1, "src", "dst").select(
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.col(value).alias("value"),
    )


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def export_widget_json(
    graph: Graph,
    path: str,
    label: str = "research_report_title",
    value: str = "shared_keywords",
    mode: str = "error",
) -> None:
    """JSON lines under ``path/nodes`` and ``path/links``."""
    as_json_lines(widget_nodes(graph, label)).write.mode(mode).text(f"{path}/nodes")
    as_json_lines(widget_links(graph, value)).write.mode(mode).text(f"{path}/links")
