"""Graphs as a node table and an edge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.lineage import settle
from tagweave.operators.ranking import dense_id


@dataclass(frozen=True)
class Graph:
    """``nodes`` has ``id`` (from 1) and ``name``; ``edges`` has ``src``, ``dst``."""

    nodes: DataFrame
    edges: DataFrame


def node_set(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Unique endpoints with the place of their first appearance.

    Sources come first in edge order, then nodes that are only targets. Edges
    are in order of target, then source.
    """
    place = F.struct(F.col(dst).alias("p1"), F.col(src).alias("p2"))
    sources = edges.select(
        F.col(src).alias("name"), F.lit(False).alias("only_target"), place.alias("at")
    )
    targets = edges.select(
        F.col(dst).alias("name"), F.lit(True).alias("only_target"), place.alias("at")
    )
    return (
        sources.unionByName(targets)
        .groupBy("name")
        .agg(F.min(F.struct("only_target", "at")).alias("_first"))
    )


def build_graph(
    edges: DataFrame,
    src: str = "paper_1",
    dst: str = "paper_2",
    directed: bool = False,
) -> Graph:
    """Number the endpoints of a named edge list.

    Edge attributes and the endpoint names are kept; undirected edges get
    ``src <= dst``. One output edge per input edge.
    """
    nodes = dense_id(
        node_set(edges, src, dst),
        ["_first.only_target", "_first.at.p1", "_first.at.p2"],
    ).select("id", "name")
    index = nodes.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    numbered = (
        edges.join(index.toDF("_s", "_sn"), F.col(src) == F.col("_sn"))
        .join(index.toDF("_d", "_dn"), F.col(dst) == F.col("_dn"))
        .drop("_sn", "_dn")
    )
    ends = [F.col("_s"), F.col("_d")]
    if not directed:
        ends = [F.least(*ends), F.greatest(*ends)]
    columns = [ends[0].alias("src"), ends[1].alias("dst"), *edges.columns]
    return Graph(nodes, numbered.select(*columns))


def to_undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smaller endpoint first; parallel edges stay."""
    return edges.withColumns({src: F.least(src, dst), dst: F.greatest(src, dst)})


def degree(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Incident edge rows per node, as ``(node, degree)``; a loop counts twice."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def adjacency_list(
    edges: DataFrame, src: str, dst: str
) -> DataFrame:
    """Neighbours of each node, both ways, as ``(node, position, neighbour)``.

    Positions count from 0 in order of the neighbours. Rows rather than arrays,
    so a hub's list can be sorted on disk.
    """
    both = (
        edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"))
        .unionByName(
            edges.select(F.col(dst).alias("node"), F.col(src).alias("neighbour"))
        )
        .distinct()
    )
    place = F.row_number().over(Window.partitionBy("node").orderBy("neighbour"))
    return both.select("node", (place - 1).cast("long").alias("position"), "neighbour")


def name_endpoints(
    edges: DataFrame,
    nodes: DataFrame,
    names: tuple[str, str] = ("id_from", "id_to"),
    ends: tuple[str, str] = ("src", "dst"),
) -> DataFrame:
    """Look up the node names behind integer endpoints."""
    for end, name in zip(ends, names):
        index = nodes.select(F.col("id").alias("_id"), F.col("name").alias(name))
        edges = edges.join(index, F.col(end) == F.col("_id"), "left").drop("_id")
    return edges


def enrich_nodes(
    nodes: DataFrame, attrs: DataFrame, id_col: str, name: str = "name"
) -> DataFrame:
    """Add the distinct attribute rows of each node; more than one multiply it."""
    nodes = settle(nodes)
    needed = nodes.select(F.col(name).alias("_key"))
    side = attrs.withColumnRenamed(id_col, "_key").join(needed, "_key", "left_semi").distinct()
    return nodes.join(side, F.col(name) == F.col("_key"), "left").drop("_key")


def dangling_edges(
    edges: DataFrame, nodes: DataFrame, src: str, dst: str, id_col: str
) -> DataFrame:
    """Edge ends absent from the node table, as ``(end, missing)``."""
    known = nodes.select(F.col(id_col).alias("missing")).distinct()
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.lit(src).alias("end"), F.col(src).alias("missing")),
                F.struct(F.lit(dst).alias("end"), F.col(dst).alias("missing")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.distinct().join(known, "missing", "left_anti").select("end", "missing")


def duplicate_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels carried by more than one row."""
    return (
        df.groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def resolve_connections(elements: DataFrame, connections: DataFrame) -> DataFrame:
    """Labels behind the ``from`` and ``to`` ids of typed connections."""
    for end in ("from", "to"):
        names = elements.select(
            F.col("id").alias("_id"), F.col("label").alias(f"{end}_label")
        )
        connections = connections.join(
            names, F.col(end) == F.col("_id"), "left"
        ).drop("_id")
    return connections


def synonym_pairs(resolved: DataFrame) -> DataFrame:
    """Unordered label pairs joined by a connection of type ``Same``."""
    return (
        resolved.where(F.col("connection_type") == "Same")
        .select(
            F.least("from_label", "to_label").alias("label_1"),
            F.greatest("from_label", "to_label").alias("label_2"),
        )
        .distinct()
    )


def distinct_groups(nodes: DataFrame, group: str = "community") -> DataFrame:
    """The legend of a drawing: each group once."""
    return nodes.select(group).distinct()


def transpose(df: DataFrame, rows: str = "r", values: str = "values") -> DataFrame:
    """Swap rows and columns of a matrix stored as one array per row.

    The result is in long form, ``(r, c, v)``: a transposed row would be as
    long as the input is tall, so it is not put into one array.
    """
    return df.select(F.col(rows).alias("c"), F.posexplode(values).alias("r", "v")).select(
        F.col("r").cast("long"), F.col("c").cast("long"), "v"
    )
