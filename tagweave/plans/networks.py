"""From exploded report keywords to enriched graphs and their tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import STOP_KEYWORDS, paper_number, singularize_labels
from tagweave.operators.betweenness import betweenness
from tagweave.operators.communities import greedy_communities, number_communities
from tagweave.operators.cooccur import (
    HOT_AT,
    drop_stop_keywords,
    keyword_counts,
    shared_pairs,
    touching,
    with_endpoint_attrs,
)
from tagweave.operators.graph import (
    Graph,
    build_graph,
    degree,
    enrich_nodes,
    name_endpoints,
)
from tagweave.operators.lineage import settle
from tagweave.operators.ranking import dense_id, first_n_keywords, order_levels

REPORT = "report_note_number"


def keyword_nodes(df: DataFrame, col: str = "label") -> DataFrame:
    """Keyword nodes with 0-based ids in keyword order and a singular label."""
    nodes = dense_id(keyword_counts(df, col), ["nodes"], start=0)
    labelled = nodes.withColumn("label", F.lower("nodes"))
    return singularize_labels(labelled, "label").select(
        "id", "nodes", "n_reports", "label"
    )


def paper_pairs(
    keywords: DataFrame,
    stop: Sequence[str] | DataFrame = STOP_KEYWORDS,
    min_shared: int = 2,
    hot_at: int = HOT_AT,
    n_rows: int | None = None,
) -> DataFrame:
    """Papers sharing at least ``min_shared`` keywords.

    The stop list applies before the join: its keywords are the hottest ones. Here and below
    ``n_rows`` is about how many rows ``keywords`` has, if known.
    """
    kept = drop_stop_keywords(keywords, stop)
    return shared_pairs(
        kept, REPORT, "new_label", min_shared, hot_at,
        ("paper_1", "paper_2", "shared_keywords"), n_rows=n_rows,
    )


def theme_edges(
    keywords: DataFrame,
    catalogue: DataFrame,
    theme: str | None,
    stop: Sequence[str] | DataFrame = STOP_KEYWORDS,
    min_shared: int = 2,
    hot_at: int = HOT_AT,
    n_rows: int | None = None,
) -> DataFrame:
    """Paper pairs with both papers' themes, where either side has ``theme``."""
    pairs = paper_pairs(keywords, stop, min_shared, hot_at, n_rows)
    edges = with_endpoint_attrs(pairs, catalogue, REPORT, "new_theme")
    return edges if theme is None else touching(edges, theme)


def paper_graph(
    keywords: DataFrame,
    catalogue: DataFrame,
    theme: str | None,
    stop: Sequence[str] | DataFrame = STOP_KEYWORDS,
    min_shared: int = 2,
    hot_at: int = HOT_AT,
    n_rows: int | None = None,
) -> Graph:
    """The enriched paper network.

    ``keywords`` has one row per report and keyword, ``catalogue`` one per
    report (``new_theme`` and any further attributes). Nodes get community,
    betweenness, degree, the attributes and their first three keywords.
    """
    edges = theme_edges(keywords, catalogue, theme, stop, min_shared, hot_at, n_rows)
    graph = build_graph(settle(edges))
    links = settle(graph.edges)
    ends = links.select("src", "dst")
    metrics = (
        number_communities(greedy_communities(ends))
        .join(betweenness(ends), "node")
        .join(degree(ends), "node")
        .withColumnRenamed("node", "id")
    )
    nodes = graph.nodes.join(metrics, "id", "left")
    nodes = enrich_nodes(nodes, catalogue, REPORT)
    # keywords are ranked only for papers in the graph
    top = first_n_keywords(
        drop_stop_keywords(keywords, stop).join(
            graph.nodes.select(F.col("name").alias(REPORT)), REPORT, "left_semi"
        )
    )
    return Graph(enrich_nodes(nodes, top, REPORT), links)


def keyword_graph(
    keywords: DataFrame,
    min_n: int = 4,
    stop: Sequence[str] | DataFrame = STOP_KEYWORDS,
    hot_at: int = HOT_AT,
    n_rows: int | None = None,
) -> Graph:
    """Keywords as nodes, linked if at least ``min_n`` papers carry both."""
    pairs = shared_pairs(
        drop_stop_keywords(keywords, stop), "new_label", REPORT, min_n, hot_at,
        ("keyword_1", "keyword_2", "n"), n_rows=n_rows,
    )
    return build_graph(settle(pairs), "keyword_1", "keyword_2")


def heatmap(graph: Graph) -> DataFrame:
    """Cells of the adjacency heatmap in long form.

    ``x`` ranks the target by its paper number, ``y`` ranks the source the other
    way round.
    """
    cells = name_endpoints(graph.edges, graph.nodes)
    cells = cells.withColumns(
        {
            "number_from": paper_number(F.col("id_from").cast("string")),
            "number_to": paper_number(F.col("id_to").cast("string")),
        }
    )
    xs = order_levels(cells, "id_to", "number_to", "x")
    ys = order_levels(cells, "id_from", "number_from", "_y")
    last = ys.agg(F.max("_y")).first()[0] or 0
    return (
        cells.join(xs, "id_to")
        .join(ys, "id_from")
        .withColumn("y", F.lit(last + 1) - F.col("_y"))
        .select("id_from", "id_to", "number_from", "number_to", "x", "y", "shared_keywords")
    )


def researcher_keyword_graph(
    df: DataFrame, researcher: str = "researcher", keyword: str = "new_label"
) -> tuple[DataFrame, DataFrame]:
    """Directed researcher-to-keyword edges and their nodes, in one id space.

    Nodes and edges are numbered from 0. A researcher is followed by the
    keywords it is the first (in order) to have.
    """
    links = settle(
        df.select(F.col(researcher).alias("who"), F.col(keyword).alias("what"))
        .dropna()
        .distinct()
    )
    names = links.select(
        F.col("who").alias("owner"), F.lit(0).alias("kind"), F.col("who").alias("Label")
    ).distinct()
    keywords = links.groupBy(F.col("what").alias("Label")).agg(F.min("who").alias("owner"))
    tagged = names.unionByName(keywords.withColumn("kind", F.lit(1)))
    nodes = dense_id(tagged, ["owner", "kind", "Label"], name="Id", start=0).select(
        "Id",
        "Label",
        F.when(F.col("kind") == 0, "researcher").otherwise("keyword").alias("kind"),
    )

    def side(kind, name, label):
        return nodes.where(F.col("kind") == kind).select(
            F.col("Id").alias(name), F.col("Label").alias(label)
        )

    joined = links.join(side("researcher", "Source", "who"), "who").join(
        side("keyword", "Target", "what"), "what"
    )
    edges = dense_id(joined, ["who", "what"], name="Id", start=0).select(
        "Source",
        "Target",
        F.lit("Directed").alias("Type"),
        F.lit("researched").alias("Kind"),
        "Id",
        F.lit(None).cast("string").alias("Label"),
        F.lit(None).cast("string").alias("timeset"),
        F.lit(1).cast("long").alias("Weight"),
    )
    return nodes, edges
