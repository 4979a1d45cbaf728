"""Every registered query, by name; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import text, vocabulary
from tagweave.operators import blocks, communities, cooccur, graph, quotient, ranking
from tagweave.operators.betweenness import betweenness as node_betweenness
from tagweave.operators.components import connected_components
from tagweave.operators.flow import code_length as walk_code_length
from tagweave.operators.flow import flow_communities
from tagweave.operators.lineage import settle, shared_folder, shuffles_of
from tagweave.plans import networks, tables
from tagweave.plans.preparation import prepare_report_keywords
from tagweave.sources import read_quoted_csv, writers

REPORT = networks.REPORT
PAIR = ("paper_1", "paper_2")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ordered rewrites for the invented prose; the second feeds on the first
PROSE_SYNONYMS = (("ing the", "ING"), ("ING", "ing-a"), ("tion", "shun"))
PROSE_STOP_WORDS = ("the", "of", "and", "de", "la", "que", "und", "y")


# --- keyword strings ----------------------------------------------------------


@query
def keyword_split(spark, d):
    docs = tables.table(spark, d, "documents")
    parts = text.split_keywords(F.col("text"))
    return docs.select(
        "doc_id",
        F.array_join(parts, "|").alias("keywords"),
        F.size(parts).cast("long").alias("n"),
    )


@query
def csv_records(spark, d):
    """Whole documents, line breaks and all, written as CSV and read back by byte ranges."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    whole = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs = tables.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.options(header=True, quoteAll=True, **whole).csv(path)
    content = F.coalesce("text", F.lit(""))
    return read_quoted_csv(spark, path, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(content).cast("long").alias("n_chars"),
        F.md5(content).alias("text_md5"),
    )


@query
def exploded(spark, d):
    return tables.document_phrases(spark, d)


@query
def flattened(spark, d):
    lines = F.split("text", "\n")
    nested = F.transform(lines, text.split_keywords)
    docs = tables.table(spark, d, "documents").select(nested.alias("key_words"))
    return cooccur.keyword_counts(text.flatten_keywords(docs, "key_words"), "nodes")


@query
def clean_label(spark, d):
    return text.clean_labels(tables.document_phrases(spark, d)).select(
        "doc_id", "new_label"
    )


@query
def clean_label_whole_word(spark, d):
    cleaned = text.clean_labels(tables.document_phrases(spark, d), whole_word=True)
    return cleaned.select("doc_id", "new_label")


@query
def synonyms(spark, d):
    col = text.apply_synonyms(F.col("label"), PROSE_SYNONYMS)
    return tables.document_phrases(spark, d).select("doc_id", col.alias("new_label"))


@query
def decapitalize(spark, d):
    col = text.decapitalize(F.col("label"))
    return tables.document_phrases(spark, d).select("doc_id", col.alias("new_label"))


@query
def strip_punct(spark, d):
    col = text.strip_punctuation(F.col("label"))
    return tables.document_phrases(spark, d).select("doc_id", col.alias("new_label"))


@query
def stop_words(spark, d):
    col = text.drop_stop_words(F.col("label"), PROSE_STOP_WORDS)
    return tables.document_phrases(spark, d).select("doc_id", col.alias("new_label"))


@query
def singular(spark, d):
    words = tables.document_words(spark, d).select("label")
    return text.singularize_labels(words, "label", "singular")


@query
def lemma_join(spark, d):
    """Words whose form without a final s is a word too have that as lemma."""
    words = tables.document_words(spark, d)
    plural = words.select(F.col("label").alias("surface"))
    base = words.select(
        F.col("label").alias("lemma"), F.concat("label", F.lit("s")).alias("surface")
    )
    return vocabulary.lemmatize_labels(
        words, plural.join(base, "surface"), "label", "lemma"
    )


@query
def stem(spark, d):
    return vocabulary.stem_labels(tables.document_words(spark, d).select("label"))


@query
def stem_families(spark, d):
    docs = tables.documents(spark, d)
    words = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("label"))
    return vocabulary.stem_families(words.where(F.col("label") != ""))


@query
def first_theme(spark, d):
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias(REPORT),
        text.first_token(F.col("o_orderpriority")).alias("new_theme"),
    )


@query
def paper_number(spark, d):
    return tables.table(spark, d, "supplier").select(
        "s_name", text.paper_number(F.col("s_name")).alias("number")
    )


# --- keyword counts and pairs ---------------------------------------------------


@query
def keyword_counts(spark, d):
    return cooccur.keyword_counts(tables.line_keywords(spark, d))


@query
def keyword_nodes(spark, d):
    return networks.keyword_nodes(tables.line_keywords(spark, d))


@query
def stop_filter(spark, d):
    return cooccur.drop_stop_keywords(
        tables.line_keywords_with_nulls(spark, d), tables.STOP
    )


def _kept(spark, d):
    return cooccur.drop_stop_keywords(tables.line_keywords(spark, d), tables.STOP)


@query
def pairs(spark, d):
    return cooccur.cooccurrence_pairs(
        _kept(spark, d), REPORT, "new_label", names=(*PAIR, "new_label")
    )


@query
def shared_keywords(spark, d):
    """With missing labels, which pair like any other value and are a hot key."""
    kept = cooccur.drop_stop_keywords(
        tables.line_keywords_with_nulls(spark, d), tables.STOP
    )
    return cooccur.shared_pairs(kept, REPORT, "new_label", names=(*PAIR, "shared_keywords"))


@query
def strong_pairs(spark, d):
    pairs = networks.paper_pairs(tables.line_keywords(spark, d), tables.STOP)
    return cooccur.min_weight(pairs, 2)


@query
def pair_weights(spark, d):
    return cooccur.pair_weights(_kept(spark, d), REPORT, "new_label")


@query
def edge_themes(spark, d):
    return networks.theme_edges(
        tables.line_keywords(spark, d), tables.reports(spark, d), None, tables.STOP
    )


@query
def theme_edges(spark, d):
    return networks.theme_edges(
        tables.line_keywords(spark, d),
        tables.reports(spark, d),
        tables.THEME,
        tables.STOP,
        n_rows=_n_lines(spark, d),
    )


@query
def first_keywords(spark, d):
    return ranking.first_n_keywords(_kept(spark, d))


def _n_lines(spark, d):
    """Rows of ``line_keywords``, as the files tell."""
    return tables.table(spark, d, "lineitem").count()


@query
def keyword_pairs(spark, d):
    return cooccur.shared_pairs(
        tables.line_keywords(spark, d), "new_label", REPORT,
        names=("keyword_1", "keyword_2", "n"), n_rows=_n_lines(spark, d),
    )


def _keyword_graph(spark, d):
    return networks.keyword_graph(
        tables.line_keywords(spark, d), 2, tables.STOP, n_rows=_n_lines(spark, d)
    )


@query
def keyword_graph(spark, d):
    return _keyword_graph(spark, d).edges


def _prepared(spark, d):
    return prepare_report_keywords(tables.raw_catalogue(spark, d), tables.part_lemmas(spark, d))


@query
def prepared_keywords(spark, d):
    """Raw keyword strings to lemmas, stems and themes."""
    return _prepared(spark, d).stems.select(REPORT, "label", "new_label", "stemmed_version", "new_theme")


@query
def prepared_nodes(spark, d):
    return _prepared(spark, d).nodes


@query
def prepared_pairs(spark, d):
    """From raw strings to orders that share two prepared keywords."""
    n_rows = _n_lines(spark, d)
    with shuffles_of(spark, n_rows):
        stems = _prepared(spark, d).stem_ids(REPORT)
    return cooccur.shared_pairs(
        stems, REPORT, "stem_id", names=(*PAIR, "shared_keywords"), n_rows=n_rows
    )


# --- graphs and their tables ------------------------------------------------------


def _graph(spark, d):
    return graph.build_graph(settle(theme_edges(spark, d)))


def _links(spark, d):
    return theme_edges(spark, d).select(*PAIR)


@query
def node_index(spark, d):
    return _graph(spark, d).nodes


@query
def undirected_edges(spark, d):
    both = cooccur.symmetric_edges(theme_edges(spark, d), *PAIR)
    return cooccur.dedupe_reversed(both, *PAIR, PAIR)


@query
def symmetric_edges(spark, d):
    return cooccur.symmetric_edges(
        theme_edges(spark, d).select(*PAIR, "shared_keywords"), *PAIR
    )


@query
def degree(spark, d):
    return graph.degree(_links(spark, d), *PAIR)


@query
def adjacency(spark, d):
    return graph.adjacency_list(settle(_links(spark, d)), *PAIR)


@query
def named_edges(spark, d):
    g = _graph(spark, d)
    return graph.name_endpoints(g.edges.select("src", "dst", "shared_keywords"), g.nodes)


@query
def node_attrs(spark, d):
    return graph.enrich_nodes(_graph(spark, d).nodes, tables.reports(spark, d), REPORT)


@query
def node_export(spark, d):
    g = _graph(spark, d)
    nodes = graph.enrich_nodes(g.nodes, tables.reports(spark, d), REPORT)
    return writers.node_table(graph.Graph(nodes, g.edges))


@query
def edge_export(spark, d):
    return writers.edge_table_with_row_names(_graph(spark, d), ("paper_2", "paper_1"))


@query
def widget_links(spark, d):
    return writers.widget_links(_graph(spark, d))


@query
def widget_json(spark, d):
    return writers.as_json_lines(writers.widget_links(_graph(spark, d)))


@query
def heatmap(spark, d):
    return networks.heatmap(_graph(spark, d))


@query
def every_nth(spark, d):
    """Every fifth label of the heatmap's horizontal axis."""
    axis = heatmap(spark, d).select("x", "id_to").distinct()
    return ranking.every_nth(axis, 5, "x")


def _nodes_by_theme(spark, d):
    links = settle(_links(spark, d))
    nodes = graph.degree(links, *PAIR).withColumnRenamed("node", "id")
    themes = tables.reports(spark, d).select(F.col(REPORT).alias("id"), "new_theme")
    return nodes.join(themes, "id")


@query
def top_paper(spark, d):
    return ranking.top_by_group(_nodes_by_theme(spark, d), "new_theme")


@query
def group_size(spark, d):
    return ranking.group_size(_nodes_by_theme(spark, d), "new_theme")


@query
def legend(spark, d):
    return graph.distinct_groups(_nodes_by_theme(spark, d), "new_theme")


def _supplied(spark, d):
    lines = tables.table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    suppliers = tables.table(spark, d, "supplier").select("s_suppkey", "s_name")
    parts = tables.table(spark, d, "part").select("p_partkey", "p_name")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )


@query
def bipartite_edges(spark, d):
    return networks.researcher_keyword_graph(_supplied(spark, d), "s_name", "p_name")[1]


@query
def bipartite_nodes(spark, d):
    return networks.researcher_keyword_graph(_supplied(spark, d), "s_name", "p_name")[0]


@query
def dangling(spark, d):
    orders = tables.table(spark, d, "orders")
    placed = orders.select(F.col("o_custkey").alias("Source"), F.col("o_orderkey").alias("Target"))
    nodes = tables.table(spark, d, "lineitem").select("l_orderkey")
    return graph.dangling_edges(placed, nodes, "Source", "Target", "l_orderkey")


@query
def dup_labels(spark, d):
    return graph.duplicate_labels(tables.table(spark, d, "part"), "p_name")


def _quotient(spark, d):
    return quotient.contract(tables.part_elements(spark, d), tables.line_connections(spark, d))


@query
def quotient_elements(spark, d):
    """Parts with duplicates contracted."""
    return _quotient(spark, d)[0]


@query
def quotient_edges(spark, d):
    return _quotient(spark, d)[1]


@query
def transpose(spark, d):
    cells = graph.transpose(tables.table(spark, d, "embeddings"), "vec_id", "embedding")
    return cells.withColumn("v", F.round(F.col("v").cast("double"), 6))


# --- graph metrics ------------------------------------------------------------------


@query
def components(spark, d):
    return connected_components(_links(spark, d), *PAIR)


@query
def component_numbers(spark, d):
    """Components as 1, 2, 3, … by falling size, then by smallest node."""
    parts = connected_components(_links(spark, d), *PAIR)
    return communities.number_communities(settle(parts.toDF("node", "community")))


@query
def betweenness(spark, d):
    scores = node_betweenness(_links(spark, d), *PAIR)
    return scores.withColumn("betweenness", F.round("betweenness", 6))


@query
def cut_nodes(spark, d):
    """Papers that hold their component together, with the number of pieces."""
    found = blocks.biconnected_blocks(settle(_links(spark, d)), *PAIR)
    return blocks.cut_nodes(found)


@query
def price_medians(spark, d):
    """Exact median price of each part."""
    lines = tables.table(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    return ranking.medians(lines, "l_partkey", "l_extendedprice").withColumn("median", F.round("median", 6))


@query
def modularity(spark, d):
    """Of the partition into connected components."""
    links = settle(_links(spark, d))
    parts = connected_components(links, *PAIR).withColumnRenamed("component", "community")
    score = communities.modularity(links, parts, *PAIR)
    return score.withColumn("modularity", F.round("modularity", 6))


@query
def code_length(spark, d):
    """Of the partition that names each node after the smallest of itself and its neighbours."""
    links = settle(_links(spark, d))
    ways = links.toDF("node", "other").unionByName(links.toDF("other", "node"))
    first = ways.groupBy("node").agg(F.min("other").alias("other"))
    assign = first.select("node", F.least("node", "other").alias("community"))
    return walk_code_length(links, assign, *PAIR).select(F.round("bits", 4).alias("bits"))


@query
def merge_round(spark, d):
    """The first round of the community search, where every node is alone."""
    edges = settle(_links(spark, d))
    m = edges.count()
    links, masses = communities.community_graph(edges, *PAIR)
    prefs = settle(communities.preferences(communities.gains(links, masses, m)))
    return communities.merge_round(prefs, masses, m)


@query
def community(spark, d):
    found = communities.greedy_communities(_links(spark, d), *PAIR)
    return communities.number_communities(found)


@query
def keyword_community(spark, d):
    """Communities of part labels that share orders."""
    found = communities.greedy_communities(_keyword_graph(spark, d).edges)
    return communities.number_communities(found)


@query
def flow_community(spark, d):
    found = flow_communities(_links(spark, d), *PAIR)
    return communities.number_communities(found)


@query
def paper_graph(spark, d):
    g = networks.paper_graph(
        tables.line_keywords(spark, d),
        tables.reports(spark, d),
        tables.THEME,
        tables.STOP,
        n_rows=_n_lines(spark, d),
    )
    return g.nodes.drop("community").withColumn("betweenness", F.round("betweenness", 6))
