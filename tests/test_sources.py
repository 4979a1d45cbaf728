import csv
import json

import pytest

from tagweave import sources
from tagweave.operators import graph
from tagweave.plans import networks
from tagweave.sources import schemas, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_snake_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Report note number", "KeyWords", "key words", "% of #"])
    names = sources.snake_case_columns(df).columns
    assert names == ["report_note_number", "key_words", "key_words_2", "percent_of_number"]


def test_catalogue_round_trip(spark, tmp_path):
    path = write(
        tmp_path / "c.csv",
        "report_note_number,research_report_title,key_words,theme,researcher,published_date,available_at\n"
        'RR 1,"A ""quoted"" title","x; y, z",Safety,Lab,2020-05-01,http://a\n'
        "RR 2,Plain,,,,,\n",
    )
    rows = sources.read_catalogue(spark, path, "csv").collect()
    assert rows[0]["research_report_title"] == 'A "quoted" title'
    assert rows[0]["published_date"].isoformat() == "2020-05-01"
    assert rows[1]["key_words"] is None


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "shuffled.csv"
    path.write_text(
        "Key words,Theme,Report Note Number,Available at,Researcher,Published date,Research report title\n"
        '"x; y",Safety,RR 7,http://b,Lab,2021-02-03,T\n'
    )
    row = sources.read_catalogue(spark, str(path), "csv").first()
    assert (row["report_note_number"], row["key_words"], row["theme"]) == ("RR 7", "x; y", "Safety")
    assert row["published_date"].isoformat() == "2021-02-03"
    short = tmp_path / "short.csv"
    short.write_text("Key words\nx\n")
    with pytest.raises(ValueError, match="theme"):
        sources.read_catalogue(spark, str(short), "csv")


def test_report_keywords_and_nodes_round_trip(spark, tmp_path):
    rk = spark.createDataFrame(
        [("RR 1", "T", "a, b", "Safety", "Lab", None, "u", "a", "a")], schemas.REPORT_KEYWORD
    )
    sources.write_report_keywords(rk, str(tmp_path / "rk"))
    assert sources.read_report_keywords(spark, str(tmp_path / "rk")).collect() == rk.collect()
    nodes = networks.keyword_nodes(
        spark.createDataFrame([("Roads",), ("roads",), ("Roads",)], "label string")
    )
    sources.write_nodes(nodes, str(tmp_path / "n"))
    back = {tuple(r) for r in sources.read_nodes(spark, str(tmp_path / "n")).collect()}
    assert back == {(0, "Roads", 2, "road"), (1, "roads", 1, "road")}


def test_gephi_files(spark, tmp_path):
    edges = write(
        tmp_path / "e.csv",
        "Source,Target,Type,Kind,Id,Label,timeset,Weight\n0,1,Directed,researched,0,,,1\n0,9,Directed,researched,1,,,1\n",
    )
    nodes = write(tmp_path / "n.csv", "Id,Label,timeset\n0,Lab,\n1,risk,\n")
    e, n = sources.read_gephi_edges(spark, edges), sources.read_gephi_nodes(spark, nodes)
    assert e.first()["Label"] is None and e.first()["Weight"] == 1
    assert [r["missing"] for r in graph.dangling_edges(e, n, "Source", "Target", "Id").collect()] == [9]


def test_stored_graph(spark, tmp_path):
    edges = write(tmp_path / "e.csv", '"","from","to","n"\n"1",1,2,5\n"2",2,1,5\n')
    nodes = write(tmp_path / "n.csv", '"","name","community"\n"1","risk","10"\n"2","hazard","10"\n')
    e, n = sources.read_stored_graph(spark, edges, nodes, schemas.STORED_KEYWORD_EDGES)
    assert {tuple(r) for r in e.collect()} == {(1, 2, 5), (2, 1, 5)}
    assert {tuple(r) for r in n.collect()} == {(1, "risk", 10), (2, "hazard", 10)}


def test_knowledge_graph(spark, tmp_path):
    doc = {
        "name": "g",
        "elements": [
            {"_id": "e1", "attributes": {"label": "friction"}},
            {"_id": "e2", "attributes": {"label": "skid"}},
            {"_id": "e3", "attributes": {"label": "skid"}},
        ],
        "connections": [
            {"_id": "c1", "direction": "directed", "delayed": False, "reversed": False,
             "attributes": {"connection type": "Same", "label": "synonym"}, "from": "e1", "to": "e2"},
            {"_id": "c2", "direction": "directed", "delayed": False, "reversed": False,
             "attributes": {"connection type": "Same", "label": "synonym"}, "from": "e2", "to": "e1"},
            {"_id": "c3", "direction": "directed", "delayed": True, "reversed": False,
             "attributes": {"label": "keyword"}, "from": "e1", "to": "e8"},
        ],
        "maps": [
            {"_id": "m", "elements": [{"_id": "n1", "position": {"x": 1.5, "y": -2}, "pinned": True, "element": "e1"}],
             "connections": [{"_id": "d1", "curvature": 0.5, "connection": "c1"}]}
        ],
    }
    kg = sources.read_knowledge_graph(spark, write(tmp_path / "g.json", json.dumps(doc, indent=1)))
    resolved = graph.resolve_connections(kg.elements, kg.connections)
    labels = {r["id"]: (r["from_label"], r["to_label"], r["delayed"]) for r in resolved.collect()}
    assert labels == {
        "c1": ("friction", "skid", False), "c2": ("skid", "friction", False), "c3": ("friction", None, True)
    }
    assert [tuple(r) for r in graph.synonym_pairs(resolved).collect()] == [("friction", "skid")]
    assert [tuple(r) for r in graph.duplicate_labels(kg.elements).collect()] == [("skid", 2)]
    assert [tuple(r) for r in kg.map_nodes.collect()] == [("m", "n1", "e1", 1.5, -2.0, True)]
    assert [tuple(r) for r in kg.map_edges.collect()] == [("m", "d1", "c1", 0.5)]


def catalogue(spark):
    """Five reports; 1 to 3 share road works, 4 and 5 share noise, 3-4 bridge."""
    words = {
        "RR 1": ["paving", "tyre", "wear", "road"],
        "RR 2": ["paving", "tyre", "road"],
        "RR 3": ["paving", "wear", "noise", "barrier", "tyre"],
        "RR 4": ["noise", "barrier", "law"],
        "RR 5": ["law", "noise"],
    }
    themes = {"RR 1": "Safety", "RR 2": "Risk", "RR 3": "Safety", "RR 4": "Risk", "RR 5": "Risk"}
    keywords = spark.createDataFrame(
        [(k, w) for k, ws in words.items() for w in ws], "report_note_number string, new_label string"
    )
    reports = spark.createDataFrame(
        [(k, t, f"Title {k}") for k, t in themes.items()],
        "report_note_number string, new_theme string, research_report_title string",
    )
    return keywords, reports


def test_paper_graph_and_exports(spark, tmp_path):
    keywords, reports = catalogue(spark)
    edges = networks.theme_edges(keywords, reports, "Safety")
    assert {tuple(r) for r in edges.collect()} == {
        ("RR 1", "RR 2", 2, "Safety", "Risk"),
        ("RR 1", "RR 3", 3, "Safety", "Safety"),
        ("RR 2", "RR 3", 2, "Risk", "Safety"),
        ("RR 3", "RR 4", 2, "Safety", "Risk"),
    }
    g = networks.paper_graph(keywords, reports, "Safety")
    nodes = {r["name"]: r.asDict() for r in g.nodes.collect()}
    assert set(nodes) == {"RR 1", "RR 2", "RR 3", "RR 4"}
    assert nodes["RR 3"]["betweenness"] == 2.0 and nodes["RR 3"]["degree"] == 3
    assert nodes["RR 1"]["keyword_1"] == "paving" and nodes["RR 2"]["keyword_3"] is None
    assert nodes["RR 4"]["new_theme"] == "Risk"
    assert {n["id"] for n in nodes.values()} == {1, 2, 3, 4}
    # everybody's first theme is kept when no theme is asked for
    assert networks.theme_edges(keywords, reports, None).count() == 5

    writers.export_edge_list(g, str(tmp_path / "edges"), ("paper_2", "paper_1"))
    lines = sorted(
        line for f in (tmp_path / "edges").glob("*.csv") for line in f.read_text().splitlines()
    )
    assert '"",Source,Target,shared_keywords,new_theme1,new_theme2' in lines
    assert "1,1,2,2,Safety,Risk" in lines
    writers.export_edge_list(g, str(tmp_path / "plain"))
    writers.export_node_list(g, str(tmp_path / "nodes"))
    assert spark.read.csv(str(tmp_path / "nodes"), header=True).columns[-1] == "Id"
    writers.export_top_papers(g, str(tmp_path / "top"))
    tops = spark.read.csv(str(tmp_path / "top"), header=True).collect()
    assert "RR 3" in {r["name"] for r in tops} and sum(int(r["n"]) for r in tops) == 4
    writers.export_widget_json(g, str(tmp_path / "widget"))
    links = spark.read.json(str(tmp_path / "widget" / "links")).collect()
    assert {(r["source"], r["target"], r["value"]) for r in links} == {(0, 1, 2), (0, 2, 3), (1, 2, 2), (2, 3, 2)}
    records = spark.read.json(str(tmp_path / "widget" / "nodes")).collect()
    assert {r["name"] for r in records} == {f"Title RR {i}" for i in range(1, 5)}


def test_ordered_exports(spark, tmp_path):
    edges = spark.range(2000).selectExpr(
        "cast(id * 7919 % 2000 as string) AS paper_1",
        "cast(id % 900 as string) AS paper_2",
        "id % 5 AS shared_keywords",
        "'a, \\nb' AS new_theme1",
        "cast(null as string) AS new_theme2",
    )
    g = graph.build_graph(edges)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.export_edge_list(g, str(tmp_path / "e"), ("paper_2", "paper_1"))
        writers.export_node_list(g, str(tmp_path / "n"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)

    def in_order(folder):
        files = sorted((tmp_path / folder).glob("part-*.csv"))
        rows = [list(csv.DictReader(f.open(newline=""))) for f in files]
        told = spark.read.json(str(tmp_path / folder / "_manifest")).collect()
        assert {r.file: r.rows for r in told} == {f.name: len(x) for f, x in zip(files, rows, strict=True) if x}
        assert sum(map(bool, rows)) > 1
        return sum(rows, [])

    found = in_order("e")
    assert [int(r[""]) for r in found] == list(range(1, 2001))
    assert [int(r["Id"]) for r in in_order("n")] == list(range(1, g.nodes.count() + 1))
    plain = graph.Graph(g.nodes, g.edges.drop("new_theme1"))
    writers.export_edge_list(plain, str(tmp_path / "p"), ("paper_2", "paper_1"))
    schema = "row_name int, Source int, Target int, shared_keywords int, new_theme2 string"
    back, _ = sources.read_stored_graph(spark, str(tmp_path / "p"), edge_schema=schema)
    want = writers.edge_table(plain).selectExpr("int(Source)", "int(Target)", "int(shared_keywords)", "new_theme2")
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_heatmap_ranks(spark):
    keywords, reports = catalogue(spark)
    g = graph.build_graph(networks.theme_edges(keywords, reports, "Safety"))
    cells = {(r["id_from"], r["id_to"]): (r["x"], r["y"]) for r in networks.heatmap(g).collect()}
    assert cells == {
        ("RR 1", "RR 2"): (1, 3), ("RR 1", "RR 3"): (2, 3), ("RR 2", "RR 3"): (2, 2), ("RR 3", "RR 4"): (3, 1)
    }


def test_keyword_graph(spark):
    keywords, _ = catalogue(spark)
    g = networks.keyword_graph(keywords, 2)
    pairs = {(r["keyword_1"], r["keyword_2"], r["n"]) for r in g.edges.collect()}
    assert pairs == {
        ("paving", "tyre", 3), ("paving", "wear", 2), ("tyre", "wear", 2),
        ("barrier", "noise", 2), ("law", "noise", 2),
    }


def test_bipartite_ids_follow_researchers(spark):
    df = spark.createDataFrame(
        [("B", "x"), ("A", "risk"), ("A", "hazard"), ("B", "risk"), ("A", "risk"), (None, "y")],
        "researcher string, new_label string",
    )
    nodes, edges = networks.researcher_keyword_graph(df)
    assert [r["Label"] for r in nodes.orderBy("Id").collect()] == ["A", "hazard", "risk", "B", "x"]
    assert [(r["Source"], r["Target"], r["Weight"]) for r in edges.orderBy("Id").collect()] == [
        (0, 1, 1), (0, 2, 1), (3, 2, 1), (3, 4, 1)
    ]
