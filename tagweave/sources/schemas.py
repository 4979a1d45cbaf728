"""Explicit schemas, so that no read has to infer one from the data.

Column names and types here are fixed values: files written by earlier tools
use them.
"""

CATALOGUE = (
    "report_note_number string, research_report_title string, key_words string,"
    " theme string, researcher string, published_date date, available_at string"
)
REPORT_KEYWORD = CATALOGUE + ", label string, new_label string"
KEYWORD_NODE = "id long, nodes string, n_reports long, label string"

# Stored results: the first column of each file is an unnamed row number.
STORED_PAPER_EDGES = "row_name string, Source int, Target int, shared_keywords int"
STORED_THEME_EDGES = STORED_PAPER_EDGES + ", new_theme1 string, new_theme2 string"
STORED_KEYWORD_EDGES = "row_name string, `from` int, `to` int, n int"
STORED_KEYWORD_NODES = "row_name string, name string, community int"

GEPHI_EDGES = (
    "Source long, Target long, Type string, Kind string, Id long,"
    " Label string, timeset string, Weight long"
)
GEPHI_NODES = "Id long, Label string, timeset string"

KNOWLEDGE_GRAPH = """
    name string,
    description string,
    elements array<struct<_id: string, attributes: map<string, string>>>,
    connections array<struct<
        _id: string, direction: string, delayed: boolean, reversed: boolean,
        attributes: map<string, string>, `from`: string, `to`: string>>,
    maps array<struct<
        _id: string,
        elements: array<struct<
            _id: string, position: struct<x: double, y: double>,
            pinned: boolean, element: string>>,
        connections: array<struct<
            _id: string, curvature: double, connection: string>>>>
"""
