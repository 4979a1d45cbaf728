"""Readers, writers and schemas for catalogues and graphs."""

from tagweave.sources.quoted import read_quoted_csv
from tagweave.sources.readers import (
    read_catalogue,
    read_gephi_edges,
    read_gephi_nodes,
    read_knowledge_graph,
    read_nodes,
    read_report_keywords,
    read_stored_graph,
    snake_case_columns,
)
from tagweave.sources.writers import (
    export_edge_list,
    export_node_list,
    export_top_papers,
    export_widget_json,
    write_nodes,
    write_report_keywords,
)

__all__ = [
    "export_edge_list",
    "export_node_list",
    "export_top_papers",
    "export_widget_json",
    "read_catalogue",
    "read_gephi_edges",
    "read_gephi_nodes",
    "read_knowledge_graph",
    "read_nodes",
    "read_quoted_csv",
    "read_report_keywords",
    "read_stored_graph",
    "snake_case_columns",
    "write_nodes",
    "write_report_keywords",
]
