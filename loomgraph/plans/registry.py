"""The modules that hold queries of the core."""

from loomgraph.plans import document_queries, graph_queries, hierarchy_queries, link_queries, retrieval_queries, table_queries, text_queries


def modules() -> list:
    return [hierarchy_queries, text_queries, graph_queries, table_queries, retrieval_queries, link_queries, document_queries]
