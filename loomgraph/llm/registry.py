"""The modules of this subpackage that hold queries."""

from loomgraph.llm import queries


def modules() -> list:
    return [queries]
