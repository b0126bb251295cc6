"""loomgraph: code-graph, retrieval and incremental-pipeline operators over Spark DataFrames.

Every operator is a pure function from DataFrames (and parameters) to a DataFrame.
"""
