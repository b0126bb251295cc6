"""Property graph over the tables at hand.

``estate`` reads orders, suppliers and parts as a graph of callers and dependencies; node ids are code * 10**9 + key.
``contains`` reads the parent links of node as CONTAINS edges.  Both keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.runtime import table

_CODE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}


def _id(code: str, key: str) -> F.Column:
    return F.lit(_CODE[code] * 10**9) + F.col(key).cast("long")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows of node."""
    return table(spark, d, "node").dropDuplicates(["id"])


def contains(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "node").select("id", "parent_id").where("parent_id is not null").distinct()
    return rows.select(F.col("parent_id").alias("src_id"), F.col("id").alias("dst_id"), F.lit("CONTAINS").alias("kind"))


def estate(spark: SparkSession, d: str) -> DataFrame:
    """(src_id, dst_id, kind): order DEPENDS_ON part, order CALLS_HTTP supplier, supplier PRODUCES part, nation CONTAINS supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    uses = lines.select(_id("orders", "l_orderkey").alias("src_id"), _id("part", "l_partkey").alias("dst_id"), F.lit("DEPENDS_ON").alias("kind"))
    calls = lines.select(_id("orders", "l_orderkey").alias("src_id"), _id("supplier", "l_suppkey").alias("dst_id"), F.lit("CALLS_HTTP").alias("kind"))
    makes = lines.select(_id("supplier", "l_suppkey").alias("src_id"), _id("part", "l_partkey").alias("dst_id"), F.lit("PRODUCES").alias("kind"))
    holds = table(spark, d, "supplier").select(_id("nation", "s_nationkey").alias("src_id"), _id("supplier", "s_suppkey").alias("dst_id"), F.lit("CONTAINS").alias("kind"))
    return uses.union(calls).union(makes).union(holds).distinct()


# kinds of the edges between siblings, by number
SIBLING_KINDS = ("CALLS_CODE", "THROWS", "READS", "IMPLEMENTS", "CALLS", "DEPENDS_ON", "WRITES", "CALLS_HTTP")


def siblings(spark: SparkSession, d: str) -> DataFrame:
    """Each node and the next one of its parent as an edge, whose kind goes by the node's number."""
    rows = nodes(spark, d).where("parent_id is not null")
    after = F.lead("id").over(Window.partitionBy("parent_id").orderBy("id"))
    kind = F.element_at(F.array(*map(F.lit, SIBLING_KINDS)), (F.col("id") % len(SIBLING_KINDS) + 1).cast("int"))
    return rows.select(F.col("id").alias("src_id"), after.alias("dst_id"), kind.alias("kind")).where("dst_id is not null")


SIBLINGS_SQL = f"siblings AS (SELECT * FROM (SELECT id AS src_id, lead(id) OVER (PARTITION BY parent_id ORDER BY id) AS dst_id, {list(SIBLING_KINDS)}[id % {len(SIBLING_KINDS)} + 1] AS kind FROM n WHERE parent_id IS NOT NULL) WHERE dst_id IS NOT NULL)"
ESTATE_SQL = """estate AS (
    SELECT DISTINCT 6000000000 + l_orderkey AS src_id, 5000000000 + l_partkey AS dst_id, 'DEPENDS_ON' AS kind FROM lineitem
    UNION SELECT 6000000000 + l_orderkey, 4000000000 + l_suppkey, 'CALLS_HTTP' FROM lineitem
    UNION SELECT 4000000000 + l_suppkey, 5000000000 + l_partkey, 'PRODUCES' FROM lineitem
    UNION SELECT 2000000000 + s_nationkey, 4000000000 + s_suppkey, 'CONTAINS' FROM supplier)"""
NODE_SQL = "n AS (SELECT DISTINCT * FROM node)"
CONTAINS_SQL = "contains AS (SELECT DISTINCT parent_id AS src_id, id AS dst_id, 'CONTAINS' AS kind FROM node WHERE parent_id IS NOT NULL)"
