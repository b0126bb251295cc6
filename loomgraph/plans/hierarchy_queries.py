"""Queries over the forests of node, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H
from loomgraph.runtime import table

_REACH = """
WITH RECURSIVE l AS (SELECT id, min(parent_id) AS parent_id FROM node GROUP BY id),
k AS (SELECT a.id, b.id AS parent_id FROM l a JOIN l b ON a.parent_id = b.id),
w(id, cur) AS (SELECT id, parent_id FROM k UNION SELECT w.id, k.parent_id FROM w JOIN k ON w.cur = k.id),
ring AS (SELECT id FROM w WHERE id = cur),
caught AS (SELECT w.id, min(w.cur) AS cycle_id FROM w JOIN ring ON w.cur = ring.id GROUP BY w.id)
"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.cycles(table(spark, d, "node"))


def p1_tree(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "node")).select(
        F.col("id").alias("node_id"), "root", "depth", F.array_join("path", "/").alias("path"), F.when(F.col("cycle_id").isNull(), F.col("subtree_size")).alias("subtree_size")
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, d, "node")))


QUERIES = {"p1_found": p1_found, "p1_tree": p1_tree, "p1_descendants": p1_descendants}

SQL = {
    "p1_found": _REACH + "SELECT id AS node_id, cycle_id FROM caught",
    "p1_tree": _REACH
    + """, good AS (SELECT id FROM l WHERE id NOT IN (SELECT id FROM caught)),
    up AS (SELECT g.id, w.cur FROM good g JOIN w ON g.id = w.id),
    size AS (SELECT cur AS id, count(*) AS below FROM up GROUP BY cur),
    height AS (SELECT id, count(*) AS depth FROM up GROUP BY id),
    chain AS (SELECT id, cur, coalesce((SELECT depth FROM height h WHERE h.id = up.cur), 0) AS lvl FROM up UNION ALL SELECT g.id, g.id, coalesce(h.depth, 0) FROM good g LEFT JOIN height h ON g.id = h.id)
    SELECT l.id AS node_id, c.root, CAST(h.depth AS INTEGER) AS depth, c.path, s.size AS subtree_size
    FROM l
    LEFT JOIN (SELECT id, arg_min(cur, lvl) AS root, string_agg(CAST(cur AS VARCHAR), '/' ORDER BY lvl) AS path FROM chain GROUP BY id) c ON l.id = c.id
    LEFT JOIN (SELECT g.id, coalesce(h.depth, 0) AS depth FROM good g LEFT JOIN height h ON g.id = h.id) h ON l.id = h.id
    LEFT JOIN (SELECT g.id, 1 + coalesce(s.below, 0) AS size FROM good g LEFT JOIN size s ON g.id = s.id) s ON l.id = s.id""",
    "p1_descendants": _REACH
    + """, good AS (SELECT id FROM l WHERE id NOT IN (SELECT id FROM caught)),
    up AS (SELECT g.id, w.cur FROM good g JOIN w ON g.id = w.id),
    height AS (SELECT id, count(*) AS depth FROM up GROUP BY id)
    SELECT up.cur AS ancestor_id, up.id AS descendant_id, CAST(h.depth - coalesce(a.depth, 0) AS INTEGER) AS distance
    FROM up JOIN height h ON up.id = h.id LEFT JOIN height a ON up.cur = a.id""",
}
