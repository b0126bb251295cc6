"""Queries of traversal over whole graphs, with their SQL."""

from pyspark.sql import functions as F

from loomgraph import adapters as A
from loomgraph.operators import traverse as G
from loomgraph.runtime import table

_PART, _SUPPLIER = 5_000_000_001, 4_000_000_001
_NODES = "(SELECT DISTINCT src_id AS id FROM estate UNION SELECT DISTINCT dst_id FROM estate)"


def _ids(edges):
    return edges.select(F.col("src_id").alias("id")).union(edges.select("dst_id")).distinct()


def _one(spark, number):
    return spark.range(1).select(F.lit(number).cast("long").alias("id"))


def impact_bfs(spark, d):
    edges = A.estate(spark, d)
    return G.impact(edges, _ids(edges), _PART)


def khop_weighted(spark, d):
    return G.expand(A.estate(spark, d), _one(spark, _SUPPLIER), 2)


def neighborhood(spark, d):
    return G.neighbourhood_edges(A.estate(spark, d), _one(spark, _PART), 2)


def direct_neighbours(spark, d):
    return G.neighbours(A.estate(spark, d), _SUPPLIER, 20_000)


def induced_edges(spark, d):
    edges = A.estate(spark, d)
    ids = G.neighbours(edges, _SUPPLIER, 20_000).union(_one(spark, _SUPPLIER))
    return G.edge_view(G.touching_both(edges, ids))


def subgraph_edges(spark, d):
    """Edges that touch any top-rated supplier."""
    best = table(spark, d, "supplier").where("s_acctbal > 5000").select((F.lit(4 * 10**9) + F.col("s_suppkey")).alias("id"))
    return G.touching_any(A.estate(spark, d), best)


def subgraph_nodes(spark, d):
    return G.subgraph_nodes(A.nodes(spark, d), 1, ["CLASS", "METHOD", "NO_SUCH_KIND"], 5000)


def shortest_path(spark, d):
    """Cheapest paths between the first and the last child of every node outside circles."""
    edges = A.contains(spark, d)
    ends = edges.groupBy("src_id").agg(F.min("dst_id").alias("from_id"), F.max("dst_id").alias("to_id")).where("from_id < to_id")
    found = G.shortest_paths(edges, ends.select("from_id", "to_id"))
    return found.select("from_id", "to_id", "cost", "hops", F.array_join("path", "/").alias("path"))


def ancestors_closure(spark, d):
    """Closure over calls: the kinds of everything below a package, each kind once."""
    nodes = A.nodes(spark, d)
    packages = nodes.where("kind = 'PACKAGE'").select("id")
    below = G.reach(A.contains(spark, d), packages, None)
    return below.join(nodes.select("id", "kind"), "id").groupBy(F.col("root_id").alias("package_id"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("least_depth"))


def transitive_points(spark, d):
    """What a nation's suppliers, and they through their products, stand for."""
    edges = A.estate(spark, d).where("kind in ('CONTAINS', 'PRODUCES')")
    own = table(spark, d, "part").select((F.lit(5 * 10**9) + F.col("p_partkey")).alias("id"), F.col("p_brand").alias("value"))
    nations = edges.where("kind = 'CONTAINS'").select(F.col("src_id").alias("id")).distinct()
    sets = G.closure_sets(own, edges)
    return sets.join(nations, "id", "left_semi")


def parent_climb(spark, d):
    """From every function up to the first client, configuration or service type."""
    nodes = A.nodes(spark, d)
    stops = nodes.where("kind in ('CLIENT', 'CONFIG', 'SERVICE', 'CLASS')").select("id")
    return G.climb(A.contains(spark, d), nodes.where("kind = 'ENDPOINT'").select("id"), stops)


def method_summaries(spark, d):
    nodes = A.nodes(spark, d).where("source_code is not null")
    own = nodes.select(
        "id",
        F.array_sort(F.array_distinct(F.regexp_extract_all("source_code", F.lit(r'(/api/v[0-9]+/[a-z]+/[a-z]+)'), 1))).alias("urls"),
        F.col("source_code").contains("retry").alias("has_retry"),
        F.col("source_code").contains("timeout").alias("has_timeout"),
    )
    found = G.summaries(own, A.contains(spark, d))
    return found.select("id", F.size("urls").alias("n_urls"), F.md5(F.array_join("urls", ",")).alias("urls_hash"), "has_retry", "has_timeout")


def dep_topk_per_node(spark, d):
    return G.top_dependencies(A.estate(spark, d), {"CALLS_HTTP": 1, "DEPENDS_ON": 2, "PRODUCES": 3}, 20)


QUERIES = {
    f.__name__: f
    for f in (
        impact_bfs, khop_weighted, neighborhood, direct_neighbours, induced_edges, subgraph_edges, subgraph_nodes, shortest_path, ancestors_closure, transitive_points, parent_climb, method_summaries, dep_topk_per_node,
    )
}

_E = f"WITH RECURSIVE {A.ESTATE_SQL}"
_W = "CASE kind WHEN 'CALLS_CODE' THEN 1.0 WHEN 'IMPLEMENTS' THEN 0.8 WHEN 'DEPENDS_ON' THEN 0.7 WHEN 'CALLS_HTTP' THEN 0.7 WHEN 'PRODUCES' THEN 0.6 WHEN 'CONSUMES' THEN 0.6 WHEN 'READS' THEN 0.5 WHEN 'WRITES' THEN 0.5 WHEN 'CONTAINS' THEN 0.5 END"
_BOTH = f"both_ways AS (SELECT src_id AS a, dst_id AS b, CAST({_W} AS DOUBLE) AS w FROM estate UNION ALL SELECT dst_id, src_id, CAST({_W} AS DOUBLE) FROM estate)"
_NB = f"nb AS (SELECT id FROM (SELECT dst_id AS id FROM estate WHERE src_id = {_SUPPLIER} UNION SELECT src_id FROM estate WHERE dst_id = {_SUPPLIER}) WHERE id <> {_SUPPLIER})"
_C = f"WITH RECURSIVE {A.NODE_SQL}, {A.CONTAINS_SQL}"
SQL = {
    "impact_bfs": f"{_E}, r(id, depth) AS (SELECT CAST({_PART} AS BIGINT), 0 UNION SELECT e.src_id, r.depth + 1 FROM r JOIN estate e ON e.dst_id = r.id WHERE r.depth < 5) SELECT id, min(depth) AS depth FROM r WHERE id <> {_PART} GROUP BY id",
    "khop_weighted": f"""{_E}, {_BOTH}, h1 AS (SELECT b AS id, max(w) AS weight FROM both_ways WHERE a = {_SUPPLIER} AND b <> {_SUPPLIER} AND w IS NOT NULL GROUP BY b ORDER BY weight DESC, id LIMIT 50),
        h2 AS (SELECT b AS id, max(w) AS weight FROM both_ways JOIN h1 ON a = h1.id WHERE b <> {_SUPPLIER} AND b NOT IN (SELECT id FROM h1) GROUP BY b ORDER BY weight DESC, id LIMIT 50)
        SELECT 1 AS hop, id, weight FROM h1 UNION ALL SELECT 2, id, weight FROM h2""",
    "neighborhood": f"{_E}, a AS (SELECT src_id, dst_id, kind FROM estate WHERE src_id = {_PART} OR dst_id = {_PART}), f AS (SELECT src_id AS id FROM a UNION SELECT dst_id FROM a) SELECT 1 AS hop, * FROM a UNION ALL SELECT 2, src_id, dst_id, kind FROM estate WHERE src_id IN (SELECT id FROM f WHERE id <> {_PART}) OR dst_id IN (SELECT id FROM f WHERE id <> {_PART})",
    "direct_neighbours": f"{_E}, {_NB} SELECT id FROM nb ORDER BY id LIMIT 10000",
    "induced_edges": f"{_E}, {_NB}, s AS (SELECT id FROM nb UNION SELECT {_SUPPLIER}) SELECT src_id || '->' || dst_id || ':' || kind AS id, src_id, dst_id, kind FROM estate WHERE src_id IN (SELECT id FROM s) AND dst_id IN (SELECT id FROM s)",
    "subgraph_edges": f"{_E}, s AS (SELECT 4000000000 + s_suppkey AS id FROM supplier WHERE s_acctbal > 5000) SELECT src_id, dst_id, kind FROM estate WHERE src_id IN (SELECT id FROM s) OR dst_id IN (SELECT id FROM s)",
    "subgraph_nodes": "SELECT DISTINCT id, coalesce(name, fqn) AS label, kind, package AS grp FROM node WHERE application_id = 1 AND kind IN ('CLASS', 'METHOD')",
    "shortest_path": f"{_C}, ends AS (SELECT src_id, min(dst_id) AS from_id, max(dst_id) AS to_id FROM contains GROUP BY src_id HAVING min(dst_id) < max(dst_id)) SELECT from_id, to_id, CASE WHEN src_id IN (from_id, to_id) THEN 2.5 ELSE 5.0 END::double AS cost, CASE WHEN src_id IN (from_id, to_id) THEN 1 ELSE 2 END AS hops, CASE WHEN src_id IN (from_id, to_id) THEN from_id || '/' || to_id ELSE from_id || '/' || src_id || '/' || to_id END AS path FROM ends",
    "ancestors_closure": f"{_C}, r(root, id, depth, path) AS (SELECT id, id, 0, [id] FROM n WHERE kind = 'PACKAGE' UNION ALL SELECT r.root, c.dst_id, r.depth + 1, list_append(r.path, c.dst_id) FROM r JOIN contains c ON c.src_id = r.id WHERE NOT list_contains(r.path, c.dst_id)), m AS (SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id HAVING min(depth) > 0) SELECT m.root AS package_id, n.kind, count(*) AS n, CAST(min(m.depth) AS INTEGER) AS least_depth FROM m JOIN n ON m.id = n.id GROUP BY m.root, n.kind",
    "transitive_points": "SELECT DISTINCT CAST(2000000000 + s.s_nationkey AS BIGINT) AS id, p.p_brand AS value FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey JOIN part p ON p.p_partkey = l.l_partkey",
    "parent_climb": f"""{_C}, stop AS (SELECT id FROM n WHERE kind IN ('CLIENT', 'CONFIG', 'SERVICE', 'CLASS')),
        r(site, pos, depth, path) AS (SELECT id, id, 0, [id] FROM n WHERE kind = 'ENDPOINT' UNION ALL SELECT r.site, c.src_id, r.depth + 1, list_append(r.path, c.src_id) FROM r JOIN contains c ON c.dst_id = r.pos WHERE r.pos NOT IN (SELECT id FROM stop) AND NOT list_contains(r.path, c.src_id)),
        m AS (SELECT site, pos, min(depth) AS depth FROM r GROUP BY site, pos) SELECT site AS site_id, pos AS id, CAST(depth AS INTEGER) AS depth FROM m WHERE pos IN (SELECT id FROM stop)""",
    "method_summaries": f"""{_C}, own AS (SELECT id, list_distinct(regexp_extract_all(source_code, '/api/v[0-9]+/[a-z]+/[a-z]+')) AS urls, contains(source_code, 'retry') AS a, contains(source_code, 'timeout') AS b FROM n WHERE source_code IS NOT NULL),
        r(root, id) AS (SELECT id, id FROM own UNION SELECT r.root, c.dst_id FROM r JOIN contains c ON c.src_id = r.id), m AS (SELECT DISTINCT root, id FROM r)
        SELECT root AS id, CAST(len(u) AS INTEGER) AS n_urls, md5(array_to_string(u, ',')) AS urls_hash, a AS has_retry, b AS has_timeout FROM (SELECT root, list_sort(list_distinct(flatten(list(urls)))) AS u, bool_or(a) AS a, bool_or(b) AS b FROM m JOIN own ON m.id = own.id GROUP BY root)""",
    "dep_topk_per_node": f"{_E} SELECT src_id, CAST(rank AS INTEGER) AS rank, dst_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY CASE kind WHEN 'CALLS_HTTP' THEN 1 WHEN 'DEPENDS_ON' THEN 2 WHEN 'PRODUCES' THEN 3 ELSE 99 END, dst_id, kind) AS rank FROM estate) WHERE rank <= 20",
}
