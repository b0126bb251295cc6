"""Graph traversal: impact, expansion, neighbourhoods, weighted paths and closures.

Each round joins the frontier with the edges, removes what was visited and is cut by a checkpoint, so that a plan does not
grow with the depth and a lost executor costs one round.  Frontiers are never broadcast by hand: the planner does so where
its statistics allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.runtime import cut
from loomgraph.schema import DEFAULT_COST, EDGE_WEIGHT, PATH_COST


def _table(values: dict[str, float], kind: Column, other: float | None) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in values.items()], F.lit(other).cast("double"))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None, reverse: bool = False) -> DataFrame:
    """(root_id, id, depth): everything reached from each root in at most ``max_depth`` steps, with the least depth.

    Roots themselves are left out; a step goes from src to dst, or back if ``reverse``.  Without ``max_depth`` everything
    is reached, by doubling: the number of rounds is the logarithm of the depth, and what 2^k steps join are pairs of
    nodes, at most one per node where each has one edge into it, as in a hierarchy.
    """
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    # read in every round, so written down once, where the frontier meets it
    steps = cut(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct().repartition("id"))
    front = roots.select(F.col("id").alias("root_id"), "id").distinct()
    visited = front.withColumn("depth", F.lit(0))
    if max_depth is None:
        return _reach_all(steps, visited)
    for depth in range(1, max_depth + 1):
        found = front.join(steps, "id").select("root_id", F.col("next").alias("id")).distinct()
        front = cut(found.join(visited.select("root_id", "id"), ["root_id", "id"], "left_anti"))
        if front.isEmpty():
            break
        visited = visited.unionByName(front.withColumn("depth", F.lit(depth)))
    return visited.where("depth > 0")


def _reach_all(steps: DataFrame, visited: DataFrame) -> DataFrame:
    """All reached pairs: those nearer than 2^k, prolonged by exactly 2^k steps, give those nearer than 2^(k+1).

    Distances leave no gap, so a round that finds nothing is the last one, whether or not walks go on in circles.
    """
    jump, length = steps, 1
    visited = cut(visited)
    while True:
        found = visited.join(jump, "id").groupBy("root_id", F.col("next").alias("id")).agg((F.min("depth") + length).alias("depth"))
        new = cut(found.join(visited.select("root_id", "id"), ["root_id", "id"], "left_anti"))
        if new.isEmpty():
            return visited.where("depth > 0")
        visited = visited.unionByName(new)
        jump = cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")).distinct())
        length *= 2


def impact(edges: DataFrame, nodes: DataFrame, root: int, max_depth: int = 5) -> DataFrame:
    """(id, depth) of all that depends on ``root``; an unknown root is an error."""
    start = nodes.where(F.col("id") == root).select("id").distinct()
    if start.isEmpty():
        raise ValueError(f"node {root} is unknown")
    return reach(edges, start, max_depth, reverse=True).select("id", "depth")


def expand(edges: DataFrame, seeds: DataFrame, radius: int, per_hop: int = 50) -> DataFrame:
    """(hop, id, weight): neighbours in both directions over weighted kinds; per hop the ``per_hop`` heaviest, ties by id."""
    radius = max(1, min(3, radius))
    both = edges.select("src_id", "dst_id", "kind").union(edges.select("dst_id", "src_id", "kind"))
    steps = both.withColumn("weight", _table(EDGE_WEIGHT, F.col("kind"), None)).where("weight is not null").groupBy(F.col("src_id").alias("id"), F.col("dst_id").alias("next")).agg(F.max("weight").alias("weight"))
    steps = cut(steps.repartition("id"))
    seen = seeds.select("id").distinct()
    front, out = seen, None
    for hop in range(1, radius + 1):
        best = front.join(steps, "id").groupBy(F.col("next").alias("id")).agg(F.max("weight").alias("weight")).join(seen, "id", "left_anti")
        front = cut(best.orderBy(F.col("weight").desc(), "id").limit(per_hop).withColumn("hop", F.lit(hop)))
        out = front if out is None else out.unionByName(front)
        if front.isEmpty():
            break
        seen = seen.union(front.select("id"))
        front = front.select("id")
    return out.select("hop", "id", "weight")


def neighbourhood_edges(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(hop, src_id, dst_id, kind): every edge that touches the frontier of a hop, in both directions."""
    depth = max(1, min(3, depth))
    front = seeds.select("id").distinct()
    seen, out = front, None
    for hop in range(1, depth + 1):
        touching = cut(touching_any(edges, front))
        part = touching.withColumn("hop", F.lit(hop))
        out = part if out is None else out.unionByName(part)
        ends = touching.select(F.col("src_id").alias("id")).union(touching.select("dst_id")).distinct()
        front = cut(ends.join(seen, "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return out.select("hop", "src_id", "dst_id", "kind")


def touching_any(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ``ids``: two semi joins, never one join on a disjunction."""
    out = edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").select("src_id", "dst_id", "kind")
    into = edges.join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id", "kind")
    return out.union(into).distinct()


def touching_both(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    one = edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    return one.join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id", "kind").distinct()


def clamp_limit(limit: int, default: int = 100, most: int = 10_000) -> int:
    return default if limit <= 0 else min(limit, most)


def neighbours(edges: DataFrame, node: int, limit: int = 0) -> DataFrame:
    """(id) of the direct neighbours in both directions, the smallest ids first up to the limit."""
    out = edges.where(F.col("src_id") == node).select(F.col("dst_id").alias("id"))
    into = edges.where(F.col("dst_id") == node).select(F.col("src_id").alias("id"))
    return out.union(into).where(F.col("id") != node).distinct().orderBy("id").limit(clamp_limit(limit))


def subgraph_nodes(nodes: DataFrame, application: int, kinds: list[str], limit: int) -> DataFrame:
    """Nodes of an application as (id, label, kind, grp), by name of the unit; unknown kinds are left out, none means all."""
    from loomgraph.schema import NODE_KINDS

    known = [k for k in kinds if k in NODE_KINDS]
    rows = nodes.where(F.col("application_id") == application)
    if known:
        rows = rows.where(F.col("kind").isin(*known))
    rows = rows.orderBy("fqn", "id").limit(clamp_limit(limit))
    return rows.select("id", F.coalesce("name", "fqn").alias("label"), "kind", F.col("package").alias("grp"))


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges with a readable id."""
    return edges.select(F.concat(F.col("src_id"), F.lit("->"), F.col("dst_id"), F.lit(":"), F.col("kind")).alias("id"), "src_id", "dst_id", "kind")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """(from_id, to_id, cost, hops, path) of the cheapest undirected path of at most ``max_hops`` steps for each pair.

    Bounded relaxation: each round extends the best known paths by one step and keeps, per start and node, the cheapest
    (ties: the lexicographically smaller path).  Equal ends give a path of no step; pairs without a path give no row.
    """
    cost = _table(PATH_COST, F.col("kind"), DEFAULT_COST)
    both = edges.select("src_id", "dst_id", cost.alias("step")).union(edges.select("dst_id", "src_id", cost.alias("step")))
    steps = both.groupBy(F.col("src_id").alias("at"), F.col("dst_id").alias("next")).agg(F.min("step").alias("step")).where("at <> next")
    steps = cut(steps.repartition("at"))
    wanted = pairs.select("from_id", "to_id").distinct()
    best = cut(wanted.select("from_id", F.col("from_id").alias("at"), F.lit(0.0).alias("cost"), F.array("from_id").alias("path")).distinct())
    front = best
    for _ in range(max_hops):
        longer = front.join(steps, "at").where(~F.array_contains("path", F.col("next")))
        longer = longer.select("from_id", F.col("next").alias("at"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("next")).alias("path"))
        new = longer.groupBy("from_id", "at").agg(F.min_by(F.struct("cost", "path"), F.struct("cost", "path")).alias("b")).select("from_id", "at", "b.cost", "b.path")
        old = best.select("from_id", "at", F.col("cost").alias("old"), F.col("path").alias("old_path"))
        # what is neither cheaper nor shorter than a known path is dominated; every other label goes on in its own round
        merged = cut(new.join(old, ["from_id", "at"], "full_outer"))
        better = F.col("old").isNull() | (F.col("cost") < F.col("old")) | ((F.col("cost") == F.col("old")) & (F.col("path") < F.col("old_path")))
        front = merged.where(F.col("cost").isNotNull() & better).select("from_id", "at", "cost", "path")
        best = merged.select("from_id", "at", F.when(F.col("cost").isNotNull() & better, F.col("cost")).otherwise(F.col("old")).alias("cost"), F.when(F.col("cost").isNotNull() & better, F.col("path")).otherwise(F.col("old_path")).alias("path"))
        if front.isEmpty():
            break
    return best.join(wanted.withColumnRenamed("to_id", "at"), ["from_id", "at"]).select("from_id", F.col("at").alias("to_id"), "cost", (F.size("path") - 1).alias("hops"), "path")


def path_text(paths: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, text): labels of a path in order; a node without a row is shown by its number."""
    each = paths.select("from_id", "to_id", F.posexplode("path").alias("at", "id"))
    named = each.join(nodes.select("id", label("name", "fqn", "id").alias("label")), "id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Node#"), "id")))
    return named.groupBy("from_id", "to_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " -> ").alias("text"))


def label(name: str, fqn: str, number: str) -> Column:
    return F.coalesce(F.when(F.trim(name) != "", F.col(name)), F.when(F.trim(fqn) != "", F.col(fqn)), F.concat(F.lit("Node#"), F.col(number)))


def all_pairs_paths(edges: DataFrame, ids: DataFrame, max_hops: int = 6, top: int = 5) -> DataFrame:
    """Cheapest paths between every two of the given nodes, the ``top`` cheapest of them.

    The nodes are the few that a question names; their number is bounded by the caller.
    """
    a, b = ids.select(F.col("id").alias("from_id")), ids.select(F.col("id").alias("to_id"))
    pairs = a.join(b, F.col("from_id") < F.col("to_id"))
    return shortest_paths(edges, pairs, max_hops).orderBy("cost", "from_id", "to_id").limit(top)


def closure_sets(own: DataFrame, calls: DataFrame, value: str = "value", max_depth: int = 10) -> DataFrame:
    """(id, value): each unit's values and those of all units it calls, however the calls circle."""
    roots = own.select("id").union(calls.select(F.col("src_id").alias("id"))).distinct()
    below = reach(calls, roots, max_depth)
    passed = below.join(own.select("id", value), "id").select(F.col("root_id").alias("id"), value)
    return own.select("id", value).union(passed).distinct()


def climb(calls: DataFrame, sites: DataFrame, stops: DataFrame) -> DataFrame:
    """(site_id, id, depth): the first stops met when climbing from call sites to their callers; a branch ends at its stop."""
    ends, starts = stops.select("id").distinct(), sites.select("id").distinct()
    open_ends = calls.join(ends.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")  # no step leaves a stop
    above = reach(open_ends, starts, None, reverse=True).select(F.col("root_id").alias("site_id"), "id", "depth")
    return starts.select(F.col("id").alias("site_id"), "id", F.lit(0).alias("depth")).unionByName(above).join(ends, "id", "left_semi").select("site_id", "id", "depth")


def summaries(own: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, urls, has_retry, has_timeout): addresses of a unit and of all units it calls, however deep, as a set and flags by OR."""
    below = reach(calls, own.select("id"), None).select("root_id", "id").union(own.select(F.col("id").alias("root_id"), "id"))
    rows = below.join(own, "id")
    return rows.groupBy(F.col("root_id").alias("id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.bool_or("has_retry").alias("has_retry"), F.bool_or("has_timeout").alias("has_timeout")
    )


def top_dependencies(edges: DataFrame, priority: dict[str, int], k: int = 20) -> DataFrame:
    """(src_id, rank, dst_id, kind): per source its ``k`` first targets by priority of the kind, then id."""
    w = Window.partitionBy("src_id").orderBy("prio", "dst_id", "kind")
    ranked = edges.withColumn("prio", _table({k_: float(v) for k_, v in priority.items()}, F.col("kind"), 99.0)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("src_id", "rank", "dst_id", "kind")
