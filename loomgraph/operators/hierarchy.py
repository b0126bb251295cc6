"""Parent-child rows to full hierarchies.

Method: bottom-up leaf peeling.  Each round removes the rows that are nobody's parent and sends their subtree sizes to
their parents; the reverse peel order then hands root, depth and path (or the id of the cycle above) down to each round.
What no round can peel is the set of rows on cycles.

Peeling alone takes as many rounds as a tree is deep.  Where few of the rows that remain are leaves, most of them have a
single child, and such chains are contracted between the rounds: pointer doubling finds for each row of a chain the top
of the chain, its distance and the sizes above it in log2(length) joins, the rows of the chain leave together, and the
row below takes their place with a longer link.  Peeling and contraction together end after O(log n) rounds, whatever the
form of the trees, and every round is a join over the rows that remain, cut by a checkpoint; nothing is gathered in one
task.  Cycles are found by the same doubling.  Descendants are kept as rows (ancestor, descendant, distance) rather than
as lists in one row, because the list of a root is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut

CONTRACT_BELOW = 0.25


def links(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row (id, parent_id) per node.

    A repeated row is one row; of contradicting parents the smallest counts; null ids are no nodes; a parent that is no
    row ends the chain and comes out as null.
    """
    one = (
        nodes.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent_id"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent_id").alias("parent_id"))
    )
    known = one.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    return one.join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))


def _contract(marked: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows of chains that leave) of rows with ``children``, the number of their children.

    A chain is a maximal run of rows with one child and a parent.  Each of its rows learns the chain's ``top`` row by
    doubling, with the steps, ids (``via``) and sizes (``sent``) from there; rows on cycles of nothing but such rows never
    learn one and stay.
    """
    single = (F.col("children") == 1) & F.col("parent_id").isNotNull()
    # "to" is the next row of the chain above, or null at its top; link, via and sent sum up from there
    own = F.col("below") + 1 + F.col("extra")
    chain = marked.where(single).select("id", "parent_id", "below", "extra", "link", "via", "low", own.alias("sent"))
    above = chain.select(F.col("id").alias("parent_id"), F.lit(True).alias("inner"))
    walk = chain.join(above, "parent_id", "left").select("id", "parent_id", "below", "extra", F.when(F.col("inner"), F.col("parent_id")).alias("to"), F.when(F.col("inner").isNull(), F.col("id")).alias("top"), F.when(F.col("inner").isNull(), F.col("parent_id")).alias("head"), "link", "via", "sent", "low")
    walk = cut(walk)
    left, before = walk.where("to is not null").count(), None
    while left and left != before:
        # rows whose pointer is at the top of the chain are done; the rest jump twice as far
        far = walk.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("top").alias("top2"), F.col("head").alias("head2"), F.col("link").alias("link2"), F.col("via").alias("via2"), F.col("sent").alias("sent2"), F.col("low").alias("low2"))
        path = F.concat("via2", F.array("to"), "via") if with_path else F.col("via")
        going = walk.where("to is not null").join(far, "to").select("id", "parent_id", "below", "extra", F.col("to2").alias("to"), F.col("top2").alias("top"), F.col("head2").alias("head"), (F.col("link") + F.col("link2")).alias("link"), path.alias("via"), (F.col("sent") + F.col("sent2")).alias("sent"), F.least("low", "low2").alias("low"))
        walk = cut(walk.where("to is null").unionByName(going))
        before, left = left, walk.where("to is not null").count()
    done = walk.where("top is not null")
    # the row below each chain: its parent is the chain's last row, whose sums are those of the whole chain
    joint = done.select(F.col("id").alias("parent_id"), F.col("top").alias("chain"), "head", F.col("link").alias("chain_link"), F.col("via").alias("chain_via"), F.col("sent").alias("chain_sent"), F.col("low").alias("chain_low"))
    ids = done.select("id")
    stay = marked.join(ids, "id", "left_anti").join(joint, "parent_id", "left")
    path = F.when(F.col("head").isNotNull(), F.concat("chain_via", F.array("parent_id"), "via")).otherwise(F.col("via")) if with_path else F.col("via")
    stay = cut(
        stay.select(
            "id", F.coalesce("head", "parent_id").alias("parent_id"), "below", (F.col("extra") + F.coalesce("chain_sent", F.lit(0))).alias("extra"),
            (F.col("link") + F.coalesce("chain_link", F.lit(0))).alias("link"), path.alias("via"), F.least("low", "chain_low").alias("low"), "chain", F.col("extra").alias("own_extra"), "chain_sent",
        )
    )
    bottom = stay.where("chain is not null").select(F.col("chain").alias("top"), F.col("id").alias("bottom"), (F.col("own_extra") + F.col("chain_sent")).alias("all_sent"))
    # size = size of the bottom row + what lies between + the row itself with what it has received
    gone = done.join(bottom, "top").select("id", F.col("head").alias("parent_id"), "link", "via", "bottom", (F.col("all_sent") - F.col("sent") + F.col("below") + 1).alias("more"))
    return stay.select("id", "parent_id", "below", "extra", "link", "via", "low"), cut(gone)


def _rings(rest: DataFrame) -> DataFrame:
    """Rows on cycles: pointer doubling, so that a ring of n nodes takes log2(n) rounds."""
    ring = cut(rest.select("id", F.col("parent_id").alias("to"), "low", "below"))
    while True:
        far = ring.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        after = cut(ring.join(far, "to").select("id", F.col("far").alias("to"), F.least("low", "far_low").alias("low"), "below", F.col("low").alias("was")))
        ring = after.drop("was")
        if after.where("low <> was").isEmpty():
            break
    none = F.lit(None)
    return ring.select("id", (F.col("below") + 1).alias("subtree_size"), none.cast("long").alias("root"), none.cast("int").alias("depth"), none.cast("array<long>").alias("path"), F.col("low").alias("cycle_id"))


def hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_path: bool = True, contract_below: float = CONTRACT_BELOW) -> DataFrame:
    """(id, parent_id, root, depth, path, subtree_size, cycle_id), one row per node.

    ``path`` runs from the root to the node (null unless ``with_path``); ``depth`` of a root is 0.  A node on or below a
    cycle has only ``cycle_id``, the smallest id on that cycle, and the size of what hangs below it.  Chains are
    contracted where less than the share ``contract_below`` of the rows are leaves; the result is the same for every
    share.  An empty table gives no row.
    """
    none = F.array().cast("array<long>") if with_path else F.lit(None).cast("array<long>")
    # link: steps to the parent; via: ids passed by the link, low: the least of them and the row's own; below: sizes received; extra: sizes of the rows that the link passes
    zero = F.lit(0).cast("long")
    rest = links(nodes, id_col, parent_col).select("id", "parent_id", zero.alias("below"), zero.alias("extra"), F.lit(1).alias("link"), none.alias("via"), F.col("id").alias("low"))
    gone: list[tuple[str, DataFrame]] = []
    while True:
        children = rest.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
        marked = cut(rest.join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit(0))))
        n, leaf, single = marked.agg(F.count(F.lit(1)), F.count(F.when(F.col("children") == 0, 1)), F.count(F.when((F.col("children") == 1) & F.col("parent_id").isNotNull(), 1))).first()
        if not leaf:
            break  # nothing, or nothing but cycles
        leaves = marked.where("children = 0")
        gone.append(("leaf", leaves))
        sent = leaves.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum(F.col("below") + 1 + F.col("extra")).alias("got"), F.count(F.lit(1)).alias("lost"))
        rest = marked.where("children > 0").join(sent, "id", "left").select("id", "parent_id", (F.col("below") + F.coalesce("got", F.lit(0))).alias("below"), "extra", "link", "via", "low", (F.col("children") - F.coalesce("lost", F.lit(0))).alias("children"))
        if leaf < contract_below * n and single:
            rest, chains = _contract(cut(rest), with_path)
            gone.append(("chain", chains))
        else:
            rest = rest.drop("children")
    keep = ["id", "subtree_size", "root", "depth", "path", "cycle_id"]
    done = _rings(marked) if n else links(nodes, id_col, parent_col).limit(0).select("id", F.lit(0).cast("long").alias("subtree_size"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<long>").alias("path"), F.lit(None).cast("long").alias("cycle_id"))
    for k, (what, rows) in enumerate(reversed(gone)):
        above = done.select(F.col("id").alias("parent_id"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"), F.col("cycle_id").alias("up_cycle"), F.lit(True).alias("up"))
        rows = rows.join(above, "parent_id", "left")
        size = F.col("below") + 1 if what == "leaf" else F.col("size") + F.col("more")
        if what == "chain":
            rows = rows.join(done.select(F.col("id").alias("bottom"), F.col("subtree_size").alias("size")), "bottom")
        free, caught = F.col("up").isNull(), F.col("up_cycle").isNotNull()
        path = F.when(free, F.array("id")).when(~caught, F.concat("up_path", "via", F.array("id"))) if with_path else F.lit(None).cast("array<long>")
        own = rows.select(
            "id",
            size.alias("subtree_size"),
            F.when(free, F.col("id")).otherwise(F.col("up_root")).alias("root"),
            F.when(free, F.lit(0)).otherwise(F.col("up_depth") + F.col("link")).cast("int").alias("depth"),
            path.alias("path"),
            F.col("up_cycle").alias("cycle_id"),
        )
        # every round is read twice by the next ones, so all but the last are cut
        done = done.unionByName(cut(own) if k + 1 < len(gone) else own)
    return done.select(*keep)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every node and each of its proper ancestors, from ``path``."""
    return (
        tree.where(F.col("path").isNotNull())
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
        .where(F.col("at") < F.col("depth"))
        .select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )


def cycles(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", **how) -> DataFrame:
    """(node_id, cycle_id) of each node whose chain of parents never ends."""
    tree = hierarchy(nodes, id_col, parent_col, with_path=False, **how)
    return tree.where(F.col("cycle_id").isNotNull()).select(F.col("id").alias("node_id"), "cycle_id")
