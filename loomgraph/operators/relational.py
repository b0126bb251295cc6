"""Lookups, filters, joins, aggregates and set operations over the tables of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.schema import NODE_KINDS


# lookups and filters
def by_fqn(nodes: DataFrame, application: int, fqn: str) -> DataFrame:
    return nodes.where((F.col("application_id") == application) & (F.col("fqn") == fqn))


def by_kinds(nodes: DataFrame, applications: list[int], kinds: list[str]) -> DataFrame:
    """Rows of the applications with one of the kinds; unknown kinds are dropped and an empty set means all."""
    rows = nodes.where(F.col("application_id").isin(*applications)) if applications else nodes
    known = [k for k in kinds if k in NODE_KINDS]
    return rows.where(F.col("kind").isin(*known)) if known else rows


def fqn_like(nodes: DataFrame, application: int, part: str, limit: int = 1000) -> DataFrame:
    """Names that hold ``part``, in which % and _ stay wildcards, in order."""
    return nodes.where((F.col("application_id") == application) & F.col("fqn").like(f"%{part}%")).orderBy("fqn", "id").limit(limit)


def classes_named(nodes: DataFrame, name: str, kinds: tuple[str, ...], ignore_case: bool = False) -> DataFrame:
    """Types whose name is ``name`` or whose qualified name ends with it."""
    n, f, w = F.col("name"), F.col("fqn"), F.lit(name)
    if ignore_case:
        n, f, w = F.lower(n), F.lower(f), F.lit(name.lower())
    return nodes.where(F.col("kind").isin(*kinds) & ((n == w) | f.endswith(F.concat(F.lit("."), w))))


def methods_named(nodes: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    n = F.lower("name") if ignore_case else F.col("name")
    return nodes.where((F.col("kind") == "METHOD") & (n == F.lit(name.lower() if ignore_case else name)))


def methods_of_class(nodes: DataFrame, owner: str, name: str, ignore_case: bool = False) -> DataFrame:
    """Methods by their own and their parent's name; methods without a parent are left out."""
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    parents = nodes.select(F.col("id").alias("owner_id"), low(F.col("name")).alias("owner_name"))
    rows = methods_named(nodes, name, ignore_case).join(parents, F.col("parent_id") == F.col("owner_id"))
    return rows.where(F.col("owner_name") == F.lit(owner.lower() if ignore_case else owner)).drop("owner_id", "owner_name")


def optional_filter(rows: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str | None] | None = None, since=None, until=None, time: str = "ts", page: int = 0, size: int = 50, tie: str = "id") -> DataFrame:
    """Filters that count only where a value is given; newest first; pages of 1..200 rows."""
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for column, part in (like or {}).items():
        if part is not None:
            rows = rows.where(F.col(column).like(f"%{part}%"))
    if since is not None:
        rows = rows.where(F.col(time) >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col(time) <= F.lit(until).cast("timestamp"))
    size = max(1, min(200, size))
    return rows.orderBy(F.col(time).desc(), tie).offset(max(0, page) * size).limit(size)


def incomplete_chunks(chunks: DataFrame, with_embedding: bool = True) -> DataFrame:
    """Chunks without hash or token count, or without vector if vectors are wanted."""
    missing = F.col("content_hash").isNull() | F.col("token_count").isNull()
    return chunks.where(missing | (F.col("embedding").isNull() if with_embedding else F.lit(False)))


def json_true(json: Column, path: str) -> Column:
    """Whether a JSON field is true; a missing one is not."""
    return F.coalesce(F.get_json_object(json, path).cast("boolean"), F.lit(False))


def json_has(json: Column, path: str, value: str) -> Column:
    """Whether a JSON array of strings holds a value."""
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(json, path), "array<string>"), value), F.lit(False))


def in_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Semi join on a set of ids of any size."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


# aggregates
def count_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def global_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table: a union of counts, then pivoted, instead of cross joins."""
    parts = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("name")).groupBy("name").count()
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(*[F.coalesce(F.sum(F.when(F.col("name") == name, F.col("count"))), F.lit(0)).alias(name) for name in tables])


def application_stats(apps: DataFrame, nodes: DataFrame, chunks: DataFrame, edges: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, key, name, nodes, chunks, edges, synonyms): counts per application, 0 where it has none; an edge counts for its source."""
    owner = nodes.select(F.col("id").alias("node_id"), "application_id")
    per = {
        "nodes": count_by(nodes, "application_id", name="nodes"),
        "chunks": count_by(chunks, "application_id", name="chunks"),
        "edges": count_by(edges.join(owner, F.col("src_id") == F.col("node_id")), "application_id", name="edges"),
        "synonyms": count_by(synonyms.join(owner, F.col("source_node_id") == F.col("node_id")), "application_id", name="synonyms"),
    }
    out = apps.select("id", "key", "name")
    for name, counts in per.items():
        out = out.join(counts.withColumnRenamed("application_id", "id"), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def shared_interfaces(types: DataFrame, key: str = "fqn") -> DataFrame:
    """(key, apps): keys that at least two applications have."""
    return types.groupBy(key).agg(F.countDistinct("application_id").alias("apps")).where("apps >= 2")


def judge_summary(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Mean, sample variance (0 for one judge) and confidence 1 / (1 + variance) per key."""
    agg = scores.where(F.col(score).isNotNull()).groupBy(key).agg(F.avg(score).alias("mean"), F.coalesce(F.var_samp(score), F.lit(0.0)).alias("variance"), F.count(F.lit(1)).alias("judges"))
    return agg.select(key, F.round("mean", 6).alias("mean"), F.round(F.coalesce(F.nanvl("variance", F.lit(0.0)), F.lit(0.0)), 6).alias("variance"), F.round(1 / (1 + F.coalesce(F.nanvl("variance", F.lit(0.0)), F.lit(0.0))), 6).alias("confidence"), "judges")


def first_rows(rows: DataFrame, group: list[str], order: list, n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in a definite order."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def capped_list(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, shown, more): the first ``n`` values of each group in order, and how many there are besides.

    Only the shown rows are gathered into a list, so that a large group stays distributed.
    """
    distinct = rows.select(group, value).distinct()
    totals = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    shown = first_rows(distinct, [group], [value], n).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("shown"))
    return shown.join(totals, group).select(group, "shown", F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


# sets
def first_wins(*ranked: DataFrame, key: str = "id") -> DataFrame:
    """Union of lists in which the row of the earlier list wins."""
    out = None
    for k, rows in enumerate(ranked):
        part = rows.withColumn("source_rank", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return first_rows(out, [key], ["source_rank"]).drop("rank")


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair of ends and kind."""
    return edges.select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b"), "kind").distinct()


# documentation state
def stale_docs(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, locale, reason): documents whose public or technical chunk is missing or older than they are."""
    latest = lambda kind, name: (
        chunks.where((F.col("source") == "doc") & (F.col("kind") == kind)).groupBy("node_id", F.col("lang_detected").alias("locale")).agg(F.max("updated_at").alias(name))
    )
    rows = docs.join(latest("public", "public_at"), ["node_id", "locale"], "left").join(latest("tech", "tech_at"), ["node_id", "locale"], "left")

    def state(text: str, at: str) -> Column:
        return F.when(F.trim(text) != "", F.when(F.col(at).isNull(), "missing").when(F.col(at) < F.col("updated_at"), "stale"))

    rows = rows.select("node_id", "locale", state("doc_public", "public_at").alias("public_state"), state("doc_tech", "tech_at").alias("tech_state"))
    return rows.where(F.col("public_state").isNotNull() | F.col("tech_state").isNotNull())


# fixed values: edges by which a method depends on another, kinds whose documents rest on those of their children, order of kinds
METHOD_DEPENDENCIES = (
    "CALLS_CODE", "THROWS", "READS", "WRITES", "QUERIES", "CALLS_HTTP", "CALLS_GRPC", "PRODUCES", "CONSUMES", "CONFIGURES", "CIRCUIT_BREAKER_TO", "RETRIES_TO", "TIMEOUTS_TO", "DEPENDS_ON",
)
RESTS_ON = {("CLASS", "INTERFACE", "ENUM", "RECORD"): ("METHOD", "FIELD"), ("PACKAGE",): ("CLASS", "INTERFACE", "ENUM", "RECORD", "PACKAGE"), ("MODULE", "REPO"): ("PACKAGE", "MODULE")}
KIND_ORDER = (
    ("FIELD", "ENDPOINT", "TOPIC", "INFRASTRUCTURE"), ("METHOD",), ("CLASS", "INTERFACE", "ENUM", "RECORD", "SERVICE", "MAPPER", "CONFIG", "SCHEMA", "EXCEPTION", "TEST"), ("PACKAGE",), ("MODULE",), ("REPO",),
)


def kind_priority(kind: Column) -> Column:
    """Place of a kind in the order of documentation, from the bottom up; unknown kinds come last."""
    return F.coalesce(*[F.when(kind.isin(*kinds), F.lit(k)) for k, kinds in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))


def ready_nodes(nodes: DataFrame, docs: DataFrame, edges: DataFrame, locale: str, limit: int | None = None, break_cycles: bool = False) -> DataFrame:
    """(id, kind, prio) of nodes without a document in the locale whose prerequisites are documented, bottom-up by kind.

    Methods wait for the methods they depend on (not for themselves), types for their methods and fields, packages for
    types and packages, modules and repositories for packages and modules.  A prerequisite is documented if its digest is
    not empty; a node with any document, even an empty one, is not asked for again.  With ``break_cycles`` nobody waits.
    """
    mine = docs.where(F.col("locale") == locale)
    open_ = nodes.join(mine.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")
    if not break_cycles:
        told = mine.where(F.col("doc_digest") != "").select(F.col("node_id").alias("id")).distinct()
        untold = nodes.join(told, "id", "left_anti")
        needs = untold.where("kind = 'METHOD'").select(F.col("id").alias("dst_id"))
        blocked = edges.where(F.col("kind").isin(*METHOD_DEPENDENCIES) & (F.col("src_id") != F.col("dst_id"))).join(needs, "dst_id", "left_semi").select(F.col("src_id").alias("id"), F.array(F.lit("METHOD")).alias("for_kinds"))
        rests = F.explode(F.array(*[F.struct(F.array(*map(F.lit, above)).alias("above"), F.array(*map(F.lit, below)).alias("below")) for above, below in RESTS_ON.items()]))
        children = untold.where("parent_id is not null").select(F.col("parent_id").alias("id"), "kind", rests.alias("r")).where(F.array_contains("r.below", F.col("kind")))
        blocked = blocked.union(children.select("id", "r.above")).distinct()
        waiting = nodes.select("id", "kind").join(blocked, "id").where(F.array_contains("for_kinds", F.col("kind"))).select("id")
        open_ = open_.join(waiting, "id", "left_anti")
    rows = open_.select("id", "kind", kind_priority(F.col("kind")).alias("prio"))
    return rows.orderBy("prio", "id").limit(limit) if limit else rows


def documentation_order(nodes: DataFrame, docs: DataFrame, edges: DataFrame, locale: str, rounds: int) -> DataFrame:
    """(id, round): which nodes become ready in which round if every ready node is documented at once."""
    from loomgraph.runtime import cut

    out, known = None, docs.select("node_id", "locale", "doc_digest")
    for k in range(1, rounds + 1):
        ready = cut(ready_nodes(nodes, known, edges, locale).select("id").withColumn("round", F.lit(k)))
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        known = known.unionByName(ready.select(F.col("id").alias("node_id"), F.lit(locale).alias("locale"), F.lit("done").alias("doc_digest")))
    return out if out is not None else nodes.select("id").limit(0).withColumn("round", F.lit(0))
