"""The graph between applications: shared contracts, shared integrations and endpoints matched by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def contracts(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(fqn, application_id, role, methods): interfaces of the same name in two applications or more.

    Applications with a type that names the interface among its ``supertypes`` provide it, the others consume it;
    ``methods`` is the largest number of methods that any copy of the interface has.
    """
    faces = types.where("kind = 'INTERFACE'")
    shared = faces.groupBy("fqn").agg(F.countDistinct("application_id").alias("apps")).where("apps >= 2").select("fqn")
    counts = methods.where("kind = 'METHOD'").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    most = faces.join(shared, "fqn").join(counts, "id", "left").groupBy("fqn").agg(F.coalesce(F.max("n"), F.lit(0)).alias("methods"))
    users = faces.join(shared, "fqn").select("fqn", "application_id").distinct()
    named = types.where("supertypes is not null").select("application_id", F.explode("supertypes").alias("super")).distinct()
    full = named.join(shared, F.col("super") == F.col("fqn")).select("fqn", "application_id")
    short = named.join(shared.withColumn("simple", T.simple_name(F.col("fqn"))), F.col("super") == F.col("simple")).select("fqn", "application_id")
    providers = full.union(short).distinct().withColumn("provides", F.lit(True))
    rows = users.join(providers, ["fqn", "application_id"], "left").join(most, "fqn")
    return rows.select("fqn", "application_id", F.when(F.col("provides"), "PROVIDES").otherwise("CONSUMES").alias("role"), "methods")


def integrations(nodes: DataFrame, edges: DataFrame, limit: int | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """(application_id, target, label, type, kind, n): edges of each application into synthetic nodes or out of them.

    Old spellings count as synthetic.  A limit takes the first targets by name.
    """
    synthetic = nodes.withColumn("target", T.normalize_fqn(F.col("fqn"))).withColumn("type", T.integration_type(F.col("fqn"))).where("type is not null and (synthetic or fqn <> target)")
    if types:
        synthetic = synthetic.where(F.col("type").isin(*types))
    if limit is not None:
        synthetic = synthetic.join(F.broadcast(synthetic.select("target").distinct().orderBy("target").limit(limit)), "target", "left_semi")
    ends = synthetic.select(F.col("id").alias("sid"), F.col("application_id").alias("own_app"), "target", T.integration_label(F.col("fqn"), F.col("name")).alias("label"), "type")
    apps = nodes.select(F.col("id").alias("other"), F.col("application_id").alias("other_app"))
    into = edges.join(ends, F.col("dst_id") == F.col("sid")).join(apps, F.col("src_id") == F.col("other")).select(F.col("other_app").alias("application_id"), "target", "label", "type", "kind")
    out = edges.join(ends, F.col("src_id") == F.col("sid")).join(apps, F.col("dst_id") == F.col("other")).select(F.col("other_app").alias("application_id"), "target", "label", "type", "kind")
    return into.union(out).groupBy("application_id", "target", "label", "type", "kind").agg(F.count(F.lit(1)).alias("n"))


def endpoint_matches(servers: DataFrame, clients: DataFrame) -> DataFrame:
    """(label, server_app, client_app): clients of an endpoint in applications that do not serve it.

    Servers are (application_id, verb, base_path, path), clients (application_id, verb, url); paths are normalised.
    """
    full = T.normalize_path(F.concat(F.coalesce(F.regexp_replace("base_path", "/+$", ""), F.lit("")), F.lit("/"), F.coalesce(F.regexp_replace("path", "^/+", ""), F.lit(""))))
    s = servers.select(F.concat(F.upper("verb"), F.lit(" "), full).alias("label"), F.col("application_id").alias("server_app")).where("label is not null").distinct()
    c = clients.select(F.concat(F.upper("verb"), F.lit(" "), T.normalize_path(F.col("url"))).alias("label"), F.col("application_id").alias("client_app")).where("label is not null").distinct()
    own = s.select("label", F.col("server_app").alias("client_app"))
    return c.join(own, ["label", "client_app"], "left_anti").join(s, "label").select("label", "server_app", "client_app")


def graph(contract_rows: DataFrame, integration_rows: DataFrame, match_rows: DataFrame) -> DataFrame:
    """(source, target, kind, n): the three strategies as edges between application and contract, target or endpoint; equal edges are summed."""
    app = lambda c: F.concat(F.lit("app:"), F.col(c))
    a = contract_rows.select(app("application_id").alias("source"), F.col("fqn").alias("target"), F.col("role").alias("kind"), F.col("methods").cast("long").alias("n"))
    b = integration_rows.select(app("application_id").alias("source"), "target", "kind", F.col("n").cast("long").alias("n"))
    serve = match_rows.select(app("server_app").alias("source"), F.col("label").alias("target"), F.lit("PROVIDES").alias("kind"), F.lit(1).cast("long").alias("n")).distinct()
    call = match_rows.select(app("client_app").alias("source"), F.col("label").alias("target"), F.lit("CALLS_HTTP").alias("kind"), F.lit(1).cast("long").alias("n")).distinct()
    return a.unionByName(b).unionByName(serve).unionByName(call).groupBy("source", "target", "kind").agg(F.sum("n").alias("n"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row with the numbers of edges by kind of target."""
    http = F.col("target").startswith("infra:http:")
    kafka = F.col("target").startswith("infra:kafka:")
    return edges.agg(F.countDistinct(F.when(http, F.col("target"))).alias("http"), F.countDistinct(F.when(kafka, F.col("target"))).alias("kafka"), F.count(F.lit(1)).alias("edges"))
