"""Edges between nodes: structure, inheritance, annotations, signatures, calls, throws, integrations and configuration.

Nodes carry (id, application_id, fqn, name, package, kind, parent_id) and, where an operator needs them, the fields of
``meta`` as columns.  Names resolve inside an application.  Lookups are equi joins on keyed tables, and a preference among
several hits is one ranking, never a chain of collected maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.relational import first_rows
from loomgraph.schema import TYPE_KINDS


def _edges(rows: DataFrame, src: str, dst: str, kind: str | Column) -> DataFrame:
    return rows.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")).where("src_id is not null and dst_id is not null and src_id <> dst_id").distinct()


def package_chain(nodes: DataFrame) -> DataFrame:
    """(application_id, fqn, name, parent_fqn): every prefix of every package."""
    packages = nodes.select("application_id", "package").where(F.trim("package") != "").distinct()
    parts = F.size(F.split("package", r"\."))
    each = packages.select("application_id", F.explode(F.transform(F.sequence(F.lit(1), parts), lambda n: F.call_function("substring_index", F.col("package"), F.lit("."), n))).alias("fqn")).distinct()
    parent = F.when(F.contains("fqn", F.lit(".")), F.regexp_replace("fqn", r"\.[^.]*$", ""))
    return each.select("application_id", "fqn", F.substring_index("fqn", ".", -1).alias("name"), parent.alias("parent_fqn"))


def structural(nodes: DataFrame) -> DataFrame:
    """CONTAINS: package to subpackage, package to its types, owner to its members (by the name before the last dot)."""
    packages = nodes.where("kind = 'PACKAGE'").select("application_id", F.col("fqn").alias("owner_fqn"), F.col("id").alias("owner_id"))
    above = F.when(F.contains("fqn", F.lit(".")), F.regexp_replace("fqn", r"\.[^.]*$", ""))
    sub = nodes.where("kind = 'PACKAGE'").select("application_id", above.alias("owner_fqn"), "id")
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("application_id", F.col("package").alias("owner_fqn"), "id")
    owners = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("application_id", F.col("fqn").alias("owner_fqn"), F.col("id").alias("owner_id"))
    members = nodes.where(F.col("kind").isin("METHOD", "FIELD", "TEST", "JOB", "ENDPOINT")).select("application_id", F.regexp_replace(T.base_fqn(F.col("fqn")), r"\.[^.]*$", "").alias("owner_fqn"), "id")
    keys = ["application_id", "owner_fqn"]
    found = [_edges(rows.join(owner, keys), "owner_id", "id", "CONTAINS") for rows, owner in ((sub, packages), (types, packages), (members, owners))]
    return found[0].union(found[1]).union(found[2]).distinct()


def resolve_types(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wanted`` (application_id, src_id, package, imports, type) with ``dst_id``, the type it names.

    Preference: the exact qualified name, an import that ends with the name, the own package, the first of that simple name.
    """
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("application_id", F.col("fqn").alias("t_fqn"), T.simple_name(F.col("fqn")).alias("simple"), F.col("package").alias("t_package"), F.col("id").alias("dst_id"))
    rows = wanted.withColumn("simple", T.simple_name(F.col("type"))).withColumn("bare", F.regexp_replace(F.substring_index("type", "<", 1), r"\?$", "")).join(types, ["application_id", "simple"])
    way = (
        F.when(F.col("t_fqn") == F.col("bare"), 1)
        .when(F.coalesce(F.array_contains("imports", F.col("t_fqn")), F.lit(False)), 2)
        .when(F.col("t_package") == F.col("package"), 3)
        .otherwise(F.when(F.contains("bare", F.lit(".")), F.lit(None)).otherwise(4))
    )
    ranked = rows.withColumn("way", way).where("way is not null")
    return first_rows(ranked, ["src_id", "type"], ["way", "t_fqn", "dst_id"]).select("src_id", "type", "way", "dst_id")


def _named(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.select("application_id", F.col("id").alias("src_id"), "package", "imports", F.explode(column).alias("type")).distinct()


def inheritance(nodes: DataFrame) -> DataFrame:
    """IMPLEMENTS for interfaces and INHERITS for other supertypes, each with a DEPENDS_ON."""
    both = nodes.withColumn("supers", F.array_distinct(F.concat(F.coalesce("supertypes_resolved", F.array().cast("array<string>")), F.coalesce("supertypes", F.array().cast("array<string>")))))
    found = resolve_types(_named(both, "supers"), nodes).join(nodes.select(F.col("id").alias("dst_id"), F.col("kind").alias("dst_kind")), "dst_id")
    kinds = F.explode(F.array(F.when(F.col("dst_kind") == "INTERFACE", "IMPLEMENTS").otherwise("INHERITS"), F.lit("DEPENDS_ON")))
    return _edges(found.select("src_id", "dst_id", kinds.alias("k")), "src_id", "dst_id", F.col("k"))


def annotations(nodes: DataFrame) -> DataFrame:
    """ANNOTATED_WITH and DEPENDS_ON to the types of annotations."""
    bare = nodes.withColumn("names", F.transform(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: F.regexp_replace(a, r"^@|\(.*$", "")))
    found = resolve_types(_named(bare, "names"), nodes).select("src_id", "dst_id", F.explode(F.array(F.lit("ANNOTATED_WITH"), F.lit("DEPENDS_ON"))).alias("k"))
    return _edges(found, "src_id", "dst_id", F.col("k"))


def signatures(nodes: DataFrame) -> DataFrame:
    """DEPENDS_ON from a member's owner, else from itself, to the types it names.

    Parsed parameter and return types (``param_types``, ``return_type``) count where there are any, else the signature.
    """
    owner = F.coalesce("owner_id", "id")
    named = T.type_tokens(F.col("signature"))
    if {"param_types", "return_type"} <= set(nodes.columns):
        parsed = F.concat(F.coalesce("param_types", F.array().cast("array<string>")), F.when(F.trim("return_type") != "", F.array("return_type")).otherwise(F.array().cast("array<string>")))
        named = F.when(F.size(parsed) > 0, T.types_in(F.array_join(parsed, ","))).otherwise(named)
    rows = nodes.select("application_id", owner.alias("src_id"), "package", "imports", F.explode(named).alias("type")).distinct()
    return _edges(resolve_types(rows, nodes), "src_id", "dst_id", "DEPENDS_ON")


def throws(nodes: DataFrame) -> DataFrame:
    return _edges(resolve_types(_named(nodes, "throws_types"), nodes), "src_id", "dst_id", "THROWS")


def calls(nodes: DataFrame) -> DataFrame:
    """CALLS_CODE from usages (array of type, receiver, member, name, isCall); all overloads of a name are kept.

    A simple name is looked for in the owner, exactly and then as overloads, and if it is a call also as a type.  A dotted
    one is looked for in the type that a capitalised receiver names, else in the owner, and nowhere else.
    """
    use = nodes.where("usages is not null").select("application_id", F.col("id").alias("src_id"), "package", "imports", "owner_fqn", F.posexplode("usages").alias("at", "u"))
    use = use.select("*", F.coalesce("u.member", "u.name").alias("called"), (F.lower("u.type") == "dot").alias("dotted"), F.col("u.receiver").alias("receiver"), F.coalesce("u.isCall", F.lit(True)).alias("is_call"))
    typed = use.where("dotted").where(F.col("receiver").rlike(r"^\p{Lu}"))
    resolved = resolve_types(typed.select("application_id", "src_id", "package", "imports", F.col("receiver").alias("type")).distinct(), nodes).join(nodes.select(F.col("id").alias("dst_id"), F.col("fqn").alias("r_fqn")), "dst_id")
    by_type = typed.join(resolved.select("src_id", F.col("type").alias("receiver"), "r_fqn"), ["src_id", "receiver"]).withColumn("scope", F.col("r_fqn"))
    by_owner = use.where(~F.col("dotted") | ~F.coalesce(F.col("receiver").rlike(r"^\p{Lu}"), F.lit(False))).withColumn("scope", F.col("owner_fqn"))
    keep = ["application_id", "src_id", "package", "imports", "at", "called", "dotted", "is_call", "scope"]
    scoped = by_type.select(*keep).unionByName(by_owner.select(*keep))
    targets = nodes.select("application_id", F.col("fqn").alias("t_fqn"), T.base_fqn(F.col("fqn")).alias("base"), F.col("id").alias("dst_id"))
    hits = scoped.where("scope is not null").withColumn("base", F.concat_ws(".", "scope", "called")).join(targets, ["application_id", "base"]).withColumn("way", F.when(F.col("t_fqn") == F.col("base"), 1).otherwise(2))
    best = hits.groupBy("src_id", "at").agg(F.min("way").alias("best"))
    members = hits.join(best, ["src_id", "at"]).where("way = best")
    rest = scoped.where("not dotted and is_call").join(best.select("src_id", "at"), ["src_id", "at"], "left_anti")
    types = resolve_types(rest.select("application_id", "src_id", "package", "imports", F.col("called").alias("type")).distinct(), nodes)
    rows = members.select("src_id", "dst_id").union(types.select("src_id", "dst_id"))
    # a call of itself is an edge too
    return rows.select("src_id", "dst_id", F.lit("CALLS_CODE").alias("kind")).distinct()


def integration_points(methods: DataFrame) -> DataFrame:
    """(method_id, type, target, verb, operation) from integration analyses: addresses by verbs (none gives one null), topics, Camel addresses."""
    http = methods.select("method_id", F.lit("HTTP").alias("type"), F.explode("analysis.urls").alias("target"), F.col("analysis.httpMethods").alias("verbs"))
    http = http.select("method_id", "type", "target", F.explode_outer("verbs").alias("verb"), F.lit(None).cast("string").alias("operation"))
    kafka = methods.select("method_id", F.lit("KAFKA").alias("type"), F.explode(F.array_distinct("analysis.kafkaTopics")).alias("target"), F.col("analysis.kafkaCalls").alias("c"))
    kafka = kafka.select("method_id", "type", "target", F.lit(None).cast("string").alias("verb"), F.get(F.filter("c", lambda x: x["topic"] == F.col("target")), F.lit(0))["operation"].alias("operation"))
    camel = methods.select("method_id", F.lit("CAMEL").alias("type"), F.explode(F.array_distinct("analysis.camelUris")).alias("target"), F.col("analysis.camelCalls").alias("c"))
    camel = camel.select("method_id", "type", "target", F.lit(None).cast("string").alias("verb"), F.get(F.filter("c", lambda x: x["uri"] == F.col("target")), F.lit(0))["direction"].alias("operation"))
    return http.unionByName(kafka).unionByName(camel)


# fixed values: the fields of an analysis that hold the targets of each type
TARGET_FIELDS = {"HTTP": "urls", "KAFKA": "kafkaTopics", "CAMEL": "camelUris"}


def methods_by_target(methods: DataFrame, type_: str, target: str, library: int | None = None) -> DataFrame:
    """Methods whose analysis names exactly this address, topic or Camel address, in one library or in all."""
    rows = methods if library is None else methods.where(F.col("library_id") == library)
    return rows.where(F.coalesce(F.array_contains(F.col(f"analysis.{TARGET_FIELDS[type_]}"), target), F.lit(False)))


def parent_clients(methods: DataFrame, library: int) -> DataFrame:
    """Methods of a library that its analysis marks as the outermost clients."""
    return methods.where((F.col("library_id") == library) & F.coalesce("analysis.isParentClient", F.lit(False)))


def method_summaries(methods: DataFrame) -> DataFrame:
    """(method_id, library_id, http, kafka, camel, is_parent_client, has_retry, has_timeout, has_circuit_breaker) of every method.

    ``http`` counts addresses times verbs (no verb counts as one); a method without an analysis has none and no flags.
    """
    n = lambda f: F.coalesce(F.nullif(F.size(f"analysis.{f}"), F.lit(-1)), F.lit(0))
    flag = lambda f: F.coalesce(f"analysis.{f}", F.lit(False))
    return methods.select(
        "method_id", "library_id", (n("urls") * F.greatest(n("httpMethods"), F.lit(1))).alias("http"), n("kafkaTopics").alias("kafka"), n("camelUris").alias("camel"),
        flag("isParentClient").alias("is_parent_client"), flag("hasRetry").alias("has_retry"), flag("hasTimeout").alias("has_timeout"), flag("hasCircuitBreaker").alias("has_circuit_breaker"),
    )


def integration_edges(callers: DataFrame, points: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(src_id, target_fqn, kind) of callers (src_id, method_id) and the points of what they call.

    Addresses are known by verb and normalised path, topics and Camel addresses by name; retries, timeouts and circuit
    breakers of ``flags`` (method_id, hasRetry, hasTimeout, hasCircuitBreaker) give edges of their own.
    """
    rows = callers.join(points, "method_id")
    fqn = (
        F.when(F.col("type") == "HTTP", F.concat(F.lit("infra:http:"), F.coalesce("verb", F.lit("ANY")), F.lit(":"), F.coalesce(T.normalize_path(F.col("target")), "target")))
        .when(F.col("type") == "KAFKA", F.concat(F.lit("infra:kafka:topic:"), "target"))
        .otherwise(F.concat(F.lit("infra:camel:uri:"), "target"))
    )
    kind = F.when(F.col("type") == "HTTP", "CALLS_HTTP").when(F.col("type") == "KAFKA", F.when(F.col("operation") == "PRODUCE", "PRODUCES").otherwise("CONSUMES")).otherwise("CALLS_CAMEL")
    edges = rows.select("src_id", fqn.alias("target_fqn"), kind.alias("kind"))
    if flags is not None:
        http = rows.where("type = 'HTTP'").join(flags, "method_id").select("src_id", fqn.alias("target_fqn"), F.explode(F.array_compact(F.array(F.when(F.col("hasRetry"), "RETRIES_TO"), F.when(F.col("hasTimeout"), "TIMEOUTS_TO"), F.when(F.col("hasCircuitBreaker"), "CIRCUIT_BREAKER_TO")))).alias("kind"))
        edges = edges.union(http)
    return edges.distinct()


def virtual_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fqn, kind, name) of targets that are no nodes yet."""
    kind = F.when(F.col("fqn").startswith("infra:kafka:"), "TOPIC").otherwise("ENDPOINT")
    new = edges.select(F.col("target_fqn").alias("fqn")).distinct().join(nodes.select("fqn").distinct(), "fqn", "left_anti")
    return new.select("fqn", kind.alias("kind"), T.integration_label(F.col("fqn"), F.lit(None).cast("string")).alias("name"))


def longest_prefix(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, grp): for every dotted key the longest group that equals it or is a prefix of it at a dot."""
    parts = F.size(F.split("key", r"\."))
    each = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), parts), lambda n: F.call_function("substring_index", F.col("key"), F.lit("."), n))).alias("grp")).distinct()
    return each.join(groups.select("grp").distinct(), "grp").groupBy("key").agg(F.max_by("grp", F.length("grp")).alias("grp"))


def config_edges(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(src_id, grp, kind): DEPENDS_ON for injected values in members, CONFIGURES for property classes."""
    value = nodes.where(F.col("kind").isin("FIELD", "METHOD")).select("id", F.explode(F.regexp_extract_all("source_code", F.lit(r'@Value\("\$\{([^}:"]+)'), 1)).alias("key"), F.lit("DEPENDS_ON").alias("kind"))
    prefix = nodes.where("kind = 'CONFIG'").select("id", F.explode(F.regexp_extract_all("source_code", F.lit(r'@ConfigurationProperties\((?:prefix\s*=\s*)?"([^"]+)"'), 1)).alias("key"), F.lit("CONFIGURES").alias("kind"))
    wanted = value.union(prefix)
    return wanted.join(longest_prefix(wanted.select("key").distinct(), groups), "key").select(F.col("id").alias("src_id"), "grp", "kind").distinct()


def link_all(nodes: DataFrame) -> DataFrame:
    """Union of the structural and semantic linkers, each edge once."""
    out = structural(nodes)
    for part in (inheritance(nodes), annotations(nodes), signatures(nodes), calls(nodes), throws(nodes)):
        out = out.union(part)
    return out.distinct()
