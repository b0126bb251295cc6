"""Queries of linking, the graph between applications and stateful operators, with their SQL."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph import adapters as A
from loomgraph.operators import classify as C
from loomgraph.operators import crossapp as X
from loomgraph.operators import library as B
from loomgraph.operators import linking as L
from loomgraph.runtime import table
from loomgraph.schema import TYPE_KINDS
from loomgraph.streaming import limits as S


def _nodes(spark, d):
    return A.nodes(spark, d)


def contains_edges(spark, d):
    return L.structural(_nodes(spark, d))


def prefix_chain(spark, d):
    return L.package_chain(_nodes(spark, d))


def type_resolution(spark, d):
    """Every type names the next type of its application: by its full name, by an import, or by its simple name alone."""
    types = _nodes(spark, d).where(F.col("kind").isin(*TYPE_KINDS))
    after = F.lead("fqn").over(Window.partitionBy("application_id").orderBy("id"))
    rows = types.select("application_id", F.col("id").alias("src_id"), "package", after.alias("next")).where("next is not null")
    simple, way = F.substring_index("next", ".", -1), F.col("src_id") % 3
    wanted = rows.select("application_id", "src_id", "package", F.when(way == 1, F.array("next")).otherwise(F.array().cast("array<string>")).alias("imports"), F.when(way == 0, F.col("next")).otherwise(simple).alias("type"))
    return L.resolve_types(wanted, _nodes(spark, d))


def _methods(spark, d):
    """Functions with what an analysis of their sources would say: addresses, verbs by number, topics and flags."""
    rows = _nodes(spark, d).where("kind in ('METHOD', 'ENDPOINT', 'CLIENT') and source_code is not null")
    said = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("source_code", F.lit(p), 1)))
    none, odd = F.array().cast("array<string>"), F.col("id") % 2 == 1
    analysis = F.struct(
        said(r"(/api/v[0-9]+/[a-z]+)").alias("urls"), F.when(odd, F.array(F.lit("GET"), F.lit("POST"))).otherwise(none).alias("httpMethods"), said(r'topic = "([a-z0-9.]+)"').alias("kafkaTopics"), said(r'"([a-z]+/[a-z]+)"').alias("camelUris"),
        F.transform(said(r'topic = "([a-z0-9.]+)"'), lambda t: F.struct(t.alias("topic"), F.when(odd, "PRODUCE").otherwise("CONSUME").alias("operation"), F.lit("x").alias("clientType"))).alias("kafkaCalls"),
        F.transform(said(r'"([a-z]+/[a-z]+)"'), lambda t: F.struct(t.alias("uri"), F.lit("TO").alias("direction"))).alias("camelCalls"),
        (F.col("kind") == "CLIENT").alias("isParentClient"), F.contains("source_code", F.lit("retry")).alias("hasRetry"), F.contains("source_code", F.lit("timeout")).alias("hasTimeout"), F.lit(False).alias("hasCircuitBreaker"),
    )
    return rows.select(F.col("id").alias("method_id"), F.col("application_id").alias("library_id"), F.when(F.col("id") % 7 != 0, analysis).alias("analysis"))


def integration_by_target(spark, d):
    """The most named topic and address, and the methods that name them, in all libraries and in the first."""
    m = _methods(spark, d)
    out = None
    for type_, field in (("HTTP", "urls"), ("KAFKA", "kafkaTopics")):
        each = m.select(F.explode(f"analysis.{field}").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        top = each.agg(F.min_by("t", F.struct(-F.col("n"), "t"))).first()[0] or ""
        for library in (None, 1):
            part = L.methods_by_target(m, type_, top, library).select(F.lit(type_).alias("type"), F.lit(top).alias("target"), F.lit(library or 0).alias("library"), "method_id")
            out = part if out is None else out.unionByName(part)
    return out


def integration_summaries(spark, d):
    return L.method_summaries(_methods(spark, d))


def integration_parents(spark, d):
    return L.parent_clients(_methods(spark, d), 1).select("method_id")


def integration_points(spark, d):
    return L.integration_points(_methods(spark, d))


def integration_edges(spark, d):
    """Each function calls the next one of its parent; what that one reaches becomes the caller's edges."""
    m = _methods(spark, d)
    callers = A.siblings(spark, d).select("src_id", F.col("dst_id").alias("method_id"))
    flags = m.select("method_id", *[F.col(f"analysis.{f}").alias(f) for f in ("hasRetry", "hasTimeout", "hasCircuitBreaker")])
    return L.integration_edges(callers, L.integration_points(m), flags)


def _next_types(spark, d):
    """Types with the simple name of the next type of their application, where a linker looks for names."""
    nodes = _nodes(spark, d).where(F.col("kind").isin(*TYPE_KINDS))
    after = F.substring_index(F.lead("fqn").over(Window.partitionBy("application_id").orderBy("id")), ".", -1)
    return nodes.withColumn("next", after).withColumn("imports", F.array().cast("array<string>"))


def _some(column):
    return F.when(F.col("next").isNotNull(), F.array(column))


def _members(spark, d):
    """Nodes as members of libraries; every fifth fqn names a client."""
    nodes = _nodes(spark, d)
    words = lambda k: F.from_json(F.get_json_object("meta", f"$.{k}"), "array<string>")
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("fqn").alias("parent_fqn"))
    return nodes.join(parents, "parent_id", "left").select("id", "fqn", "kind", "parent_fqn", words("modifiers").alias("modifiers"), words("annotations").alias("annotations"))


def relevant_library_nodes(spark, d):
    """Classes and members that matter between applications; methods whose source names a topic count as integrating."""
    members = _members(spark, d)
    classes = B.relevant_classes(members, TYPE_KINDS)
    calls = _nodes(spark, d).where("kind = 'METHOD' and source_code like '%topic = %'").select("fqn")
    found = B.relevant_members(members, classes, calls).select("id", F.lit("member").alias("sort"))
    return classes.select("id", F.lit("class").alias("sort")).unionByName(found)


def library_kinds(spark, d):
    """Packages as groups of libraries, two of them given as the company's."""
    groups = _nodes(spark, d).where("package is not null").select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("org.springframework."), "package")).otherwise(F.col("package")).alias("grp")).distinct()
    return groups.select("grp", B.library_kind(F.col("grp"), ["ORG.norvik.r", "org.norvik.s"]).alias("kind"))


def inheritance_edges(spark, d):
    rows = _next_types(spark, d)
    return L.inheritance(rows.withColumn("supertypes", _some(F.col("next"))).withColumn("supertypes_resolved", F.lit(None).cast("array<string>")))


def annotation_edges(spark, d):
    rows = _next_types(spark, d)
    return L.annotations(rows.withColumn("annotations", _some(F.concat(F.lit("@"), "next", F.lit('("x")')))))


def signature_edges(spark, d):
    """Every other type has parsed parameter types, the others a signature only."""
    rows, odd = _next_types(spark, d), F.col("id") % 2 == 1
    rows = rows.withColumn("param_types", F.when(odd, _some(F.concat("next", F.lit("<Long?>"))))).withColumn("return_type", F.lit(None).cast("string")).withColumn("owner_id", F.lit(None).cast("long"))
    return L.signatures(rows.withColumn("signature", F.when(~odd, F.concat(F.lit("override fun Wrong(x: "), "next", F.lit("): where")))))


def throws_edges(spark, d):
    return L.throws(_next_types(spark, d).withColumn("throws_types", _some(F.col("next"))))


def config_edges(spark, d):
    """Members read a value below their package, property classes take it as their prefix; groups are the packages with a configuration."""
    nodes = _nodes(spark, d)
    value = F.when(F.col("kind") == "CONFIG", F.concat(F.lit('@ConfigurationProperties(prefix = "'), "package", F.lit('")'))).otherwise(F.concat(F.lit('@Value("${'), "package", F.lit('.limit:5}")')))
    return L.config_edges(nodes.withColumn("source_code", value), nodes.where("kind = 'CONFIG' and package is not null and id % 2 = 0").select(F.col("package").alias("grp")))


def frame_nodes(spark, d):
    """A frame for every method, mapped back to its node."""
    nodes = _nodes(spark, d)
    base = F.substring_index("fqn", "(", 1)
    found = nodes.where("kind = 'METHOD'").select(F.col("id").alias("trace_id"), F.lit(0).alias("at"), F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit("$Inner")).alias("owner"), F.substring_index(base, ".", -1).alias("method"))
    return C.frame_nodes(found, nodes, "trace_id")


def audit_capture(spark, d):
    """Events as requests of an API."""
    verb = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "click", "HEAD").otherwise("POST")
    events = table(spark, d, "events").select("event_id", verb.alias("http_method"), F.when(F.col("user_id") % 3 == 0, "/health").otherwise(F.concat(F.lit("/api/"), "event_type")).alias("resource"))
    return S.audit_capture(events)


def call_edges(spark, d):
    """Calls inside a type: every called name is looked for in the owner, with its overloads."""
    nodes = _nodes(spark, d)
    owners = nodes.select(F.col("id").alias("parent_id"), F.col("fqn").alias("owner_fqn"))
    called = F.array_distinct(F.regexp_extract_all("source_code", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1))
    usages = F.transform(called, lambda n: F.struct(F.lit("simple").alias("type"), F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("member"), n.alias("name"), F.lit(True).alias("isCall")))
    fns = nodes.join(owners, "parent_id", "left").withColumn("usages", F.when(F.col("kind").isin("METHOD", "ENDPOINT", "JOB", "TEST"), usages)).withColumn("imports", F.array().cast("array<string>"))
    return L.calls(fns)


def prefix_join(spark, d):
    """Every package against the packages that hold a configuration: the longest one above it."""
    nodes = _nodes(spark, d)
    return L.longest_prefix(nodes.where("package is not null").select(F.col("package").alias("key")).distinct(), nodes.where("kind = 'CONFIG' and package is not null").select(F.col("package").alias("grp")))


def crossapp_integrations(spark, d):
    """Parents of topics and infrastructure as integrations of their applications."""
    nodes = _nodes(spark, d)
    old = F.when(F.col("kind") == "TOPIC", F.concat(F.lit("topic://"), "name")).otherwise(F.col("fqn"))
    rows = nodes.select("id", "application_id", old.alias("fqn"), "name", F.lit(False).alias("synthetic"))
    return X.integrations(rows, A.contains(spark, d))


def url_endpoint_match(spark, d):
    """Mapped endpoints against paths that functions of other applications name."""
    nodes = _nodes(spark, d).where("source_code is not null")
    mapped = nodes.where("kind = 'ENDPOINT'").select("application_id", F.explode(F.regexp_extract_all("source_code", F.lit(r'@GetMapping\("([^"]*)"'), 1)).alias("path"))
    servers = mapped.select("application_id", F.lit("GET").alias("verb"), F.lit("").alias("base_path"), F.regexp_replace("path", "^/api/v[0-9]+", "").alias("path"))
    named = nodes.where("kind = 'METHOD'").select("application_id", F.explode(F.regexp_extract_all("source_code", F.lit(r'path = f?["\'](/api/[^"\']*)'), 1)).alias("url"))
    clients = named.select("application_id", F.lit("GET").alias("verb"), F.regexp_replace("url", "^/api/v[0-9]+", "").alias("url"))
    return X.endpoint_matches(servers, clients)


def crossapp_edges(spark, d):
    """All strategies as one graph; every node names the next one of its application as its supertype."""
    nodes = _nodes(spark, d)
    after = F.lead("name").over(Window.partitionBy("application_id").orderBy("id"))
    types = nodes.select("id", "application_id", F.col("name").alias("fqn"), "kind", F.when(after.isNotNull(), F.array(after)).alias("supertypes"))
    return X.graph(X.contracts(types, nodes.select("parent_id", "kind")), crossapp_integrations(spark, d), url_endpoint_match(spark, d))


def rate_fixed_window(spark, d):
    rows = S.rate_limited(table(spark, d, "events"), "user_id", 3, 3600.0, "fixed")
    return rows.groupBy("user_id").agg(F.count(F.when(F.col("admitted"), 1)).alias("admitted"), F.count(F.when(~F.col("admitted"), 1)).alias("rejected"))


def rate_sliding_log(spark, d):
    rows = S.rate_limited(table(spark, d, "events"), "user_id", 3, 3600.0, "sliding")
    return rows.groupBy("user_id").agg(F.count(F.when(F.col("admitted"), 1)).alias("admitted"), F.count(F.when(~F.col("admitted"), 1)).alias("rejected"))


def run_state_fold(spark, d):
    """Users' events as runs: an error fails its step, a purchase completes it, other events leave it running or pending."""
    events = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "click", "RUNNING").otherwise("PENDING")
    return S.run_states(events.select(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("step"), status.alias("status"), "ts"))


def claim_postprocess(spark, d):
    chunks = table(spark, d, "chunk").dropDuplicates(["id"])
    return S.claim_batch(chunks, "content_hash is null or token_count is null or embedding is null", ["created_at", "id"], 50).select("id")


def events_after(spark, d):
    return S.events_after(table(spark, d, "events"), 500).select("event_id", "user_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (contains_edges, prefix_chain, type_resolution, integration_by_target, integration_summaries, integration_parents, integration_points, integration_edges, relevant_library_nodes, library_kinds, inheritance_edges, annotation_edges, signature_edges, throws_edges, config_edges, frame_nodes, audit_capture, call_edges, prefix_join, crossapp_integrations, url_endpoint_match, crossapp_edges, rate_fixed_window, rate_sliding_log, run_state_fold, claim_postprocess, events_after)
}

_N = f"WITH RECURSIVE {A.NODE_SQL}"
_TYPES = "('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'SERVICE', 'MAPPER', 'EXCEPTION', 'CLIENT', 'CONFIG', 'ENDPOINT')"
_UP = "CASE WHEN contains({0}, '.') THEN regexp_replace({0}, '\\.[^.]*$', '') END"
_M = f"""{_N}, z AS (SELECT id, application_id, kind, source_code, list_distinct(regexp_extract_all(source_code, '/api/v[0-9]+/[a-z]+')) AS urls, list_distinct(regexp_extract_all(source_code, 'topic = "([a-z0-9.]+)"', 1)) AS topics, list_distinct(regexp_extract_all(source_code, '"([a-z]+/[a-z]+)"', 1)) AS camel FROM n WHERE kind IN ('METHOD', 'ENDPOINT', 'CLIENT') AND source_code IS NOT NULL), m AS (SELECT * FROM z WHERE id % 7 <> 0)"""
_PTS = f"""{_M}, {A.SIBLINGS_SQL}, pts AS (SELECT id AS method_id, 'HTTP' AS type, target, CASE WHEN id % 2 = 1 THEN unnest(['GET', 'POST']) END AS verb, CAST(NULL AS VARCHAR) AS operation FROM (SELECT id, unnest(urls) AS target FROM m) WHERE id % 2 = 1 UNION ALL SELECT id, 'HTTP', unnest(urls), NULL, NULL FROM m WHERE id % 2 = 0
    UNION ALL SELECT id, 'KAFKA', unnest(topics), NULL, CASE WHEN id % 2 = 1 THEN 'PRODUCE' ELSE 'CONSUME' END FROM m UNION ALL SELECT id, 'CAMEL', unnest(camel), NULL, 'TO' FROM m)"""
_RS = f"""{_N}, t AS (SELECT application_id, id, fqn, package, regexp_extract(fqn, '[^.]*$') AS simple FROM n WHERE kind IN {_TYPES}), z AS (SELECT application_id, id AS src_id, package, regexp_extract(lead(fqn) OVER (PARTITION BY application_id ORDER BY id), '[^.]*$') AS s FROM t),
    rs AS (SELECT src_id, dst_id, s FROM (SELECT z.src_id, z.s, t.id AS dst_id, row_number() OVER (PARTITION BY z.src_id ORDER BY CASE WHEN t.fqn = z.s THEN 1 WHEN t.package = z.package THEN 3 ELSE 4 END, t.fqn, t.id) AS r FROM z JOIN t ON z.application_id = t.application_id AND z.s = t.simple) WHERE r = 1 AND src_id <> dst_id)"""
SQL = {
    "contains_edges": f"""{_N}, e AS (SELECT p.id AS src_id, c.id AS dst_id FROM n c JOIN n p ON c.kind = 'PACKAGE' AND p.kind = 'PACKAGE' AND c.application_id = p.application_id AND p.fqn = {_UP.format('c.fqn')}
        UNION SELECT p.id, c.id FROM n c JOIN n p ON c.kind IN {_TYPES} AND p.kind = 'PACKAGE' AND c.application_id = p.application_id AND p.fqn = c.package
        UNION SELECT p.id, c.id FROM n c JOIN n p ON c.kind IN ('METHOD', 'FIELD', 'TEST', 'JOB', 'ENDPOINT') AND p.kind IN {_TYPES} AND c.application_id = p.application_id AND p.fqn = regexp_replace(split_part(c.fqn, '(', 1), '\\.[^.]*$', ''))
        SELECT DISTINCT src_id, dst_id, 'CONTAINS' AS kind FROM e WHERE src_id <> dst_id""",
    "prefix_chain": f"{_N}, p AS (SELECT DISTINCT application_id, string_split(package, '.') AS s FROM n WHERE trim(package) <> ''), e AS (SELECT DISTINCT application_id, array_to_string(s[1:k], '.') AS fqn FROM (SELECT application_id, s, unnest(range(1, len(s) + 1)) AS k FROM p)) SELECT application_id, fqn, regexp_extract(fqn, '[^.]*$') AS name, {_UP.format('fqn')} AS parent_fqn FROM e",
    "type_resolution": f"""{_N}, t AS (SELECT application_id, id, fqn, package, regexp_extract(fqn, '[^.]*$') AS simple FROM n WHERE kind IN {_TYPES}), z AS (SELECT application_id, id AS src_id, package, lead(fqn) OVER (PARTITION BY application_id ORDER BY id) AS nx FROM t),
        w AS (SELECT *, regexp_extract(nx, '[^.]*$') AS s, CASE WHEN src_id % 3 = 0 THEN nx ELSE regexp_extract(nx, '[^.]*$') END AS type FROM z WHERE nx IS NOT NULL),
        h AS (SELECT w.src_id, w.type, t.id AS dst_id, t.fqn, CASE WHEN t.fqn = w.type THEN 1 WHEN w.src_id % 3 = 1 AND t.fqn = w.nx THEN 2 WHEN t.package = w.package THEN 3 WHEN contains(w.type, '.') THEN NULL ELSE 4 END AS way FROM w JOIN t ON w.application_id = t.application_id AND w.s = t.simple)
        SELECT src_id, type, CAST(way AS INTEGER) AS way, dst_id FROM (SELECT *, row_number() OVER (PARTITION BY src_id, type ORDER BY way, fqn, dst_id) AS r FROM h WHERE way IS NOT NULL) WHERE r = 1""",
    "integration_by_target": f"""{_M}, e AS (SELECT 'HTTP' AS type, id, application_id, unnest(urls) AS t FROM m UNION ALL SELECT 'KAFKA', id, application_id, unnest(topics) FROM m), c AS (SELECT type, t, count(*) AS c FROM e GROUP BY ALL), top AS (SELECT type, arg_min(t, (-c, t)) AS t FROM c GROUP BY type)
        SELECT e.type, e.t AS target, CAST(l.l AS INTEGER) AS library, e.id AS method_id FROM e JOIN top USING (type, t), (VALUES (0), (1)) l(l) WHERE l.l = 0 OR e.application_id = 1""",
    "integration_summaries": f"""{_M} SELECT id AS method_id, application_id AS library_id, CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE len(urls) * CASE WHEN id % 2 = 1 THEN 2 ELSE 1 END END AS INTEGER) AS http, CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE len(topics) END AS INTEGER) AS kafka, CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE len(camel) END AS INTEGER) AS camel,
        id % 7 <> 0 AND kind = 'CLIENT' AS is_parent_client, id % 7 <> 0 AND contains(source_code, 'retry') AS has_retry, id % 7 <> 0 AND contains(source_code, 'timeout') AS has_timeout, false AS has_circuit_breaker FROM z""",
    "integration_parents": f"{_M} SELECT id AS method_id FROM m WHERE kind = 'CLIENT' AND application_id = 1",
    "relevant_library_nodes": f"""{_N}, w AS (SELECT n.id, n.fqn, n.kind, p.fqn AS pf, coalesce(CAST(json_extract(n.meta, '$.modifiers') AS VARCHAR[]), []) AS m, lower(array_to_string(coalesce(CAST(json_extract(n.meta, '$.annotations') AS VARCHAR[]), []), ' ')) AS a FROM n LEFT JOIN n p ON n.parent_id = p.id),
        c AS (SELECT * FROM w WHERE kind IN {_TYPES} AND list_contains(m, 'public') AND (regexp_matches(a, 'controller|feignclient|kafkalistener|rabbitlistener|service|component|webclient') OR regexp_matches(lower(fqn), 'webclient|resttemplate|okhttp|httpclient|feign|restclient|kafka|routebuilder|camel') OR kind = 'INTERFACE')), t AS (SELECT fqn FROM n WHERE kind = 'METHOD' AND contains(source_code, 'topic = '))
        SELECT id, 'class' AS sort FROM c UNION ALL SELECT id, 'member' FROM w WHERE (kind = 'METHOD' AND list_contains(m, 'public') AND (regexp_matches(a, '(get|post|put|delete|patch|request)mapping|kafkalistener|rabbitlistener|scheduled|eventlistener') OR fqn IN (SELECT fqn FROM t) OR pf IN (SELECT fqn FROM c)))
        OR (kind = 'FIELD' AND pf IN (SELECT fqn FROM c) AND (list_contains(m, 'public') OR (list_contains(m, 'static') AND list_contains(m, 'final'))))""",
    "library_kinds": f"{_N} SELECT DISTINCT grp, CASE WHEN starts_with(grp, 'org.springframework') THEN 'framework' WHEN starts_with(lower(grp), 'org.norvik.r') OR starts_with(lower(grp), 'org.norvik.s') THEN 'company' ELSE 'external' END AS kind FROM (SELECT CASE WHEN id % 5 = 0 THEN 'org.springframework.' || package ELSE package END AS grp FROM n WHERE package IS NOT NULL)",
    "integration_points": f"""{_PTS} SELECT * FROM pts""",
    "integration_edges": f"""{_PTS}, c AS (SELECT s.src_id, p.* FROM siblings s JOIN pts p ON s.dst_id = p.method_id), t AS (SELECT *, CASE type WHEN 'HTTP' THEN 'infra:http:' || coalesce(verb, 'ANY') || ':' || target WHEN 'KAFKA' THEN 'infra:kafka:topic:' || target ELSE 'infra:camel:uri:' || target END AS target_fqn FROM c)
        SELECT src_id, target_fqn, CASE type WHEN 'HTTP' THEN 'CALLS_HTTP' WHEN 'KAFKA' THEN CASE WHEN operation = 'PRODUCE' THEN 'PRODUCES' ELSE 'CONSUMES' END ELSE 'CALLS_CAMEL' END AS kind FROM t
        UNION SELECT src_id, target_fqn, 'RETRIES_TO' FROM t JOIN m ON t.method_id = m.id WHERE type = 'HTTP' AND contains(source_code, 'retry') UNION SELECT src_id, target_fqn, 'TIMEOUTS_TO' FROM t JOIN m ON t.method_id = m.id WHERE type = 'HTTP' AND contains(source_code, 'timeout')""",
    "inheritance_edges": f"{_RS} SELECT DISTINCT src_id, dst_id, unnest([CASE WHEN n.kind = 'INTERFACE' THEN 'IMPLEMENTS' ELSE 'INHERITS' END, 'DEPENDS_ON']) AS kind FROM rs JOIN n ON dst_id = n.id",
    "annotation_edges": f"{_RS} SELECT DISTINCT src_id, dst_id, unnest(['ANNOTATED_WITH', 'DEPENDS_ON']) AS kind FROM rs",
    "signature_edges": f"{_RS} SELECT DISTINCT src_id, dst_id, 'DEPENDS_ON' AS kind FROM rs WHERE regexp_matches(s, '^[A-Z]')",
    "throws_edges": f"{_RS} SELECT DISTINCT src_id, dst_id, 'THROWS' AS kind FROM rs",
    "config_edges": f"""{_N}, g AS (SELECT DISTINCT package AS grp FROM n WHERE kind = 'CONFIG' AND package IS NOT NULL AND id % 2 = 0), w AS (SELECT id, package || CASE WHEN kind = 'CONFIG' THEN '' ELSE '.limit' END AS key, CASE WHEN kind = 'CONFIG' THEN 'CONFIGURES' ELSE 'DEPENDS_ON' END AS kind FROM n WHERE kind IN ('FIELD', 'METHOD', 'CONFIG') AND package <> '')
        SELECT id AS src_id, arg_max(grp, length(grp)) AS grp, kind FROM w JOIN g ON key = grp OR starts_with(key, grp || '.') GROUP BY id, kind""",
    "frame_nodes": f"{_N}, b AS (SELECT id, fqn, split_part(fqn, '(', 1) AS base FROM n WHERE kind = 'METHOD'), f AS (SELECT base, arg_min(id, (fqn, id)) AS id FROM b GROUP BY base) SELECT b.id AS trace_id, 0 AS \"at\", f.id FROM b JOIN f USING (base)",
    "audit_capture": "SELECT * FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'HEAD' ELSE 'POST' END AS http_method, CASE WHEN user_id % 3 = 0 THEN '/health' ELSE '/api/' || event_type END AS resource FROM events) WHERE http_method = 'POST' AND resource LIKE '/api%'",
    "rate_sliding_log": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), w(user_id, r, log, ok) AS (SELECT user_id, r, [t], true FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.r, CASE WHEN len(list_filter(w.log, lambda x: e.t - x <= 3600000000)) < 3 THEN list_append(list_filter(w.log, lambda x: e.t - x <= 3600000000), e.t) ELSE list_filter(w.log, lambda x: e.t - x <= 3600000000) END, len(list_filter(w.log, lambda x: e.t - x <= 3600000000)) < 3 FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
        SELECT user_id, count(*) FILTER (ok) AS admitted, count(*) FILTER (NOT ok) AS rejected FROM w GROUP BY user_id""",
    "prefix_join": f"{_N}, k AS (SELECT DISTINCT package AS key FROM n WHERE package IS NOT NULL), g AS (SELECT DISTINCT package AS grp FROM n WHERE kind = 'CONFIG' AND package IS NOT NULL) SELECT key, arg_max(grp, length(grp)) AS grp FROM k JOIN g ON key = grp OR starts_with(key, grp || '.') GROUP BY key",
    "crossapp_integrations": f"""{_N}, {A.CONTAINS_SQL}, s AS (SELECT id, application_id, 'infra:kafka:topic:' || name AS target, name AS label FROM n WHERE kind = 'TOPIC'), e AS (SELECT a.application_id, s.target, s.label, c.kind FROM contains c JOIN s ON c.dst_id = s.id JOIN n a ON c.src_id = a.id UNION ALL SELECT a.application_id, s.target, s.label, c.kind FROM contains c JOIN s ON c.src_id = s.id JOIN n a ON c.dst_id = a.id)
        SELECT application_id, target, label, 'KAFKA' AS type, kind, count(*) AS n FROM e GROUP BY ALL""",
    "url_endpoint_match": f"""{_N}, s AS (SELECT DISTINCT application_id AS server_app, 'GET ' || regexp_replace(lower(p), '^/api/v[0-9]+', '') AS label FROM (SELECT application_id, unnest(regexp_extract_all(source_code, '@GetMapping\\("([^"]*)"', 1)) AS p FROM n WHERE kind = 'ENDPOINT')),
        c AS (SELECT DISTINCT application_id AS client_app, 'GET ' || regexp_replace(lower(p), '^/api/v[0-9]+', '') AS label FROM (SELECT application_id, unnest(regexp_extract_all(source_code, 'path = f?["''](/api/[^"'']*)', 1)) AS p FROM n WHERE kind = 'METHOD'))
        SELECT c.label, server_app, client_app FROM c JOIN s ON c.label = s.label WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.label = c.label AND o.server_app = c.client_app)""",
    "run_state_fold": """WITH l AS (SELECT user_id AS run_id, dayofmonth(ts) AS step, arg_max(st, (ts, st)) AS status FROM (SELECT *, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END AS st FROM events) GROUP BY 1, 2),
        a AS (SELECT run_id, count(*) FILTER (status = 'SUCCESS') AS s, count(*) FILTER (status = 'FAILED') AS f, count(*) FILTER (status = 'PENDING') AS p, count(*) FILTER (status = 'RUNNING') AS r FROM l GROUP BY run_id)
        SELECT run_id, CASE WHEN f > 0 THEN 'FAILED' WHEN r + p > 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status, s AS steps_done, f AS steps_failed, CASE WHEN f > 0 THEN p ELSE 0 END AS steps_skipped FROM a""",
    "claim_postprocess": "SELECT id FROM (SELECT DISTINCT id, created_at, content_hash, token_count, embedding FROM chunk) WHERE content_hash IS NULL OR token_count IS NULL OR embedding IS NULL ORDER BY created_at NULLS FIRST, id LIMIT 50",
    "events_after": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500",
    "rate_fixed_window": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), w(user_id, r, start, used) AS (SELECT user_id, r, t, 1 FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.r, CASE WHEN e.t - w.start >= 3600000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start >= 3600000000 THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
        SELECT user_id, count(*) FILTER (used <= 3) AS admitted, count(*) FILTER (used > 3) AS rejected FROM w GROUP BY user_id""",
}
SQL["crossapp_edges"] = f"""{SQL['crossapp_integrations'].split('SELECT application_id, target')[0].rstrip()}, i AS (SELECT application_id, target, label, 'KAFKA' AS type, kind, count(*) AS n FROM e GROUP BY ALL), u AS ({SQL['url_endpoint_match']}),
    face AS (SELECT * FROM n WHERE kind = 'INTERFACE'), sh AS (SELECT name FROM face GROUP BY name HAVING count(DISTINCT application_id) >= 2), mc AS (SELECT parent_id, count(*) AS c FROM n WHERE kind = 'METHOD' GROUP BY parent_id),
    most AS (SELECT face.name, coalesce(max(c), 0) AS methods FROM face JOIN sh ON face.name = sh.name LEFT JOIN mc ON mc.parent_id = face.id GROUP BY face.name), nx AS (SELECT application_id, lead(name) OVER (PARTITION BY application_id ORDER BY id) AS super FROM n),
    g AS (SELECT 'app:' || f.application_id AS source, f.name AS target, CASE WHEN EXISTS (SELECT 1 FROM nx WHERE nx.application_id = f.application_id AND nx.super = f.name) THEN 'PROVIDES' ELSE 'CONSUMES' END AS kind, most.methods AS n FROM (SELECT DISTINCT name, application_id FROM face) f JOIN most ON f.name = most.name
    UNION ALL SELECT 'app:' || application_id, target, kind, n FROM i UNION ALL SELECT DISTINCT 'app:' || server_app, label, 'PROVIDES', 1 FROM u UNION ALL SELECT DISTINCT 'app:' || client_app, label, 'CALLS_HTTP', 1 FROM u)
    SELECT source, target, kind, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL"""
