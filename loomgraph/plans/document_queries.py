"""Queries of sources, chunk plans, contexts and reports, with their SQL."""

from pyspark.sql import functions as F

from loomgraph import adapters as A
from loomgraph.operators import chunking as K
from loomgraph.operators import reports as P
from loomgraph.runtime import table
from loomgraph.sources import readers as S


def _docs(spark, d):
    return table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"])


def chunk_plan(spark, d):
    return K.chunk_plan(A.nodes(spark, d)).withColumn("section", F.array_join("section", "/"))


def plan_relations(spark, d):
    return K.relation_hints(A.siblings(spark, d))


def _uses(spark, d):
    """Edges between siblings in both directions."""
    edges = A.siblings(spark, d)
    return edges.unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "kind"))


def doc_context(spark, d):
    return K.doc_context(A.nodes(spark, d), _docs(spark, d), _uses(spark, d), "en").withColumn("block", F.md5("block"))


def prompt_selection(spark, d):
    nodes = A.nodes(spark, d)
    context = K.doc_context(nodes, _docs(spark, d), _uses(spark, d), "en").withColumnRenamed("node_id", "id")
    code = F.coalesce(F.trim("source_code") != "", F.lit(False))
    return nodes.join(context, "id").select("id", K.prompt_name(F.col("kind"), F.col("n_deps"), F.col("n_children"), code).alias("prompt"))


def hash_backfill(spark, d):
    c = table(spark, d, "chunk").dropDuplicates(["id"]).select("id", "content", "content_hash", "token_count", "embedding")
    return K.post_process(c).select("id", "content_hash", "token_count")


_RULES = tuple(f"{name.lower()}Rule" for name in P.CROSS_CUTTING) + ("Other", "Plain")


def _profiled(spark, d):
    """Nodes and edges for the profile: queries stand for tables, exceptions for annotations."""
    kind = F.when(F.col("kind") == "DB_QUERY", "DB_TABLE").otherwise(F.col("kind"))
    name = F.when(F.col("kind") == "EXCEPTION", F.element_at(F.array(*map(F.lit, _RULES)), (F.col("id") % len(_RULES) + 1).cast("int"))).otherwise(F.col("name"))
    nodes = A.nodes(spark, d).select("id", "application_id", "fqn", "meta", kind.alias("kind"), name.alias("name"))
    marks = nodes.where("kind = 'EXCEPTION'").select(F.col("id").alias("dst_id"), F.lit("ANNOTATED_WITH").alias("mark"))
    edges = A.siblings(spark, d).join(marks, "dst_id", "left").select("src_id", "dst_id", F.coalesce("mark", "kind").alias("kind"))
    return nodes, edges


def profile_report(spark, d):
    return P.profile(*_profiled(spark, d))


def cross_cutting(spark, d):
    """Annotations of all applications, by usage."""
    return P.cross_cutting(P.annotation_uses(*_profiled(spark, d)))


def access_control(spark, d):
    """Profiled nodes, with types of integration by number."""
    nodes, edges = _profiled(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("OAuth2", "KAFKA", "SecurityGate"))), (F.col("id") % 3 + 1).cast("int"))
    meta = F.when(F.col("kind") == "INFRASTRUCTURE", F.concat(F.lit('{"integrationType": "'), kind, F.lit('"}'))).otherwise(F.col("meta"))
    return P.access_control(nodes.withColumn("meta", meta), edges)


def node_details(spark, d):
    return P.details(A.nodes(spark, d), A.contains(spark, d))


def relation_text(spark, d):
    return P.relation_text(A.contains(spark, d).unionByName(A.siblings(spark, d)), A.nodes(spark, d)).select("src_id", F.length("text").alias("chars"), F.md5("text").alias("hash"))


def error_surroundings(spark, d):
    """What surrounds every endpoint, taken as the place of an error."""
    nodes = A.nodes(spark, d)
    return P.error_surroundings(nodes.where("kind = 'ENDPOINT'").select(F.col("id").alias("root_id")), A.siblings(spark, d), nodes)


def repo_urls(spark, d):
    parts = S.repo_url(F.col("repo_url"))
    return table(spark, d, "application").where("repo_url is not null").select("id", parts["provider"].alias("provider"), parts["owner"].alias("owner"), parts["name"].alias("repo"))


def source_scan(spark, d):
    """Declarations in the sources of Kotlin and Java types and functions."""
    nodes = A.nodes(spark, d).where("source_code is not null and lang in ('kotlin', 'java')")
    files = nodes.select(F.concat(F.lit("n"), F.col("id"), F.when(F.col("lang") == "java", ".java").otherwise(".kt")).alias("path"), F.col("source_code").alias("text"))
    return S.scan_sources(files).where("decl_type <> 'file'").groupBy("language", "decl_type").agg(F.count(F.lit(1)).alias("n"))


def proto_scan(spark, d):
    nodes = A.nodes(spark, d).where("lang = 'proto' and source_code is not null")
    return S.scan_proto(nodes.select(F.concat(F.col("id"), F.lit(".proto")).alias("path"), F.col("source_code").alias("text")))


def yaml_scan(spark, d):
    nodes = A.nodes(spark, d).where("lang = 'yaml' and source_code is not null")
    return S.scan_yaml(nodes.select("application_id", F.concat(F.lit("application-"), F.col("id"), F.lit(".yml")).alias("path"), F.col("source_code").alias("text")))


QUERIES = {f.__name__: f for f in (chunk_plan, plan_relations, doc_context, prompt_selection, hash_backfill, profile_report, cross_cutting, access_control, node_details, relation_text, error_surroundings, repo_urls, source_scan, proto_scan, yaml_scan)}

_N = f"WITH {A.NODE_SQL}, {A.CONTAINS_SQL}, {A.SIBLINGS_SQL}"
_PRIO = "list_position(['CALLS_CODE', 'THROWS', 'READS', 'WRITES', 'QUERIES', 'CALLS_HTTP', 'CALLS_GRPC', 'PRODUCES', 'CONSUMES', 'CONFIGURES', 'CIRCUIT_BREAKER_TO', 'RETRIES_TO', 'TIMEOUTS_TO', 'DEPENDS_ON'], {0})"
_CONTEXT = f"""{_N}, g AS (SELECT node_id, max(doc_digest) AS digest FROM node_doc WHERE locale = 'en' GROUP BY node_id), e AS (SELECT * FROM siblings UNION ALL SELECT dst_id, src_id, kind FROM siblings),
    u AS (SELECT n.id AS owner, e.dst_id AS other, e.kind AS how, row_number() OVER (PARTITION BY n.id ORDER BY coalesce({_PRIO.format('e.kind')}, 99), e.dst_id, e.kind) AS r FROM e JOIN n ON n.id = e.src_id WHERE n.kind = 'METHOD'),
    k AS (SELECT p.id AS owner, c.id AS other, CAST(NULL AS VARCHAR) AS how, row_number() OVER (PARTITION BY p.id ORDER BY c.id) AS r FROM n c JOIN n p ON c.parent_id = p.id WHERE (p.kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') AND c.kind IN ('METHOD', 'FIELD')) OR p.kind IN ('PACKAGE', 'MODULE', 'REPO')),
    l AS (SELECT x.owner, x.r, x.how, coalesce(trim(g.digest), '') = '' AS blank, CASE WHEN x.how IS NULL THEN '- child=' ELSE '- edge=' || x.how || ' dst=' END || coalesce(n.fqn, 'node#' || x.other) || CASE WHEN coalesce(trim(g.digest), '') = '' THEN ' digest=missing' ELSE chr(10) || '  ' || replace(g.digest, chr(10), chr(10) || '  ') END AS t
        FROM (SELECT * FROM u WHERE r <= 20 UNION ALL SELECT * FROM k WHERE r <= 40) x LEFT JOIN n ON n.id = x.other LEFT JOIN g ON g.node_id = x.other),
    b AS (SELECT owner, string_agg(t, chr(10) ORDER BY r) AS block, count(*) AS shown, count(*) FILTER (blank) AS missing, count(*) FILTER ({_PRIO.format('how')} IS NOT NULL) AS n_deps, count(*) FILTER (how IS NULL) AS n_children FROM l GROUP BY owner),
    x AS (SELECT n.id AS node_id, n.kind, n.source_code, CASE WHEN n.kind IN ('METHOD', 'CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'PACKAGE', 'MODULE', 'REPO') THEN coalesce(b.block, '- none') END AS block, coalesce(b.shown, 0) AS shown, coalesce(b.missing, 0) AS missing, coalesce(b.n_deps, 0) AS n_deps, coalesce(b.n_children, 0) AS n_children FROM n LEFT JOIN b ON n.id = b.owner)"""
_LABEL = "coalesce(CASE WHEN trim({0}.name) <> '' THEN {0}.name END, CASE WHEN trim({0}.fqn) <> '' THEN {0}.fqn END, 'Node#' || {1})"
_VERB = "CASE e.kind WHEN 'CALLS_CODE' THEN 'вызывает' WHEN 'DEPENDS_ON' THEN 'зависит от' WHEN 'IMPLEMENTS' THEN 'реализует' WHEN 'READS' THEN 'читает из' WHEN 'WRITES' THEN 'пишет в' WHEN 'CALLS_HTTP' THEN 'вызывает HTTP' WHEN 'CONTAINS' THEN 'содержит' END"
_TOLD = f"(SELECT e.src_id, e.dst_id, e.kind, '- [' || {_LABEL.format('a', 'e.src_id')} || '] ' || {_VERB} || ' [' || {_LABEL.format('z', 'e.dst_id')} || ']' AS line FROM (SELECT * FROM contains UNION SELECT * FROM siblings) e LEFT JOIN n a ON e.src_id = a.id LEFT JOIN n z ON e.dst_id = z.id WHERE {_VERB} IS NOT NULL)"
_PN = f"""{_N}, pn AS (SELECT id, application_id, fqn, meta, CASE WHEN kind = 'DB_QUERY' THEN 'DB_TABLE' ELSE kind END AS kind, CASE WHEN kind = 'EXCEPTION' THEN {list(_RULES)}[id % {len(_RULES)} + 1] ELSE name END AS name FROM n),
    pe AS (SELECT s.src_id, s.dst_id, CASE WHEN t.kind = 'EXCEPTION' THEN 'ANNOTATED_WITH' ELSE s.kind END AS kind FROM siblings s JOIN n t ON s.dst_id = t.id),
    cc AS (SELECT a.application_id, t.name AS annotation, count(*) AS n FROM pe JOIN pn t ON pe.dst_id = t.id JOIN pn a ON pe.src_id = a.id WHERE pe.kind = 'ANNOTATED_WITH' AND regexp_matches(lower(t.name), 'preauthorize|secured|rolesallowed|transactional|async|cacheable|cacheevict|cacheput|scheduled|retryable|circuitbreaker') GROUP BY ALL)"""


def _list_sql(section: str, grp: str, kind: str, n: int, unit: str = "") -> str:
    rows = f"(SELECT *, coalesce(name, fqn) AS l, {grp} AS grp FROM pn WHERE kind = '{kind}')"
    return f"""SELECT application_id, '{section}' AS section, grp, CAST(r AS INTEGER) AS position, '- ' || l AS line FROM (SELECT *, row_number() OVER (PARTITION BY application_id, grp ORDER BY id) AS r FROM {rows}) WHERE r <= {n}
        UNION ALL SELECT application_id, '{section}', grp, {n + 1}, '- ... и ещё ' || (count(*) - {n}) || '{unit}' FROM {rows} GROUP BY application_id, grp HAVING count(*) > {n}"""


SQL = {
    "chunk_plan": f"""{_N}, p AS (SELECT *, CASE WHEN coalesce(trim(signature) <> '' OR trim(doc_comment) <> '', false) THEN 1 ELSE 0 END AS d FROM n) SELECT id AS node_id, id || CASE d WHEN 1 THEN ':doc:tech' ELSE ':code:snippet' END AS plan_id, CASE d WHEN 1 THEN 'doc' ELSE 'code' END AS source, CASE d WHEN 1 THEN 'tech' ELSE 'snippet' END AS kind,
        CASE d WHEN 1 THEN 'ru' ELSE lang END AS lang, CAST(CASE WHEN kind IN ('ENDPOINT', 'METHOD', 'INFRASTRUCTURE') THEN 10 WHEN kind = 'CLASS' THEN 5 ELSE 0 END AS INTEGER) AS priority, fqn AS title, array_to_string(list_concat(coalesce(string_split(package, '.'), []), CASE WHEN name IS NULL THEN [] ELSE [name] END), '/') AS section FROM p""",
    "plan_relations": f"{_N} SELECT src_id AS node_id, kind, dst_id, 0.7::double AS confidence FROM siblings WHERE kind = 'CALLS'",
    "doc_context": f"{_CONTEXT} SELECT node_id, md5(block) AS block, shown, missing, n_deps, n_children FROM x",
    "prompt_selection": f"""{_CONTEXT} SELECT node_id AS id, CASE WHEN kind = 'METHOD' THEN CASE WHEN n_deps > 0 THEN 'method-with-deps' ELSE 'method-no-deps' END WHEN kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') THEN CASE WHEN n_children > 0 THEN 'type-with-children' ELSE 'type-no-children' END
        WHEN kind IN ('PACKAGE', 'MODULE', 'REPO') THEN CASE WHEN n_children > 0 THEN 'container-with-children' ELSE 'container-no-children' END WHEN kind = 'INFRASTRUCTURE' THEN 'infrastructure' WHEN coalesce(trim(source_code) <> '', false) THEN 'leaf-with-code' ELSE 'leaf-no-code' END AS prompt FROM x""",
    "hash_backfill": r"SELECT DISTINCT id, coalesce(content_hash, CASE WHEN trim(content) <> '' THEN sha256(content) END) AS content_hash, coalesce(token_count, CAST(len(regexp_extract_all(content, '[^ \t\n\x0B\f\r]+')) AS INTEGER)) AS token_count FROM chunk",
    "node_details": f"{_N} SELECT n.id, n.fqn, (SELECT count(*) FROM contains c WHERE c.dst_id = n.id) AS incoming, (SELECT count(*) FROM contains c WHERE c.src_id = n.id) AS outgoing FROM n",
    "repo_urls": r"""WITH b AS (SELECT id, regexp_replace(regexp_replace(trim(repo_url), '^(?:https?://|ssh://)?(?:[^@/]*@)?', ''), '(\.git)?/*$', '') AS b FROM application WHERE repo_url IS NOT NULL) SELECT id, CASE WHEN contains(regexp_extract(b, '^([^/:]+)', 1), 'github') THEN 'GITHUB' WHEN contains(regexp_extract(b, '^([^/:]+)', 1), 'gitlab') THEN 'GITLAB' WHEN contains(regexp_extract(b, '^([^/:]+)', 1), 'bitbucket') THEN 'BITBUCKET' ELSE 'OTHER' END AS provider, nullif(regexp_extract(b, '^[^/:]+[/:](?:\d+/)?(.+)/[^/]+$', 1), '') AS owner, nullif(regexp_extract(b, '([^/:]+)$', 1), '') AS repo FROM b""",
    "relation_text": f"{_N}, t AS (SELECT src_id, substr('СВЯЗИ В ГРАФЕ КОДА:' || chr(10) || string_agg(line || ' (Тип: ' || kind || ')', chr(10) ORDER BY kind, dst_id), 1, 5000) AS text FROM {_TOLD} GROUP BY src_id) SELECT src_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS hash FROM t",
    "error_surroundings": f"{_N}, w AS {_TOLD}, r AS (SELECT id FROM n WHERE kind = 'ENDPOINT') SELECT w.src_id AS root_id, w.dst_id AS neighbour_id, w.* FROM w JOIN siblings s USING (src_id, dst_id, kind) WHERE w.src_id IN (SELECT id FROM r) AND w.kind IN ('CALLS_CODE', 'CALLS_HTTP', 'READS', 'WRITES', 'DEPENDS_ON') UNION SELECT w.dst_id, w.src_id, w.* FROM w JOIN siblings s USING (src_id, dst_id, kind) WHERE w.dst_id IN (SELECT id FROM r) AND w.kind = 'CALLS_CODE'",
    "access_control": f"""{_PN} SELECT application_id, 'infrastructure' AS sort, id, ['OAuth2', 'KAFKA', 'SecurityGate'][id % 3 + 1] AS mark FROM pn WHERE kind = 'INFRASTRUCTURE' AND id % 3 <> 1
        UNION ALL SELECT a.application_id, 'protected', a.id, t.name FROM pe JOIN pn t ON pe.dst_id = t.id JOIN pn a ON pe.src_id = a.id WHERE pe.kind = 'ANNOTATED_WITH' AND regexp_matches(lower(coalesce(t.name, t.fqn)), 'preauthorize|secured|rolesallowed')""",
    "cross_cutting": f"{_PN} SELECT * FROM cc",
    "profile_report": f"""{_PN} SELECT application_id, 'kinds' AS section, '' AS grp, CAST(list_position({list(P.PROFILE_KINDS)}, kind) AS INTEGER) AS position, '- ' || kind || ': ' || count(*) AS line FROM pn WHERE list_contains({list(P.PROFILE_KINDS)}, kind) GROUP BY application_id, kind
        UNION ALL {_list_sql('endpoints', "''", 'ENDPOINT', 50, ' эндпоинтов')} UNION ALL {_list_sql('integrations', "'unknown'", 'INFRASTRUCTURE', 20)} UNION ALL {_list_sql('integrations', "'HTTP-клиенты'", 'CLIENT', 20)} UNION ALL {_list_sql('integrations', "'Топики/очереди'", 'TOPIC', 20)}
        UNION ALL SELECT application_id, 'annotations', '', CAST(row_number() OVER (PARTITION BY application_id ORDER BY n DESC, annotation) AS INTEGER), '- @' || annotation || ': ' || n || ' использований' FROM cc UNION ALL {_list_sql('modules', "''", 'MODULE', 20, ' модулей')}
        UNION ALL SELECT application_id, 'data', '', CAST(r AS INTEGER), '- DB_TABLE: ' || coalesce(name, fqn) || coalesce(' (' || nullif(concat_ws('; ', 'читают: ' || told.reads, 'пишут: ' || told.writes), '') || ')', '')
        FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY kind, id) AS r FROM pn WHERE kind = 'DB_TABLE') t LEFT JOIN told ON told.dst_id = t.id WHERE r <= 30 UNION ALL SELECT application_id, 'data', '', 31, '- ... и ещё ' || (count(*) - 30) || ' объектов данных' FROM pn WHERE kind = 'DB_TABLE' GROUP BY application_id HAVING count(*) > 30""".replace("cc AS (", "acc AS (SELECT pe.dst_id, pe.kind, coalesce(a.name, a.fqn) AS who, row_number() OVER (PARTITION BY pe.dst_id, pe.kind ORDER BY pe.src_id) AS q FROM pe JOIN pn a ON a.id = pe.src_id WHERE pe.kind IN ('READS', 'WRITES')), told AS (SELECT dst_id, string_agg(who, ', ' ORDER BY q) FILTER (kind = 'READS') AS reads, string_agg(who, ', ' ORDER BY q) FILTER (kind = 'WRITES') AS writes FROM acc WHERE q <= 5 GROUP BY dst_id), cc AS ("),
    "proto_scan": r"""WITH n AS (SELECT DISTINCT id, regexp_replace(regexp_replace(source_code, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g') AS t FROM node WHERE lang = 'proto' AND source_code IS NOT NULL) SELECT id || '.proto' AS path, upper(split_part(d, ' ', 1)) AS kind, regexp_extract(d, '(\w+)$', 1) AS name, CAST(NULL AS VARCHAR) AS owner FROM (SELECT id, unnest(regexp_extract_all(t, '\b((?:message|enum|service)\s+\w+)\s*\{', 1)) AS d FROM n)""",
}
