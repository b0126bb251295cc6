"""Queries of retrieval and classification, with their SQL.

The question's vector is that of the chunk (or term) with the smallest id that has one: a single row, read as a literal.
"""

from pyspark.sql import functions as F

from loomgraph import adapters as A
from loomgraph.operators import classify as C
from loomgraph.operators import retrieval as V
from loomgraph.operators.relational import judge_summary
from loomgraph.functions import text as T
from loomgraph.functions.vector import cosine
from loomgraph.plans.text_queries import SQL as T_SQL
from loomgraph.runtime import table

QUESTION = "queue index"


def _chunks(spark, d):
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("embedding") == 64)
    return table(spark, d, "chunk").dropDuplicates(["id"]).withColumn("embedding", F.when(usable, F.col("embedding")))


def _vector(rows, column="embedding"):
    from loomgraph.functions.vector import norm

    return rows.where(norm(F.col(column)) > 0).orderBy("id").select(column).first()[0]


def knn_cosine(spark, d):
    c = _chunks(spark, d)
    return V.knn(c, _vector(c), 20, threshold=0.01).select("id", F.round("similarity", 6).alias("similarity"))


def knn_scoped_threshold(spark, d):
    c = _chunks(spark, d)
    return V.knn(c, _vector(c), 20, application=1, threshold=0.01).select("id", F.round("similarity", 6).alias("similarity"))


def fts_conjunctive(spark, d):
    return V.full_text(_chunks(spark, d), QUESTION, 50).select("id", F.round("score", 6).alias("score"))


def fts_cover_density(spark, d):
    rows = _chunks(spark, d).select("id", V.tokens(F.col("content")).alias("t")).where(F.array_contains("t", "queue") & F.array_contains("t", "index"))
    return rows.select("id", F.round(V.cover_density(F.col("t"), ["queue", "index"]), 6).alias("density"))


def hybrid_rrf(spark, d):
    c = _chunks(spark, d)
    return V.hybrid(c, QUESTION, _vector(c), 10, threshold=0.01).select("id", F.round("score", 9).alias("score"))


def multi_query_search(spark, d):
    c = _chunks(spark, d)
    v = _vector(c)
    return V.search_many(c, [("queue", v), ("session", v)], hyde=v, k=5).select("id", "source_rank")


def keyword_filter_two_stage(spark, d):
    c = _chunks(spark, d).where("content is not null").select("id", "content")
    return V.two_stage_filter(c, ["queue", "depot"]).select("id")


def synonym_dual_threshold(spark, d):
    s = table(spark, d, "synonym_dictionary").dropDuplicates(["id"])
    ok = lambda c: F.when(F.forall(c, lambda x: ~F.isnan(x)) & (F.size(c) == 64), F.col(c))
    s = s.withColumns({"term_embedding": ok("term_embedding"), "desc_embedding": ok("desc_embedding")})
    return V.synonym_matches(s, _vector(s, "term_embedding"), 50, 0.05).select("id", "term", F.round("similarity", 6).alias("similarity"))


def synonym_mining(spark, d):
    """Pairs from documents' digests that the dictionary does not know."""
    nodes = A.nodes(spark, d).select(F.col("id").alias("node_id"), F.col("name").alias("node_name"))
    docs = table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"]).join(nodes, "node_id")
    pairs = docs.select("node_name", F.regexp_extract("doc_digest", r"uses=(\w+)", 1).alias("term"), F.col("doc_public").alias("description"), F.col("doc_tech").alias("purpose"))
    return V.mine_synonyms(pairs, table(spark, d, "synonym_dictionary"), ("password",)).select(F.lower("term").alias("term"))


def exact_node_search(spark, d):
    nodes = A.nodes(spark, d)
    return V.exact_nodes(nodes, "NoSuchClass", None, ["nothing.like.this", "order", "stock"])


def agent_node_search(spark, d):
    return V.find_nodes(A.nodes(spark, d), "Order", 10)


def final_scores(spark, d):
    """Score of every document: coverage, readability, and the cosine of term and description of its node's synonym."""
    syn = table(spark, d, "synonym_dictionary").dropDuplicates(["id"])
    sem = syn.select(F.col("source_node_id").alias("node_id"), cosine(F.col("term_embedding"), F.col("desc_embedding")).alias("c")).where(~F.isnan("c")).groupBy("node_id").agg(F.max("c").alias("c"))
    docs = table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"])
    nodes = A.nodes(spark, d).select(F.col("id").alias("node_id"), "source_code")
    rows = docs.join(nodes, "node_id").join(sem, "node_id", "left")
    judge = F.when(F.col("node_id") % 2 == 0, (F.col("node_id") % 11).cast("double"))  # every other document was judged
    semantic = F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0)) * 10
    return rows.select("node_id", "locale", T.final_score(T.coverage(F.col("source_code"), F.col("doc_tech")), T.readability(F.col("doc_public")), semantic, judge).alias("score"))


def context_assembly(spark, d):
    """Context of every documented node: code, then documents, each cut to its cap."""
    nodes = A.nodes(spark, d).select(F.col("id").alias("query_id"), F.lit(1).alias("position"), F.lit("Code").alias("title"), F.col("source_code").alias("body"), F.lit(1500).alias("cap"))
    docs = table(spark, d, "node_doc").where("locale = 'en'").dropDuplicates(["node_id", "locale"])
    tech = docs.select(F.col("node_id").alias("query_id"), F.lit(2).alias("position"), F.lit("Documentation").alias("title"), F.col("doc_tech").alias("body"), F.lit(3000).alias("cap"))
    out = V.assemble_context(nodes.join(docs.select(F.col("node_id").alias("query_id")), "query_id", "left_semi").unionByName(tech))
    return out.select("query_id", F.length("context").alias("chars"), F.md5("context").alias("hash"))


def intent_class(spark, d):
    m = table(spark, d, "spring_ai_chat_memory").where("content is not null").select("content").distinct()
    c = F.col("content")
    return m.select(F.md5(c).alias("message"), C.intent(c).alias("intent"), C.topic(c).alias("topic"), C.named_class(c).alias("class_name"), C.named_method(c).alias("method_name"))


def _traces(spark, d):
    """A trace for every method: a library frame, a cause, and the method's own frame below the cause."""
    base = F.substring_index("fqn", "(", 1)
    own = F.concat(F.lit(" at "), base, F.lit("(Own.kt:"), F.coalesce("line_start", F.lit(1)), F.lit(")\n"))
    text = F.concat(F.lit("java.lang.IllegalStateException: outer\n at org.springframework.web.X.run(X.java:5)\nCaused by: java.lang.NullPointerException: inner\n at java.util.List.get(List.java:1)\n"), own, F.lit(" at com.acme.Main.main(Main.kt:7)"))
    return A.nodes(spark, d).where("kind = 'METHOD'").select(F.col("id").alias("trace_id"), text.alias("trace"))


def stacktrace_frames(spark, d):
    return C.frames(_traces(spark, d), "trace_id", "trace")


def stacktrace_root(spark, d):
    return C.root_cause(_traces(spark, d), "trace_id", "trace")


def kind_refine(spark, d):
    nodes = A.nodes(spark, d).where("kind in ('CLASS', 'INTERFACE', 'SERVICE', 'CLIENT', 'MAPPER', 'RECORD', 'ENUM')")
    notes = F.from_json(F.get_json_object("meta", "$.annotations"), "array<string>")
    none = F.lit(None).cast("array<string>")
    return nodes.select("id", C.refine_type(F.col("kind"), F.col("name"), F.col("package"), notes, none, none).alias("refined"))


def function_kind_refine(spark, d):
    nodes = A.nodes(spark, d).where("kind in ('METHOD', 'ENDPOINT', 'JOB', 'TEST') and source_code is not null")
    notes = F.regexp_extract_all("source_code", F.lit(r"(@[A-Za-z]+)"), 1)
    return nodes.select("id", C.refine_function(F.lit("METHOD"), notes, F.lit(None).cast("array<string>")).alias("refined"))


def infra_detection(spark, d):
    rows = spark.sql(
        """SELECT * FROM VALUES (1, 'rr.ups-client.api-url', '${UPS_SERVICE_API_URL:https://ups.example/api}'), (1, 'rr.ups-client.timeout', '10'), (1, 'spring.datasource.url', 'jdbc:postgresql://db/x'),
        (1, 'spring.datasource.username', 'u'), (1, 'spring.kafka.bootstrap-servers', '${KAFKA:k:9092}'), (1, 'spring.kafka.group', 'g'), (1, 'mail.queue', 'x'), (1, 'spring.rabbitmq.host', 'r'), (1, 'spring.rabbitmq.port', '1'),
        (1, 'camunda.base-url', 'http://cam'), (1, 'plain.key', 'v') AS t(source_id, prop, value)"""
    )
    return C.integrations(rows)


QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine, knn_scoped_threshold, fts_conjunctive, fts_cover_density, hybrid_rrf, multi_query_search, keyword_filter_two_stage, synonym_dual_threshold, synonym_mining, exact_node_search, agent_node_search, final_scores,
        context_assembly, intent_class, stacktrace_frames, stacktrace_root, kind_refine, function_kind_refine, infra_detection,
    )
}

_OK = "len({0}) = 64 AND len(list_filter({0}, lambda x: isnan(x) OR x IS NULL)) = 0 AND list_sum(list_transform({0}, lambda x: x * x)) > 0"
_C = f"WITH c AS (SELECT DISTINCT id, application_id, content, CASE WHEN {_OK.format('embedding')} THEN CAST(embedding AS DOUBLE[]) END AS v FROM chunk), q AS (SELECT v AS q FROM c WHERE v IS NOT NULL ORDER BY id LIMIT 1), s AS (SELECT id, application_id, list_cosine_similarity(v, (SELECT q FROM q)) AS sim FROM c WHERE v IS NOT NULL), tk AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM c)"
_FT = "SELECT id, len(list_filter(t, lambda x: x IN ('queue', 'index')))::double / len(t) AS score FROM tk WHERE list_contains(t, 'queue') AND list_contains(t, 'index')"
_TR = r"WITH m AS (SELECT DISTINCT id AS trace_id, regexp_replace(split_part(fqn, '(', 1), '\.[^.]*$', '') AS owner, regexp_extract(split_part(fqn, '(', 1), '[^.]*$') AS method, coalesce(line_start, 1) AS line FROM node WHERE kind = 'METHOD')"
SQL = {
    "knn_cosine": f"{_C} SELECT id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.01 ORDER BY sim DESC, id LIMIT 20",
    "knn_scoped_threshold": f"{_C} SELECT id, round(sim, 6) AS similarity FROM s WHERE application_id = 1 AND sim >= 0.01 ORDER BY sim DESC, id LIMIT 20",
    "fts_conjunctive": f"{_C} SELECT id, round(score, 6) AS score FROM ({_FT}) ORDER BY score DESC, id LIMIT 50",
    "hybrid_rrf": f"""{_C}, a AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM (SELECT id, sim FROM s WHERE sim >= 0.01 ORDER BY sim DESC, id LIMIT 20)), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM ({_FT}) ORDER BY score DESC, id LIMIT 20))
        SELECT id, round(sum(p), 9) AS score FROM (SELECT id, 0.6::double / (60 + r) AS p FROM a UNION ALL SELECT id, 0.4::double / (60 + r) FROM b) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10""",
    "keyword_filter_two_stage": r"SELECT DISTINCT id FROM chunk WHERE regexp_matches(content, '(?i)(^|[^\p{L}\p{N}_])(queue|depot)($|[^\p{L}\p{N}_])')",
    "synonym_dual_threshold": f"""WITH n AS (SELECT DISTINCT id, term, CASE WHEN {_OK.format('term_embedding')} THEN CAST(term_embedding AS DOUBLE[]) END AS t, CASE WHEN {_OK.format('desc_embedding')} THEN CAST(desc_embedding AS DOUBLE[]) END AS v FROM synonym_dictionary),
        q AS (SELECT t AS q FROM n WHERE t IS NOT NULL ORDER BY id LIMIT 1), top AS (SELECT * FROM n WHERE t IS NOT NULL ORDER BY list_cosine_similarity(t, (SELECT q FROM q)) DESC, id LIMIT 50) SELECT id, term, round(list_cosine_similarity(v, (SELECT q FROM q)), 6) AS similarity FROM top WHERE list_cosine_similarity(v, (SELECT q FROM q)) >= 0.05""",
    "synonym_mining": r"""WITH p AS (SELECT DISTINCT n.name AS node_name, regexp_extract(d.doc_digest, 'uses=(\w+)', 1) AS term, d.doc_public AS description, d.doc_tech AS purpose FROM (SELECT DISTINCT node_id, locale, doc_digest, doc_public, doc_tech FROM node_doc) d JOIN (SELECT DISTINCT id, name FROM node) n ON d.node_id = n.id)
        SELECT DISTINCT lower(term) AS term FROM p WHERE NOT regexp_matches(lower(coalesce(node_name, '')), 'datasource|config|adapter|bean|test|properties') AND length(purpose) >= 60 AND length(term) >= 5 AND length(trim(description)) >= 5 AND lower(term) <> lower(node_name) AND lower(term) <> 'password' AND lower(term) NOT IN (SELECT lower(trim(term)) FROM synonym_dictionary WHERE term IS NOT NULL)""",
    "exact_node_search": "SELECT id, fqn, 2 AS how FROM (SELECT DISTINCT id, fqn FROM node) WHERE contains(lower(fqn), 'order') ORDER BY fqn, id LIMIT 3",
    "context_assembly": """WITH d AS (SELECT DISTINCT node_id, doc_tech FROM node_doc WHERE locale = 'en'), n AS (SELECT DISTINCT id, source_code FROM node), p AS (SELECT id AS query_id, 1 AS position, '## Code' || chr(10) || substr(source_code, 1, 1500) AS t FROM n WHERE id IN (SELECT node_id FROM d) AND trim(source_code) <> ''
        UNION ALL SELECT node_id, 2, '## Documentation' || chr(10) || substr(doc_tech, 1, 3000) FROM d WHERE trim(doc_tech) <> ''), c AS (SELECT query_id, substr(string_agg(t, chr(10) || chr(10) ORDER BY position), 1, 12000) AS context FROM p GROUP BY query_id) SELECT query_id, CAST(length(context) AS INTEGER) AS chars, md5(context) AS hash FROM c""",
    "final_scores": f"""WITH y AS (SELECT source_node_id AS node_id, max(list_cosine_similarity(CAST(term_embedding AS DOUBLE[]), CAST(desc_embedding AS DOUBLE[]))) AS c FROM synonym_dictionary WHERE {_OK.format('term_embedding')} AND {_OK.format('desc_embedding')} GROUP BY 1),
        cov AS ({T_SQL['doc_coverage'].replace('round(len', '(len').replace('/ len(keys), 6)', '/ len(keys))')}), rd AS ({T_SQL['doc_readability'].replace('round(least', '(least').replace('/ 10, 4)', '/ 10)')}),
        a AS (SELECT cov.node_id, cov.locale, coverage AS v, coalesce(readability, 5.0) AS r, greatest(coalesce(c, 0), 0) * 10 AS s FROM cov LEFT JOIN rd ON cov.node_id = rd.node_id AND cov.locale = rd.locale LEFT JOIN y ON cov.node_id = y.node_id)
        SELECT node_id, locale, round(CASE WHEN node_id % 2 = 0 THEN 0.15::double * s + 0.15::double * v + 0.1::double * r + 0.6::double * (node_id % 11) ELSE (v + r + s) / 3 END, 2) AS score FROM a""",
    "intent_class": r"""WITH m AS (SELECT DISTINCT content AS c, lower(content) AS l FROM spring_ai_chat_memory WHERE content IS NOT NULL), f AS (SELECT *, len(regexp_extract_all(c, 'at\s+[\w.$]+\.\w+\([^)]*:\d+\)')) AS f, regexp_matches(c, '[\w.]+Exception\s*:') OR contains(c, 'Caused by:') AS h FROM m)
        SELECT md5(c) AS message, CASE WHEN f >= 2 OR (f = 1 AND h) THEN 'STACKTRACE' WHEN regexp_matches(l, 'архитектур|как устроен|обзор систем|какие слои|интеграци|технологи|структура проект|из чего состоит|architecture|overview|layers|system design') THEN 'ARCHITECTURE'
        WHEN regexp_matches(c, '[A-Z][a-z]+[A-Z]') OR regexp_matches(c, '(?i)(^|[^\p{L}\p{N}_])(класс|class|метод|method|функция|function)\s+[A-Za-z_]') THEN 'EXACT' ELSE 'DEFAULT' END AS intent,
        CASE WHEN regexp_matches(l, 'авториз|безопасност|security|auth|доступ|права') THEN 'SECURITY' WHEN regexp_matches(l, 'интеграц|внешни|integration|клиент|client|http|kafka|rabbit') THEN 'INTEGRATION' WHEN regexp_matches(l, 'данн|модел|табли|data|model|table|бд|database|хранени') THEN 'DATA' ELSE 'GENERAL' END AS topic,
        nullif(regexp_extract(c, '(?i)(?:класс|class)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS class_name,
        coalesce(nullif(regexp_extract(c, '(?i)метод\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(c, '(?i)method\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(c, '(?i)функция\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(c, '(?i)function\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '')) AS method_name FROM f""",
    "stacktrace_root": rf"{_TR} SELECT trace_id, 'java.lang.IllegalStateException' AS exception, 'java.lang.NullPointerException' AS cause, owner, method, line FROM m",
    "stacktrace_frames": rf"""{_TR} SELECT trace_id, x."at", x.owner, x.method, x.file, x.line, x.is_app FROM (SELECT trace_id, unnest([{{'at': 0, 'owner': 'org.springframework.web.X', 'method': 'run', 'file': 'X.java', 'line': 5, 'is_app': false}}, {{'at': 1, 'owner': 'java.util.List', 'method': 'get', 'file': 'List.java', 'line': 1, 'is_app': false}},
        {{'at': 2, 'owner': owner, 'method': method, 'file': 'Own.kt', 'line': line, 'is_app': true}}, {{'at': 3, 'owner': 'com.acme.Main', 'method': 'main', 'file': 'Main.kt', 'line': 7, 'is_app': true}}]) AS x FROM m)""",
    "function_kind_refine": """WITH a AS (SELECT DISTINCT id, list_transform(regexp_extract_all(source_code, '@[A-Za-z]+'), lambda x: lower(x[2:])) AS a FROM node WHERE kind IN ('METHOD', 'ENDPOINT', 'JOB', 'TEST') AND source_code IS NOT NULL)
        SELECT id, CASE WHEN list_has_any(a, ['test', 'parameterizedtest', 'repeatedtest']) THEN 'TEST' WHEN list_has_any(a, ['getmapping', 'postmapping', 'putmapping', 'deletemapping', 'patchmapping', 'requestmapping']) THEN 'ENDPOINT' WHEN list_contains(a, 'scheduled') THEN 'JOB' ELSE 'METHOD' END AS refined FROM a""",
    "kind_refine": """WITH b AS (SELECT DISTINCT id, kind, lower(coalesce(name, '')) AS n, string_split(lower(coalesce(package, '')), '.') AS p, list_transform(coalesce(CAST(json_extract(meta, '$.annotations') AS VARCHAR[]), []), lambda x: lower(regexp_extract(regexp_replace(x, '^@|\\(.*$', '', 'g'), '[^.]*$'))) AS a FROM node WHERE kind IN ('CLASS', 'INTERFACE', 'SERVICE', 'CLIENT', 'MAPPER', 'RECORD', 'ENUM'))
        SELECT id, CASE WHEN n LIKE '%test' OR n LIKE '%it' OR n LIKE '%spec' OR list_contains(p, 'test') THEN 'TEST' WHEN list_has_any(a, ['restcontroller', 'controller', 'grpcservice', 'feignclient']) THEN 'ENDPOINT'
        WHEN list_has_any(a, ['configurationproperties', 'configuration']) OR list_contains(p, 'config') OR n LIKE '%config' OR n LIKE '%configuration' THEN 'CONFIG' WHEN n LIKE '%exception' THEN 'EXCEPTION' WHEN list_contains(p, 'job') OR n LIKE '%job' OR n LIKE '%worker' OR n LIKE '%scheduler' THEN 'JOB'
        WHEN list_contains(a, 'repository') OR list_contains(p, 'repository') OR n LIKE '%repository' OR n LIKE '%dao' THEN 'DB_QUERY' WHEN list_has_any(p, ['kafka', 'messaging', 'mq', 'queue', 'stream']) AND regexp_matches(n, '(consumer|producer|listener|subscriber|publisher|receiver|sender)$') THEN 'TOPIC' WHEN list_contains(p, 'migration') OR n LIKE '%migration' THEN 'MIGRATION'
        WHEN list_contains(a, 'mapper') OR list_contains(p, 'mapper') OR n LIKE '%mapper' THEN 'MAPPER' WHEN list_contains(a, 'schema') OR list_contains(p, 'schema') THEN 'SCHEMA' WHEN list_contains(a, 'service') OR (list_contains(a, 'component') AND list_contains(p, 'service')) OR (list_contains(p, 'service') AND n LIKE '%service') OR list_contains(a, 'springbootapplication') THEN 'SERVICE' ELSE kind END AS refined FROM b""",
    "infra_detection": """SELECT 1 AS source_id, * FROM (VALUES ('CAMUNDA', 'camunda', 'camunda.base-url', 'http://cam', NULL), ('DATABASE', 'spring.datasource', 'spring.datasource.url,spring.datasource.username', 'jdbc:postgresql://db/x', NULL),
        ('HTTP', 'rr.ups-client', 'rr.ups-client.api-url,rr.ups-client.timeout', 'https://ups.example/api', 'UPS_SERVICE_API_URL'), ('KAFKA', 'spring.kafka', 'spring.kafka.bootstrap-servers,spring.kafka.group', 'k:9092', 'KAFKA'),
        ('RABBIT', 'spring.rabbitmq', 'spring.rabbitmq.host,spring.rabbitmq.port', 'r', NULL)) t(type, grp, properties, default_url, env_var)""",
    "agent_node_search": """WITH n AS (SELECT DISTINCT id, fqn, name, kind FROM node), w AS (SELECT id, fqn, 0 AS r FROM n WHERE contains(fqn, 'Order') UNION ALL SELECT id, fqn, 1 FROM n WHERE kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'SERVICE', 'MAPPER', 'EXCEPTION', 'CLIENT', 'CONFIG', 'ENDPOINT') AND (name = 'Order' OR fqn LIKE '%.Order') UNION ALL SELECT id, fqn, 2 FROM n WHERE kind = 'METHOD' AND name = 'Order')
        SELECT id, fqn FROM (SELECT id, fqn, min(r) AS r FROM w GROUP BY id, fqn) ORDER BY r, fqn, id LIMIT 10""",
    "fts_cover_density": f"""{_C}, h AS (SELECT id, list_filter(list_transform(range(1, len(t) + 1), lambda i: {{'w': t[i], 'i': i}}), lambda x: x.w IN ('queue', 'index')) AS h FROM tk WHERE list_contains(t, 'queue') AND list_contains(t, 'index')),
        ev AS (SELECT id, unnest(h) AS x, h FROM h), st AS (SELECT id, x.i AS b, least(list_max(list_transform(list_filter(h, lambda y: y.w = 'queue' AND y.i <= x.i), lambda y: y.i)), list_max(list_transform(list_filter(h, lambda y: y.w = 'index' AND y.i <= x.i), lambda y: y.i))) AS a, len(list_filter(h, lambda y: y.w = 'queue' AND y.i <= x.i)) AS q, len(list_filter(h, lambda y: y.w = 'index' AND y.i <= x.i)) AS p FROM ev),
        m AS (SELECT id, a, min(b) AS b FROM st WHERE q > 0 AND p > 0 GROUP BY id, a) SELECT id, round(sum(1.0::double / (b - a + 1)), 6) AS density FROM m GROUP BY id""",
}
