"""Queries of lookups, joins, aggregates, sets and writes over whole tables, with their SQL."""

from pyspark.sql import functions as F

from loomgraph import adapters as A
from loomgraph.operators import chunking as K
from loomgraph.operators import relational as R
from loomgraph.operators import retrieval as V
from loomgraph.operators import upsert as U
from loomgraph.runtime import table
from loomgraph.schema import TYPE_KINDS


def _docs(spark, d):
    return table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"])


def _chunks(spark, d):
    return table(spark, d, "chunk").dropDuplicates(["id"])


def nodes_by_kind(spark, d):
    return R.by_kinds(A.nodes(spark, d), [1, 2, 3], ["METHOD", "CLASS", "UNKNOWN"]).select("id", "application_id", "kind")


def node_by_fqn(spark, d):
    """The node of the first name of the first application."""
    nodes = A.nodes(spark, d)
    first = nodes.where("fqn is not null").agg(F.min(F.struct("application_id", "fqn")).alias("x")).first()["x"]
    return R.by_fqn(nodes, first.application_id, first.fqn).select("id", "application_id", "fqn")


def fqn_contains(spark, d):
    return R.fqn_like(A.nodes(spark, d), 1, "voice", 1000).select("id", "fqn")


def class_lookup(spark, d):
    """The name of the first type, in any case, and that of the last one as it is written."""
    nodes = A.nodes(spark, d)
    first, last = nodes.where(F.col("kind").isin(*TYPE_KINDS)).agg(F.min_by("name", "id"), F.max_by("name", "id")).first()
    return R.classes_named(nodes, first.upper(), TYPE_KINDS, True).select("id", "fqn").unionByName(R.classes_named(nodes, last, TYPE_KINDS).select("id", "fqn")).distinct()


def class_method_lookup(spark, d):
    """The first method with an owner, by its own and its owner's name in any case, and all methods of that name."""
    nodes = A.nodes(spark, d)
    owners = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("owner"))
    one = nodes.where("kind = 'METHOD'").join(owners, "parent_id").agg(F.min(F.struct("id", "owner", "name")).alias("x")).first()["x"]
    both = R.methods_of_class(nodes, one.owner.upper(), one.name.upper(), True).select("id", F.lit("both").alias("by"))
    return both.unionByName(R.methods_named(nodes, one.name).select("id", F.lit("name").alias("by")))


def audit_search(spark, d):
    events = table(spark, d, "events")
    return R.optional_filter(events, {"event_type": "error", "user_id": None}, {"props": "k"}, since="2024-01-05", until="2024-01-20", page=1, size=100, tie="event_id").select("event_id", "user_id", "event_type")


def json_containment(spark, d):
    nodes = A.nodes(spark, d)
    return nodes.where(R.json_has(F.col("meta"), "$.annotations", "@Repository") | R.json_true(F.col("meta"), "$.synthetic")).select("id", "fqn")


def incomplete_chunks(spark, d):
    return R.incomplete_chunks(_chunks(spark, d)).select("id")


def documented_nodes(spark, d):
    """Semi and anti join: nodes with and without any document."""
    nodes, docs = A.nodes(spark, d).select("id", "kind"), _docs(spark, d).select(F.col("node_id").alias("id"))
    yes = R.in_ids(nodes, docs).withColumn("documented", F.lit(True))
    no = nodes.join(docs, "id", "left_anti").withColumn("documented", F.lit(False))
    return yes.union(no)


def app_stats(spark, d):
    syn = table(spark, d, "synonym_dictionary").dropDuplicates(["id"])
    return R.application_stats(table(spark, d, "application"), A.nodes(spark, d), _chunks(spark, d), A.contains(spark, d), syn)


def global_stats(spark, d):
    return R.global_counts(applications=table(spark, d, "application"), nodes=A.nodes(spark, d), chunks=_chunks(spark, d), docs=_docs(spark, d))


def kind_counts(spark, d):
    return R.count_by(A.nodes(spark, d), "application_id", "kind")


def shared_contracts(spark, d):
    nodes = A.nodes(spark, d).where("kind in ('INTERFACE', 'CLASS', 'SERVICE', 'CLIENT')")
    return R.shared_interfaces(nodes, "name")


def judge_aggregate(spark, d):
    """Judge statistics over event values by user."""
    return R.judge_summary(table(spark, d, "events"), "user_id", "value")


def capped_names(spark, d):
    return R.capped_list(A.nodes(spark, d).where("kind = 'ENDPOINT'"), "application_id", "fqn", 5)


def annotation_usage(spark, d):
    nodes = A.nodes(spark, d).select("id", F.explode(F.from_json(F.get_json_object("meta", "$.annotations"), "array<string>")).alias("annotation"))
    return R.count_by(nodes.distinct(), "annotation")


def multi_query_dedupe(spark, d):
    """Union of three lists in which the first list with an id wins."""
    c = _chunks(spark, d)
    lists = [c.where(F.contains(F.lower("content"), F.lit(w))).select("id", F.lit(w).alias("found_by")) for w in ("queue", "index", "order")]
    return R.first_wins(*lists).select("id", "found_by")


def undirected_edges(spark, d):
    return R.undirected(A.estate(spark, d))


def stale_docs(spark, d):
    return R.stale_docs(_docs(spark, d), _chunks(spark, d))


def ready_nodes(spark, d):
    return R.ready_nodes(A.nodes(spark, d), _docs(spark, d), A.siblings(spark, d).unionByName(A.contains(spark, d)), "en")


def cycle_break_nodes(spark, d):
    return R.ready_nodes(A.nodes(spark, d), _docs(spark, d), A.contains(spark, d), "en", break_cycles=True)


def latest_per_group(spark, d):
    return U.latest_chunk(_chunks(spark, d)).select("node_id", "id")


def recent_chats(spark, d):
    rows = table(spark, d, "spring_ai_chat_memory").groupBy("conversation_id").agg(F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.col("last").desc(), "conversation_id").limit(10).select("conversation_id", "n")


def edge_upsert(spark, d):
    """Edges of one kind proposed over those that exist: nothing is doubled."""
    edges = A.estate(spark, d)
    return U.insert_missing(edges.where("kind <> 'CALLS_HTTP'"), edges, ["src_id", "dst_id", "kind"])


def doc_upsert(spark, d):
    """English documents of a node replace the Russian one's texts, the status stays."""
    docs = _docs(spark, d)
    new = docs.where("locale = 'en'").select("node_id", F.lit("ru").alias("locale"), "doc_public", F.lit("PENDING").alias("synonym_status"))
    old = docs.where("locale = 'ru'").select("node_id", "locale", "doc_public", "synonym_status")
    return U.replace_rows(old, new, ["node_id", "locale"], keep=("synonym_status",)).select("node_id", "locale", F.md5("doc_public").alias("text_hash"), "synonym_status")


def doc_chunk_sync(spark, d):
    return U.upsert_doc_chunks(_chunks(spark, d), _docs(spark, d)).select("node_id", "locale", "kind", F.md5("content").alias("content_hash"), "stale")


def node_change_detect(spark, d):
    """Kotlin nodes against a version in which long sources changed and names of classes are in lower case."""
    nodes = A.nodes(spark, d).where("lang = 'kotlin'")
    long = F.length("source_code") > 400
    new = nodes.withColumn("code_hash", F.when(long, F.concat(F.coalesce("code_hash", F.lit("")), F.lit("x"))).otherwise(F.col("code_hash"))).withColumn("name", F.when(F.col("kind") == "CLASS", F.lower("name")).otherwise(F.col("name")))
    return U.detect_changes(nodes, new, ["application_id", "fqn"]).select("application_id", "fqn", "action", F.md5("source_code").alias("source_hash"), "line_start")


def change_totals(spark, d):
    """How many of the nodes above were created, updated and passed over, if every eleventh was unknown."""
    nodes = A.nodes(spark, d).where("lang = 'kotlin'")
    new = nodes.withColumn("code_hash", F.when(F.length("source_code") > 400, F.concat(F.coalesce("code_hash", F.lit("")), F.lit("x"))).otherwise(F.col("code_hash")))
    return U.change_counts(U.detect_changes(nodes.where("id % 11 <> 0"), new, ["application_id", "fqn"]))


def chunk_updates(spark, d):
    """Hashes and counts of every third chunk written in place, a count only where it is known; vectors of all are cleared."""
    c = _chunks(spark, d).select("id", "content_hash", "token_count", "embedding")
    new = _chunks(spark, d).where("id % 3 = 0").select("id", F.sha2("content", 256).alias("content_hash"), F.when(F.col("id") % 2 == 0, F.length("content")).alias("token_count"))
    out = U.clear_columns(U.update_rows(c, new, ["id"], keep_given=("token_count",)), "embedding")
    return out.select("id", "content_hash", "token_count", F.col("embedding").isNull().alias("cleared"))


def application_delete(spark, d):
    """What is left of nodes, edges, documents and chunks without the first application."""
    docs = _docs(spark, d).select("node_id", "locale")
    left = U.delete_application(1, A.nodes(spark, d).select("id", "application_id"), A.contains(spark, d), docs=(docs, "node_id"), chunks=(_chunks(spark, d).select("id", "node_id"), "node_id"))
    out = None
    for name, rows in left.items():
        part = rows.select(F.lit(name).alias("name"), F.col(rows.columns[0]).alias("a"), F.col(rows.columns[1]).cast("string").alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


def merge_policies(spark, d):
    c = _chunks(spark, d)
    old, new = F.col("content_hash"), F.sha2("content", 256)
    return c.select(
        "id", U.merge_value("KEEP_EXISTING", old, new).alias("keep"), U.merge_value("OVERWRITE", old, new).alias("over"), F.length(U.merge_value("PREFER_LONGER", F.col("lang_detected"), F.col("source"))).alias("longer_chars"), U.merge_value("GRADE_BETTER", F.lit("B"), F.lit("A")).alias("grade")
    )


def planned_content(spark, d):
    return U.planned_content(A.nodes(spark, d)).select("id", F.md5("content").alias("hash"))


def meta_merge(spark, d):
    """Names taken over by number: every third is removed, every third is blank and passed over."""
    third = F.col("id") % 3
    old = F.create_map(F.lit("kind"), "kind", F.lit("name"), F.coalesce("name", F.lit("-")))
    new = F.create_map(F.lit("name"), F.when(third == 1, "").when(third == 2, F.lower(F.coalesce("name", F.lit("-")))), F.lit("package"), F.coalesce("package", F.lit("")))
    merged = U.merge_meta(old, new)
    return A.nodes(spark, d).where("kind is not null").select("id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("meta"))


def run_totals(spark, d):
    return K.run_summary(K.chunk_plan(A.nodes(spark, d)), 10.0)


def generated_docs(spark, d):
    """Documents by a model that tells the length of its prompt, or nothing for sources of even number."""
    nodes = A.nodes(spark, d).withColumn("signature", F.when(F.col("id") % 2 == 0, F.lit("SKIP")).otherwise(F.col("signature")))
    out = K.generate_docs(nodes, "en", lambda prompts: [None if "\nSKIP" in p else f"{len(p)} characters" for p in prompts])
    return out.select("node_id", "locale", "doc_tech", "doc_digest", "source_hash")


def reranked(spark, d):
    """Chunks scored by a model that likes long texts, the five best of them."""
    rows = _chunks(spark, d).select("id", "content", F.lit(0.0).alias("similarity"))
    return V.answer_set(V.rerank(rows, lambda texts: [float(len(t)) for t in texts]), 5)


def delete_orphans(spark, d):
    """Synonyms without those of nodes that have a document."""
    syn = table(spark, d, "synonym_dictionary").dropDuplicates(["id"]).select("id", "source_node_id")
    return U.delete_rows(syn, _docs(spark, d).select("node_id"), "source_node_id")


QUERIES = {
    f.__name__: f
    for f in (
        nodes_by_kind, node_by_fqn, fqn_contains, class_lookup, class_method_lookup, audit_search, json_containment, incomplete_chunks, documented_nodes, app_stats, global_stats, kind_counts, shared_contracts, judge_aggregate, capped_names,
        annotation_usage, multi_query_dedupe, undirected_edges, stale_docs, ready_nodes, cycle_break_nodes, latest_per_group, recent_chats, edge_upsert, doc_upsert, doc_chunk_sync, node_change_detect, change_totals, chunk_updates, application_delete, merge_policies, planned_content, meta_merge, run_totals, generated_docs, reranked, delete_orphans,
    )
}

_N = f"WITH {A.NODE_SQL}, {A.CONTAINS_SQL}, d AS (SELECT DISTINCT * FROM node_doc), c AS (SELECT DISTINCT * FROM chunk)"
_PRIO = "CASE WHEN kind IN ('FIELD', 'ENDPOINT', 'TOPIC', 'INFRASTRUCTURE') THEN 0 WHEN kind = 'METHOD' THEN 1 WHEN kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'SERVICE', 'MAPPER', 'CONFIG', 'SCHEMA', 'EXCEPTION', 'TEST') THEN 2 WHEN kind = 'PACKAGE' THEN 3 WHEN kind = 'MODULE' THEN 4 WHEN kind = 'REPO' THEN 5 ELSE 6 END"
_OPEN = f"{_N}, {A.SIBLINGS_SQL}, op AS (SELECT * FROM n WHERE id NOT IN (SELECT node_id FROM d WHERE locale = 'en')), miss AS (SELECT * FROM n WHERE id NOT IN (SELECT node_id FROM d WHERE locale = 'en' AND doc_digest IS NOT NULL AND doc_digest <> ''))"
_DEPENDS = "('CALLS_CODE', 'THROWS', 'READS', 'WRITES', 'QUERIES', 'CALLS_HTTP', 'CALLS_GRPC', 'PRODUCES', 'CONSUMES', 'CONFIGURES', 'CIRCUIT_BREAKER_TO', 'RETRIES_TO', 'TIMEOUTS_TO', 'DEPENDS_ON')"
SQL = {
    "nodes_by_kind": f"{_N} SELECT id, application_id, kind FROM n WHERE application_id IN (1, 2, 3) AND kind IN ('METHOD', 'CLASS')",
    "node_by_fqn": f"{_N} SELECT id, application_id, fqn FROM n WHERE (application_id, fqn) = (SELECT min((application_id, fqn)) FROM n WHERE fqn IS NOT NULL)",
    "fqn_contains": f"{_N} SELECT id, fqn FROM n WHERE application_id = 1 AND fqn LIKE '%voice%' ORDER BY fqn, id LIMIT 1000",
    "class_lookup": f"{_N}, t AS (SELECT * FROM n WHERE kind IN {TYPE_KINDS}), x AS (SELECT arg_min(name, id) AS a, arg_max(name, id) AS z FROM t) SELECT DISTINCT t.id, t.fqn FROM t, x WHERE lower(t.name) = lower(a) OR ends_with(lower(t.fqn), '.' || lower(a)) OR t.name = z OR ends_with(t.fqn, '.' || z)",
    "class_method_lookup": f"""{_N}, o AS (SELECT m.id, p.name AS owner, m.name FROM n m JOIN n p ON m.parent_id = p.id WHERE m.kind = 'METHOD'), one AS (SELECT * FROM o ORDER BY id LIMIT 1)
        SELECT o.id, 'both' AS "by" FROM o JOIN one ON lower(o.owner) = lower(one.owner) AND lower(o.name) = lower(one.name) UNION ALL SELECT n.id, 'name' FROM n JOIN one ON n.name = one.name WHERE n.kind = 'METHOD'""",
    "audit_search": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND props LIKE '%k%' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 100",
    "json_containment": f"{_N} SELECT id, fqn FROM n WHERE coalesce(list_contains(CAST(json_extract(meta, '$.annotations') AS VARCHAR[]), '@Repository'), false) OR coalesce(CAST(json_extract(meta, '$.synthetic') AS BOOLEAN), false)",
    "incomplete_chunks": f"{_N} SELECT id FROM c WHERE content_hash IS NULL OR token_count IS NULL OR embedding IS NULL",
    "documented_nodes": f"{_N} SELECT id, kind, id IN (SELECT node_id FROM d WHERE node_id IS NOT NULL) AS documented FROM n",
    "app_stats": f"""{_N}, s AS (SELECT DISTINCT id, source_node_id FROM synonym_dictionary) SELECT a.id, a.key, a.name, (SELECT count(*) FROM n WHERE n.application_id = a.id) AS nodes, (SELECT count(*) FROM c WHERE c.application_id = a.id) AS chunks,
        (SELECT count(*) FROM contains e JOIN n ON e.src_id = n.id WHERE n.application_id = a.id) AS edges, (SELECT count(*) FROM s JOIN n ON s.source_node_id = n.id WHERE n.application_id = a.id) AS synonyms FROM application a""",
    "global_stats": "SELECT (SELECT count(*) FROM application) AS applications, (SELECT count(DISTINCT id) FROM node) AS nodes, (SELECT count(DISTINCT id) FROM chunk) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT node_id, locale FROM node_doc)) AS docs",
    "kind_counts": f"{_N} SELECT application_id, kind, count(*) AS n FROM n GROUP BY application_id, kind",
    "shared_contracts": f"{_N} SELECT name, count(DISTINCT application_id) AS apps FROM n WHERE kind IN ('INTERFACE', 'CLASS', 'SERVICE', 'CLIENT') GROUP BY name HAVING count(DISTINCT application_id) >= 2",
    "judge_aggregate": "SELECT user_id, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, round(1 / (1 + coalesce(var_samp(value), 0)), 6) AS confidence, count(*) AS judges FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "capped_names": f"{_N} SELECT application_id, array_to_string(l[1:5], ', ') AS shown, greatest(len(l) - 5, 0) AS more FROM (SELECT application_id, list_sort(list_distinct(list(fqn))) AS l FROM n WHERE kind = 'ENDPOINT' GROUP BY application_id)",
    "annotation_usage": f"{_N} SELECT annotation, count(*) AS n FROM (SELECT DISTINCT id, unnest(CAST(json_extract(meta, '$.annotations') AS VARCHAR[])) AS annotation FROM n) GROUP BY annotation",
    "multi_query_dedupe": f"{_N} SELECT id, CASE WHEN contains(lower(content), 'queue') THEN 'queue' WHEN contains(lower(content), 'index') THEN 'index' ELSE 'order' END AS found_by FROM c WHERE contains(lower(content), 'queue') OR contains(lower(content), 'index') OR contains(lower(content), 'order')",
    "undirected_edges": f"WITH {A.ESTATE_SQL} SELECT DISTINCT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b, kind FROM estate",
    "stale_docs": f"""{_N}, p AS (SELECT node_id, lang_detected AS locale, max(updated_at) AS at FROM c WHERE source = 'doc' AND kind = 'public' GROUP BY 1, 2), t AS (SELECT node_id, lang_detected AS locale, max(updated_at) AS at FROM c WHERE source = 'doc' AND kind = 'tech' GROUP BY 1, 2),
        s AS (SELECT d.node_id, d.locale, CASE WHEN trim(d.doc_public) <> '' THEN CASE WHEN p.at IS NULL THEN 'missing' WHEN p.at < d.updated_at THEN 'stale' END END AS public_state, CASE WHEN trim(d.doc_tech) <> '' THEN CASE WHEN t.at IS NULL THEN 'missing' WHEN t.at < d.updated_at THEN 'stale' END END AS tech_state
        FROM d LEFT JOIN p ON d.node_id = p.node_id AND d.locale = p.locale LEFT JOIN t ON d.node_id = t.node_id AND d.locale = t.locale) SELECT * FROM s WHERE public_state IS NOT NULL OR tech_state IS NOT NULL""",
    "ready_nodes": f"""{_OPEN} SELECT id, kind, CAST({_PRIO} AS INTEGER) AS prio FROM op
        WHERE (kind <> 'METHOD' OR id NOT IN (SELECT e.src_id FROM siblings e JOIN miss t ON t.id = e.dst_id WHERE e.src_id <> e.dst_id AND e.kind IN {_DEPENDS} AND t.kind = 'METHOD'))
        AND (kind NOT IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') OR id NOT IN (SELECT parent_id FROM miss WHERE parent_id IS NOT NULL AND kind IN ('METHOD', 'FIELD')))
        AND (kind <> 'PACKAGE' OR id NOT IN (SELECT parent_id FROM miss WHERE parent_id IS NOT NULL AND kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD', 'PACKAGE')))
        AND (kind NOT IN ('MODULE', 'REPO') OR id NOT IN (SELECT parent_id FROM miss WHERE parent_id IS NOT NULL AND kind IN ('PACKAGE', 'MODULE')))""",
    "cycle_break_nodes": f"{_OPEN} SELECT id, kind, CAST({_PRIO} AS INTEGER) AS prio FROM op",
    "latest_per_group": f"{_N} SELECT node_id, id FROM (SELECT node_id, id, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM c) WHERE r = 1",
    "recent_chats": "SELECT conversation_id, count(*) AS n FROM spring_ai_chat_memory GROUP BY conversation_id ORDER BY max(timestamp) DESC, conversation_id LIMIT 10",
    "edge_upsert": f"WITH {A.ESTATE_SQL} SELECT * FROM estate",
    "doc_upsert": f"{_N}, o AS (SELECT * FROM d WHERE locale = 'ru'), w AS (SELECT * FROM d WHERE locale = 'en') SELECT coalesce(o.node_id, w.node_id) AS node_id, 'ru' AS locale, md5(CASE WHEN w.node_id IS NOT NULL THEN w.doc_public ELSE o.doc_public END) AS text_hash, CASE WHEN o.node_id IS NOT NULL THEN o.synonym_status ELSE 'PENDING' END AS synonym_status FROM o FULL JOIN w ON o.node_id = w.node_id",
    "doc_chunk_sync": f"""{_N}, w AS (SELECT node_id, locale, 'public' AS kind, doc_public AS content FROM d WHERE trim(doc_public) <> '' UNION ALL SELECT node_id, locale, 'tech', doc_tech FROM d WHERE trim(doc_tech) <> ''),
        o AS (SELECT node_id, lang_detected AS locale, kind, content FROM (SELECT *, row_number() OVER (PARTITION BY node_id, lang_detected, kind ORDER BY updated_at DESC NULLS LAST, id DESC) AS r FROM c WHERE source = 'doc') WHERE r = 1)
        SELECT w.node_id, w.locale, w.kind, md5(w.content) AS content_hash, o.content IS NULL OR o.content <> w.content AS stale FROM w LEFT JOIN o ON w.node_id = o.node_id AND w.locale = o.locale AND w.kind = o.kind""",
    "node_change_detect": f"""{_N} SELECT application_id, fqn, CASE WHEN coalesce(length(source_code) > 400, false) OR (kind = 'CLASS' AND name <> lower(name)) THEN 'update' ELSE 'skip' END AS action, md5(source_code) AS source_hash, line_start FROM n WHERE lang = 'kotlin'""",
    "change_totals": f"{_N}, k AS (SELECT *, id % 11 = 0 AS fresh, coalesce(length(source_code) > 400, false) AS long FROM n WHERE lang = 'kotlin') SELECT count(*) FILTER (fresh) AS created, count(*) FILTER (NOT fresh AND long) AS updated, count(*) FILTER (NOT fresh AND NOT long) AS skipped FROM k",
    "chunk_updates": f"{_N} SELECT id, CASE WHEN id % 3 = 0 THEN sha256(content) ELSE content_hash END AS content_hash, CAST(CASE WHEN id % 3 = 0 THEN coalesce(CASE WHEN id % 2 = 0 THEN length(content) END, token_count) ELSE token_count END AS INTEGER) AS token_count, true AS cleared FROM c",
    "application_delete": f"""{_N}, g AS (SELECT id FROM n WHERE application_id = 1) SELECT 'nodes' AS name, id AS a, CAST(application_id AS VARCHAR) AS b FROM n WHERE coalesce(application_id <> 1, true) UNION ALL SELECT 'edges', src_id, CAST(dst_id AS VARCHAR) FROM contains WHERE src_id NOT IN (SELECT id FROM g) AND dst_id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'docs', node_id, locale FROM (SELECT DISTINCT node_id, locale FROM d) WHERE node_id IS NULL OR node_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chunks', id, CAST(node_id AS VARCHAR) FROM c WHERE node_id IS NULL OR node_id NOT IN (SELECT id FROM g)""",
    "merge_policies": f"{_N} SELECT id, coalesce(content_hash, sha256(content)) AS keep, coalesce(sha256(content), content_hash) AS over, CAST(length(CASE WHEN lang_detected IS NULL OR length(source) > length(lang_detected) THEN source ELSE lang_detected END) AS INTEGER) AS longer_chars, 'A' AS grade FROM c",
    "planned_content": f"{_N} SELECT id, md5(CASE WHEN trim(coalesce(source_code, doc_comment, '')) = '' THEN '(empty)' ELSE trim(coalesce(source_code, doc_comment, '')) END) AS hash FROM n",
    "meta_merge": f"{_N} SELECT id, array_to_string(list_sort(list_filter(['kind=' || kind, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'name=' || coalesce(name, '-') ELSE 'name=' || lower(coalesce(name, '-')) END, CASE WHEN coalesce(package, '') <> '' THEN 'package=' || package END], lambda x: x IS NOT NULL)), ';') AS meta FROM n WHERE kind IS NOT NULL",
    "run_totals": f"{_N} SELECT count(*) AS nodes, count(DISTINCT CASE WHEN coalesce(trim(signature) <> '' OR trim(doc_comment) <> '', false) THEN 1 ELSE 0 END) AS kinds, round(count(*) / 10.0::double, 3) AS nodes_per_second FROM n",
    "generated_docs": f"""{_N}, p AS (SELECT id, source_code, id % 2 = 0 OR contains(source_code, chr(10) || 'SKIP') AS skip, length(concat_ws(chr(10), coalesce(fqn, name), signature, source_code)) || ' characters' AS t FROM n)
        SELECT id AS node_id, 'en' AS locale, CASE WHEN NOT coalesce(skip, false) THEN t END AS doc_tech, CASE WHEN coalesce(skip, false) THEN 'no-content' ELSE t END AS doc_digest, CASE WHEN trim(source_code) <> '' THEN sha256(source_code) END AS source_hash FROM p""",
    "reranked": f"{_N} SELECT id, CAST(coalesce(length(content), 0) AS DOUBLE) AS similarity FROM c ORDER BY similarity DESC, id LIMIT 5",
    "delete_orphans": f"{_N} SELECT DISTINCT id, source_node_id FROM synonym_dictionary WHERE source_node_id IS NULL OR source_node_id NOT IN (SELECT node_id FROM d WHERE node_id IS NOT NULL)",
}
