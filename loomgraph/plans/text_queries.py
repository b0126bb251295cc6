"""Queries of the scalar functions, over whole columns of texts, names and addresses."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.runtime import table

_WORDS = ("Handler", "retry window", "за один проход")
_S = r"[ \t\n\x0B\f\r]"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").dropDuplicates(["id"])


def query_normalize(spark, d):
    return _chunks(spark, d).select("id", T.normalize_query(F.col("content")).alias("normalized"))


def url_canonical(spark, d):
    apps = table(spark, d, "application").select("id", F.col("repo_url").alias("url"))
    return apps.select("id", T.normalize_path(F.col("url")).alias("path"), F.parse_url("url", F.lit("HOST")).alias("host"))


def fqn_parts(spark, d):
    nodes = table(spark, d, "node").select("id", "fqn", "package", "name").distinct()
    return nodes.select("id", T.base_fqn(F.col("fqn")).alias("base_fqn"), T.simple_name(F.col("fqn")).alias("simple_name"), T.type_fqn(F.col("package"), F.col("name")).alias("type_fqn"))


def fqn_normalize(spark, d):
    nodes = table(spark, d, "node").select("id", "fqn", "name", "kind").distinct()
    old = F.when(F.col("kind") == "TOPIC", F.concat(F.lit("topic://"), "fqn")).when(F.col("kind") == "ENDPOINT", F.concat(F.lit("endpoint://GET /"), "fqn")).otherwise(F.col("fqn"))
    nodes = nodes.withColumn("old", old)
    return nodes.select("id", T.normalize_fqn(F.col("old")).alias("norm"), T.integration_type(F.col("old")).alias("integration"), T.integration_label(F.col("old"), F.col("name")).alias("label"))


def signature_types(spark, d):
    nodes = table(spark, d, "node").where("signature is not null").select("id", "signature").distinct()
    return nodes.select("id", F.array_join(T.type_tokens(F.col("signature")), ",").alias("types"))


def camel_split(spark, d):
    nodes = table(spark, d, "node").select("id", "name").distinct()
    return nodes.select("id", F.array_join(T.camel_parts(F.col("name")), " ").alias("parts"), F.size(T.camel_parts(F.col("name"))).alias("n"))


def keyword_match(spark, d):
    c = F.col("content")
    return _chunks(spark, d).select("id", T.has_keyword(c, "queue").alias("exact"), T.has_keyword_fuzzy(c, "retryWindow").alias("fuzzy"))


def tf_relevance(spark, d):
    return _chunks(spark, d).where("content is not null").select("id", F.round(T.relevance(F.col("content"), ["queue", "retry"]), 6).alias("relevance"))


def content_hash_tokens(spark, d):
    c = F.col("content")
    return _chunks(spark, d).where("content is not null").select("id", T.content_hash(c).alias("sha256"), T.token_count(c).alias("tokens"))


def md_grade(spark, d):
    docs = table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"]).where("doc_tech is not null")
    t = F.col("doc_tech")
    return docs.select("node_id", "locale", T.uses_markdown(t).alias("markdown"), T.grade(T.token_count(t), F.length(t)).alias("grade"), F.length(T.preview(t)).alias("preview_chars"))


def lang_ratio(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    t = F.col("text")
    return docs.select("doc_id", F.round(T.cyrillic_ratio(t), 6).alias("cyrillic"), T.is_russian_enough(t).alias("russian"))


def code_normalize(spark, d):
    nodes = table(spark, d, "node").where("source_code is not null").select("id", "source_code").distinct()
    code = T.normalize_code(F.col("source_code"))
    return nodes.select("id", F.length(code).alias("chars"), T.line_count(code).alias("lines"), F.md5(code).alias("hash"))


def node_validation(spark, d):
    """Quality checks of a node: name, lines, source span and parent in the same application."""
    nodes = table(spark, d, "node").select("id", "application_id", "fqn", "line_start", "line_end", "parent_id").distinct()
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("application_id").alias("parent_app"))
    r = nodes.join(parents, "parent_id", "left")
    return r.select(
        "id",
        F.coalesce((F.trim("fqn") != "") & (F.length("fqn") <= 1000), F.lit(False)).alias("good_fqn"),
        F.coalesce((F.col("line_start") >= 0) & (F.col("line_end") >= F.col("line_start")), F.col("line_start").isNull() & F.col("line_end").isNull()).alias("good_lines"),
        (F.col("parent_id").isNull() | ((F.col("parent_id") != F.col("id")) & F.coalesce(F.col("parent_app") == F.col("application_id"), F.lit(False)))).alias("good_parent"),
    )


def env_placeholders(spark, d):
    """Every placeholder of configuration sources with its default."""
    nodes = table(spark, d, "node").where("kind = 'CONFIG'").select("id", "source_code").distinct()
    each = nodes.select("id", F.explode(F.array_distinct(F.regexp_extract_all("source_code", F.lit(r"(\$\{[^}:]+(?::[^}]*)?\})"), 1))).alias("placeholder"))
    p = F.col("placeholder")
    return each.select("id", "placeholder", T.env_var(p).alias("env_var"), T.env_default(p).alias("default_value"))


def doc_coverage(spark, d):
    nodes = table(spark, d, "node").select(F.col("id").alias("node_id"), "source_code").distinct()
    docs = table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"]).select("node_id", "locale", "doc_tech")
    return docs.join(nodes, "node_id").select("node_id", "locale", F.round(T.coverage(F.col("source_code"), F.col("doc_tech")), 6).alias("coverage"))


def doc_readability(spark, d):
    docs = table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"]).where("doc_public is not null")
    return docs.select("node_id", "locale", F.round(T.readability(F.col("doc_public")), 4).alias("readability"))


def call_extraction(spark, d):
    nodes = table(spark, d, "node").where("kind in ('METHOD', 'ENDPOINT', 'JOB', 'TEST') and source_code is not null").select("id", "source_code").distinct()
    return nodes.select("id", F.array_join(T.simple_calls(F.col("source_code")), ",").alias("calls"), F.array_join(T.dotted_calls(F.col("source_code")), ",").alias("dotted"), F.array_join(T.thrown_types(F.col("source_code")), ",").alias("throws"))


def kdoc_parse(spark, d):
    nodes = table(spark, d, "node").where("doc_comment is not null").select("id", "doc_comment").distinct()
    c = F.col("doc_comment")
    return nodes.select(
        "id", T.doc_summary(c).alias("summary"), F.size(T.doc_params(c)).alias("n_params"), T.doc_tag(c, "return").alias("returns"), T.doc_tag(c, "since").alias("since"), T.doc_tag(c, "see").alias("see")
    )


HEADING = "r"


def markdown_section(spark, d):
    """The first section whose heading begins with ``HEADING``, headings of any level taken as second-level ones, of technical documents and of all documents."""
    docs = table(spark, d, "node_doc").dropDuplicates(["node_id", "locale"]).select(F.concat_ws("/", "node_id", "locale").alias("id"), F.col("doc_tech").alias("md"))
    rows = docs.unionByName(table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("md")))
    return rows.where("md is not null").select("id", F.md5(T.section(F.regexp_replace(F.regexp_replace("md", "\r\n", "\n"), "(^|\n)#+ ", "$1## "), HEADING)).alias("body"))


def judge_scores(spark, d):
    """Every chunk read as a judge's answer."""
    c = F.col("content")
    return _chunks(spark, d).where("content is not null").select("id", T.first_score(c).alias("score"), F.md5(T.unfence(F.concat(F.lit("```json"), F.regexp_replace(c, "`", "'"), F.lit("```")))).alias("bare"))


def annotation_arguments(spark, d):
    """Mapping annotations in function sources with verb and path."""
    nodes = table(spark, d, "node").where("kind = 'ENDPOINT' and source_code is not null").select("id", "source_code").distinct()
    each = nodes.select("id", F.explode(F.regexp_extract_all("source_code", F.lit(r'(@[A-Za-z]+Mapping\("[^"]*"\))'), 1)).alias("annotation")).distinct()
    a = F.col("annotation")
    return each.select("id", T.http_verb(a).alias("verb"), T.annotation_argument(a).alias("path"), T.normalize_path(T.annotation_argument(a)).alias("canonical"))


def infra_names(spark, d):
    apps = table(spark, d, "application").select("id", F.concat_ws(".", F.lit("spring"), F.regexp_replace("key", "-", "."), F.lit("client")).alias("grp"))
    return apps.select("id", T.readable_infra_name(F.col("grp"), F.lit("HTTP")).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        query_normalize, url_canonical, fqn_parts, fqn_normalize, signature_types, camel_split, keyword_match, tf_relevance, content_hash_tokens, md_grade, lang_ratio, code_normalize, node_validation,
        env_placeholders, doc_coverage, doc_readability, call_extraction, kdoc_parse, markdown_section, judge_scores, annotation_arguments, infra_names,
    )
}

_C = "(SELECT DISTINCT id, content FROM chunk)"
_NORM = f"CASE WHEN old LIKE 'endpoint://%' THEN 'infra:http:' || regexp_replace(regexp_replace(old, '^endpoint://', ''), '^([A-Z]+) +', '\\1:') WHEN old LIKE 'topic://%' THEN 'infra:kafka:topic:' || regexp_replace(old, '^topic://', '') ELSE old END"
_PATH = "CASE WHEN {u} IS NULL OR contains({u}, '${{') OR trim({u}) = '' THEN NULL ELSE (CASE WHEN c = '' THEN '/' WHEN c LIKE '/%' THEN c ELSE '/' || c END) END"
_BARE = r"regexp_replace(lower(regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', '')), '/+$', '')"

SQL = {
    "query_normalize": rf"SELECT id, regexp_replace(regexp_replace(regexp_replace(content, '{_S}+', ' ', 'g'), '^ | $', '', 'g'), '[?!.,;:]+$', '') AS normalized FROM {_C}",
    "url_canonical": f"SELECT id, {_PATH.format(u='repo_url')} AS path, nullif(regexp_extract(repo_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:]+)', 1), '') AS host FROM (SELECT id, repo_url, {_BARE.format(u='repo_url')} AS c FROM application)",
    "fqn_parts": r"SELECT DISTINCT id, split_part(fqn, '(', 1) AS base_fqn, regexp_replace(regexp_extract(split_part(fqn, '<', 1), '[^.]*$'), '\?$', '') AS simple_name, CASE WHEN package IS NULL OR trim(package) = '' THEN name ELSE concat_ws('.', package, name) END AS type_fqn FROM node",
    "fqn_normalize": f"""SELECT id, norm, CASE WHEN norm LIKE 'infra:http:%' THEN 'HTTP' WHEN norm LIKE 'infra:kafka:%' THEN 'KAFKA' WHEN norm LIKE 'infra:camel:%' THEN 'CAMEL' END AS integration,
        CASE WHEN norm LIKE 'infra:http:%' THEN regexp_replace(regexp_replace(norm, '^infra:http:', ''), '^([A-Z]+):', '\\1 ') WHEN norm LIKE 'infra:%' THEN regexp_replace(norm, '^infra:(kafka:topic|camel:uri):', '') ELSE coalesce(name, old) END AS label
        FROM (SELECT id, old, name, {_NORM} AS norm FROM (SELECT DISTINCT id, name, CASE WHEN kind = 'TOPIC' THEN 'topic://' || fqn WHEN kind = 'ENDPOINT' THEN 'endpoint://GET /' || fqn ELSE fqn END AS old FROM node))""",
    "signature_types": r"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(s, '([A-Za-z_][A-Za-z0-9_.]*)', 1), lambda t: t NOT IN ('fun', 'val', 'var', 'override', 'public', 'private', 'protected', 'internal', 'class', 'interface', 'object', 'where') AND (contains(t, '.') OR regexp_matches(t, '^[A-Z]'))))), ',') AS types
        FROM (SELECT id, regexp_extract(substr(signature, strpos(signature, '(') + 1), '^((?s).*)\)', 1) || ':' || regexp_extract(signature, '[^)]*$') AS s FROM (SELECT DISTINCT id, signature FROM node WHERE signature IS NOT NULL))""",
    "camel_split": "SELECT id, array_to_string(p, ' ') AS parts, CAST(len(p) AS INTEGER) AS n FROM (SELECT id, list_filter(regexp_split_to_array(regexp_replace(name, '([A-Z])', '_\\1', 'g'), '[_-]'), lambda x: x <> '') AS p FROM (SELECT DISTINCT id, name FROM node))",
    "keyword_match": rf"SELECT id, coalesce(regexp_matches(content, '(?i)(^|[^\p{{L}}\p{{N}}_])queue($|[^\p{{L}}\p{{N}}_])'), false) AS exact, coalesce(contains(lower(content), 'retrywindow') OR (contains(lower(content), 'retry') AND contains(lower(content), 'window')), false) AS fuzzy FROM {_C}",
    "tf_relevance": rf"""SELECT id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_filter(w, lambda x: contains(x, 'queue') OR contains('queue', x))) * 10.0::double / len(w) + len(list_filter(w, lambda x: contains(x, 'retry') OR contains('retry', x))) * 10.0::double / len(w), 6) END AS relevance
        FROM (SELECT id, list_filter(regexp_split_to_array(lower(content), '{_S}+'), lambda x: x <> '') AS w FROM {_C} WHERE content IS NOT NULL)""",
    "content_hash_tokens": rf"SELECT id, CASE WHEN trim(content) <> '' THEN sha256(content) END AS sha256, CAST(len(regexp_extract_all(content, '[^ \t\n\x0B\f\r]+')) AS INTEGER) AS tokens FROM {_C} WHERE content IS NOT NULL",
    "md_grade": r"""SELECT node_id, locale, regexp_matches(t, '(?m)^\s{0,3}#{1,6}\s') OR regexp_matches(t, '\[[^\]]+\]\([^)]+\)') OR regexp_matches(t, '`{1,3}[^`]+`{1,3}') OR regexp_matches(t, '(?m)^\s{0,3}[-*+]\s+') OR regexp_matches(t, '\*\*[^*]+\*\*|__[^_]+__') AS markdown,
        CASE WHEN n >= 300 OR length(t) >= 2000 THEN 'A' WHEN n >= 120 OR length(t) >= 800 THEN 'B' ELSE 'C' END AS grade, CAST(least(length(t), 240) + CASE WHEN length(t) > 240 THEN 1 ELSE 0 END AS INTEGER) AS preview_chars
        FROM (SELECT DISTINCT node_id, locale, doc_tech AS t, len(regexp_extract_all(doc_tech, '[^ \t\n\x0B\f\r]+')) AS n FROM node_doc WHERE doc_tech IS NOT NULL)""",
    "lang_ratio": r"SELECT doc_id, CASE WHEN l > 0 THEN round(c::double / l, 6) ELSE 0.0 END AS cyrillic, CASE WHEN l > 0 THEN c::double / l ELSE 0.0 END >= 0.6 AS russian FROM (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '\p{Cyrillic}')) AS c FROM documents WHERE text IS NOT NULL)",
    "code_normalize": r"SELECT id, CAST(length(c) AS INTEGER) AS chars, CAST(CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, chr(10), '')) + 1 END AS INTEGER) AS lines, md5(c) AS hash FROM (SELECT DISTINCT id, replace(source_code, chr(13) || chr(10), chr(10)) AS c FROM node WHERE source_code IS NOT NULL)",
    "node_validation": """WITH n AS (SELECT DISTINCT id, application_id, fqn, line_start, line_end, parent_id FROM node)
        SELECT n.id, coalesce(trim(n.fqn) <> '' AND length(n.fqn) <= 1000, false) AS good_fqn, coalesce(n.line_start >= 0 AND n.line_end >= n.line_start, n.line_start IS NULL AND n.line_end IS NULL) AS good_lines,
        n.parent_id IS NULL OR (n.parent_id <> n.id AND coalesce(p.application_id = n.application_id, false)) AS good_parent FROM n LEFT JOIN n p ON n.parent_id = p.id""",
    "env_placeholders": r"""SELECT DISTINCT id, p AS placeholder, nullif(trim(regexp_extract(p, '\$\{([^}:]+)(:([^}]*))?\}', 1)), '') AS env_var, CASE WHEN trim(regexp_extract(p, '\$\{([^}:]+)(:([^}]*))?\}', 3)) <> '' THEN regexp_extract(p, '\$\{([^}:]+)(:([^}]*))?\}', 3) END AS default_value
        FROM (SELECT id, unnest(regexp_extract_all(source_code, '\$\{[^}:]+(?::[^}]*)?\}')) AS p FROM node WHERE kind = 'CONFIG')""",
    "doc_coverage": f"""WITH k AS (SELECT d.node_id, d.locale, n.source_code AS code, d.doc_tech AS doc, list_distinct(list_filter(regexp_extract_all(n.source_code, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND length(w) > 3 AND w NOT IN ('return', 'class', 'override', 'private', 'public', 'import', 'package', 'else', 'when', 'while', 'catch', 'finally'))) AS keys
        FROM (SELECT DISTINCT node_id, locale, doc_tech FROM node_doc) d JOIN (SELECT DISTINCT id, source_code FROM node) n ON d.node_id = n.id)
        SELECT node_id, locale, CASE WHEN coalesce(trim(code), '') = '' OR coalesce(trim(doc), '') = '' THEN 0.0::double WHEN len(keys) = 0 THEN 10.0::double ELSE round(len(list_filter(keys, lambda w: contains(lower(doc), lower(w)))) * 10.0::double / len(keys), 6) END AS coverage FROM k""",
    "call_extraction": r"""WITH z AS (SELECT ['listOf', 'map', 'of', 'timer', 'start', 'stop', 'sequenceOf', 'arrayOf', 'mutableListOf'] AS noise) SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(source_code, '\b(\w+)\s*\(', 1), lambda c: NOT list_contains(noise, c)))), ',') AS calls,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(source_code, '([\w.]+\b\.\w+)\s*\(', 1), lambda c: NOT list_contains(noise, string_split(c, '.')[-1]) AND NOT list_contains(noise, string_split(c, '.')[-2])))), ',') AS dotted,
        array_to_string(list_sort(list_distinct(regexp_extract_all(source_code, 'throw[ \t]+(?:new[ \t]+)?([A-Z][A-Za-z0-9_.]*)', 1))), ',') AS throws
        FROM (SELECT DISTINCT id, source_code FROM node WHERE kind IN ('METHOD', 'ENDPOINT', 'JOB', 'TEST') AND source_code IS NOT NULL), z""",
    "judge_scores": rf"SELECT id, CASE WHEN regexp_matches(content, '\d') THEN least(CAST(regexp_extract(content, '\d+(\.\d+)?') AS DOUBLE), 10.0) END AS score, md5(trim(replace(content, chr(96), chr(39)), ' ')) AS bare FROM {_C} WHERE content IS NOT NULL",
    "markdown_section": rf"""WITH r AS (SELECT DISTINCT node_id || '/' || locale AS id, doc_tech AS md FROM node_doc UNION ALL SELECT 'd' || doc_id, text FROM documents), l AS (SELECT id, string_split(regexp_replace(replace(md, chr(13) || chr(10), chr(10)), '(^|\n)#+ ', '\1## ', 'g'), chr(10)) AS l FROM r WHERE md IS NOT NULL),
        h AS (SELECT id, l, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^##[ \t]*{HEADING}')), true), 0) AS p FROM l), e AS (SELECT *, CASE WHEN p > 0 THEN l[p + 1:] ELSE [] END AS t FROM h), f AS (SELECT *, coalesce(list_position(list_transform(t, lambda x: regexp_matches(x, '^##[^#]')), true), 0) AS q FROM e)
        SELECT id, md5(nullif(trim(array_to_string(CASE WHEN q > 0 THEN t[1:q - 1] ELSE t END, chr(10)), ' '), '')) AS body FROM f""",
    "annotation_arguments": rf"""SELECT id, verb, path, {_PATH.format(u='path')} AS canonical FROM (SELECT id, verb, path, {_BARE.format(u='path')} AS c FROM (
        SELECT DISTINCT id, a, CASE WHEN regexp_extract(a, '@?(Get|Post|Put|Delete|Patch|Request)Mapping', 1) = 'Request' THEN 'GET' ELSE upper(regexp_extract(a, '@?(Get|Post|Put|Delete|Patch|Request)Mapping', 1)) END AS verb, nullif(regexp_extract(a, '"([^"]*)"', 1), '') AS path
        FROM (SELECT id, unnest(regexp_extract_all(source_code, '@[A-Za-z]+Mapping\("[^"]*"\)')) AS a FROM node WHERE kind = 'ENDPOINT' AND source_code IS NOT NULL)))""",
    "infra_names": "SELECT id, array_to_string(list_filter(string_split(key, '-'), lambda p: lower(p) NOT IN ('client', 'settings', 'config', 'configuration', 'properties')), '-') || ' (HTTP)' AS name FROM application",
    "doc_readability": r"""SELECT node_id, locale, CASE WHEN w > 0 THEN round(least(greatest(206.835 - 1.015 * w::double / greatest(s, 1) - 84.6 * v::double / w, 0), 100) / 10, 4) ELSE 5.0 END::double AS readability FROM (SELECT DISTINCT node_id, locale, len(regexp_extract_all(doc_public, '\p{L}+')) AS w, len(regexp_extract_all(doc_public, '[.!?]+')) AS s, len(regexp_extract_all(lower(doc_public), '[aeiouyаеёиоуыэюяäöüáéíóúàèùâêîôû]+')) AS v FROM node_doc WHERE doc_public IS NOT NULL)""",
}
