"""Queries over the tables of the project, each over whole tables with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, conversations, credentials, docpairs, leakage, neighbours, prose, spans, windows
from loomgraph.runtime import table


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "node"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("node_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.locate(table(spark, d, "node")).select("node_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.locate(table(spark, d, "node"), with_text=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.node_languages(table(spark, d, "node"), model=prose.fit(table(spark, d, "documents")))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return prose.node_shares(table(spark, d, "node"), model=prose.fit(table(spark, d, "documents")))


def long_texts(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, node_id, locale, text) of the three text columns."""
    code = table(spark, d, "node").select(F.lit("source_code").alias("field_name"), F.col("id").alias("node_id"), F.lit("").alias("locale"), F.col("source_code").alias("text"))
    docs = table(spark, d, "node_doc")
    for name in ("doc_tech", "doc_public"):
        code = code.unionByName(docs.select(F.lit(name).alias("field_name"), "node_id", F.coalesce("locale", F.lit("")).alias("locale"), F.col(name).alias("text")))
    return code


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return windows.split_long(long_texts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 0").select("field_name", "node_id", "locale", "hard_cut").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped(table(spark, d, "spring_ai_chat_memory"))


def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "spring_ai_chat_memory"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "documents"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    chunk = neighbours.usable(table(spark, d, "chunk"), "id", {"chunk.embedding": "embedding"})
    names = {f"synonym_dictionary.{c}": c for c in ("term_embedding", "desc_embedding")}
    return chunk.unionByName(neighbours.usable(table(spark, d, "synonym_dictionary"), "id", names))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_vectors(spark, d), 0.95)
    return pairs.select(F.col("field").alias("field_name"), "id_a", "id_b")


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return neighbours.nearest(vectors, vectors.where("id % 100 = 0"))


QUERIES = {"p2_found": p2_found, "p2_nearest": p2_nearest, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_shares": p5_shares, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_found": p7_found, "p7_turns": p7_turns, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_shared": p10_shared}
_VEC = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BLANK = r"^[\s\p{Z}\p{C}]*$"

SQL: dict[str, str] = {
    "p2_found": f"""WITH v AS (SELECT DISTINCT 'chunk.embedding' AS f, id, CAST(embedding AS DOUBLE[]) AS v FROM chunk WHERE {_VEC.format('embedding')}
        UNION SELECT 'synonym_dictionary.term_embedding', id, CAST(term_embedding AS DOUBLE[]) FROM synonym_dictionary WHERE {_VEC.format('term_embedding')}
        UNION SELECT 'synonym_dictionary.desc_embedding', id, CAST(desc_embedding AS DOUBLE[]) FROM synonym_dictionary WHERE {_VEC.format('desc_embedding')})
        SELECT DISTINCT a.f AS field_name, a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.f = b.f AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95""",
    "p6_found": f"""WITH t AS (SELECT DISTINCT 'source_code' AS field_name, id AS node_id, '' AS locale, source_code AS text FROM node UNION SELECT DISTINCT 'doc_tech', node_id, coalesce(locale, ''), doc_tech FROM node_doc UNION SELECT DISTINCT 'doc_public', node_id, coalesce(locale, ''), doc_public FROM node_doc)
        SELECT DISTINCT field_name, node_id, locale, CAST(list_max(list_transform(regexp_split_to_array(text, '{_SPACE}'), lambda x: length(x))) > 4000 AS INTEGER) AS hard_cut FROM t WHERE length(text) > 4000""",
    "p7_found": f"""WITH m AS (SELECT DISTINCT conversation_id AS c, timestamp AS ts, CAST(json_extract_string(metadata, '$.seq') AS BIGINT) AS seq, coalesce(CASE upper(trim(type)) WHEN 'HUMAN' THEN 'USER' WHEN 'AI' THEN 'ASSISTANT' ELSE upper(trim(type)) END, '?') AS role, coalesce(content, '') AS content FROM spring_ai_chat_memory WHERE NOT regexp_matches(coalesce(conversation_id, ''), '{_BLANK}')),
        o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM m WINDOW w AS (PARTITION BY c ORDER BY ts NULLS FIRST, seq NULLS FIRST, role, md5(content))),
        t AS (SELECT c, n, role, regexp_matches(content, '{_BLANK}') AS blank FROM o WHERE NOT coalesce(pr = role AND pc = content, false) AND role IN ('USER', 'ASSISTANT')),
        l AS (SELECT *, lag(role) OVER (PARTITION BY c ORDER BY n) AS before FROM t),
        k AS (SELECT c FROM l GROUP BY c HAVING NOT bool_or(blank OR coalesce(before = role, false)) AND arg_min(role, n) = 'USER' AND arg_max(role, n) = 'ASSISTANT')
        SELECT DISTINCT c AS conversation_id FROM m WHERE c NOT IN (SELECT c FROM k)""",
}
