"""Retrieval: cosine neighbours, full text, rank fusion, filters, expansion by synonyms and assembly of a context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text as T
from loomgraph.functions.vector import cosine
from loomgraph.operators.relational import first_rows, first_wins

DEFAULT_THRESHOLD = 0.3
RRF_K = 60


def knn(chunks: DataFrame, query: list[float], k: int, application: int | None = None, threshold: float = 0.0) -> DataFrame:
    """(id, similarity) of the ``k`` nearest chunks at or above the threshold (0.3 where none is given), ties by id."""
    least = threshold if threshold > 0 else DEFAULT_THRESHOLD
    rows = chunks if application is None else chunks.where(F.col("application_id") == application)
    vector = F.array(*[F.lit(float(x)) for x in query])
    found = rows.select("id", cosine(F.col("embedding"), vector).alias("similarity")).where(F.col("similarity") >= least)
    return found.orderBy(F.col("similarity").desc(), "id").limit(k)


def tokens(content: Column) -> Column:
    """Lower-case words of letters and digits, unstemmed."""
    return F.regexp_extract_all(F.lower(content), F.lit(r"([\p{L}\p{N}]+)"), 1)


def full_text(chunks: DataFrame, query: str, k: int, application: int | None = None) -> DataFrame:
    """(id, score) of chunks that hold all words of the query; the score is the share of its words among theirs."""
    import re

    terms = sorted({t.lower() for t in re.findall(r"[^\W_]+", query)})
    rows = chunks if application is None else chunks.where(F.col("application_id") == application)
    rows = rows.select("id", tokens(F.col("content")).alias("t"))
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    every = reduce(lambda a, b: a & b, [F.array_contains("t", t) for t in terms])
    hits = F.size(F.filter("t", lambda t: t.isin(*terms)))
    found = rows.where(every).select("id", (hits / F.size("t")).alias("score"))
    return found.orderBy(F.col("score").desc(), "id").limit(k)


def cover_density(words: Column, terms: list[str]) -> Column:
    """Sum of 1 / length over the minimal stretches of words that hold all terms."""
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.filter(indexed, lambda x: x["w"].isin(*terms))
    last = lambda upto, term: F.array_max(F.transform(F.filter(hits, lambda x: (x["w"] == term) & (x["i"] <= upto)), lambda x: x["i"]))
    ends = F.transform(hits, lambda h: F.struct(h["i"].alias("end"), F.array_min(F.array(*[last(h["i"], F.lit(t)) for t in terms])).alias("start"), F.size(F.array_compact(F.array(*[last(h["i"], F.lit(t)) for t in terms]))).alias("n")))
    full = F.filter(ends, lambda e: e["n"] == len(terms))
    # of stretches with the same start the first is minimal
    minimal = F.filter(full, lambda e: ~F.exists(full, lambda o: (o["start"] == e["start"]) & (o["end"] < e["end"])))
    return F.aggregate(minimal, F.lit(0.0), lambda s, e: s + F.lit(1.0) / (e["end"] - e["start"] + 1))


def fuse(lists: list[tuple[DataFrame, str, float]], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score): weighted reciprocal ranks of (list, column of its order, weight); ties by id."""
    out = None
    for rows, order, weight in lists:
        # the lists are bounded by their own limits before they are ranked
        ranked = rows.select("id", F.row_number().over(Window.orderBy(F.col(order).desc(), "id")).alias("r")).select("id", (F.lit(weight) / (F.lit(rrf_k) + F.col("r"))).alias("part"))
        out = ranked if out is None else out.unionByName(ranked)
    return out.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def hybrid(chunks: DataFrame, query: str, vector: list[float], k: int = 10, application: int | None = None, vector_weight: float = 0.6, text_weight: float = 0.4, threshold: float = 0.0) -> DataFrame:
    """(id, score): vector and full-text lists, each 2k deep, fused."""
    near = knn(chunks, vector, 2 * k, application, threshold)
    words = full_text(chunks, query, 2 * k, application)
    return fuse([(near, "similarity", vector_weight), (words, "score", text_weight)], k)


def search_many(chunks: DataFrame, queries: list[tuple[str, list[float]]], hyde: list[float] | None = None, k: int = 5, mode: str = "HYBRID") -> DataFrame:
    """(id, score): several forms of a question searched one by one, the first list with an id wins."""
    weights = {"HYBRID": (0.6, 0.4), "FTS": (0.0, 1.0), "VECTOR": (1.0, 0.0)}[mode]
    lists = [hybrid(chunks, q, v, k, None, *weights) for q, v in queries]
    if hyde is not None:
        lists.append(knn(chunks, hyde, 3).withColumnRenamed("similarity", "score"))
    return first_wins(*lists).select("id", "score", "source_rank")


def answer_set(results: DataFrame, n: int = 5) -> DataFrame:
    """Distinct ids, the most similar first."""
    return results.groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(n)


def two_stage_filter(results: DataFrame, keywords: list[str]) -> DataFrame:
    """Results that name a keyword exactly; only if none does, those that name one loosely."""
    content = F.col("content")
    exact = T.any_of([T.has_keyword(content, k) for k in keywords] or [F.lit(True)])
    loose = T.any_of([T.has_keyword_fuzzy(content, k) for k in keywords] or [F.lit(True)])
    flagged = results.withColumn("exact", exact).withColumn("loose", loose)
    any_exact = flagged.agg(F.max(F.col("exact").cast("int")).alias("any_exact"))
    joined = flagged.join(F.broadcast(any_exact))  # one row
    return joined.where(F.when(F.col("any_exact") == 1, F.col("exact")).otherwise(F.col("loose"))).drop("exact", "loose", "any_exact")


def synonym_matches(synonyms: DataFrame, query: list[float], k: int = 3, description_least: float = 0.7) -> DataFrame:
    """(id, term, description, similarity): of the ``k`` nearest terms those whose description is near as well."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    near = synonyms.select("id", "term", "description", cosine(F.col("term_embedding"), vector).alias("term_similarity"), cosine(F.col("desc_embedding"), vector).alias("similarity"))
    top = near.where("term_similarity is not null").orderBy(F.col("term_similarity").desc(), "id").limit(k)
    return top.where(F.col("similarity") >= description_least).orderBy(F.col("similarity").desc(), "id").select("id", "term", "description", "similarity")


def expand_query(query: str, matches: DataFrame) -> DataFrame:
    """(query): the question with the matched terms behind it; unchanged without matches."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "id", F.concat("term", F.lit(": "), "description").alias("x"))))
    joined = F.array_join(F.transform(pairs, lambda p: p["x"]), "; ")
    return matches.agg(joined.alias("s")).select(F.when(F.col("s") == "", F.lit(query)).otherwise(F.concat(F.lit(query + " (Контекст: ["), "s", F.lit("])"))).alias("query"))


# fixed values: parts of names that are no terms of the business; the least purpose that is worth asking a model about
TECHNICAL_NAMES = ("DataSource", "Config", "Adapter", "Bean", "Test", "Properties")
LEAST_PURPOSE = 60


def mine_synonyms(candidates: DataFrame, known: DataFrame, stop_terms: tuple[str, ...] = ()) -> DataFrame:
    """New (term, description, node_name) pairs of candidates (term, description, node_name, purpose).

    Nodes of technical names and purposes of less than ``LEAST_PURPOSE`` characters are passed over.  A term has five
    characters or more, no ideographs, is not the node's name, and is distinct and unknown by lower case.
    """
    t = F.trim("term")
    technical = T.any_of([F.contains(F.lower(F.coalesce("node_name", F.lit(""))), F.lit(w.lower())) for w in TECHNICAL_NAMES])
    good = ~technical & (F.length("purpose") >= LEAST_PURPOSE) & (F.length(t) >= 5) & (F.length(F.trim("description")) >= 5) & ~t.rlike(r"\p{IsHan}") & (F.lower(t) != F.lower("node_name"))
    if stop_terms:
        good = good & ~F.lower(t).isin(*stop_terms)
    fresh = first_rows(candidates.where(good).withColumn("low", F.lower(t)), ["low"], ["term", "description"]).drop("rank")
    return fresh.join(known.select(F.lower(F.trim("term")).alias("low")).distinct(), "low", "left_anti").drop("low")


def exact_nodes(nodes: DataFrame, class_name: str | None, method_name: str | None, guesses: list[str] = ()) -> DataFrame:
    """(id, fqn, how): class and method, else class, else method, else the first guessed name that any fqn holds (three of it)."""
    from loomgraph.operators.relational import classes_named, methods_named, methods_of_class
    from loomgraph.schema import TYPE_KINDS

    ways = []
    if class_name and method_name:
        ways.append(methods_of_class(nodes, class_name, method_name, True))
    if class_name:
        ways.append(classes_named(nodes, class_name, TYPE_KINDS, True))
    if method_name:
        ways.append(methods_named(nodes, method_name, True))
    ways += [nodes.where(F.contains(F.lower("fqn"), F.lit(g.lower()))).orderBy("fqn", "id").limit(3) for g in guesses]
    out = None
    for k, way in enumerate(ways):
        part = way.select("id", "fqn", F.lit(k).alias("how"))
        out = part if out is None else out.unionByName(part)
    best = out.agg(F.min("how").alias("best"))
    return out.join(F.broadcast(best)).where("how = best").select("id", "fqn", "how")


def find_nodes(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(id, fqn): names that hold the text, then types, then methods of that name, up to the limit."""
    from loomgraph.operators.relational import classes_named, methods_named
    from loomgraph.schema import TYPE_KINDS

    ways = [nodes.where(F.contains("fqn", F.lit(text))), classes_named(nodes, text, TYPE_KINDS), methods_named(nodes, text)]
    return first_wins(*[w.select("id", "fqn") for w in ways]).orderBy("source_rank", "fqn", "id").limit(limit).select("id", "fqn")


def rerank(results: DataFrame, score: Callable[[list[str]], list[float]] | None) -> DataFrame:
    """Results with the scorer's similarity; unchanged without a scorer or where it fails."""
    if score is None:
        return results

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                batch = batch.assign(similarity=[float(s) for s in score(batch["content"].fillna("").tolist())])
            except Exception:  # noqa: BLE001 - the input stands where the model fails
                pass
            yield batch

    return results.mapInPandas(run, results.schema)


# fixed values: the largest sections of a context, in characters
CONTEXT_CAPS = {"code": 1500, "relations": 5000, "total": 12_000}


def assemble_context(sections: DataFrame, total: int = CONTEXT_CAPS["total"]) -> DataFrame:
    """(query_id, context): ordered sections (query_id, position, title, body, cap), each cut to its cap, the whole to ``total``."""
    body = F.concat(F.lit("## "), "title", F.lit("\n"), F.substring("body", F.lit(1), F.col("cap")))
    rows = sections.where(F.trim("body") != "").select("query_id", F.struct("position", body.alias("text")).alias("s"))
    joined = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "\n\n").alias("context"))
    return joined.select("query_id", F.substring("context", 1, total).alias("context"))
