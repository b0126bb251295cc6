"""From nodes to documents and chunks: plans, contexts, prompts, generation and post-processing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.relational import first_rows


# fixed values: kinds that are planned first
PLAN_PRIORITY = {"ENDPOINT": 10, "METHOD": 10, "INFRASTRUCTURE": 10, "CLASS": 5}
HINT_CONFIDENCE = 0.7


def chunk_plan(nodes: DataFrame) -> DataFrame:
    """(node_id, plan_id, source, kind, lang, priority, title, section): one planned chunk per node.

    Nodes with a signature or documentation give a technical document, the rest a snippet of code; the priority goes by
    the kind of node; the section is the parts of the package and the name.  The plan's relations are rows of their own,
    see ``relation_hints``, since a hub has any number of them.
    """
    documented = F.coalesce((F.trim("signature") != "") | (F.trim("doc_comment") != ""), F.lit(False))
    source, kind = F.when(documented, "doc").otherwise("code"), F.when(documented, "tech").otherwise("snippet")
    priority = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in PLAN_PRIORITY.items()], F.lit(0))
    section = F.concat(F.coalesce(F.split("package", r"\."), F.array().cast("array<string>")), F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))
    return nodes.select(
        F.col("id").alias("node_id"), F.concat_ws(":", "id", source, kind).alias("plan_id"), source.alias("source"), kind.alias("kind"),
        F.when(documented, "ru").otherwise(F.col("lang")).alias("lang"), priority.alias("priority"), F.col("fqn").alias("title"), section.alias("section"),
    )


def relation_hints(edges: DataFrame) -> DataFrame:
    """(node_id, kind, dst_id, confidence): the calls that a node's planned chunk hints at."""
    return edges.where("kind = 'CALLS'").select(F.col("src_id").alias("node_id"), "kind", "dst_id", F.lit(HINT_CONFIDENCE).alias("confidence"))


# fixed values: order in which dependencies are shown
DEPENDENCY_PRIORITY = {
    k: i
    for i, k in enumerate(
        ("CALLS_CODE", "THROWS", "READS", "WRITES", "QUERIES", "CALLS_HTTP", "CALLS_GRPC", "PRODUCES", "CONSUMES", "CONFIGURES", "CIRCUIT_BREAKER_TO", "RETRIES_TO", "TIMEOUTS_TO", "DEPENDS_ON")
    )
}
TYPES = ("CLASS", "INTERFACE", "ENUM", "RECORD")
CONTAINERS = ("PACKAGE", "MODULE", "REPO")


def doc_context(nodes: DataFrame, docs: DataFrame, edges: DataFrame, locale: str, deps: int = 20, children: int = 40) -> DataFrame:
    """(node_id, block, shown, missing, n_deps, n_children): the digests a node's document rests on, in a definite order.

    A method shows its first ``deps`` dependencies by kind and id, a type its first ``children`` methods and fields, a
    container its first children of any kind; other nodes show nothing.  What has no digest is marked missing; only edges
    of the fixed kinds count as dependencies.
    """
    from loomgraph.operators.traverse import top_dependencies

    digest = docs.where(F.col("locale") == locale).groupBy("node_id").agg(F.max("doc_digest").alias("digest"))
    names = nodes.select(F.col("id").alias("other"), "fqn").join(digest.withColumnRenamed("node_id", "other"), "other", "left")
    kinds = nodes.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"))
    used = top_dependencies(edges, DEPENDENCY_PRIORITY, deps).select(F.col("src_id").alias("owner"), F.col("dst_id").alias("other"), "rank", F.col("kind").alias("how"))
    used = used.join(kinds.where("owner_kind = 'METHOD'"), "owner").withColumn("line", F.concat(F.lit("- edge="), "how", F.lit(" dst=")))
    kids = nodes.where("parent_id is not null").select(F.col("parent_id").alias("owner"), F.col("id").alias("other"), "kind").join(kinds, "owner")
    kids = kids.where((F.col("owner_kind").isin(*TYPES) & F.col("kind").isin("METHOD", "FIELD")) | F.col("owner_kind").isin(*CONTAINERS))
    kids = first_rows(kids, ["owner"], ["other"], children).withColumn("line", F.lit("- child=")).withColumn("how", F.lit(None).cast("string"))
    cols = ["owner", "other", "rank", "how", "line"]
    rows = used.select(*cols).unionByName(kids.select(*cols)).join(names, "other", "left")
    blank = F.coalesce(F.trim("digest"), F.lit("")) == ""
    text = F.concat("line", F.coalesce("fqn", F.concat(F.lit("node#"), "other")), F.when(blank, " digest=missing").otherwise(F.concat(F.lit("\n  "), F.regexp_replace("digest", "\n", "\n  "))))
    # at most ``deps`` or ``children`` lines per node are gathered
    blocks = rows.groupBy(F.col("owner").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", text.alias("text")))), lambda x: x["text"]), "\n").alias("block"),
        F.count(F.lit(1)).alias("shown"), F.count(F.when(blank, 1)).alias("missing"),
        F.count(F.when(F.col("how").isin(*DEPENDENCY_PRIORITY), 1)).alias("n_deps"), F.count(F.when(F.col("how").isNull(), 1)).alias("n_children"),
    )
    asks = F.col("kind").isin("METHOD", *TYPES, *CONTAINERS)
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return nodes.select(F.col("id").alias("node_id"), "kind").join(blocks, "node_id", "left").select("node_id", F.when(asks, F.coalesce("block", F.lit("- none"))).alias("block"), zero("shown"), zero("missing"), zero("n_deps"), zero("n_children"))


def prompt_name(kind: Column, deps: Column, children: Column, has_code: Column) -> Column:
    """Which prompt a node's profile calls for."""
    two = lambda test, yes, no: F.when(test, yes).otherwise(no)
    return (
        F.when(kind == "METHOD", two(deps > 0, "method-with-deps", "method-no-deps"))
        .when(kind.isin(*TYPES), two(children > 0, "type-with-children", "type-no-children"))
        .when(kind.isin(*CONTAINERS), two(children > 0, "container-with-children", "container-no-children"))
        .when(kind == "INFRASTRUCTURE", "infrastructure")
        .otherwise(two(has_code, "leaf-with-code", "leaf-no-code"))
    )


def generate_docs(nodes: DataFrame, locale: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(node_id, locale, doc_tech, doc_digest, source_hash): documents by an injected model; the digest is their beginning.

    A failing or empty answer gives the digest no-content and no document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = list(model(batch["prompt"].tolist()))
            except Exception:  # noqa: BLE001 - a failed batch has no documents
                answers = [None] * len(batch)
            text = [a if a and a.strip() else None for a in answers]
            yield pd.DataFrame({"node_id": batch["id"], "locale": locale, "doc_tech": text, "doc_digest": [t[:500] if t else "no-content" for t in text], "source_hash": batch["hash"]})

    prompt = F.concat_ws("\n", F.coalesce("fqn", "name"), "signature", "source_code")
    rows = nodes.select("id", prompt.alias("prompt"), T.content_hash(F.col("source_code")).alias("hash"))
    return rows.mapInPandas(run, "node_id long, locale string, doc_tech string, doc_digest string, source_hash string")


def post_process(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, most: int = 30_000, summarise: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Chunks with hash, token count and, where a model is given, vector; what is there already stays.

    Texts beyond ``most`` characters do not fit a model: they are summarised first, and without ``summarise`` the vector
    is the mean of those of their pieces of ``most`` characters, so that no part of a text is left out.
    """
    done = chunks.withColumn("content_hash", F.coalesce("content_hash", T.content_hash(F.col("content")))).withColumn("token_count", F.coalesce("token_count", T.token_count(F.col("content"))))
    if embed is None:
        return done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            todo = batch["embedding"].isna() & batch["content"].fillna("").str.strip().ne("")
            texts = batch.loc[todo, "content"].tolist()
            if summarise and any(len(t) > most for t in texts):
                short = iter(summarise([t for t in texts if len(t) > most]))
                texts = [next(short) if len(t) > most else t for t in texts]
            pieces = [[t[i : i + most] for i in range(0, len(t), most)] for t in texts]
            vectors = iter(embed([p for ps in pieces for p in ps]) if pieces else [])
            column = batch["embedding"].tolist()
            for at, ps in zip([i for i, t in enumerate(todo) if t], pieces):
                own = [next(vectors) for _ in ps]
                column[at] = [float(sum(x)) / len(own) for x in zip(*own)]
            yield batch.assign(embedding=column)

    return done.mapInPandas(run, done.schema)


def store_add(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Vector store with rows added; a row of a known id replaces the old one."""
    return store.join(rows.select("id").distinct(), "id", "left_anti").unionByName(rows.dropDuplicates(["id"]), allowMissingColumns=True)


def run_summary(plans: DataFrame, seconds: float) -> DataFrame:
    """Totals and rate of a run."""
    return plans.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("source", "kind").alias("kinds"), F.round(F.count(F.lit(1)) / F.lit(max(seconds, 1e-9)), 3).alias("nodes_per_second"))
