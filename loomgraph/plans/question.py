"""A question as a state machine of retrieval steps over lazily composed DataFrames; one action when it is answered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import classify, retrieval, traverse

MAX_STEPS = 20


@dataclass
class Question:
    text: str
    vector: list[float] | None = None
    application: int | None = None
    intent: str = "DEFAULT"
    trail: list[str] = field(default_factory=list)
    nodes: DataFrame | None = None
    results: DataFrame | None = None


@dataclass
class Tables:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    synonyms: DataFrame


def _scalar(spark: SparkSession, text: str, expression: Callable) -> str | None:
    return spark.range(1).select(expression(F.lit(text)).alias("x")).first()[0]


def normalization(q: Question, t: Tables) -> str:
    q.text = _scalar(t.spark, q.text, T.normalize_query)
    return "INTENT"


def intent(q: Question, t: Tables) -> str:
    q.intent = _scalar(t.spark, q.text, classify.intent)
    return {"STACKTRACE": "STACKTRACE", "EXACT": "EXACT"}.get(q.intent, "EXPANSION")


def stacktrace(q: Question, t: Tables) -> str:
    traces = t.spark.range(1).select(F.lit(1).alias("k"), F.lit(q.text).alias("trace"))
    q.nodes = classify.frame_nodes(classify.frames(traces, "k", "trace").where("is_app"), t.nodes, "k").select("id").distinct()
    return "GRAPH"


def exact(q: Question, t: Tables) -> str:
    owner, method = _scalar(t.spark, q.text, classify.named_class), _scalar(t.spark, q.text, classify.named_method)
    if not owner and not method:
        return "EXPANSION"
    q.nodes = retrieval.exact_nodes(t.nodes, owner, method).select("id")
    return "GRAPH"


def graph(q: Question, t: Tables) -> str:
    q.nodes = q.nodes.union(traverse.expand(t.edges, q.nodes, 1).select("id")).distinct()
    return "SEARCH"


def expansion(q: Question, t: Tables) -> str:
    if q.vector is not None:
        q.text = retrieval.expand_query(q.text, retrieval.synonym_matches(t.synonyms, q.vector)).first()["query"]
    return "SEARCH"


def search(q: Question, t: Tables) -> str:
    found = retrieval.hybrid(t.chunks, q.text, q.vector, 10, q.application) if q.vector is not None else retrieval.full_text(t.chunks, q.text, 10, q.application)
    q.results = found.withColumnRenamed("score", "similarity")
    if q.nodes is not None:
        of_nodes = t.chunks.join(q.nodes.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("id", F.lit(1.0).alias("similarity"))
        q.results = retrieval.answer_set(q.results.unionByName(of_nodes), 10)
    return "DONE"


STEPS: dict[str, Callable[[Question, Tables], str]] = {"NORMALIZATION": normalization, "INTENT": intent, "STACKTRACE": stacktrace, "EXACT": exact, "GRAPH": graph, "EXPANSION": expansion, "SEARCH": search}


def ask(question: Question, tables: Tables, steps: dict[str, Callable[[Question, Tables], str]] | None = None) -> Question:
    """Run the steps from normalization on; a step that comes again, or too many steps, end it as failed."""
    table, at = steps or STEPS, "NORMALIZATION"
    while at != "DONE":
        if at in question.trail or len(question.trail) >= MAX_STEPS or at not in table:
            question.trail.append("FAILED")
            return question
        question.trail.append(at)
        at = table[at](question, tables)
    question.trail.append("DONE")
    return question


def research(goal: str, model: Callable[[str], str], tools: dict[str, Callable[[str], str]], max_rounds: int = 8) -> tuple[str, list[int]]:
    """Let a model call tools by lines ``ACTION: name[input]`` until it says ``FINAL: answer``; (answer, ids it cites as [id=n])."""
    import re

    log, cited = f"GOAL: {goal}", []
    for _ in range(max_rounds):
        said = model(log)
        cited += [int(x) for x in re.findall(r"\[id=(\d+)\]", said)]
        if m := re.search(r"FINAL:\s*(.+)", said, re.S):
            return m.group(1).strip(), sorted(set(cited))
        m = re.search(r"ACTION:\s*(\w+)\[(.*?)\]", said, re.S)
        seen = tools[m.group(1)](m.group(2)) if m and m.group(1) in tools else "unknown action"
        cited += [int(x) for x in re.findall(r"\[id=(\d+)\]", seen)]
        log += f"\n{said}\nOBSERVATION: {seen}"
    return "", sorted(set(cited))
