"""Reports: the architecture profile of applications and details of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import any_of
from loomgraph.operators.relational import count_by, first_rows
from loomgraph.operators.retrieval import CONTEXT_CAPS
from loomgraph.operators.traverse import label

# fixed values: annotations of cross-cutting concerns; kinds in the order of the profile
CROSS_CUTTING = ("PreAuthorize", "Secured", "RolesAllowed", "Transactional", "Async", "Cacheable", "CacheEvict", "CachePut", "Scheduled", "Retryable", "CircuitBreaker")
PROFILE_KINDS = (
    "MODULE", "PACKAGE", "CLASS", "INTERFACE", "METHOD", "ENDPOINT", "SERVICE", "CLIENT", "TOPIC", "JOB", "DB_TABLE", "DB_VIEW", "INFRASTRUCTURE", "CONFIG", "EXCEPTION", "MAPPER", "TEST", "MIGRATION",
)


def _listed(rows: DataFrame, keys: list[str], line: Column, n: int, unit: str = "") -> DataFrame:
    """(keys, position, line): the first ``n`` rows of each group by id, then how many there are besides.

    Only the shown rows are ranked to the end (the planner limits each group before the exchange), so a large group stays
    distributed.
    """
    shown = first_rows(rows.withColumn("line", line), keys, ["id"], n).select(*keys, F.col("rank").alias("position"), "line")
    more = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)
    rest = more.select(*keys, F.lit(n + 1).alias("position"), F.concat(F.lit("- ... и ещё "), F.col("n") - n, F.lit(unit)).alias("line"))
    return shown.unionByName(rest)


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(application_id, section, grp, position, line): the architecture profile of each application, line by line.

    Sections: numbers of the kinds, endpoints (50), integrations by type (20 each), tables and views with their readers
    and writers (30, of 5 each), annotations of cross-cutting concerns, modules (20).
    """
    app, name = ["application_id"], F.coalesce("name", "fqn")
    dash = lambda c: F.concat(F.lit("- "), c)
    meta = lambda *ks: F.coalesce(*[F.nullif(F.trim(F.get_json_object("meta", f"$.{k}")), F.lit("")) for k in ks])

    def part(rows: DataFrame, section: str, grp: Column | None = None) -> DataFrame:
        return rows.select("application_id", F.lit(section).alias("section"), (F.lit("") if grp is None else grp).alias("grp"), F.col("position").cast("int").alias("position"), "line")

    at = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(PROFILE_KINDS, 1)])
    counts = count_by(nodes.where(F.col("kind").isin(*PROFILE_KINDS)), "application_id", "kind").select("application_id", at.alias("position"), dash(F.concat("kind", F.lit(": "), "n")).alias("line"))
    label = F.nullif(F.concat_ws(" ", meta("httpMethod"), meta("path", "url")), F.lit(""))
    out = part(counts, "kinds").unionByName(part(_listed(nodes.where("kind = 'ENDPOINT'"), app, dash(F.coalesce(label, name)), 50, " эндпоинтов"), "endpoints"))
    infra = nodes.where("kind = 'INFRASTRUCTURE'").withColumn("type", F.coalesce(meta("integrationType"), F.lit("unknown")))
    out = out.unionByName(part(_listed(infra, [*app, "type"], dash(name), 20), "integrations", F.col("type")))
    for kind, grp in (("CLIENT", "HTTP-клиенты"), ("TOPIC", "Топики/очереди")):
        out = out.unionByName(part(_listed(nodes.where(F.col("kind") == kind), app, dash(name), 20), "integrations", F.lit(grp)))
    out = out.unionByName(part(data_model(nodes, edges), "data"))
    found = cross_cutting(annotation_uses(nodes, edges))
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("application_id").orderBy(F.col("n").desc(), "annotation")))
    out = out.unionByName(part(ranked.withColumn("line", F.concat(F.lit("- @"), "annotation", F.lit(": "), "n", F.lit(" использований"))), "annotations"))
    return out.unionByName(part(_listed(nodes.where("kind = 'MODULE'"), app, dash(name), 20, " модулей"), "modules"))


def annotation_uses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(application_id, annotation): one row per ANNOTATED_WITH edge, by the name of the annotation's node."""
    names = nodes.select(F.col("id").alias("dst_id"), F.coalesce("name", F.substring_index("fqn", ".", -1)).alias("annotation"))
    return edges.where("kind = 'ANNOTATED_WITH'").join(names, "dst_id").join(nodes.select(F.col("id").alias("src_id"), "application_id"), "src_id").select("application_id", "annotation")


def cross_cutting(usages: DataFrame) -> DataFrame:
    """(application_id, annotation, n) of annotations (application_id, annotation) whose name holds that of a cross-cutting concern, in any case."""
    bare = F.regexp_replace("annotation", r"^@|\(.*$", "")
    known = any_of([F.contains(F.lower("annotation"), F.lit(c.lower())) for c in CROSS_CUTTING])
    return count_by(usages.withColumn("annotation", bare).where(known), "application_id", "annotation")


def data_model(nodes: DataFrame, edges: DataFrame, most: int = 30, n: int = 5) -> DataFrame:
    """(application_id, position, line): tables, then views, with the first ``n`` readers and writers of each."""
    data = nodes.where("kind in ('DB_TABLE', 'DB_VIEW')").select("id", "application_id", "kind", F.coalesce("name", "fqn").alias("label"))
    names = nodes.select(F.col("id").alias("src_id"), F.coalesce("name", "fqn").alias("who"))
    uses = edges.where("kind in ('READS', 'WRITES')").join(data.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").join(names, "src_id")
    first = first_rows(uses.withColumnRenamed("kind", "how"), ["dst_id", "how"], ["src_id"], n).groupBy(F.col("dst_id").alias("id")).agg(
        *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("how") == how, F.struct("rank", "who")))), lambda x: x["who"]), ", ").alias(how) for how in ("READS", "WRITES")]
    )
    shown = first_rows(data, ["application_id"], ["kind", "id"], most).join(first, "id", "left")
    told = F.concat_ws("; ", F.when(F.col("READS") != "", F.concat(F.lit("читают: "), "READS")), F.when(F.col("WRITES") != "", F.concat(F.lit("пишут: "), "WRITES")))
    line = F.concat(F.lit("- "), "kind", F.lit(": "), "label", F.when(told != "", F.concat(F.lit(" ("), told, F.lit(")"))).otherwise(""))
    rest = data.groupBy("application_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return shown.select("application_id", F.col("rank").alias("position"), line.alias("line")).unionByName(
        rest.select("application_id", F.lit(most + 1).alias("position"), F.concat(F.lit("- ... и ещё "), F.col("n") - most, F.lit(" объектов данных")).alias("line"))
    )


def details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fqn, incoming, outgoing): numbers of relations of each node by direction."""
    out = edges.groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = edges.groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    return nodes.select("id", "fqn").join(into, "id", "left").join(out, "id", "left").select("id", "fqn", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


# fixed values: verbs of the kinds that are told, the head of the text
VERBS = {
    "CALLS_CODE": "вызывает", "DEPENDS_ON": "зависит от", "IMPLEMENTS": "реализует", "READS": "читает из", "WRITES": "пишет в", "CALLS_HTTP": "вызывает HTTP", "PRODUCES": "публикует в", "CONSUMES": "потребляет из", "CONTAINS": "содержит",
}
RELATIONS_HEAD = "СВЯЗИ В ГРАФЕ КОДА:"
SHORTEST_LINE = len("- [a] v [b] (Тип: READS)")


def relation_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_id, dst_id, kind, line) of the edges whose kind is told; a node without a name is shown by its number."""
    verb = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in VERBS.items()])
    rows = edges.where(F.col("kind").isin(*VERBS)).select("src_id", "dst_id", "kind").distinct()
    for end in ("src", "dst"):
        names = nodes.select(F.col("id").alias(f"{end}_id"), label("name", "fqn", "id").alias(f"{end}_label"))
        rows = rows.join(names, f"{end}_id", "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.concat(F.lit("Node#"), f"{end}_id")))
    return rows.select("src_id", "dst_id", "kind", F.concat(F.lit("- ["), "src_label", F.lit("] "), verb, F.lit(" ["), "dst_label", F.lit("] (Тип: "), "kind", F.lit(")")).alias("line"))


def relation_text(edges: DataFrame, nodes: DataFrame, most: int = CONTEXT_CAPS["relations"]) -> DataFrame:
    """(src_id, text): a node's relations as the context shows them, by kind and target, cut to the context's share.

    No line is shorter than ``SHORTEST_LINE``, so only so many lines as could be seen are gathered, whatever the hub.
    """
    rows = first_rows(relation_lines(edges, nodes), ["src_id"], ["kind", "dst_id"], most // SHORTEST_LINE + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("src_id").agg(F.substring(F.concat(F.lit(RELATIONS_HEAD + "\n"), text), 1, most).alias("text"))


# fixed values: edges that are followed from the place of an error
ERROR_EDGES = ("CALLS_CODE", "CALLS_HTTP", "READS", "WRITES", "DEPENDS_ON")


def error_surroundings(places: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root_id, neighbour_id, src_id, dst_id, kind, line): what surrounds each place of an error (root_id).

    Outgoing edges of the fixed kinds and incoming calls, one row each; the line is told as in ``relation_lines``, without the kind.
    """
    roots = places.select("root_id").distinct()
    out = edges.where(F.col("kind").isin(*ERROR_EDGES)).join(roots.withColumnRenamed("root_id", "src_id"), "src_id", "left_semi").select(F.col("src_id").alias("root_id"), F.col("dst_id").alias("neighbour_id"), "src_id", "dst_id", "kind")
    into = edges.where("kind = 'CALLS_CODE'").join(roots.withColumnRenamed("root_id", "dst_id"), "dst_id", "left_semi").select(F.col("dst_id").alias("root_id"), F.col("src_id").alias("neighbour_id"), "src_id", "dst_id", "kind")
    rows = out.unionByName(into).distinct()
    return rows.join(relation_lines(edges, nodes), ["src_id", "dst_id", "kind"]).select("root_id", "neighbour_id", "src_id", "dst_id", "kind", F.regexp_replace("line", r" \(Тип: \w+\)$", "").alias("line"))


# fixed values: parts of types and annotations that tell of access control
ACCESS_TYPES = ("auth", "oauth", "security")
ACCESS_ANNOTATIONS = ("PreAuthorize", "Secured", "RolesAllowed")


def access_control(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(application_id, sort, id, mark): infrastructure of access control with its type, and members with an annotation of it."""
    kind = F.get_json_object("meta", "$.integrationType")
    infra = nodes.where((F.col("kind") == "INFRASTRUCTURE") & any_of([F.contains(F.lower(kind), F.lit(t)) for t in ACCESS_TYPES])).select("application_id", F.lit("infrastructure").alias("sort"), "id", kind.alias("mark"))
    names = nodes.select(F.col("id").alias("dst_id"), F.coalesce("name", "fqn").alias("mark")).where(any_of([F.contains(F.lower("mark"), F.lit(a.lower())) for a in ACCESS_ANNOTATIONS]))
    marked = edges.where("kind = 'ANNOTATED_WITH'").join(names, "dst_id").select(F.col("src_id").alias("id"), "mark")
    return infra.unionByName(nodes.select("id", "application_id").join(marked, "id").select("application_id", F.lit("protected").alias("sort"), "id", "mark"))
