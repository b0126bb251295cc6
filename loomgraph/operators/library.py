"""Libraries: their kind, and which of their classes and members matter between applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import any_of

# fixed values: parts of annotations and names that mark integration
CLASS_ANNOTATIONS = ("RestController", "Controller", "FeignClient", "KafkaListener", "RabbitListener", "Service", "Component", "WebClient")
CLASS_NAMES = ("webclient", "resttemplate", "okhttp", "httpclient", "feign", "restclient", "kafka", "routebuilder", "camel")
MEMBER_ANNOTATIONS = ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "KafkaListener", "RabbitListener", "Scheduled", "EventListener")
# fixed values: kinds of libraries by the beginning of their group
KNOWN_GROUPS = {"org.springframework": "framework", "com.fasterxml.jackson": "library", "org.jetbrains.kotlin": "language"}


def library_kind(group: Column, company: list[str]) -> Column:
    """framework, library, language, company (by the given prefixes, in any case) or external."""
    own = any_of([F.lower(group).startswith(p.lower()) for p in company]) if company else F.lit(False)
    return F.coalesce(*[F.when(group.startswith(p), F.lit(k)) for p, k in KNOWN_GROUPS.items()], F.when(own, F.lit("company")), F.lit("external"))


def _marked(annotations: Column, names: tuple[str, ...]) -> Column:
    low = [n.lower() for n in names]
    return F.coalesce(F.exists(annotations, lambda a: any_of([F.contains(F.lower(a), F.lit(n)) for n in low])), F.lit(False))


def _with(modifiers: Column, *words: str) -> Column:
    tests = [F.coalesce(F.array_contains(modifiers, w), F.lit(False)) for w in words]
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def relevant_classes(members: DataFrame, class_kinds: tuple[str, ...]) -> DataFrame:
    """Public classes that integrate by annotation or name, and public interfaces.  ``members``: fqn, kind, modifiers, annotations."""
    name = any_of([F.contains(F.lower("fqn"), F.lit(n)) for n in CLASS_NAMES])
    return members.where(F.col("kind").isin(*class_kinds) & _with(F.col("modifiers"), "public") & (_marked(F.col("annotations"), CLASS_ANNOTATIONS) | name | (F.col("kind") == "INTERFACE")))


def relevant_members(members: DataFrame, classes: DataFrame, integrating: DataFrame) -> DataFrame:
    """Methods and fields that matter: public methods by annotation, by an integrating call of theirs (``integrating``: fqn) or by their
    class, public or constant fields by their class.  ``members`` carries ``parent_fqn`` besides."""
    inside = classes.select(F.col("fqn").alias("parent_fqn"), F.lit(True).alias("inside")).distinct()
    calls = integrating.select("fqn", F.lit(True).alias("calls")).distinct()
    rows = members.where("kind in ('METHOD', 'FIELD')").join(inside, "parent_fqn", "left").join(calls, "fqn", "left")
    within, public = F.coalesce("inside", F.lit(False)), _with(F.col("modifiers"), "public")
    method = (F.col("kind") == "METHOD") & public & (_marked(F.col("annotations"), MEMBER_ANNOTATIONS) | F.coalesce("calls", F.lit(False)) | within)
    field = (F.col("kind") == "FIELD") & within & (public | _with(F.col("modifiers"), "static", "final"))
    return rows.where(method | field).select(*members.columns)
