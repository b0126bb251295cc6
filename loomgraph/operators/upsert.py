"""Writes as rewrites: idempotent upserts, change detection, merges and deletes over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(existing: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows stay; of proposed ones those with a new key are added, one per key."""
    fresh = proposed.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def replace_rows(existing: DataFrame, proposed: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a proposed key take the proposed values, but for the columns in ``keep``."""
    new = proposed.dropDuplicates(keys)
    renamed = new.select(*[F.col(c).alias(c if c in keys else f"new_{c}") for c in new.columns], F.lit(True).alias("is_new"))
    joined = existing.withColumn("is_old", F.lit(True)).join(renamed, keys, "full_outer")
    columns = []
    for c in existing.columns:
        if c in keys or c not in new.columns:
            columns.append(F.col(c))
        elif c in keep:
            columns.append(F.when(F.col("is_old"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c))
        else:
            columns.append(F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*columns)


def upsert_doc_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(node_id, locale, kind, content, stale): chunk contents after taking over the documents.

    Where a content changes, its hash and vector no longer hold, so ``stale`` is set.
    """
    wanted = docs.select("node_id", "locale", F.explode(F.array(F.struct(F.lit("public").alias("kind"), F.col("doc_public").alias("content")), F.struct(F.lit("tech").alias("kind"), F.col("doc_tech").alias("content")))).alias("x")).select("node_id", "locale", "x.kind", "x.content").where(F.trim("content") != "")
    old = chunks.where(F.col("source") == "doc").groupBy("node_id", F.col("lang_detected").alias("locale"), "kind").agg(F.max_by("content", F.struct("updated_at", "id")).alias("old"))
    return wanted.join(old, ["node_id", "locale", "kind"], "left").select("node_id", "locale", "kind", "content", (F.col("old").isNull() | (F.col("old") != F.col("content"))).alias("stale"))


def detect_changes(existing: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str = "code_hash") -> DataFrame:
    """Incoming rows with ``action`` insert, update or skip; source and lines as they come out.

    Descriptive fields are overwritten; the source is kept unless the hash changed; lines are overwritten if it did and
    otherwise only by given values.
    """
    fields = ["name", "kind", "signature", "doc_comment", "file_path"]
    old = existing.select(*keys, F.col(hash_col).alias("old_hash"), F.col("source_code").alias("old_source"), F.col("line_start").alias("old_start"), *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("known"))
    rows = incoming.join(old, keys, "left")
    changed = ~F.col(hash_col).eqNullSafe(F.col("old_hash"))
    same = ~changed
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    action = F.when(F.col("known").isNull(), "insert").when(same, "skip").otherwise("update")
    return rows.select(
        *keys,
        action.alias("action"),
        F.when(F.col("known").isNull() | changed, F.col("source_code")).otherwise(F.col("old_source")).alias("source_code"),
        F.when(F.col("known").isNull() | changed, F.col("line_start")).otherwise(F.coalesce("line_start", "old_start")).alias("line_start"),
    )


def merge_meta(old: Column, new: Column) -> Column:
    """Maps of strings: a null removes a key, an empty value is passed over, anything else overwrites."""
    removed = F.map_keys(F.map_filter(new, lambda _, v: v.isNull()))
    given = F.map_filter(new, lambda _, v: v.isNotNull() & (v != "") & (v != "[]"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(removed, k) & ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(kept, given)


def merge_value(policy: str, old: Column, new: Column) -> Column:
    """KEEP_EXISTING, OVERWRITE, PREFER_LONGER or GRADE_BETTER (A before B before C)."""
    if policy == "KEEP_EXISTING":
        return F.coalesce(old, new)
    if policy == "OVERWRITE":
        return F.coalesce(new, old)
    if policy == "PREFER_LONGER":
        return F.when(old.isNull() | (F.length(new) > F.length(old)), new).otherwise(old)
    if policy == "GRADE_BETTER":
        return F.when(old.isNull() | (new < old), new).otherwise(old)
    raise ValueError(f"unknown policy {policy}")


def latest_chunk(chunks: DataFrame) -> DataFrame:
    """(node_id, id, created_at): the newest chunk of each node, ties by the greater id."""
    return chunks.groupBy("node_id").agg(F.max(F.struct("created_at", "id")).alias("x")).select("node_id", "x.id", "x.created_at")


def planned_content(nodes: DataFrame) -> DataFrame:
    """(id, content): source, else documentation, trimmed; blank becomes (empty)."""
    text = F.trim(F.coalesce("source_code", "doc_comment", F.lit("")))
    return nodes.select("id", F.when(text == "", F.lit("(empty)")).otherwise(text).alias("content"))


def delete_rows(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti")


def delete_application(application: int, nodes: DataFrame, edges: DataFrame, **by_node: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Nodes, edges and further tables (table, column of the node) without what belongs to one application."""
    gone = nodes.where(F.col("application_id") == application).select("id")
    left = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    out = {"nodes": nodes.where(~F.coalesce(F.col("application_id") == application, F.lit(False))), "edges": left.select(*edges.columns)}
    return out | {name: delete_rows(rows, gone, column).select(*rows.columns) for name, (rows, column) in by_node.items()}


def update_rows(existing: DataFrame, updates: DataFrame, keys: list[str], keep_given: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns of ``updates`` overwritten where their key occurs there; in ``keep_given`` a null leaves the old value.

    No row is added.  Of several updates of a key the greatest counts.
    """
    columns = [c for c in updates.columns if c not in keys]
    new = updates.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("u"), F.lit(True).alias("hit"))
    rows = existing.join(new, keys, "left")
    return rows.select(*[F.when(F.col("hit"), F.coalesce(f"u.{c}", c) if c in keep_given else F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def clear_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with these columns emptied, so that they are processed again."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def change_counts(changes: DataFrame, action: str = "action") -> DataFrame:
    """(created, updated, skipped): one row with how many rows were inserted, updated and passed over."""
    n = lambda what: F.count(F.when(F.col(action) == what, 1))
    return changes.agg(n("insert").alias("created"), n("update").alias("updated"), n("skip").alias("skipped"))
