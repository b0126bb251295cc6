"""Rebuilding conversations from message rows.

Method: conversations come as export fragments that overlap: each begins with the message the one before it ends with.
Per fragment the repeats are removed and its turns are summed up (first and last speaker, strict alternation, blanks).
The overlap graph joins a fragment whose first message's hash is the hash of another one's last message; a hash covers
time, sequence, role and content, so a message is one within its conversation and a path is unambiguous.  Pointer doubling
along the edges merges the sums of a path and gives each fragment its place; nothing but the matches orders the
fragments.  A conversation whose fragments form no single path has a gap (or an ambiguity) and is dropped.

The rows at hand are no export yet, so ``export`` cuts them into fragments: the ranges of one global range partitioning,
whose bounds fall anywhere, inside long conversations too, so that no conversation has to lie in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.runtime import cut, partitions

# fixed values: spellings of the roles, after trimming and upper-casing
ROLES = {"USER": "USER", "HUMAN": "USER", "ASSISTANT": "ASSISTANT", "AI": "ASSISTANT", "SYSTEM": "SYSTEM", "TOOL": "TOOL"}
_BLANK = r"^[\s\p{Z}\p{C}]*$"


def role(raw: Column) -> Column:
    """One of the four roles; null for anything else."""
    name = F.upper(F.regexp_replace(raw, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return F.coalesce(*[F.when(name == spelt, F.lit(to)) for spelt, to in ROLES.items()])


def blank(text: Column) -> Column:
    return text.isNull() | text.rlike(_BLANK)


def messages(rows: DataFrame, keep_content: bool = False) -> DataFrame:
    """Distinct messages (conv, ts, seq, role, hash, blank[, content]); rows without a conversation id belong to none."""
    content = F.coalesce("content", F.lit(""))
    slim = rows.where(~blank(F.col("conversation_id"))).select(
        F.col("conversation_id").alias("conv"),
        F.col("timestamp").alias("ts"),
        F.get_json_object("metadata", "$.seq").cast("long").alias("seq"),
        F.coalesce(role(F.col("type")), F.lit("?")).alias("role"),
        F.md5(content).alias("hash"),
        blank(F.col("content")).alias("blank"),
        *([F.col("content")] if keep_content else []),
    )
    return slim.dropDuplicates(["conv", *_ORDER, "blank"])


_ORDER = ["ts", "seq", "role", "hash"]
_SUMS = ["first", "last", "turns", "rows", "broken"]


def export(msgs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Messages as fragments (conv, fragment, ...), in which each fragment but a conversation's first begins with a copy of the message before it.

    The bounds of the ranges come from a sample, so the assignment is written down once before it is used in several
    places.  ``fragment`` is a mere name: it tells nothing about the order.
    """
    n = pieces or partitions(msgs.sparkSession)
    cutted = cut(msgs.repartitionByRange(n, "conv", *_ORDER).withColumn("range", F.spark_partition_id()))
    named = F.xxhash64("conv", "range").alias("fragment")
    last = cutted.groupBy("conv", "range").agg(F.max(F.struct(*_ORDER, "blank")).alias("m"))
    after = last.withColumn("range", F.lead("range").over(Window.partitionBy("conv").orderBy("range"))).where("range is not null")
    copies = after.select("conv", named, *[F.col(f"m.{c}") for c in [*_ORDER, "blank"]])
    return cutted.select("conv", named, *[c for c in cutted.columns if c not in ("conv", "range")]).unionByName(copies, allowMissingColumns=True)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place in the fragment (``at``, from 1) and whether they repeat the row before (``again``)."""
    w = Window.partitionBy("conv", "fragment").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    again = F.coalesce((F.lag("role").over(w) == F.col("role")) & (F.lag("hash").over(w) == F.col("hash")), F.lit(False))
    return rows.withColumn("at", F.row_number().over(w)).withColumn("again", again)


def _summaries(fragments: DataFrame) -> DataFrame:
    """(conv, fragment, head, tail, and the sums of the first message and of the rest) of each fragment."""
    w = Window.partitionBy("conv", "fragment").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    turn = ~F.col("again") & F.col("role").isin("USER", "ASSISTANT")
    spoken, rest = F.when(turn, F.col("role")), turn & (F.col("at") > 1)
    marked = _numbered(fragments).withColumn("spoken", spoken).withColumn("prior", F.last("spoken", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    name = F.md5(F.to_json(F.struct(*_ORDER)))
    said = F.when(rest, F.col("at"))
    return marked.groupBy("conv", "fragment").agg(
        F.min_by(name, "at").alias("head"),
        F.max_by(name, "at").alias("tail"),
        F.max(F.when(F.col("at") == 1, F.col("spoken"))).alias("head_role"),
        F.coalesce(F.bool_or((F.col("at") == 1) & turn & F.col("blank")), F.lit(False)).alias("head_blank"),
        F.min_by("spoken", said).alias("first"),
        F.max_by("spoken", said).alias("last"),
        F.count(F.when(rest, 1)).alias("turns"),
        F.count(F.when((F.col("at") > 1) & ~F.col("again"), 1)).alias("rows"),
        F.coalesce(F.bool_or(rest & (F.col("blank") | (F.col("prior") == F.col("spoken")))), F.lit(False)).alias("broken"),
    )


def _then(a: str, b: str) -> list[Column]:
    """Sums of one stretch and the one behind it."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    clash = F.coalesce(x("last") == y("first"), F.lit(False))
    return [F.coalesce(x("first"), y("first")).alias("first"), F.coalesce(y("last"), x("last")).alias("last"), (x("turns") + y("turns")).alias("turns"), (x("rows") + y("rows")).alias("rows"), (x("broken") | y("broken") | clash).alias("broken")]


def assemble(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, fragment, before, starts), (conv, kept, turns)) of overlapping fragments, whatever they are called.

    ``before`` counts the rows of the conversation before the fragment's own ones, ``starts`` tells the first fragment.
    """
    sums = cut(_summaries(fragments))
    # an edge where a suffix hash is a prefix hash
    tails = sums.select("conv", F.col("tail").alias("head"), F.col("fragment").alias("prev"))
    found = sums.join(tails, ["conv", "head"]).where("prev <> fragment")
    edges = found.groupBy("conv", "fragment").agg(F.min("prev").alias("prev"), F.count(F.lit(1)).alias("ways"))
    nexts = found.groupBy("conv", F.col("prev").alias("fragment")).agg(F.count(F.lit(1)).alias("next"))
    linked = sums.join(edges, ["conv", "fragment"], "left").join(nexts, ["conv", "fragment"], "left")
    # the first fragment's first message counts; elsewhere it is the copy of the one before
    opening = F.struct(F.col("head_role").alias("first"), F.col("head_role").alias("last"), F.when(F.col("head_role").isNotNull(), 1).otherwise(0).alias("turns"), F.lit(1).alias("rows"), F.col("head_blank").alias("broken"))
    nothing = F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("turns"), F.lit(0).alias("rows"), F.lit(False).alias("broken"))
    start = linked.withColumn("h", F.when(F.col("prev").isNull(), opening).otherwise(nothing)).withColumn("r", F.struct(*_SUMS))
    walk = start.select("conv", "fragment", "prev", F.coalesce("ways", F.lit(0)).alias("ways"), F.coalesce("next", F.lit(0)).alias("next"), F.col("prev").isNull().alias("starts"), F.col("rows").alias("own"), *_then("h.", "r."))
    going = cut(walk.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv"))))
    alone, going = going.where("n = 1"), going.where("n > 1")
    left, before = going.where("prev is not null").count(), None
    while left and left != before:
        far = going.select("conv", F.col("fragment").alias("prev"), F.col("prev").alias("prev2"), F.struct(*_SUMS).alias("a"))
        longer = going.withColumn("b", F.struct(*_SUMS)).drop(*_SUMS).where("prev is not null").join(far, ["conv", "prev"])
        moved = longer.select("conv", "fragment", F.col("prev2").alias("prev"), "ways", "next", "starts", "own", "n", *_then("a.", "b."))
        going = cut(going.where("prev is null").unionByName(moved))
        before, left = left, going.where("prev is not null").count()
    # a single path: one start, no fork, every fragment reached from the start
    whole = going.groupBy("conv").agg(
        ((F.sum(F.col("starts").cast("int")) == 1) & (F.max("ways") <= 1) & (F.count("prev") == 0) & (F.max("next") <= 1)).alias("path"),
        F.max_by(F.struct(*_SUMS), "rows").alias("s"),
    )
    kept = lambda first, last, broken: ~broken & F.coalesce((first == "USER") & (last == "ASSISTANT"), F.lit(False))
    verdict = alone.select("conv", kept(F.col("first"), F.col("last"), F.col("broken")).alias("kept"), "turns").unionByName(whole.select("conv", (F.col("path") & kept(F.col("s.first"), F.col("s.last"), F.col("s.broken"))).alias("kept"), F.col("s.turns").alias("turns")))
    places = alone.unionByName(going).select("conv", "fragment", (F.col("rows") - F.col("own")).alias("before"), "starts")
    return places, verdict


def verdicts(rows: DataFrame, pieces: int | None = None) -> DataFrame:
    """(conversation_id, kept, turns) for every conversation.

    Rows are ordered by time, then ``metadata.seq`` (rows without either come first), then role and content hash, which
    makes ties definite.  A row with the role and content of the row just before it counts once.
    """
    return assemble(export(messages(rows), pieces))[1].withColumnRenamed("conv", "conversation_id")


def dropped(rows: DataFrame, pieces: int | None = None) -> DataFrame:
    """(conversation_id) of each conversation that is broken, empty or lacks replies."""
    return verdicts(rows, pieces).where(~F.col("kept")).select("conversation_id")


def turns(rows: DataFrame, pieces: int | None = None) -> DataFrame:
    """Kept conversations as (conversation_id, position, role, content), repeats removed, all roles."""
    fragments = export(messages(rows, keep_content=True), pieces)
    places, verdict = assemble(fragments.drop("content"))
    good = places.join(verdict.where("kept").select("conv"), "conv", "left_semi")
    own = _numbered(fragments).where(~F.col("again")).join(good, ["conv", "fragment"]).where("starts or at > 1")
    inside = F.row_number().over(Window.partitionBy("conv", "fragment").orderBy("at"))
    # the first message of the start is among what ``before`` counts
    position = F.when(F.col("starts"), inside).otherwise(F.col("before") + inside).cast("int")
    return own.select(F.col("conv").alias("conversation_id"), position.alias("position"), "role", "content")
