"""Most similar vectors for every vector.

Method: multi-index hashing.  Rotations learned on a bounded sample (iterative quantisation over the principal axes)
turn every vector into binary codes of 64 bits a rotation.  The codes are split into substrings and each substring is an
index of its own: a join on (index, substring) probes all of them, and by the pigeonhole principle it retrieves every
code that differs in fewer bits than there are substrings.  Vectors at the required cosine differ in more bits than that,
yet seldom in every substring, so the number of indexes is chosen from the angle such that a pair at the threshold
escapes with probability ``MISS``.  Candidates are screened by the Hamming distance of their first code inside the join
and then reranked with the float vectors.

The planes of the codes go through the origin or through the mean of the sample, whichever makes the join cheaper as
estimated on the sample: vectors that all point one way fall on one side of every plane through the origin.  The length of
a substring is chosen for the least cost as well.  Slots that hold many rows all the same are split: their rows are coded
by further rotations, and within the slot again only equal substrings meet.

Vectors that are null, all zero, of another dimension or hold a null, NaN or infinite element take no part.  Equal
vectors are indexed once and expanded afterwards.  Every row is indexed; only the rotations come from the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.runtime import cut

DIM = 64
SAMPLE = 20_000
MISS = 1e-3
SCREEN_SIGMAS = 4.5
QUERY_BLOCK = 8192
HOT = 2048


def usable(rows: DataFrame, id_col: str, columns: dict[str, str], dim: int = DIM) -> DataFrame:
    """(field, id, vec) of the vectors that take part; ``columns`` maps each field's name to its column."""
    out = None
    for name, column in columns.items():
        part = rows.select(F.lit(name).alias("field"), F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<float>").alias("vec"))
        out = part if out is None else out.unionByName(part)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    return out.where((F.size("vec") == dim) & finite & some & F.col("id").isNotNull())


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 20, seed: int = 977) -> np.ndarray:
    """dim x 64*count matrix of ``count`` rotations, each learned from another random start."""
    dim = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) > 1 else np.eye(dim)
    projected = sample @ axes
    out = []
    for k in range(count):
        turn = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(sample) > dim else 0):
            left, _, right = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (left @ right).T
        out.append(axes @ turn)
    return np.hstack(out).astype(np.float32)


def differing(cosine: float, norm: float = 1.0) -> float:
    """Share of bits in which vectors at this cosine differ, if their lengths from the centre are ``norm``."""
    apart = math.sqrt(max(0.0, 2 - 2 * min(1.0, cosine)))
    return min(0.5, 2 * math.asin(min(1.0, apart / (2 * norm))) / math.pi)


def plan(rows: int, differ: float, miss: float = MISS) -> tuple[int, int, int, int]:
    """(bits of a substring, number of indexes, rotations of 64 bits, Hamming radius of the screen) at the least cost.

    A row costs one entry in every index and the rows that chance puts beside it; of equal costs the longer substring.
    """
    best = None
    for bits in range(12, max(13, min(30, math.ceil(math.log2(max(rows, 2)))) + 1)):
        hit = (1 - differ) ** bits
        indexes = max(1, math.ceil(math.log(miss) / math.log1p(-hit))) if hit < 1 else 1
        cost = indexes * (4 + rows / 2**bits)
        if best is None or cost <= best[0]:
            best = cost, bits, indexes
    _, bits, indexes = best
    radius = math.ceil(64 * differ + SCREEN_SIGMAS * math.sqrt(64 * differ * (1 - differ)))
    return bits, indexes, math.ceil(bits * indexes / 64), radius


def centre(sample: np.ndarray, rows: int, cosine: float) -> tuple[np.ndarray, float]:
    """(centre of the planes, share of bits that differ at the cosine): the origin or the sample's mean, by estimated cost.

    The cost counts how often two vectors of the sample share a substring.  Around the mean the shortest twentieth of the
    lengths decides how far apart a pair may look.
    """
    dim = sample.shape[1]
    options = [(np.zeros(dim), differing(cosine))]
    if len(sample) > dim:
        mean = sample.mean(axis=0)
        norm = float(np.quantile(np.linalg.norm(sample - mean, axis=1), 0.05))
        if norm > 0:
            options.append((mean, differing(cosine, norm)))
    best = None
    for middle, differ in options:
        bits, indexes, _, _ = plan(rows, differ)
        signs = (sample - middle) @ learn_rotations(sample - middle, 1) > 0 if len(sample) else np.zeros((0, 64), bool)
        shared = []
        for lo in range(0, 64 - bits + 1, bits):
            counts = np.unique(signs[:, lo : lo + bits] @ (1 << np.arange(bits)), return_counts=True)[1]
            shared.append(float((counts * (counts - 1)).sum()) / max(1, len(sample) * (len(sample) - 1)))
        cost = indexes * (4 + rows * (sum(shared) / len(shared)))
        if best is None or cost < best[0]:
            best = cost, middle, differ
    return best[1], best[2]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _sample(vectors: DataFrame, rows: int, size: int, dim: int) -> np.ndarray:
    """At most ``size`` vectors, those with the least hash, so that the sample is the same in every run.

    A bound on the hash leaves about twice that many before they are ordered, however many rows there are.
    """
    bound = int(min(1.0, 2 * size / max(rows, 1)) * ((1 << 62) - 1))
    hashed = vectors.select("vec", F.xxhash64("id", "field").bitwiseAND(F.lit((1 << 62) - 1)).alias("h"))
    rows = hashed.where(F.col("h") <= bound).orderBy("h").limit(size).select("vec").toArrow()
    column = rows.column("vec").combine_chunks()
    return _matrix(column, dim).astype(np.float64) if len(column) else np.zeros((0, dim))


def _codes(vectors: DataFrame, rotations: np.ndarray, bits: int, indexes: int, dim: int, middle: np.ndarray | None = None) -> DataFrame:
    """(field, id, code, subs): the first 64 bits and the substrings of all rotations, around ``middle``."""
    shared = vectors.sparkSession.sparkContext.broadcast((rotations, (np.zeros(dim) if middle is None else middle).astype(np.float32)))
    schema = pa.schema([("field", pa.string()), ("id", pa.int64()), ("code", pa.int64()), ("subs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, around = shared.value
        weights = (1 << np.arange(bits)).astype(np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                signs = (_matrix(part.column(2), dim) - around) @ turn > 0
                code = np.packbits(signs[:, :64], axis=1).view(np.int64).ravel()
                subs = (signs[:, : bits * indexes].reshape(-1, indexes, bits) * weights).sum(axis=2, dtype=np.int32)
                ends = np.arange(0, subs.size + 1, indexes, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code), pa.ListArray.from_arrays(pa.array(ends), pa.array(subs.ravel()))], schema=schema)

    return vectors.select("field", "id", "vec").mapInArrow(run, "field string, id long, code long, subs array<int>")


def _cosine(a: str, b: str) -> F.Column:
    """Cosine of two array columns in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def _meet(probes: DataFrame, radius: int) -> DataFrame:
    """(f, id_a, id_b) of rows in one slot and field whose first codes are near."""
    left = probes.select("slot", "f", F.col("id").alias("id_a"), F.col("code").alias("code_a"))
    right = probes.select("slot", F.col("f").alias("g"), F.col("id").alias("id_b"), F.col("code").alias("code_b"))
    near = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= radius
    return left.join(right.hint("merge"), "slot").where((F.col("id_a") < F.col("id_b")) & (F.col("f") == F.col("g")) & near).select("f", "id_a", "id_b")


def similar_pairs(vectors: DataFrame, cosine: float, sample: int = SAMPLE, miss: float = MISS, dim: int = DIM, hot: int = HOT) -> DataFrame:
    """(field, id_a, id_b, cosine): any two rows of a field, ``id_a`` < ``id_b``, with at least this cosine."""
    one = vectors.groupBy("field", "vec").agg(F.min("id").alias("id"), F.collect_set("id").alias("ids"))
    one = cut(one)
    rows = one.count()
    taken = _sample(one, rows, sample, dim)
    middle, differ = centre(taken, rows, cosine)
    bits, indexes, rotations, radius = plan(rows, differ, miss)
    turn = learn_rotations(taken - middle, rotations)
    names = {name: k for k, name in enumerate(sorted(r["field"] for r in one.select("field").distinct().collect()))}
    number = F.coalesce(*[F.when(F.col("field") == name, F.lit(k)) for name, k in names.items()], F.lit(-1)).cast("byte")
    coded = _codes(one, turn, bits, indexes, dim, middle)
    # one long names field, index and substring
    slot = F.shiftleft(F.xxhash64("field", "at").bitwiseAND(F.lit((1 << (62 - bits)) - 1)), bits).bitwiseOR(F.col("sub").cast("long"))
    probes = coded.select("field", "id", "code", F.posexplode("subs").alias("at", "sub")).select(slot.alias("slot"), number.alias("f"), "id", "code")
    full_slots = cut(probes.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("slot"))
    if full_slots.isEmpty():
        pairs = _meet(probes, radius).distinct()
    else:
        # rows of full slots are coded again by other rotations; within a slot only equal substrings of those meet
        full = cut(probes.join(full_slots, "slot", "left_semi"))
        again = one.withColumn("f", number).join(full.select("f", "id").distinct(), ["f", "id"], "left_semi")
        finer = _codes(again, learn_rotations(taken - middle, rotations, seed=7919), bits, indexes, dim, middle).select(number.alias("f"), "id", F.posexplode("subs").alias("at", "sub"))
        split = full.join(finer, ["f", "id"]).select(F.xxhash64("slot", "at", "sub").alias("slot"), "f", "id", "code")
        pairs = _meet(probes.join(full_slots, "slot", "left_anti"), radius).unionByName(_meet(split, radius)).distinct()
    floats = one.select(number.alias("f"), "field", "id", "vec", "ids")
    ranked = (
        cut(pairs)
        .join(floats.select("f", F.col("id").alias("id_a"), F.col("vec").alias("va"), F.col("ids").alias("ia"), "field"), ["f", "id_a"])
        .join(floats.select("f", F.col("id").alias("id_b"), F.col("vec").alias("vb"), F.col("ids").alias("ib")), ["f", "id_b"])
        .withColumn("cosine", _cosine("va", "vb"))
        .where(F.col("cosine") >= cosine)
    )
    across = ranked.select("field", "cosine", F.explode("ia").alias("x"), "ib").select("field", "cosine", "x", F.explode("ib").alias("y"))
    copies = one.where(F.size("ids") > 1).select("field", F.lit(1.0).alias("cosine"), F.explode("ids").alias("x"), "ids").select("field", "cosine", "x", F.explode("ids").alias("y")).where("x < y")
    both = across.unionByName(copies).where("x != y")
    return both.groupBy("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("cosine").alias("cosine"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, keep: float = 0.03, dim: int = DIM, block: int = QUERY_BLOCK) -> DataFrame:
    """(field, query_id, rank, id, cosine): the ``k`` rows of the same field most similar to each query row.

    The nearest rows of a query may be far off; then probing substrings retrieves nearly every code, so the codes are
    scanned, and the radius around each query is set such that it holds the share ``keep`` of the rows of a batch (at
    least 8k).  These are reranked with floats.  Queries go to the executors in blocks of bounded size.
    """
    one = cut(vectors.dropDuplicates(["field", "id"]))
    turn = learn_rotations(_sample(one, one.count(), sample, dim), 4)
    asked = one.join(queries.select("field", "id").distinct(), ["field", "id"], "left_semi")
    spark, out = vectors.sparkSession, None
    schema = pa.schema([("field", pa.string()), ("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
    for chunk in _query_blocks(asked, block, dim):
        shared = spark.sparkContext.broadcast((chunk, turn))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_field, turn_ = shared.value
            pack = lambda x: np.packbits(x @ turn_ > 0, axis=1).view(np.uint64)
            coded = {f: (ids, x, pack(x)) for f, (ids, x) in by_field.items()}
            best: dict[str, tuple[np.ndarray, np.ndarray]] = {f: (np.full((len(ids), k), -1), np.full((len(ids), k), -2.0)) for f, (ids, _) in by_field.items()}
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), dtype=object)
                ids_all, x_all = batch.column(1).to_numpy(), _matrix(batch.column(2), dim)
                for field in set(names.tolist()) & set(coded):
                    mine = np.flatnonzero(names == field)
                    ids, x = ids_all[mine], x_all[mine]
                    code = pack(x)
                    q_ids, q_x, q_code = coded[field]
                    least = min(len(ids), max(8 * k, int(keep * len(ids))))
                    top_ids, top_cos = best[field]
                    for lo in range(0, len(q_ids), 256):
                        part = slice(lo, min(lo + 256, len(q_ids)))
                        far = sum(np.bitwise_count(q_code[part, None, w] ^ code[None, :, w]).astype(np.uint16) for w in range(code.shape[1]))
                        near = np.argpartition(far, least - 1, axis=1)[:, :least] if least < len(ids) else np.broadcast_to(np.arange(len(ids)), far.shape)
                        cos = np.einsum("qcd,qd->qc", x[near], q_x[part]).astype(np.float64)
                        cos[ids[near] == q_ids[part, None]] = -2.0
                        all_ids, all_cos = np.hstack((top_ids[part], ids[near])), np.hstack((top_cos[part], cos))
                        order = np.lexsort((all_ids, -all_cos))[:, :k]
                        top_ids[part], top_cos[part] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_cos, order, 1)
            for field, (top_ids, top_cos) in best.items():
                q_ids = coded[field][0]
                good = (top_cos > -2.0).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([field] * int(good.sum()), pa.string()), pa.array(np.repeat(q_ids, k)[good]), pa.array(top_ids.ravel()[good]), pa.array(top_cos.ravel()[good])], schema=schema
                )

        part = one.select("field", "id", "vec").mapInArrow(run, "field string, query_id long, id long, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "field string, query_id long, id long, cosine double")
    w = Window.partitionBy("field", "query_id").orderBy(F.col("cosine").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("field", "query_id", "rank", "id", "cosine")


def _query_blocks(asked: DataFrame, block: int, dim: int) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of at most ``block`` query vectors by field, read one after the other."""
    rows: dict[str, tuple[list[int], list[list[float]]]] = {}
    n = 0

    def packed():
        out = {}
        for field, (ids, vecs) in rows.items():
            x = np.array(vecs, np.float64)
            out[field] = (np.array(ids, np.int64), (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
        return out

    for row in asked.toLocalIterator():
        ids, vecs = rows.setdefault(row["field"], ([], []))
        ids.append(row["id"])
        vecs.append(row["vec"])
        n += 1
        if n == block:
            yield packed()
            rows, n = {}, 0
    if n:
        yield packed()
