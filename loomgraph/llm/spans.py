"""Long exact spans shared between records.

Method: recompression.  A text becomes a sequence of tokens (short words, else single characters) named by a hash of
their characters.  Each round then names runs of equal symbols and, with the symbols split into left and right ones by a
bit of their name, pairs of a left and a right symbol.  A name is a hash of what it stands for, so the naming is global
over the corpus without any exchange, and equal substrings have the same symbols but for a few at their ends.

How many at most: the first tokens differ for less than ``TOKEN`` characters behind the start of a common span, and each
round adds less than ``CAP`` for a run and less than ``CAP`` for a pair that reach over it; at the other end it is the
same.  With ``EDGE`` = TOKEN + 2 * ROUNDS * CAP = 136 the symbols of a span agree but for 136 characters at either end.
The symbol of least rank in any ``WINDOW`` = 128 characters is an anchor, so the first window behind the edge has its
anchor in both texts, and the ``PROBE`` = 200 characters behind it end within 136 + 128 + 200 = 464 < 500 characters.
Records that agree on the name of those characters are candidates, and no span of ``MIN_CHARS`` escapes.  Names shared by
many records (notices, templates) are narrowed by longer names before any pairs are formed.

Candidates are verified on the stretches around the common names, not on whole texts: every window of ``min_chars``
characters of one side is looked up among those of the other and compared character by character, so that what is
covered is exact in periodic text too, where a record agrees with itself at every period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut, partitions

MIN_CHARS = 500
PROBE = 200
ROUNDS = 3
CAP = 20
TOKEN = 16
EDGE = TOKEN + 2 * ROUNDS * CAP
WINDOW = 128
CHUNK = 1 << 17
_B = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    out = []
    for base in (_B, inverse):
        p = np.ones(n, np.uint64)
        step = 1
        while step < n:
            factor = np.uint64(pow(int(base), step, 1 << 64))
            m = min(step, n - step)
            p[step : step + m] = p[:m] * factor
            step *= 2
        out.append(p)
    return out[0], out[1]


class Powers:
    def __init__(self) -> None:
        self.up, self.down = _powers(1)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(max(n, 2 * len(self.up)))
        return self.up, self.down


_POWERS = Powers()


def _tokens(code: np.ndarray, word: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Start positions of the first symbols: words of at most TOKEN characters, all other characters alone."""
    n = len(code)
    edge = np.ones(n, bool)
    edge[1:] = ~(word[1:] & word[:-1])
    edge[breaks] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, n))
    long = lengths > TOKEN
    if long.any():
        inner = np.repeat(long, lengths)
        edge |= inner
        starts = np.flatnonzero(edge)
    return starts


def _merge(sym: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, group: np.ndarray, name: np.ndarray):
    """Keep one symbol per group; ``group`` marks its members' first, ``name`` holds its name there."""
    heads = np.flatnonzero(group)
    return name[heads], start[heads], np.add.reduceat(size, heads), first[heads]


def recompress(code: np.ndarray, word: np.ndarray, breaks: np.ndarray, rounds: int = ROUNDS, cap: int = CAP):
    """(names, starts) of the top-level symbols of texts that lie one behind the other; ``breaks`` are their starts."""
    up, down = _POWERS.need(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_mix(code.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(code)], out=sums[1:])
    start = _tokens(code, word, breaks)
    end = np.append(start[1:], len(code))
    sym = _mix((sums[end] - sums[start]) * down[start])
    size = end - start
    first = np.zeros(len(code) + 1, bool)
    first[breaks] = True
    first = first[start]
    for k in range(rounds):
        # runs: a symbol equal to its predecessor joins it, unless the whole run would be longer than the cap
        same = np.zeros(len(sym), bool)
        same[1:] = (sym[1:] == sym[:-1]) & ~first[1:]
        if same.any():
            heads = np.flatnonzero(~same)
            total = np.add.reduceat(size, heads)
            count = np.diff(np.append(heads, len(sym)))
            joined = (count > 1) & (total <= cap)
            if joined.any():
                drop = same & np.repeat(joined, count)
                named = sym[heads]
                named = np.where(joined, _mix(named + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), named)
                sym = sym.copy()
                sym[heads] = named
                sym, start, size, first = _merge(sym, start, size, first, ~drop, sym)
        # pairs: a left symbol and the right one behind it
        right = (_mix(sym ^ np.uint64((0x2545F491 * (k + 1)) & _MASK)) >> np.uint64(17)) & np.uint64(1) == 1
        pair = np.zeros(len(sym), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~first[1:] & (size[:-1] + size[1:] <= cap)
        at = np.flatnonzero(pair)
        name = sym.copy()
        name[at] = _mix(sym[at] * np.uint64(0x9FB21C651E98DF25) + _mix(sym[at + 1]))
        group = np.ones(len(sym), bool)
        group[at + 1] = False
        sym, start, size, first = _merge(sym, start, size, first, group, name)
    return sym, start, first, sums


def _least(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values that begin at a position; ``width`` is a power of two."""
    out, step = x, 1
    while step < width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return out


def anchors(sym: np.ndarray, start: np.ndarray, breaks: np.ndarray, length: int, window: int = WINDOW) -> np.ndarray:
    """Starts of the symbols that have the least rank of all that start in some ``window`` characters of their text."""
    if length < window:
        return np.zeros(0, np.int64)
    none = np.iinfo(np.uint32).max
    rank = (_mix(sym ^ np.uint64(0x5DEECE66D)) >> np.uint64(33)).astype(np.uint32)
    dense = np.full(length, none, np.uint32)
    dense[start] = rank
    low = _least(dense, window, np.minimum)
    crossing = np.zeros(len(low), bool)
    for b in breaks[1:]:
        crossing[max(0, b - window + 1) : b] = True
    low[crossing | (low == none)] = 0
    padded = np.concatenate((np.zeros(window - 1, np.uint32), low, np.zeros(window - 1, np.uint32)))
    return start[_least(padded, window, np.maximum)[start] == rank]


def _word_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x3000) if not 0xD800 <= i < 0xE000 and chr(i).isalnum()]] = True
    return table


_TABLE: list[np.ndarray] = []


def probes(texts: list[str], length: int = PROBE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, position of the anchor, name of the ``length`` characters behind it), chunk by chunk."""
    if not _TABLE:
        _TABLE.append(_word_table())
    table = _TABLE[0]
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= CHUNK):
            total += len(texts[hi])
            hi += 1
        sizes = np.array([len(t) for t in texts[lo:hi]])
        code = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        own = np.repeat(np.arange(lo, hi), sizes)
        sym, start, _, sums = recompress(code, table[code], breaks)
        at = anchors(sym, start, breaks, len(code))
        ends = breaks + sizes
        fits = at + length <= ends[own[at] - lo]
        at = at[fits]
        _, down = _POWERS.need(len(code) + 1)
        yield own[at], at - breaks[own[at] - lo], _mix((sums[at + length] - sums[at]) * down[at]).view(np.int64)
        lo = hi


HOT = 48
STEP = 20
MAX_BROADCAST_IDS = 1 << 20


def _hashes(code: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of ``length`` characters."""
    up, down = _POWERS.need(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_mix(code.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(code)], out=sums[1:])
    return (sums[length:] - sums[:-length]) * down[: len(code) - length + 1]


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _extent(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name once, with its first and last place."""
    names, where = np.unique(key, return_inverse=True)
    lo, hi = np.full(len(names), np.iinfo(np.int32).max, np.int32), np.zeros(len(names), np.int32)
    np.minimum.at(lo, where, at)
    np.maximum.at(hi, where, at)
    return names, lo, hi


def _texts_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text) for a join with ``rows`` by doc: the ids go to all executors only if a count proves them few, so that no other text is shuffled."""
    ids = cut(rows.select("doc").distinct())
    texts = docs.select("doc", "text")
    return texts.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= MAX_BROADCAST_IDS else texts


def _probe_rows(docs: DataFrame) -> DataFrame:
    """(key, doc, lo, hi, same, same2): the names of a text's probes, each once; the last two columns name the whole text."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("same", pa.int64()), ("same2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same, same2 = (batch.column(k).to_numpy() for k in (0, 2, 3))
            for own, at, key in probes(batch.column(1).to_pylist()):
                if not len(own):
                    continue
                order = np.lexsort((at, key, own))
                own, at, key = own[order], at[order], key[order]
                heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
                tails = np.append(heads[1:], len(own)) - 1
                of = own[heads]
                columns = (key[heads], ids[of], at[heads].astype(np.int32), at[tails].astype(np.int32), same[of], same2[of])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.select("doc", "text", "same", "same2").mapInArrow(run, "key long, doc long, lo int, hi int, same long, same2 long")


def _longer_names(hot: DataFrame, docs: DataFrame, length: int, min_chars: int) -> DataFrame:
    """Names held by many texts, replaced by names of ``length`` characters at every grid offset that a span may have.

    A probe lies r characters behind the start of a span, 0 <= r <= min_chars - PROBE.  Of the offsets at distances of
    min_chars - length one lies in [-r, min_chars - length - r], so that the longer name lies within the span too.
    """
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    step = min_chars - length
    offsets = np.arange(-((min_chars - PROBE + step - 1) // step) * step, 1, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, keys, text in zip(*(c.to_pylist() for c in batch.columns)):
                wanted = np.array(keys, np.int64)
                for _, places, key in probes([text]):
                    code = _code(text)
                    at = np.unique((places[np.isin(key, wanted)][:, None] + offsets[None, :]).ravel())
                    at = at[(at >= 0) & (at + length <= len(code))]
                    if len(at):
                        names, lo, hi = _extent(_mix(_hashes(code, length)[at] + np.uint64(length)).view(np.int64), at)
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), doc)), pa.array(lo), pa.array(hi)], schema=schema)

    # a text's own names are the most that one row gathers
    placed = cut(hot.groupBy("doc").agg(F.collect_set("key").alias("keys")))
    return placed.join(_texts_of(placed, docs), "doc").select("doc", "keys", "text").mapInArrow(run, "key long, doc long, lo int, hi int")


def _candidates(named: DataFrame) -> DataFrame:
    """(a, b, lo_a, hi_a, lo_b, hi_b): any two texts with a common name and where such names lie in them."""
    left = named.select("key", F.col("doc").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = named.select("key", F.col("doc").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    return left.join(right.hint("merge"), "key").where("a < b").drop("key")


def common(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Starts in ``a`` of the windows of ``least`` characters that ``b`` holds too, compared character by character."""
    if len(a) < least or len(b) < least:
        return np.zeros(0, np.int64)
    ha, hb = _hashes(a, least), _hashes(b, least)
    order = np.argsort(hb, kind="stable")
    at = np.searchsorted(hb, ha, sorter=order)
    at[at == len(hb)] = 0
    hits = np.flatnonzero(hb[order[at]] == ha)
    partner = order[at[hits]]
    good = np.zeros(len(hits), bool)
    # a window that follows on a proven one in both texts needs only its last character
    follows = np.zeros(len(hits), bool)
    follows[1:] = (np.diff(hits) == 1) & (np.diff(partner) == 1)
    for k in np.flatnonzero(~follows):
        good[k] = np.array_equal(a[hits[k] : hits[k] + least], b[partner[k] : partner[k] + least])
    last = a[hits + least - 1] == b[partner + least - 1]
    run = np.cumsum(~follows)
    broken = np.unique(run[(follows & ~last) | (~follows & ~good)])
    sure = ~np.isin(run, broken)
    for k in np.flatnonzero(~sure):  # a run with two different windows of one name: each window on its own
        sure[k] = np.array_equal(a[hits[k] : hits[k] + least], b[partner[k] : partner[k] + least])
    return hits[sure]


def _stretches(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, length) of the union of the windows."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > least)
    lo, hi = starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)] + least
    return [(int(x), int(y - x)) for x, y in zip(lo, hi)]


def _verify(candidates: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """(a, b, side, start, length): what either text of a pair holds of the other, ``side`` 0 for a and 1 for b.

    Only the stretches around the common names are sent: each text goes once to its pairs, and what is shuffled after
    that are the pieces.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("side", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
    pairs = cut(candidates.groupBy("a", "b").agg(F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"), F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b")))
    wanted = F.explode(F.array(F.struct(F.col("a").alias("doc"), F.lit(0).alias("side"), F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")), F.struct(F.col("b").alias("doc"), F.lit(1).alias("side"), F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi"))))
    sides = pairs.select("a", "b", wanted.alias("x")).select("a", "b", "x.*")
    begin = F.greatest(F.col("lo") - min_chars, F.lit(0))
    cutout = F.expr(f"substring(text, cast(greatest(lo - {min_chars}, 0) as int) + 1, cast(hi - greatest(lo - {min_chars}, 0) + {2 * min_chars} as int))")
    pieces = sides.join(_texts_of(sides, docs), "doc").select("a", "b", "side", begin.cast("int").alias("begin"), cutout.alias("piece"))
    first, second = (pieces.where(F.col("side") == k).select("a", "b", F.col("begin").alias(f"begin_{k}"), F.col("piece").alias(f"piece_{k}")) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int]] = [[] for _ in schema]
            for a, b, begin_a, begin_b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                ca, cb = _code(ta), _code(tb)
                for side, starts, offset in ((0, common(ca, cb, min_chars), begin_a), (1, common(cb, ca, min_chars), begin_b)):
                    for start, length in _stretches(starts, min_chars):
                        for column, value in zip(rows, (a, b, side, offset + start, length)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    both = first.join(second.hint("shuffle_hash"), ["a", "b"])
    return both.select("a", "b", "begin_0", "begin_1", "piece_0", "piece_1").mapInArrow(run, "a long, b long, side int, start int, length int")


def _named(documents: DataFrame, min_chars: int) -> DataFrame:
    return documents.where(F.length("text") >= min_chars).select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("same"), F.xxhash64(F.lit(1), "text").alias("same2"))


def shared_spans(documents: DataFrame, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(a, b, side, start, length): the stretches of one text that lie in spans of ``min_chars`` which the other holds too.

    ``side`` 0 tells a's stretches, 1 those of b; they do not overlap.  Equal texts are represented by their smallest id;
    ``members`` gives the copies.  Null texts and texts under ``min_chars`` share nothing.
    """
    if min_chars < EDGE + WINDOW + PROBE:
        raise ValueError(f"spans of less than {EDGE + WINDOW + PROBE} characters may hold no anchor")
    docs = _named(documents, min_chars)
    n = partitions(documents.sparkSession)
    # of equal texts the smallest id stands for all; a name of one text only is dropped before anything is joined
    rows = _probe_rows(docs).repartition(n, "key").groupBy("key", "same", "same2").agg(F.min("doc").alias("doc"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # the count asks for every column, so that both uses of the rows are the same exchange and the texts are named once
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("d"), F.min("lo").alias("l"), F.max("hi").alias("h")).where("n > 1 and d is not null and l <= h")
    shared = cut(rows.join(counts.select("key", "n"), "key").select("key", "doc", "lo", "hi", (F.col("n") > hot).alias("hot")))
    found = _candidates(shared.where(~F.col("hot")))
    heavy = shared.where("hot")
    if heavy.limit(1).count():
        found = found.unionByName(_candidates(_longer_names(heavy, docs, min_chars - STEP, min_chars)))
    return _verify(found, docs, min_chars)


def members(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rep, doc): each text's representative, the smallest id with an equal text; texts are compared by 128 bits."""
    docs = _named(documents, min_chars).select("doc", "same", "same2")
    reps = docs.groupBy("same", "same2").agg(F.min("doc").alias("rep"))
    return cut(docs.join(reps, ["same", "same2"]).select("rep", "doc"))


def sharing_pairs(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_a, doc_b) of any two documents that share a span, copies included."""
    spans = shared_spans(documents, min_chars).where("side = 0").select("a", "b").distinct()
    group = members(documents, min_chars)
    across = (
        spans.join(group.select(F.col("rep").alias("a"), F.col("doc").alias("x")), "a")
        .join(group.select(F.col("rep").alias("b"), F.col("doc").alias("y")), "b")
        .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    )
    within = group.select("rep", F.col("doc").alias("doc_a")).join(group.select("rep", F.col("doc").alias("doc_b")), "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.union(within)


def shared_shares(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_partners): how much of each document lies in spans that other documents hold too.

    ``n_partners`` counts different texts; documents that share nothing come out with 0.
    """
    spans = cut(shared_spans(documents, min_chars))
    own = lambda x, y: F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y))
    sides = spans.select(own("a", "b").alias("rep"), F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi"), own("b", "a").alias("other"))
    # sorted intervals folded to the length of their union; their number is bounded by the spans of one text
    packed = sides.groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("parts"), F.countDistinct("other").alias("n_partners"))
    fold = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["hi"]).alias("end"), (acc["sum"] + F.greatest(x["hi"] - F.greatest(acc["end"], x["lo"]), F.lit(0))).alias("sum")),
        lambda acc: acc["sum"],
    )
    covered = packed.select("rep", fold.alias("covered"), "n_partners")
    group = members(documents, min_chars)
    sizes = group.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    own = group.join(sizes, "rep").join(covered, "rep", "left").select(F.col("doc").alias("doc_id"), "copies", "covered", "n_partners")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return base.join(own, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"),
        F.coalesce("n_partners", F.lit(0)).cast("int").alias("n_partners"),
    )
