"""Encoding of texts with a public byte-level BPE vocabulary.

Method: a word's parts lie in one contiguous array beside the ranks of each pair of adjacent parts.  The smallest rank is
looked for again and again; the boundary between its parts is deleted and the two neighbouring ranks are refreshed.  The
new words of a batch are rows of one matrix, so that each step scans and refreshes all of them at once.  For words longer
than ``SHORT`` bytes, where scanning would be quadratic, a heap finds the same minimum.

A text that is null or empty has an empty list.  Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import array
import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
SHORT = 96
CACHE_WORDS = 400_000
BATCH = 2000
_NONE = 1 << 60


def _ranges(member: Callable[[str], bool]) -> str:
    """Inside of a character class with all code points of which ``member`` holds."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and member(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


class Splitter:
    """Words as the public vocabulary's pattern defines them.

    Built-in classes are several times faster than classes of hundreds of ranges.  They mean the same unless a text
    holds a number that is no decimal digit or one of four separators, and only such texts take the exact classes.
    """

    def __init__(self) -> None:
        letters, numbers = _ranges(lambda c: unicodedata.category(c)[0] == "L"), _ranges(lambda c: unicodedata.category(c)[0] == "N")
        # fixed values: characters with the property White_Space
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        odd = _ranges(lambda c: unicodedata.category(c) in ("No", "Nl") or "\x1c" <= c <= "\x1f")
        self.odd = re.compile(f"[{odd}]").search
        self.plain = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall
        self.quick = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.exact = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def __call__(self, text: str) -> list[str]:
        if self.odd(text):
            return self.exact(text)
        return self.plain(text) if text.isascii() else self.quick(text)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, whose size is checked since it goes to every executor."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while adjacent:
        low = min(adjacent)
        if low == _NONE:
            break
        at = adjacent.index(low)
        del bounds[at + 1], adjacent[at]
        if at < len(adjacent):
            adjacent[at] = ranks.get(word[bounds[at] : bounds[at + 2]], _NONE)
        if at:
            adjacent[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], _NONE)
    return tuple(ranks[word[a:b]] for a, b in zip(bounds, bounds[1:]))


class Pairs:
    """Rank of the union of two adjacent parts, by their own ranks; a rank is the id of the merged part."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)


def merge_many(words: list[bytes], pairs: Pairs, block: int = 4096) -> list[tuple[int, ...]]:
    """Ids of many short words, a block of words of like length at a time."""
    out: list[tuple[int, ...]] = [()] * len(words)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for lo in range(0, len(order), block):
        rows = np.array(order[lo : lo + block])
        sizes = np.array([len(words[k]) for k in rows])
        width = int(sizes[-1])
        flat = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width)
        parts = pairs.byte[flat]
        columns = np.arange(width)
        adjacent = np.full((len(rows), width), _NONE, np.int64)
        if width > 1:
            adjacent[:, :-1] = pairs.ranks(parts[:, :-1], parts[:, 1:])
            adjacent[columns[None, :] >= sizes[:, None] - 1] = _NONE
        while len(rows):
            at = adjacent.argmin(axis=1)
            low = adjacent[np.arange(len(rows)), at]
            over = low == _NONE
            if over.any():
                for k, n, ids in zip(rows[over].tolist(), sizes[over].tolist(), parts[over].tolist()):
                    out[k] = tuple(ids[:n])
                go = ~over
                rows, sizes, parts, adjacent, at, low = rows[go], sizes[go], parts[go], adjacent[go], at[go], low[go]
                if not len(rows):
                    break
            # the boundary behind the part goes: everything to its right moves up by one
            line = np.arange(len(rows))
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, 1)
            adjacent = np.take_along_axis(adjacent, source, 1)
            parts[line, at] = low
            sizes = sizes - 1
            adjacent[line, width - 1] = _NONE
            right = at + 1 < sizes
            adjacent[line, at] = np.where(right, pairs.ranks(low, parts[line, np.minimum(at + 1, width - 1)]), _NONE)
            left = at > 0
            before = np.maximum(at - 1, 0)
            adjacent[line[left], before[left]] = pairs.ranks(parts[line[left], before[left]], low[left])
    return out


def merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges with a heap over a linked list of parts."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (rank := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        if (h := before[i]) >= 0 and (rank := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (rank, h, stop))
    return tuple(ranks[word[i : end[i]]] for i in range(n) if alive[i])


class Encoder(dict):
    """Word to ids; what was encoded once is kept, as long as there is room."""

    def __init__(self, data: bytes):
        super().__init__()
        self.ranks = parse_vocabulary(data)
        self.pairs = Pairs(self.ranks)
        self.split = Splitter()

    def __missing__(self, word: str) -> tuple[int, ...]:
        return merge_long(word.encode("utf-8"), self.ranks)

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of split texts that are not known yet; words that are too long are never kept."""
        if len(self) >= CACHE_WORDS:
            self.clear()
        rest = []
        for word in set(chain.from_iterable(texts)).difference(self):
            raw = word.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self[word] = (whole,)
            elif len(raw) <= SHORT:
                rest.append((word, raw))
        for (word, _), ids in zip(rest, merge_many([raw for _, raw in rest], self.pairs)):
            self[word] = ids

    def encode_batch(self, texts: list[str | None]) -> Iterator[Iterator[int]]:
        words = [self.split(text) if text else [] for text in texts]
        self.learn(words)
        return (chain.from_iterable(map(self.__getitem__, w)) for w in words)

    def encode(self, text: str | None) -> Iterator[int]:
        return next(self.encode_batch([text]))


_ENCODERS: dict[int, Encoder] = {}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) for every row; other columns are left out, so clashing names do no harm."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = data.value
        encoder = _ENCODERS.get(hash(raw))
        if encoder is None:
            encoder = _ENCODERS[hash(raw)] = Encoder(raw)
        for batch in batches:
            flat, ends = array.array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for lo in range(0, batch.num_rows, BATCH):
                for k, ids in enumerate(encoder.encode_batch(batch.column(1).slice(lo, BATCH).to_pylist()), lo):
                    flat.extend(ids)
                    ends[k + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
