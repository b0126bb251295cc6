"""Evaluation texts leaking into training text.

Method: prefix-filtered set join.  The shingles of an item are its windows of ``words`` consecutive words.  Words are
ordered by rarity, counted over all documents, and of every window only its rarest word goes into the index: a document
that contains the window contains that word, so the join on these prefix words loses nothing.  A hit fixes where the
window would have to lie; the bounds on length and position are applied, and the window is then verified word by word
and grown to the whole stretch that both texts share.

Words are compared without regard to case, punctuation, white space, comment and line marks, markup, invisible
characters and the way characters are composed.  Null and blank texts hold no words; an item of fewer than ``words``
words cannot leak.  Items are a stated query set: they go to all executors in blocks whose size is bounded.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 13
BLOCK_BYTES = 8 << 20
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--|-->")
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿\x00-\x08\x0e-\x1b\x7f]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Comparable words of a text."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    else:
        text = _INVISIBLE.sub("", text).lower()
    return _WORD.findall(text)


class Index:
    """The windows of one block of items: prefix word -> (item, position of the word in its passage)."""

    def __init__(self, passages: list[list[str]], frequency: dict[str, int], size: int):
        self.passages, self.size = passages, size
        self.at: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for item, passage in enumerate(passages):
            order = [(frequency.get(w, 0), w) for w in passage]
            for start in range(len(passage) - size + 1):
                rarest = min(range(start, start + size), key=lambda k: (order[k], k))
                self.at[passage[rarest]].add((item, rarest))

    def matches(self, doc: list[str]) -> dict[int, int]:
        """Item -> the longest stretch of words shared with it, where that is at least ``size``."""
        found: dict[int, int] = {}
        n, size = len(doc), self.size
        if n < size:
            return found
        done: set[tuple[int, int]] = set()
        for i in [i for i, w in enumerate(doc) if w in self.at]:
            for item, p in self.at[doc[i]]:
                passage = self.passages[item]
                shift = i - p
                # positional bound: the overlap of document and passage on this diagonal must hold a window
                if min(n, shift + len(passage)) - max(0, shift) < size or (item, i - p, i) in done:
                    continue
                a = i
                while a > 0 and a - shift > 0 and doc[a - 1] == passage[a - 1 - shift]:
                    a -= 1
                b = i + 1
                while b < n and b - shift < len(passage) and doc[b] == passage[b - shift]:
                    b += 1
                for k in range(i, b):
                    done.add((item, shift, k))
                if b - a >= size:
                    found[item] = max(found.get(item, 0), b - a)
        return found


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, weight = [], 0
    for row in items.toLocalIterator():
        passage = words(row["passage"])
        weight += sum(map(len, passage)) + 64
        block.append((row["item_id"], passage))
        if weight >= limit:
            yield block
            block, weight = [], 0
    if block:
        yield block


def _frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """Number of documents that hold each word of the vocabulary, over all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        keep = known.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(keep.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def leaks(docs: DataFrame, items: DataFrame, size: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, shared_words): the items of which a document holds at least ``size`` consecutive words."""
    out: DataFrame | None = None
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared_words", pa.int32())])
    clean = items.select(F.col("item_id").cast("long"), "passage").where(F.col("item_id").isNotNull())
    for block in _blocks(clean, block_bytes):
        passages = [p for _, p in block]
        frequency = _frequencies(docs, frozenset(w for p in passages for w in p))
        shared = spark.sparkContext.broadcast((Index(passages, frequency, size), [i for i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for batch in batches:
                rows: list[list] = [[], [], []]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item, n in index.matches(words(text)).items():
                        for column, value in zip(rows, (doc_id, ids[item], n)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

        part = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(run, "doc_id long, item_id long, shared_words int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, shared_words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("shared_words").alias("shared_words"))
