"""Splitting oversized texts at natural boundaries.

Method: every natural boundary (after a blank line, a line, a sentence, white space) of every long text of a batch gets
its farthest legal successor: the farthest boundary of the strongest kind that keeps the piece, overlap included, under
the limit.  The successor table is then squared again and again; the cuts reached from each text's start double with
every squaring, so all greedy cuts of all texts come out in a logarithmic number of array operations.

Where white space is lacking over the whole reach, a hard cut falls exactly at the reach; such positions join the
boundaries beforehand.  Each piece after the first begins exactly ``overlap`` characters before the end of the one before.
Characters are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200
# fixed values: white space as the language's str.isspace has it
_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?;:…。！？"], np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions behind white space, strength 0..3 with 0 the strongest, length of the longest run without white space)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(code, _SPACE)
    marks = np.flatnonzero(space)
    longest = int(np.diff(np.concatenate(([-1], marks, [len(code)]))).max()) - 1
    last = space & ~np.append(space[1:], False)
    ends = np.flatnonzero(last) + 1
    starts = np.flatnonzero(space & ~np.insert(space[:-1], 0, False))
    newlines = np.concatenate(([0], np.cumsum(code == 10)))
    lines = newlines[ends] - newlines[starts]
    before = np.where(starts > 0, code[np.maximum(starts - 1, 0)], 0)
    strength = np.where(lines > 1, 0, np.where(lines == 1, 1, np.where(np.isin(before, _STOPS), 2, 3)))
    inner = ends < len(code)
    return ends[inner], strength[inner], longest


def _nodes(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted nodes of one text: the start (at ``overlap``, as if a piece had ended there), boundaries, hard cuts, the end."""
    at, strength, longest = boundaries(text)
    size, reach = len(text), limit - overlap
    keep = at > overlap
    at, strength = at[keep], strength[keep]
    pos = np.concatenate(([overlap], at, [size]))
    kind = np.concatenate(([4], strength, [0]))
    gaps = np.flatnonzero(np.diff(pos) > reach)
    if len(gaps):
        extra = np.concatenate([np.arange(pos[g] + reach, pos[g + 1], reach) for g in gaps])
        pos, kind = np.concatenate((pos, extra)), np.concatenate((kind, np.full(len(extra), 4)))
        order = np.argsort(pos, kind="stable")
        pos, kind = pos[order], kind[order]
    return pos, kind, size, longest


def successors(pos: np.ndarray, kind: np.ndarray, reach: int) -> np.ndarray:
    """Index of each node's farthest legal successor; the last node leads to itself."""
    n = len(pos)
    far = np.searchsorted(pos, pos + reach, side="right") - 1
    best = far.copy()
    best[far == n - 1] = n - 1
    open_ = far < n - 1
    for strength in (2, 1, 0):
        own = np.flatnonzero(kind <= strength)
        own = own[own < n - 1]
        if not len(own):
            continue
        k = np.searchsorted(own, far, side="right") - 1
        candidate = np.where(k >= 0, own[np.maximum(k, 0)], -1)
        good = open_ & (candidate >= 0) & (pos[np.maximum(candidate, 0)] > pos + reach // 2)
        best[good] = candidate[good]
    best[n - 1] = n - 1
    return best


def greedy_cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[list[tuple[int, int]], int]]:
    """For each text its pieces (start, end) and its longest run without white space; all texts are cut at once."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    parts, tables, first, base = [], [], [], 0
    for text in texts:
        if len(text) <= limit:
            parts.append(None)
            continue
        pos, kind, size, longest = _nodes(text, limit, overlap)
        tables.append(successors(pos, kind, limit - overlap) + base)
        parts.append((pos, base, longest))
        first.append(base)
        base += len(pos)
    if tables:
        jump, reached = np.concatenate(tables), np.zeros(base, bool)
        front = np.array(first)
        reached[front] = True
        while True:
            grown = np.flatnonzero(reached)
            new = jump[grown]
            if reached[new].all():
                break
            reached[new] = True
            jump = jump[jump]
    out = []
    for text, part in zip(texts, parts):
        if part is None:
            out.append(([(0, len(text))], 0))
            continue
        pos, at, longest = part
        cuts = pos[np.flatnonzero(reached[at : at + len(pos)])]
        out.append(([(int(a) - overlap, int(b)) for a, b in zip(cuts, cuts[1:])], longest))
    return out


def split_long(texts: DataFrame, text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The key columns of ``texts`` with (piece_no, start, piece, hard_cut), for each text longer than ``limit``.

    ``hard_cut`` is 1 where the text has a run of more than ``limit`` characters without white space.  Null texts and
    texts within the limit give no row; repeated rows count once.
    """
    keys = [c for c in texts.columns if c != text_col]
    schema = ", ".join(f"`{texts.schema[c].name}` {texts.schema[c].dataType.simpleString()}" for c in keys)
    long = texts.where(F.length(text_col) > limit).dropDuplicates([*keys, text_col])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                rows = batch.iloc[lo : lo + 64]
                body = rows[text_col].tolist()
                found = greedy_cuts(body, limit, overlap)
                take = np.repeat(np.arange(len(rows)), [len(pieces) for pieces, _ in found])
                out = rows[keys].iloc[take].reset_index(drop=True)
                out["piece_no"] = np.concatenate([np.arange(len(pieces), dtype=np.int32) for pieces, _ in found])
                out["start"] = [a for pieces, _ in found for a, _ in pieces]
                out["piece"] = [text[a:b] for text, (pieces, _) in zip(body, found) for a, b in pieces]
                out["hard_cut"] = np.repeat(np.array([longest > limit for _, longest in found], np.int32), [len(pieces) for pieces, _ in found])
                yield out

    return long.select(*keys, text_col).mapInPandas(run, f"{schema}, piece_no int, start int, piece string, hard_cut int")
