import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import windows as W


def greedy(text, limit, overlap):
    """The same cuts one after the other."""
    at, strength, _ = W.boundaries(text)
    out, end, n = [], overlap, len(text)
    reach = limit - overlap
    while end < n:
        top = end + reach
        if top >= n:
            new = n
        else:
            fits = [(p, s) for p, s in zip(at.tolist(), strength.tolist()) if end < p <= top]
            new = fits[-1][0] if fits else top
            for s in (0, 1, 2):
                strong = [p for p, k in fits if k <= s]
                if strong and strong[-1] > end + reach // 2:
                    new = strong[-1]
                    break
        out.append((end - overlap, new))
        end = new
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r\u00a0я\U0001f600", min_size=31, max_size=300), st.integers(0, 9))
def test_same_as_greedy(text, overlap):
    pieces, longest = W.greedy_cuts([text], 30, overlap)[0]
    assert pieces == greedy(text, 30, overlap)
    assert longest == max(len(r) for r in re.split(r"\s", text))
    assert all(b - a <= 30 for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(later[0] == earlier[1] - overlap for earlier, later in zip(pieces, pieces[1:]))


def test_rows(spark):
    long = "word " * 1000
    rows = [("f", 1, "", long), ("f", 1, "", long), ("f", 2, "", "x" * 4001), ("f", 3, "en", "x" * 4000), ("f", 4, None, None), ("f", 5, "", "")]
    df = spark.createDataFrame(rows, "field_name string, node_id long, locale string, text string")
    out = W.split_long(df).collect()
    assert {(r.node_id, r.hard_cut) for r in out} == {(1, 0), (2, 1)}
    first = sorted((r for r in out if r.node_id == 1), key=lambda r: r.piece_no)
    assert "".join(r.piece if not r.piece_no else r.piece[200:] for r in first) == long
    assert W.split_long(df.limit(0)).count() == 0
