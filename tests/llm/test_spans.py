import random

import numpy as np
import pytest

from loomgraph.llm import spans as S

SCHEMA = "doc_id long, text string"


def brute(texts, least):
    seen, out = {}, set()
    for doc, text in texts:
        for i in range(len(text or "") - least + 1):
            seen.setdefault(text[i : i + least], set()).add(doc)
    for docs in seen.values():
        out |= {(a, b) for a in docs for b in docs if a < b}
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeопр") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(400) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    for k in range(30):
        source = rng.choice(base)
        at, n = rng.randrange(0, 600), rng.choice([480, 499, 500, 501, 520, 700])
        out.append((100 + k, text(rng.randrange(0, 90)) + source[at : at + n] + text(rng.randrange(0, 90))))
    out += [(200, base[0]), (201, base[0]), (300, None), (301, ""), (302, "-" * 700), (303, "x" + "-" * 900), (304, "ab" * 400), (305, "y" + "ab" * 300), (306, "".join(rng.choice("abc") for _ in range(1200)))]
    out.append((307, out[-1][1][300:1000]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(texts, SCHEMA).selectExpr("*", "1 AS key", "2 AS a")
    assert {(r.doc_a, r.doc_b) for r in S.sharing_pairs(df).collect()} == brute(texts, 500)


def test_hot_names_take_the_longer_way(spark):
    notice = corpus(5)[0][1][:450]
    rng = random.Random(9)
    filler = lambda: "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [(i, filler() + notice + filler()) for i in range(20)]
    texts += [(50, texts[0][1][200:900]), (51, texts[1][1][:760])]
    got = {(r.a, r.b) for r in S.shared_spans(spark.createDataFrame(texts, SCHEMA), hot=3).collect()}
    assert got == brute(texts, 500) and got


def test_shares(spark):
    texts = corpus(3)
    got = {r.doc_id: r for r in S.shared_shares(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert set(got) == {d for d, _ in texts} and all(0 <= r.shared_chars <= r.n_chars for r in got.values())
    assert got[200].shared_chars == got[200].n_chars and got[300].shared_chars == 0
    assert S.sharing_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def covered(texts, doc, least):
    """Positions of a text that lie in a window which another, different text holds too."""
    text = dict(texts)[doc]
    other = {t[i : i + least] for d, t in texts if t and t != text for i in range(len(t) - least + 1)}
    hit = [False] * len(text)
    for i in range(len(text) - least + 1):
        if text[i : i + least] in other:
            hit[i : i + least] = [True] * least
    return sum(hit)


def test_coverage_is_exact_in_periodic_text(spark):
    rng = random.Random(11)
    texts = []
    for k, period in enumerate((1, 2, 7, 33, 81, 210)):
        unit = "".join(rng.choice("abcdefgh пр") for _ in range(period))
        texts += [(1000 + 10 * k, "begin " + (unit * 4000)[:3000] + " end"), (1001 + 10 * k, "other " + (unit * 4000)[:600])]
    texts += corpus(4)[:20]
    got = {r.doc_id: r.shared_chars for r in S.shared_shares(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert {d: got[d] for d, _ in texts if d >= 1000} == {d: covered(texts, d, 500) for d, _ in texts if d >= 1000}
    assert got[1010] >= 3000


def test_every_span_has_a_common_anchor():
    """The bound of the module's text: whatever surrounds a span, some probe inside it is the same."""
    rng = random.Random(3)
    for k in range(300):
        letters = rng.choice(["ab", "abc ", "abcdefgh ", "a", "ab cd.\n", "xyzабв 0"])
        span = "".join(rng.choice(letters) for _ in range(500))
        if k % 3 == 0:
            unit = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 90)))
            span = (unit * 500)[:500]
        found = []
        for _ in range(2):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))
            whole = text + span + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))
            found.append({(int(p) - len(text), int(n)) for _, at, names in S.probes([whole]) for p, n in zip(at, names) if len(text) <= p <= len(text) + 300})
        assert found[0] & found[1]


def test_equal_substrings_have_equal_interior_symbols():
    rng = random.Random(4)
    span = "".join(rng.choice("abcdefgh ") for _ in range(600))
    names = []
    for _ in range(2):
        text = "".join(rng.choice("xyz ") for _ in range(rng.randrange(50, 90))) + span + "".join(rng.choice("xyz ") for _ in range(50))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sym, start, _, _ = S.recompress(code, np.array([chr(c).isalnum() for c in code]), np.array([0]))
        names.append(sym.tolist())
    assert len(set(names[0]) & set(names[1])) > 30
