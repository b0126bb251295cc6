import random

import pytest

from loomgraph.operators import hierarchy as H

SCHEMA = "id long, parent_id long, kind string"


def brute(links):
    out = {}
    for node in links:
        chain, at = [], node
        while at is not None and at in links and at not in chain:
            chain.append(at)
            at = links[at]
        if at is not None and at in links:
            out[node] = ("cycle", min(chain[chain.index(at) :]))
        else:
            out[node] = ("path", chain[::-1])
    return out


def solved(df):
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"contract_below": 1.1}, {"contract_below": 0.0}])
def test_random_forests_with_cycles(spark, how):
    rng = random.Random(7)
    links = {i: (rng.choice([None, rng.randrange(60), 999]) if i % 3 else max(0, i - 1)) for i in range(60)}
    links[0], links[30], links[31] = None, 31, 30
    rows = [(i, p, "X") for i, p in links.items()]
    found = solved(H.hierarchy(spark.createDataFrame(rows + rows[:9], SCHEMA), **how))
    want = brute(links)
    assert set(found) == set(links)
    for node, (what, value) in want.items():
        row = found[node]
        if what == "cycle":
            assert row.cycle_id == value and row.path is None and row.depth is None and row.root is None
        else:
            assert row.cycle_id is None and list(row.path) == value and row.depth == len(value) - 1 and row.root == value[0]
            below = [n for n, (w, v) in want.items() if w == "path" and node in v]
            assert row.subtree_size == len(below)


def test_deep_chain_self_parent_and_missing_parent(spark):
    rows = [(i, i - 1 if i else None, "X") for i in range(400)] + [(2000 + i, 1999 + i if i % 50 else 3 * i, "X") for i in range(200)] + [(1000, 1000, "X"), (1001, 1000, "X"), (1002, 5555, "X")]
    found = solved(H.hierarchy(spark.createDataFrame(rows, SCHEMA)))
    assert found[399].depth == 399 and found[0].subtree_size == 550 and found[390].subtree_size == 10 and list(found[399].path) == list(range(400)) and found[2149].depth == 350
    assert found[1000].cycle_id == 1000 and found[1001].cycle_id == 1000
    assert found[1002].depth == 0 and found[1002].root == 1002


def test_rest_of_nothing_but_rings_is_solved_by_doubling(spark):
    rows = [(i, (i + 1) % 40, "X") for i in range(40)] + [(205, 20, "X"), (300, 305, "X"), (310, 305, "X"), (305, 304, "X")] + [(300 + k, 300 + k - 1, "X") for k in (1, 2, 3, 4)] + [(100 + i, 100 + (i + 1) % 7, "X") for i in range(7)]
    found = solved(H.hierarchy(spark.createDataFrame(rows, SCHEMA)))
    assert {found[i].cycle_id for i in range(40)} == {0} and {found[100 + i].cycle_id for i in range(7)} == {100}
    assert found[205].cycle_id == 0 and {found[i].cycle_id for i in (300, 301, 304, 305, 310)} == {300}


def test_nulls_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, 1, "a"), (1, None, None), (2, 1, "b"), (2, 1, "b")], SCHEMA).selectExpr("*", "id AS root", "kind AS path")
    found = solved(H.hierarchy(df))
    assert set(found) == {1, 2} and list(found[2].path) == [1, 2]
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.cycles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_descendants(spark):
    tree = H.hierarchy(spark.createDataFrame([(1, None, "x"), (2, 1, "x"), (3, 2, "x"), (4, 1, "x")], SCHEMA))
    got = {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(tree).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)}
