import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import neighbours as N

SCHEMA = "id long, embedding array<float>"


def table(spark, rows):
    return N.usable(spark.createDataFrame(rows, SCHEMA), "id", {"f": "embedding"})


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    for i in range(0, n - 1, 7):
        x[i + 1] = x[i] + rng.standard_normal(64) * 0.12
    return x


def test_pairs_against_brute_force(spark):
    x = vectors(400)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [float(v) for v in x[3]]), (901, [float(v * 5) for v in x[3]])]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = [r[0] for r in rows]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))}
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(table(spark, rows + rows[:5]), 0.95).collect()}
    assert got == want and len(want) > 40


def test_unusable_vectors_take_no_part(spark):
    good = [1.0] + [0.0] * 63
    rows = [(1, good), (2, good), (3, None), (4, [0.0] * 64), (5, [float("nan")] + good[1:]), (6, [1.0] * 32), (7, [float("inf")] + good[1:]), (8, [None] + good[1:]), (None, good)]
    assert [(r.id_a, r.id_b, r.cosine) for r in N.similar_pairs(table(spark, rows), 0.95).collect()] == [(1, 2, 1.0)]
    empty = table(spark, [])
    assert N.similar_pairs(empty, 0.95).count() == 0 and N.nearest(empty, empty).count() == 0


def test_recall_of_nearest(spark):
    x = vectors(1500, 3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    t = table(spark, rows)
    got = {}
    for r in N.nearest(t, t.where("id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 100):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len(got[q] & set(np.argsort(-cos)[:10].tolist()))
    assert hits / 150 >= 0.9


def test_plan_follows_size_and_angle():
    small, large = N.plan(10**4, N.differing(0.95)), N.plan(10**8, N.differing(0.95))
    assert large[0] > small[0] and large[1] > small[1]
    differ = math.acos(0.95) / math.pi
    assert (1 - (1 - differ) ** small[0]) ** small[1] <= 1e-3


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], SCHEMA).withColumn("vec", F.lit(1)).withColumn("field", F.lit("x"))
    assert N.usable(df, "id", {"f": "embedding"}).count() == 1


@pytest.mark.parametrize("rows", [1, 2])
def test_tiny_tables(spark, rows):
    assert N.similar_pairs(table(spark, [(i, [float(i + 1), 1.0] + [0.0] * 62) for i in range(rows)]), 0.5).count() == rows - 1


def brute(rows):
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))}


@pytest.mark.parametrize("shift, hot", [(2.0, 2048), (0.0, 3), (2.0, 3)])
def test_shifted_vectors_and_full_slots(spark, shift, hot):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(vectors(600, 5) + shift)]
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(table(spark, rows), 0.95, hot=hot).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60


def test_planes_go_through_the_mean_where_that_is_cheaper():
    x = np.random.default_rng(2).standard_normal((4000, 64))
    for shift, moved in ((0.0, False), (2.0, True)):
        y = x + shift
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        middle, differ = N.centre(y, 20_000, 0.95)
        assert bool(np.abs(middle).sum() > 0.5) == moved and (differ > 0.15) == moved
