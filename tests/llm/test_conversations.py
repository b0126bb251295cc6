import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import conversations as C

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "conversation_id string, type string, content string, metadata string, timestamp timestamp"


def rows(conv, turns):
    return [(conv, t, c, f'{{"seq": {i}}}', T0 + timedelta(seconds=i // 2)) for i, (t, c) in enumerate(turns)]


CASES = {
    "good": ([("USER", "a"), ("ai", "b"), (" User", "c"), ("Assistant ", "d")], True), "system": ([("SYSTEM", "s"), ("HUMAN", "a"), ("tool", "x"), ("AI", "b")], True), "repeat": ([("USER", "a"), ("user ", "a"), ("AI", "b"), ("ASSISTANT", "b")], True),
    "late repeat": ([("USER", "a"), ("AI", "b"), ("USER", "a"), ("AI", "b")], True), "no reply": ([("USER", "a"), ("AI", "b"), ("USER", "c")], False), "two users": ([("USER", "a"), ("USER", "b"), ("AI", "c")], False), "starts wrong": ([("AI", "a"), ("USER", "b"), ("AI", "c")], False),
    "blank": ([("USER", "a"), ("AI", " \n\u00a0")], False), "null": ([("USER", None), ("AI", "b")], False), "only system": ([("SYSTEM", "a")], False),
}


@pytest.mark.parametrize("pieces", [1, 3, 9])
def test_cases(spark, pieces):
    data = [r for conv, (turns, _) in CASES.items() for r in rows(conv, turns)]
    data += [(c, "USER", "x", None, T0) for c in (None, "", " \t")]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data + data[:6], SCHEMA)
    assert {r.conversation_id for r in C.dropped(df, pieces).collect()} == {c for c, (_, keep) in CASES.items() if not keep}


def test_hot_conversation_over_many_fragments(spark):
    long = [("USER" if i % 2 == 0 else "AI", "same text") for i in range(3000)]
    broken = long[:1501] + long[1500:1501] + [("USER", "other")] + long[1501:]
    df = spark.createDataFrame(rows("hot", long) + rows("bad", broken) + rows("x", CASES["good"][0]), SCHEMA)
    assert {r.conversation_id for r in C.dropped(df, 12).collect()} == {"bad"}
    turns = C.turns(df, 7)
    assert turns.where("conversation_id = 'hot'").agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()[:] == (1, 3000, 3000)
    assert [r.content for r in turns.where("conversation_id = 'x'").orderBy("position").collect()] == ["a", "b", "c", "d"]


def test_empty(spark):
    assert C.dropped(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_and_gaps_come_from_the_matches(spark):
    long = [("USER" if i % 2 == 0 else "AI", f"text {i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows("hot", long) + rows("x", CASES["good"][0]), SCHEMA)
    parts = C.cut(C.export(C.messages(df), 9))
    names = sorted(r.fragment for r in parts.where("conv = 'hot'").select("fragment").distinct().collect())
    assert len(names) > 5

    def kept(fragments):
        return {r.conv for r in C.assemble(fragments)[1].where("kept").collect()}

    assert kept(parts) == {"hot", "x"}
    assert kept(parts.withColumn("fragment", F.xxhash64(F.lit(7), "fragment"))) == {"hot", "x"}
    inner = C.assemble(parts)[0].where("conv = 'hot' and not starts").orderBy("before").first().fragment
    assert kept(parts.where(F.col("fragment") != inner)) == {"x"}
