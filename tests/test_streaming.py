import pytest
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from loomgraph.streaming import limits as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROWS = [(i, u, T0 + timedelta(seconds=s)) for i, (u, s) in enumerate([(1, 0), (1, 1), (1, 2), (1, 61), (2, 0), (1, 62), (1, 63)])]
SCHEMA = "event_id long, user_id long, ts timestamp"


def test_rules():
    assert S.fixed_window([0, 1, 2, 61, 62, 63], 2, 60)[0] == [True, True, False, True, True, False]
    assert S.sliding_log([0, 1, 2, 60, 61, 62], 2, 60)[0] == [True, True, False, False, True, True]


def test_batch_equals_rule_and_handles_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for kind in ("fixed", "sliding"):
        got = {r.event_id: r.admitted for r in S.rate_limited(df, "user_id", 2, 60.0, kind).collect()}
        assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: False}
        assert S.rate_limited(df.limit(0), "user_id", 2, 60.0, kind).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for part in (df.where("event_id < 3"), df.where("event_id >= 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.rate_limited_stream(stream, "user_id", 2, 60.0, "fixed")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert spark.table("limited").count() == len(ROWS) and spark.table("limited").where("user_id = 2 and admitted").count() == 1


def test_poller_and_states(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    S.poll(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), lambda df, _: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == len(ROWS)
    events = spark.createDataFrame([(1, "a", "FAILED", T0), (1, "b", "PENDING", T0), (2, "a", "RUNNING", T0), (2, "a", "SUCCESS", T0 + timedelta(1))], "run_id long, step string, status string, ts timestamp")
    assert {r.run_id: (r.status, r.steps_skipped) for r in S.run_states(events).collect()} == {1: ("FAILED", 1), 2: ("SUCCESS", 0)}
    requests = spark.createDataFrame([("GET", "/api/a"), ("POST", "/api/a"), ("POST", "/x")], "http_method string, resource string")
    assert S.audit_capture(requests).select(F.count("*")).first()[0] == 1


def test_result_cache():
    from loomgraph.streaming.runs import ResultCache

    now = [0.0]
    cache = ResultCache(60, lambda: now[0])
    cache.put("What  is X?", [1], 7)
    cache.put(" ", [2])
    assert cache.get("what is x?", 7) == [1] and cache.get("what is x?") is None and cache.get(" ") is None
    now[0] = 60.0
    assert cache.get("What is X?", 7) is None
    cache.put("a", 1, 7)
    cache.put("a", 1, 8)
    assert cache.forget(7) == 1 and cache.get("a", 8) == 1 and cache.forget() == 1


def test_run_registry():
    from loomgraph.streaming.runs import RunRegistry

    runs = RunRegistry()
    a, b = runs.create(1, "per-node"), runs.create(1, "per-node")
    runs.progress(a.id, processed=3, written=2)
    runs.progress(a.id, processed=1)
    runs.complete(a.id)
    runs.fail(b.id, "lost")
    assert (runs.get(a.id).state, runs.get(a.id).processed, runs.get(a.id).written) == ("SUCCESS", 4, 2) and runs.get(b.id).errors == ["lost"]
    assert runs.newest(1) is b and runs.newest(2) is None and runs.get(9) is None
    with pytest.raises(ValueError):
        runs.progress(a.id)
