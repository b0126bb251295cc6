"""Stateful operators: rate limits, run states, claimed batches and captures, with the same rules in batch and in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def fixed_window(times: list[float], limit: int, width: float, state: tuple[float, int] | None = None) -> tuple[list[bool], tuple[float, int]]:
    """Admission in windows that begin at the first event after the last one ended; the state is (start, count)."""
    start, used = state if state else (float("-inf"), 0)
    out = []
    for t in times:
        if t - start >= width:
            start, used = t, 0
        used += 1
        out.append(used <= limit)
    return out, (start, used)


def sliding_log(times: list[float], limit: int, width: float, state: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Admission where fewer than ``limit`` events were admitted in the last ``width`` seconds, both ends included."""
    log, out = list(state or []), []
    for t in times:
        while log and t - log[0] > width:
            log.pop(0)
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


_OUT = "{key} {type}, event_id long, ts timestamp, admitted boolean"


def _rule(kind: str):
    return {"fixed": fixed_window, "sliding": sliding_log}[kind]


def rate_limited(events: DataFrame, key: str, limit: int, width: float, kind: str) -> DataFrame:
    """(key, event_id, ts, admitted) in batch; events are ordered by time, then id.

    Admission depends on all earlier events of a key, so a key is one sequence.  It is streamed through its partition in
    sorted order with a state of at most ``limit`` times and never gathered as a group.
    """
    rule = _rule(kind)
    schema = _OUT.format(key=key, type=events.schema[key].dataType.simpleString())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            flags: list[bool] = []
            for value, rows in batch.groupby(batch[key].ne(batch[key].shift()).cumsum(), sort=False):
                name = rows[key].iloc[0]
                if name != current:
                    current, state = name, None
                got, state = rule([t.timestamp() for t in rows["ts"]], limit, width, state)
                flags += got
            yield batch.assign(admitted=flags)

    slim = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "event_id", "ts")
    return slim.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, schema)


def rate_limited_stream(events: DataFrame, key: str, limit: int, width: float, kind: str) -> DataFrame:
    """The same over a stream: the state of a key is kept between micro-batches and dropped when it is idle for a width.

    The drop goes by the clock, for which a query runs batches without data for ever; one that is to end by itself
    (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false.
    """
    rule = _rule(kind)
    schema = _OUT.format(key=key, type=events.schema[key].dataType.simpleString())

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(batches)
        rows = pd.concat(frames).sort_values(["ts", "event_id"], ignore_index=True)
        old = list(state.get[0]) if state.exists else None
        if kind == "fixed":
            old = (old[0], int(old[1])) if old else None
        flags, new = rule([t.timestamp() for t in rows["ts"]], limit, width, old)
        state.update((list(map(float, new)),))
        state.setTimeoutDuration(int(width * 1000) + 1000)
        yield rows[[key, "event_id", "ts"]].assign(admitted=flags)

    slim = events.select(key, "event_id", "ts")
    return slim.groupBy(key).applyInPandasWithState(step, schema, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, status, steps_done, steps_failed, steps_skipped): fold of step events (run_id, step, status, ts).

    The last status of a step counts; a failed step fails the run and what is still pending is skipped.
    """
    last = events.groupBy("run_id", "step").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))
    agg = last.groupBy("run_id").agg(
        F.count(F.when(F.col("status") == "SUCCESS", 1)).alias("steps_done"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("steps_failed"),
        F.count(F.when(F.col("status") == "PENDING", 1)).alias("pending"),
        F.count(F.when(F.col("status") == "RUNNING", 1)).alias("running"),
    )
    failed = F.col("steps_failed") > 0
    status = F.when(failed, "FAILED").when(F.col("running") + F.col("pending") > 0, "RUNNING").otherwise("SUCCESS")
    return agg.select("run_id", status.alias("status"), "steps_done", "steps_failed", F.when(failed, F.col("pending")).otherwise(F.lit(0)).alias("steps_skipped"))


def active_run(runs: DataFrame) -> DataFrame:
    """(application_id, id): the newest running run of each application."""
    w = Window.partitionBy("application_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return runs.where("status = 'RUNNING'").withColumn("r", F.row_number().over(w)).where("r = 1").select("application_id", "id")


def claim_batch(rows: DataFrame, condition: str, order: list[str], limit: int) -> DataFrame:
    """The oldest rows in a state, up to the limit; a single writer claims, so no row is claimed twice."""
    return rows.where(condition).orderBy(*order).limit(limit)


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a poller: each micro-batch goes to ``handle`` once; progress lies in the checkpoint folder."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def audit_capture(requests: DataFrame) -> DataFrame:
    """Changing calls of the API: requests that are no reads, under /api."""
    return requests.where(~F.col("http_method").isin("GET", "HEAD", "OPTIONS") & F.col("resource").startswith("/api"))


def events_after(events: DataFrame, after_id: int) -> DataFrame:
    return events.where(F.col("event_id") > after_id).orderBy("ts", "event_id")
