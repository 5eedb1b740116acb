"""Structured Streaming: messages to links, deduplication, workflow replay with keyed state, and timers for jobs
whose heartbeats stop. Each stream reuses the batch operators and gives the same rows as they do on the same log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docintake.operators import messages as m
from docintake.operators import workflow as wf
from docintake.sources.sinks import append_batch, scratch_path


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages from a folder of files with one JSON object a line."""
    return m.parse_lines(spark.readStream.text(path))


def distinct_messages(messages: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event once: repeats within the watermark are dropped."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])


def link_stream(messages: DataFrame) -> DataFrame:
    return m.links(messages)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote: rows with ``batch_id``."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = stream.writeStream.outputMode(mode).foreachBatch(append_batch(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(out)


# ---------------------------------------------------------------- keyed state

_EDGES = {(s, e): t for s, e, t in wf.expanded_edges()}
REPLAY = "job_id bigint, state string, version int, rejected int"


def _replay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, version, rejected = state.get if state.exists else ("queued", 0, 0)
    events = pd.concat(frames).sort_values("seq")
    for e in events["event"]:
        to = _EDGES.get((now, e))
        now, version, rejected = (to, version + 1, rejected) if to else (now, version, rejected + 1)
    state.update((now, version, rejected))
    yield pd.DataFrame({"job_id": [key[0]], "state": [now], "version": [version], "rejected": [rejected]})


def replay_stream(log: DataFrame) -> DataFrame:
    """The state of each job (job_id, seq, event) after each micro-batch that has events of it. Events of a job
    must arrive in order between batches; within a batch they are put in order."""
    return log.groupBy("job_id").applyInPandasWithState(_replay, REPLAY, "state string, version int, rejected int", "update", GroupStateTimeout.NoTimeout)


def _enqueue(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(frames).sort_values("request_id")
    job = state.get[0] if state.exists else None
    created = [False] * len(rows)
    if job is None:
        job, created[0] = -int(rows["request_id"].iloc[0]), True
        state.update((job,))
    yield pd.DataFrame({"request_id": rows["request_id"], "dedupe_key": key[0], "job_id": job, "created": created})


def enqueue_stream(requests: DataFrame) -> DataFrame:
    """Requests (request_id, dedupe_key) with the job that they create or join: one open job for a key."""
    return requests.groupBy("dedupe_key").applyInPandasWithState(_enqueue, "request_id bigint, dedupe_key string, job_id bigint, created boolean", "job bigint", "append", GroupStateTimeout.NoTimeout)


def _stale(minutes: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "event": ["recover"], "last_ms": [last]})
            return
        last = max([state.get[0]] if state.exists else [0], default=0)
        last = max(last, *(int(f["ms"].max()) for f in frames))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return run


def stale_stream(heartbeats: DataFrame, minutes: int, delay: str = "1 minute") -> DataFrame:
    """A recover event for each job (job_id, ts) whose heartbeats stop for ``minutes`` of event time."""
    rows = heartbeats.withWatermark("ts", delay).select("job_id", "ts", (F.unix_millis("ts")).alias("ms"))
    return rows.groupBy("job_id").applyInPandasWithState(_stale(minutes), "job_id bigint, event string, last_ms bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
