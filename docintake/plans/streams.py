"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.plans.registry import query
from docintake.plans.workflow import _EDGES
from docintake.streaming import streams as st

_STEPS = ("claim", "fetch_started", "source_ready", "generation_started", "generation_check_started", "draft_ready", "review_completed", "quality_passed", "publish_succeeded", "fail", "recover", "retry")
_EVENT = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_STEPS)) + " END"
_LOG = f"SELECT user_id AS job_id, event_id AS seq, {_EVENT} AS event FROM events"


def _events(spark, d):
    # As a pattern, since a stream takes a single file only so.
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")


def _log(spark, d):
    return _events(spark, d).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"))


@query("stream_wf_replay", f"""
WITH RECURSIVE {_EDGES}, ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM ({_LOG}) q),
r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST('queued' AS VARCHAR) AS state, 0 AS version, 0 AS rejected FROM ev
  UNION ALL SELECT r.job_id, ev.k, coalesce(x.t, r.state), r.version + CASE WHEN x.t IS NULL THEN 0 ELSE 1 END, r.rejected + CASE WHEN x.t IS NULL THEN 1 ELSE 0 END
  FROM r JOIN ev ON ev.job_id = r.job_id AND ev.k = r.k + 1 LEFT JOIN edges x ON x.s = r.state AND x.e = ev.event)
SELECT job_id, state, version, rejected FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS b FROM r) q WHERE b = 1""")
def _(spark, d):
    rows = st.run_available(st.replay_stream(_log(spark, d)), "replay", "update")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("state", "version", "rejected"), "batch_id").alias("r")).select("job_id", "r.*")


@query("stream_distinct_events", "SELECT event_id, user_id FROM events")
def _(spark, d):
    twice = _events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return st.run_available(st.distinct_messages(twice, delay="400 days"), "distinct").select("event_id", "user_id")


@query("stream_enqueue", "SELECT event_id AS request_id, concat('paper:', CAST(user_id AS VARCHAR)) AS dedupe_key, -min(event_id) OVER (PARTITION BY user_id) AS job_id, event_id = min(event_id) OVER (PARTITION BY user_id) AS created FROM events")
def _(spark, d):
    requests = _events(spark, d).select(F.col("event_id").alias("request_id"), F.concat(F.lit("paper:"), F.col("user_id").cast("string")).alias("dedupe_key"))
    return st.run_available(st.enqueue_stream(requests), "enqueue").drop("batch_id")
