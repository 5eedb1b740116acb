"""Workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import workflow as wf
from docintake.plans.queue import _with
from docintake.plans.registry import query
from docintake.sources.views import load, sql

_EDGES = "edges(s, e, t) AS (VALUES " + ", ".join(f"('{s}', '{e}', '{t}')" for s, e, t in wf.expanded_edges()) + ")"
_FOLD = f"""
WITH RECURSIVE {_EDGES}, ev AS (SELECT job_id, seq, event, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM v_wf),
r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS event, CAST('' AS VARCHAR) AS before, CAST('queued' AS VARCHAR) AS state, false AS accepted, 0 AS version, 0 AS rejected FROM ev
  UNION ALL
  SELECT r.job_id, ev.k, ev.seq, ev.event, r.state, coalesce(x.t, r.state), x.t IS NOT NULL, r.version + CASE WHEN x.t IS NULL THEN 0 ELSE 1 END, r.rejected + CASE WHEN x.t IS NULL THEN 1 ELSE 0 END
  FROM r JOIN ev ON ev.job_id = r.job_id AND ev.k = r.k + 1 LEFT JOIN edges x ON x.s = r.state AND x.e = ev.event)
"""
_LAST = ", z AS (SELECT job_id, state, version, rejected FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS b FROM r) q WHERE b = 1)"


@query("wf_replay", _FOLD + _LAST + " SELECT * FROM z", "v_wf")
def _(spark, d):
    return wf.replay(load(spark, d, "v_wf"))


@query("wf_audit", _FOLD + "SELECT job_id, seq, event, before AS from_state, CASE WHEN accepted THEN state END AS to_state, accepted, CASE WHEN accepted THEN version END AS version FROM r WHERE k > 0", "v_wf")
def _(spark, d):
    return wf.audit(load(spark, d, "v_wf"))


@query("wf_audit_detail", _FOLD + """SELECT job_id, seq, concat('{"from":"', before, '","to":"', state, '","event":"', event, '","detail":"', repeat(event, 100)[1:1000], '"}') AS detail FROM r WHERE k > 0 AND accepted""", "v_wf")
def _(spark, d):
    rows = wf.audit(load(spark, d, "v_wf")).filter("accepted")
    return rows.select("job_id", "seq", wf.transition_detail(F.col("from_state"), F.col("to_state"), F.col("event"), F.repeat("event", 100)).alias("detail"))


@query("wf_status_projection", _FOLD + _LAST + """
SELECT CASE WHEN state = 'queued' THEN 'queued' WHEN state = 'completed' THEN 'done' WHEN state IN ('needs_source','generation_incomplete','quality_failed','failed','cancelled') THEN 'failed' ELSE 'running' END AS status,
  CASE state WHEN 'needs_source' THEN 'source_unavailable' WHEN 'generation_incomplete' THEN 'generation_incomplete' WHEN 'quality_failed' THEN 'quality_rejected' WHEN 'failed' THEN 'execution_failed' WHEN 'cancelled' THEN 'cancelled' ELSE 'none' END AS failure_kind, count(*) AS n
FROM z GROUP BY 1, 2""", "v_wf")
def _(spark, d):
    got = wf.replay(load(spark, d, "v_wf"))
    return got.groupBy(wf.queue_status(F.col("state")).alias("status"), wf.failure_kind(F.col("state")).alias("failure_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("wf_next_state", f"WITH {_EDGES} SELECT w.job_id, w.seq, w.event, x.t AS to_state FROM v_wf w LEFT JOIN edges x ON x.s = 'claimed' AND x.e = w.event", "v_wf")
def _(spark, d):
    return wf.next_state(load(spark, d, "v_wf").select("job_id", "seq", "event", F.lit("claimed").alias("state")), wf.edges_frame(spark)).drop("state")


_LEASE_EVENTS = "SELECT job_id, seq, event, CASE WHEN event_id % 5 = 0 THEN 'w-b' WHEN event_id % 7 = 0 THEN '' ELSE 'w-a' END AS worker_id FROM v_wf"
_ENDS = "('recover', 'complete', 'fail', 'retry', 'cancel')"


@query("wf_lease_replay", f"""
WITH RECURSIVE {_EDGES}, ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM ({_LEASE_EVENTS}) q),
r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST('queued' AS VARCHAR) AS state, 0 AS version, CAST('' AS VARCHAR) AS worker_id, 0 AS rejected, 0 AS ignored FROM ev
  UNION ALL
  SELECT job_id, k, CASE WHEN kind = 'ok' THEN t ELSE state END, version + CASE WHEN kind = 'ok' THEN 1 ELSE 0 END,
    CASE WHEN kind = 'ok' AND event = 'claim' THEN w WHEN kind = 'ok' AND event IN {_ENDS} THEN '' ELSE worker_id END, rejected + CASE WHEN kind = 'no' THEN 1 ELSE 0 END, ignored + CASE WHEN kind = 'ignored' THEN 1 ELSE 0 END
  FROM (SELECT r.job_id, ev.k, ev.event, ev.worker_id AS w, r.state, r.version, r.worker_id, r.rejected, r.ignored, x.t,
      CASE WHEN ev.event <> 'claim' AND ev.worker_id <> '' AND ev.worker_id <> r.worker_id THEN 'no'
        WHEN ev.event = 'fail' AND r.state IN ('completed', 'needs_source', 'generation_incomplete', 'quality_failed', 'failed') THEN 'ignored'
        WHEN ev.event = 'complete' AND r.state = 'completed' THEN 'ignored' WHEN x.t IS NULL THEN 'no' ELSE 'ok' END AS kind
    FROM r JOIN ev ON ev.job_id = r.job_id AND ev.k = r.k + 1 LEFT JOIN edges x ON x.s = r.state AND x.e = ev.event) q)
SELECT job_id, state, version, worker_id, rejected, ignored FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS b FROM r) q WHERE b = 1""", "v_wf")
def _(spark, d):
    w = load(spark, d, "v_wf")
    return wf.replay_with_leases(w.select("job_id", "seq", "event", F.when(F.col("event_id") % 5 == 0, "w-b").when(F.col("event_id") % 7 == 0, "").otherwise("w-a").alias("worker_id")))


@query("wf_checkpoints", "SELECT job_id, concat('https://doc/', CAST(max(seq) AS VARCHAR)) AS checkpoint, count(*) AS publishes FROM v_wf WHERE event = 'publish_succeeded' GROUP BY job_id", "v_wf")
def _(spark, d):
    return wf.checkpoints(load(spark, d, "v_wf").withColumn("detail", F.concat(F.lit("https://doc/"), F.col("seq").cast("string"))))


_AGAIN = {"visual_qa_started": "recover", "complete": "claim"}  # publishing, then a crash and a new claim
_CRASHED = "SELECT job_id, seq, CASE event WHEN 'visual_qa_started' THEN 'recover' WHEN 'complete' THEN 'claim' ELSE event END AS event FROM v_wf"


@query("wf_resumable", _FOLD.replace("FROM v_wf", f"FROM ({_CRASHED}) v") + _LAST + """, c AS (SELECT job_id, concat('https://doc/', CAST(max(seq) AS VARCHAR)) AS checkpoint FROM v_wf WHERE event = 'publish_succeeded' GROUP BY job_id)
SELECT z.job_id, c.checkpoint FROM z JOIN c ON c.job_id = z.job_id WHERE z.state = 'claimed'""", "v_wf")
def _(spark, d):
    log = load(spark, d, "v_wf").withColumn("detail", F.concat(F.lit("https://doc/"), F.col("seq").cast("string")))
    log = log.withColumn("event", F.coalesce(wf._lookup(_AGAIN, F.col("event")), F.col("event")))
    return wf.resumable(wf.replay(log).join(wf.checkpoints(log), "job_id")).select("job_id", "checkpoint")


@query("wf_retryable_jobs", _FOLD + _LAST + "SELECT job_id, state FROM z WHERE state IN ('needs_source','generation_incomplete','quality_failed','failed')", "v_wf")
def _(spark, d):
    return wf.replay(load(spark, d, "v_wf")).filter(F.col("state").isin(*wf.RETRYABLE)).select("job_id", "state")


@query("wf_loop_counts", """SELECT job_id, count(*) FILTER (event = 'retry') AS generation_repairs, count(*) FILTER (event = 'recover') AS quality_repairs, count(*) FILTER (event = 'fail') AS visual_repairs,
  count(*) FILTER (event = 'retry') > 1 OR count(*) FILTER (event = 'recover') > 1 OR count(*) FILTER (event = 'fail') > 0 AS over_budget FROM v_wf GROUP BY job_id""", "v_wf")
def _(spark, d):
    other = {"retry": "generation_repair_required", "recover": "quality_repair_required", "fail": "visual_repair_required"}
    log = load(spark, d, "v_wf").withColumn("event", F.coalesce(wf._lookup(other, F.col("event")), F.col("event")))
    return wf.loop_counts(log, {"generation": 1, "quality": 1, "visual": 0})


_LEGACY = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'Running ' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'odd' END END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN 'downloading' WHEN 1 THEN 'Visual-QA' WHEN 2 THEN '' WHEN 3 THEN 'quality_checking' WHEN 4 THEN 'stage x' WHEN 5 THEN 'writing' ELSE 'needs-source' END AS stage FROM orders"""


@query("wf_legacy_state", f"""SELECT id, CASE WHEN s IN ({', '.join(f"'{x}'" for x in wf.STATES)}) THEN s {' '.join(f"WHEN s = '{a}' THEN '{b}'" for a, b in wf.LEGACY_STAGES.items())}
  WHEN t = 'queued' THEN 'queued' WHEN t = 'done' THEN 'completed' WHEN t = 'failed' THEN 'failed' WHEN t = 'running' THEN 'claimed' END AS state
FROM (SELECT id, replace(lower(trim(stage)), '-', '_') AS s, lower(trim(status)) AS t FROM ({_LEGACY}) q) w""")
def _(spark, d):
    return sql(spark, d, _LEGACY).select("id", wf.state_from_legacy(F.col("status"), F.col("stage")).alias("state"))


@query("wf_state_sizes", _FOLD + _LAST + f""", spec(state, terminal, retryable, active) AS (VALUES {', '.join(f"('{s}', {s in wf.TERMINAL}, {s in wf.RETRYABLE}, {s not in wf.TERMINAL})" for s in wf.STATES)})
SELECT spec.state, spec.terminal, spec.retryable, spec.active, count(z.job_id) AS jobs FROM spec LEFT JOIN z ON z.state = spec.state GROUP BY 1, 2, 3, 4""", "v_wf")
def _(spark, d):
    jobs = wf.replay(load(spark, d, "v_wf")).groupBy("state").agg(F.count(F.lit(1)).alias("jobs"))
    return wf.states_frame(spark).join(jobs, "state", "left").fillna(0, ["jobs"])


@query("wf_path_conformance", f"""WITH {_EDGES}, s AS (SELECT job_id AS name, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS pos, state, lead(state) OVER (PARTITION BY job_id ORDER BY seq) AS next
  FROM (SELECT w.job_id, w.seq, x.t AS state FROM v_wf w JOIN (SELECT e, min(t) AS t FROM edges GROUP BY e) x ON x.e = w.event) q)
SELECT name, CAST(pos AS INT) AS pos, state, next FROM s WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges WHERE s = s.state AND t = s.next)""".replace("FROM edges WHERE s = s.state AND t = s.next", "FROM edges g WHERE g.s = s.state AND g.t = s.next"), "v_wf")
def _(spark, d):
    target = wf.edges_frame(spark).groupBy("event").agg(F.min("to_state").alias("state"))
    log = load(spark, d, "v_wf").join(F.broadcast(target), "event")
    paths = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "state"))).alias("x")).select(F.col("job_id").alias("name"), F.col("x.state").alias("states"))
    return wf.broken_paths(paths, wf.edges_frame(spark))


_JOBS = """SELECT id, status, worker_id, source_id AS stage, 'claimed' AS state, m.as_of, m.as_of - heartbeat_age_s * INTERVAL 1 SECOND AS heartbeat_at FROM v_jobs, (SELECT max(created_at) AS as_of FROM v_jobs) m"""


def _jobs(spark, d):
    j = load(spark, d, "v_jobs")
    j = j.withColumn("as_of", F.lit(j.agg(F.max("created_at")).first()[0]))
    return j.withColumns({"heartbeat_at": F.col("as_of") - F.make_dt_interval(secs=F.col("heartbeat_age_s").cast("decimal(18,6)")), "stage": F.col("source_id"), "state": F.lit("claimed")})


@query("wf_stale_jobs", f"SELECT id, worker_id FROM ({_JOBS}) q WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < as_of - INTERVAL 30 MINUTE)", "v_jobs")
def _(spark, d):
    return wf.stale(_jobs(spark, d), F.col("as_of"), 30).select("id", "worker_id")


@query("wf_dead_worker_jobs", "SELECT id, CAST(split_part(worker_id, ':', 2) AS INT) AS pid FROM v_jobs WHERE status = 'running' AND split_part(worker_id, ':', 1) = 'host-1' AND CAST(split_part(worker_id, ':', 2) AS INT) % 3 <> 0", "v_jobs")
def _(spark, d):
    jobs = load(spark, d, "v_jobs")
    live = jobs.select((F.col("id") % 97).cast("int").alias("pid")).filter("pid % 3 = 0").distinct()
    return wf.dead_workers(jobs, "host-1", live).select("id", "pid")


@query("wf_recovery_rows", f"""SELECT id, event_type, CASE event_type WHEN 'transition' THEN concat('{{"from":"claimed","to":"queued","event":"recover","detail":"worker=', worker_id, ' stage=', stage, '"}}') ELSE concat('worker=', worker_id, ' stage=', stage) END AS detail
FROM ({_JOBS}) q, (VALUES ('transition'), ('recover_stale')) k(event_type) WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < as_of - INTERVAL 30 MINUTE)""", "v_jobs")
def _(spark, d):
    return wf.recovery_rows(wf.stale(_jobs(spark, d), F.col("as_of"), 30), "recover_stale")


_FAILED = "SELECT id, status, CASE id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'needs_source' ELSE 'cancelled' END AS state, source_id AS error, worker_id, 'x' AS stage, created_at AS started_at, created_at AS finished_at, created_at AS heartbeat_at, CAST(id % 4 AS INT) AS state_version FROM v_jobs"
_AGAIN_IDS = "status = 'failed' AND id % 3 < 2 AND id % 2 = 0"


def _retried(spark, d):
    jobs = _with(spark, d, _FAILED, ["v_jobs"])
    watchers = jobs.select((F.col("id") * 10).alias("watcher_id"), F.col("id").alias("job_id"), (F.col("id") % 5 > 0).alias("notified"))
    return wf.retry_jobs(jobs, watchers, jobs.filter("id % 2 = 0").select("id"))


@query("wf_retried_jobs", f"""SELECT id, CASE WHEN {_AGAIN_IDS} THEN 'queued' ELSE status END AS status, CASE WHEN {_AGAIN_IDS} THEN 'queued' ELSE state END AS state, CASE WHEN {_AGAIN_IDS} THEN '' ELSE error END AS error, CASE WHEN {_AGAIN_IDS} THEN '' ELSE worker_id END AS worker_id,
 CASE WHEN {_AGAIN_IDS} THEN 'retry_queued' ELSE stage END AS stage, CASE WHEN NOT ({_AGAIN_IDS}) THEN started_at END AS started_at, CASE WHEN NOT ({_AGAIN_IDS}) THEN finished_at END AS finished_at, CASE WHEN NOT ({_AGAIN_IDS}) THEN heartbeat_at END AS heartbeat_at, state_version + CASE WHEN {_AGAIN_IDS} THEN 1 ELSE 0 END AS state_version FROM ({_FAILED}) f""", "v_jobs")
def _(spark, d):
    return _retried(spark, d)[0]


@query("wf_retried_watchers", f"SELECT id * 10 AS watcher_id, id AS job_id, CASE WHEN {_AGAIN_IDS} THEN false ELSE id % 5 > 0 END AS notified FROM ({_FAILED}) f", "v_jobs")
def _(spark, d):
    return _retried(spark, d)[1]


@query("wf_retried_events", f"""SELECT id, k AS event_type, CASE k WHEN 'retry' THEN 'manual retry' ELSE concat('{{"from":"', state, '","to":"queued","event":"retry","detail":"manual retry"}}') END AS detail FROM ({_FAILED}) f, (VALUES ('retry'), ('transition')) v(k) WHERE {_AGAIN_IDS}""", "v_jobs")
def _(spark, d):
    return _retried(spark, d)[2]
