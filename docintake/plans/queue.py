"""Queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import queue as q
from docintake.plans.registry import query
from docintake.sources.views import load

_REQUESTS = "SELECT id AS request_id, concat(CASE WHEN id % 4 = 0 THEN 'article' ELSE 'paper' END, ':', CAST(id % 1000 AS VARCHAR(20))) AS dedupe_key FROM v_usage"
_WATCHERS = "SELECT u.id AS watcher_id, u.id % 15000 AS job_id, u.id % 2 = 1 AS notified FROM v_usage u"
_TIMES = "SELECT j.*, m.as_of, created_at + start_offset_s * INTERVAL 1 SECOND AS started_at, created_at + (start_offset_s + duration_s) * INTERVAL 1 SECOND AS finished_at FROM v_jobs j, (SELECT max(created_at) AS as_of FROM v_jobs) m"


def _with(spark, d, text, views):
    import re

    frames = {v: load(spark, d, v) for v in views}
    text = text.replace("{", "{{").replace("}", "}}")
    for v in views:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){v}\b", rf"\1\2{{{v}}}", text)
    return spark.sql(text, **frames)


def _times(spark, d):
    j = load(spark, d, "v_jobs")
    j = j.withColumn("as_of", F.lit(j.agg(F.max("created_at")).first()[0]))
    start = F.coalesce(F.col("start_offset_s"), F.lit(0)).cast("decimal(18,6)")
    took = F.col("duration_s").cast("decimal(18,6)")
    return j.withColumns({"started_at": F.when(F.col("start_offset_s").isNotNull(), F.col("created_at") + F.make_dt_interval(secs=start)), "finished_at": F.when(took.isNotNull(), F.col("created_at") + F.make_dt_interval(secs=start + took))})


@query("job_dedupe_key", "SELECT id, concat(source_kind, ':', source_id) AS dedupe_key FROM v_jobs", "v_jobs")
def _(spark, d):
    return load(spark, d, "v_jobs").select("id", q.dedupe_key(F.col("source_kind"), F.col("source_id")).alias("dedupe_key"))


_DEDUPE = f"""SELECT r.request_id, r.dedupe_key, coalesce(a.id, -f.first_id) AS job_id, a.id IS NULL AND r.request_id = f.first_id AS created
FROM ({_REQUESTS}) r JOIN (SELECT dedupe_key, min(request_id) AS first_id FROM ({_REQUESTS}) x GROUP BY dedupe_key) f ON f.dedupe_key = r.dedupe_key
LEFT JOIN (SELECT dedupe_key, min(id) AS id FROM v_jobs WHERE status IN ('queued', 'running') GROUP BY dedupe_key) a ON a.dedupe_key = r.dedupe_key"""


def _deduped(spark, d):
    return q.dedupe_requests(_with(spark, d, _REQUESTS, ["v_usage"]), load(spark, d, "v_jobs"))


@query("job_enqueue_dedupe", _DEDUPE, "v_jobs", "v_usage")
def _(spark, d):
    return _deduped(spark, d)


@query("job_queue_positions", "SELECT id, CAST(CASE WHEN status = 'queued' THEN count(*) FILTER (status = 'queued') OVER (ORDER BY id) ELSE 0 END AS BIGINT) AS position FROM v_jobs", "v_jobs")
def _(spark, d):
    return q.queue_positions(load(spark, d, "v_jobs"), 5000)


@query("job_claim_order", "SELECT id, priority FROM v_jobs WHERE status = 'queued' ORDER BY priority DESC, id LIMIT 50", "v_jobs")
def _(spark, d):
    return q.claim_order(load(spark, d, "v_jobs"), 50).select("id", "priority")


_MEDIAN = f"""SELECT k.source_kind, CAST(coalesce(round_even(quantile_cont(s, 0.5), 0), 300) AS BIGINT) AS seconds FROM (SELECT DISTINCT source_kind FROM v_jobs) k
LEFT JOIN (SELECT source_kind, s FROM (SELECT source_kind, duration_s AS s, row_number() OVER (PARTITION BY source_kind ORDER BY finished_at DESC, id DESC) AS n FROM ({_TIMES}) t
  WHERE status = 'done' AND finished_at >= as_of - INTERVAL 14 DAY) x WHERE n <= 12 AND s BETWEEN 30 AND 10800) y ON y.source_kind = k.source_kind GROUP BY 1"""


@query("job_recent_duration", _MEDIAN, "v_jobs")
def _(spark, d):
    return q.recent_durations(_times(spark, d), F.col("as_of"))


@query("job_waiting_time", f"""SELECT id, position, (CAST(floor((greatest(position, 1) - 1) / 3) AS BIGINT)) * greatest(seconds, 60) AS wait_seconds, (CAST(floor((greatest(position, 1) - 1) / 3) AS BIGINT) + 1) * greatest(seconds, 60) AS done_seconds
FROM (SELECT id, source_kind, CAST(CASE WHEN status = 'queued' THEN count(*) FILTER (status = 'queued') OVER (ORDER BY id) ELSE 0 END AS BIGINT) AS position FROM v_jobs) p JOIN ({_MEDIAN}) m ON m.source_kind = p.source_kind""", "v_jobs")
def _(spark, d):
    jobs = load(spark, d, "v_jobs")
    seconds = q.recent_durations(_times(spark, d), F.col("as_of"))
    wait, done = q.waiting_time(F.col("position"), 3, F.col("seconds"))
    rows = q.queue_positions(jobs, 5000).join(jobs.select("id", "source_kind"), "id").join(seconds, "source_kind")
    return rows.select("id", "position", wait.alias("wait_seconds"), done.alias("done_seconds"))


@query("job_duration_text", """SELECT id, CASE WHEN m < 60 THEN concat(CAST(m AS VARCHAR), ' 分钟') WHEN m % 60 = 0 THEN concat(CAST(m // 60 AS VARCHAR), ' 小时') ELSE concat(CAST(m // 60 AS VARCHAR), ' 小时 ', CAST(m % 60 AS VARCHAR), ' 分钟') END AS text
FROM (SELECT id, CAST(greatest(1, round_even(duration_s / 60, 0)) AS BIGINT) AS m FROM v_jobs WHERE duration_s IS NOT NULL) x""", "v_jobs")
def _(spark, d):
    return load(spark, d, "v_jobs").filter("duration_s is not null").select("id", q.duration_text(F.col("duration_s")).alias("text"))


@query("job_status_counts", "SELECT status, count(*) AS n FROM v_jobs GROUP BY status", "v_jobs")
def _(spark, d):
    return q.status_counts(load(spark, d, "v_jobs"))


@query("job_pending_watchers", f"SELECT count(*) FILTER (NOT notified) AS pending FROM ({_WATCHERS}) w", "v_usage")
def _(spark, d):
    return q.pending_watchers(_with(spark, d, _WATCHERS, ["v_usage"]))


@query("job_watcher_messages", f"""SELECT w.watcher_id, w.job_id, j.status AS usage_status, CASE j.status WHEN 'done' THEN concat('done: ', doc_url) ELSE concat('failed: ', source_id) END AS message
FROM ({_WATCHERS}) w JOIN v_jobs j ON j.id = w.job_id WHERE NOT notified AND j.status IN ('done', 'failed')""", "v_jobs", "v_usage")
def _(spark, d):
    return q.watcher_messages(_with(spark, d, _WATCHERS, ["v_usage"]), load(spark, d, "v_jobs"))


_STAGE = "CASE id % 5 WHEN 0 THEN 'downloading' WHEN 1 THEN ' Reading' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'writing' ELSE 'other' END"


@query("job_progress_messages", f"""SELECT w.watcher_id, w.job_id, CASE j.id % 5 WHEN 0 THEN 'OnIt' WHEN 1 THEN 'StatusReading' WHEN 2 THEN 'THINKING' WHEN 3 THEN 'Typing' ELSE '' END AS label
FROM ({_WATCHERS}) w JOIN v_jobs j ON j.id = w.job_id WHERE NOT notified AND j.status = 'running'""", "v_jobs", "v_usage")
def _(spark, d):
    return q.progress_messages(_with(spark, d, _WATCHERS, ["v_usage"]), load(spark, d, "v_jobs").withColumn("stage", F.expr(_STAGE)))


_ASKS = "SELECT id AS request_id, CASE WHEN id % 4 = 0 THEN 'article' ELSE 'paper' END AS kind, CAST(id % 1500 AS VARCHAR(20)) AS source_id, concat('https://a/', CAST(id % 400 AS VARCHAR(20))) AS url FROM v_usage"
_PAPERS = "SELECT source_id AS paper_id, max(status) AS status, max(doc_url) AS doc_url FROM v_jobs WHERE source_kind = 'paper' AND status <> 'running' GROUP BY source_id"


def _cached(spark, d):
    papers = _with(spark, d, _PAPERS, ["v_jobs"]).filter("status = 'done'")
    articles = spark.range(300).select(q.hash_id(F.concat(F.lit("https://a/"), F.col("id").cast("string"))).alias("doc_id"), F.when(F.col("id") % 3 == 0, "failed").otherwise("done").alias("status"), F.concat(F.lit("https://doc/a"), F.col("id").cast("string")).alias("doc_url"))
    return q.cached_results(_with(spark, d, _ASKS, ["v_usage"]), papers, articles)


_CACHED = f"""SELECT a.request_id, a.kind, a.source_id, a.url, CASE WHEN a.kind = 'paper' THEN p.doc_url WHEN CAST(a.url[11:] AS INT) < 300 AND CAST(a.url[11:] AS INT) % 3 <> 0 THEN concat('https://doc/a', a.url[11:]) END AS cached_url
FROM ({_ASKS}) a LEFT JOIN (SELECT * FROM ({_PAPERS}) z WHERE status = 'done' AND doc_url <> '') p ON p.paper_id = a.source_id"""


@query("job_cached_results", _CACHED, "v_jobs", "v_usage")
def _(spark, d):
    return _cached(spark, d)


@query("job_request_outcome", f"""SELECT c.request_id, CASE WHEN c.cached_url IS NOT NULL THEN 'cached' WHEN e.created THEN 'queued' ELSE 'watching' END AS outcome FROM ({_CACHED}) c JOIN ({_DEDUPE}) e ON e.request_id = c.request_id""", "v_jobs", "v_usage")
def _(spark, d):
    return _cached(spark, d).join(_deduped(spark, d).select("request_id", "created"), "request_id").select("request_id", q.outcome(F.col("cached_url"), F.col("created")).alias("outcome"))


@query("job_list", "SELECT id, status, source_id FROM v_jobs WHERE status = 'failed' ORDER BY id DESC LIMIT 80", "v_jobs")
def _(spark, d):
    return q.newest(load(spark, d, "v_jobs"), 80, "id", status="failed").select("id", "status", "source_id")


@query("job_event_list", "SELECT job_id, seq, event FROM v_wf WHERE job_id = (SELECT min(job_id) FROM v_wf) ORDER BY seq DESC LIMIT 300", "v_wf")
def _(spark, d):
    log = load(spark, d, "v_wf")
    one = log.agg(F.min("job_id").alias("job_id"))
    return q.newest(log.join(F.broadcast(one), "job_id"), 300, "seq").select("job_id", "seq", "event")


@query("job_batch_plan", """SELECT batch_id, pos, wave, (wave - 1) * 2 AS wait_minutes, greatest(3, wave * 4) AS from_minutes, greatest(3, wave * 4) + 4 AS to_minutes
FROM (SELECT user_id AS batch_id, event_id AS pos, CAST(ceil(row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 3) AS INT) AS wave, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) x WHERE n <= 6""")
def _(spark, d):
    return q.batch_plan(load(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("pos")), 3, 6)


@query("job_batch_summary", """SELECT user_id AS batch_id, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS failed, coalesce(string_agg(left(repeat(props, 30), 180), '; ' ORDER BY event_id) FILTER (event_type = 'error'), '') AS reasons FROM events GROUP BY user_id""")
def _(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("ok"), F.repeat("props", 30).alias("reason"))
    return q.batch_summary(rows)


@query("job_idempotency_key", "SELECT id, substr(sha256(concat('job-done:', CAST(id AS VARCHAR), ':', source_id)), 1, 32) AS k FROM v_jobs", "v_jobs")
def _(spark, d):
    return load(spark, d, "v_jobs").select("id", q.idempotency_key(F.lit("job-done"), F.col("id").cast("string"), F.col("source_id")).alias("k"))


@query("job_stage_labels", "SELECT id, CASE id % 5 WHEN 0 THEN 'OnIt' WHEN 1 THEN 'StatusReading' WHEN 2 THEN 'THINKING' WHEN 3 THEN 'Typing' ELSE '' END AS label FROM v_jobs", "v_jobs")
def _(spark, d):
    return load(spark, d, "v_jobs").select("id", q.stage_label(F.expr(_STAGE)).alias("label"))
