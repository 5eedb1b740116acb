"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import gates as g
from docintake.operators import reports as r
from docintake.plans.queue import _with
from docintake.plans.registry import query
from docintake.sources.sinks import scratch_path, write_listing
from docintake.sources.views import load, sql

_RESOLVED = "detail <> '' AND (detail LIKE '%仍有%' OR detail NOT LIKE '%已修正%')"


@query("adm_summary", f"""
SELECT 'usage' AS metric, status AS key, count(*) AS n FROM v_usage GROUP BY status
UNION ALL SELECT 'feedback', CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 4 = 1 THEN 'unknown' ELSE 'done' END, count(*) FROM v_issues WHERE id % 2 = 0 OR id % 4 = 1 GROUP BY 2
UNION ALL SELECT 'jobs', status, count(*) FROM v_jobs GROUP BY status
UNION ALL SELECT 'documents_done', '', count(*) FILTER (status = 'done' AND doc_url <> '') FROM v_usage
UNION ALL SELECT 'active_users', '', count(DISTINCT sender_id) FROM v_usage
UNION ALL SELECT 'unresolved_issues', '', count(*) FILTER ({_RESOLVED}) FROM v_issues""", "v_usage", "v_jobs", "v_issues")
def _(spark, d):
    issues = load(spark, d, "v_issues")
    feedback = issues.filter("id % 2 = 0 or id % 4 = 1").select(F.when(F.col("id") % 4 == 0, "new").when(F.col("id") % 4 == 1, "").otherwise("done").alias("status"))
    return r.status_summary(load(spark, d, "v_usage"), feedback, load(spark, d, "v_jobs"), issues, g.unresolved(F.col("category"), F.col("detail")))


@query("adm_usage_list", "SELECT id, sender_id, status, doc_url FROM v_usage ORDER BY id DESC LIMIT 80", "v_usage")
def _(spark, d):
    return r.latest(load(spark, d, "v_usage"), 80, "id").select("id", "sender_id", "status", "doc_url")


@query("adm_feedback_list", "SELECT id, detail FROM v_issues WHERE severity = 'high' ORDER BY id DESC LIMIT 80", "v_issues")
def _(spark, d):
    return r.latest(load(spark, d, "v_issues"), 80, "id", severity="high").select("id", "detail")


@query("adm_review_list", "SELECT id, category, detail FROM v_issues WHERE source_kind = 'article' AND source_id = '7' ORDER BY id DESC LIMIT 300", "v_issues")
def _(spark, d):
    return r.latest(load(spark, d, "v_issues"), 300, "id", source_kind="article", source_id="7").select("id", "category", "detail")


@query("adm_visible_review_list", f"SELECT id, category, detail FROM (SELECT * FROM v_issues ORDER BY id DESC LIMIT 300) x WHERE {_RESOLVED}", "v_issues")
def _(spark, d):
    page = r.latest(load(spark, d, "v_issues"), 300, "id")  # the limit comes before the filter
    return page.filter(g.unresolved(F.col("category"), F.col("detail"))).select("id", "category", "detail")


@query("adm_review_stats", "SELECT category, severity, count(*) AS n FROM v_issues GROUP BY 1, 2", "v_issues")
def _(spark, d):
    return r.review_stats(load(spark, d, "v_issues"))


@query("adm_named_senders", """SELECT u.id, u.sender_id, coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_name END, CASE WHEN c.c_custkey % 2 = 0 THEN c.c_mktsegment ELSE c.c_name END, '') AS sender_name
FROM v_usage u LEFT JOIN customer c ON u.sender_id = concat('ou_', CAST(c.c_custkey AS VARCHAR))""", "v_usage")
def _(spark, d):
    c = load(spark, d, "customer").withColumn("sender_id", F.concat(F.lit("ou_"), F.col("c_custkey").cast("string")))
    cache = c.select("sender_id", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("display_name"))
    resolved = c.select("sender_id", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("name"), F.col("c_name").alias("en_name"))
    return r.named_senders(load(spark, d, "v_usage").select("id", "sender_id"), cache, resolved, ["name", "en_name"])


@query("adm_limit_clamp", "SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 80 ELSE least(greatest(event_id % 700 - 100, 1), 300) END AS INT) AS page FROM events")
def _(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "many").otherwise((F.col("event_id") % 700 - 100).cast("string"))
    return load(spark, d, "events").select("event_id", r.clamp_limit(text).alias("page"))


@query("adm_issue_append", """SELECT source_kind, source_id, CASE WHEN id % 7 = 0 THEN 'other' ELSE category END AS category, CASE WHEN id % 5 = 0 THEN 'medium' ELSE severity END AS severity, left(repeat(detail, 400), 1000) AS detail FROM v_issues""", "v_issues")
def _(spark, d):
    found = load(spark, d, "v_issues").select("source_kind", "source_id", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("category")).alias("category"), F.when(F.col("id") % 5 != 0, F.col("severity")).alias("severity"), F.repeat("detail", 400).alias("detail"))
    return r.issue_rows(found)


# ---------------------------------------------------------------- state tables

_CHANGES = "SELECT event_id AS seq, user_id AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS status, CASE WHEN event_id % 4 = 0 THEN props END AS doc_url, event_id AS updated FROM events"
_LAST = "arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}"


def _changes(spark, d):
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 4 == 0, F.col("props")).alias("doc_url"), F.col("event_id").alias("updated"))


@query("state_upsert", f"SELECT k, {', '.join(_LAST.format(c=c) for c in ('status', 'doc_url', 'updated'))} FROM ({_CHANGES}) c GROUP BY k")
def _(spark, d):
    return r.upsert(_changes(spark, d), ["k"], "seq", ["status", "doc_url", "updated"])


@query("state_merge_snapshot", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.status, a.status) AS status FROM (SELECT user_id AS k, max(event_type) AS status FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1) a
FULL JOIN (SELECT user_id AS k, CASE WHEN user_id % 5 > 0 THEN min(event_type) END AS status FROM events WHERE event_id % 2 = 1 AND user_id % 4 <> 0 GROUP BY 1) b ON a.k = b.k""")
def _(spark, d):
    e = load(spark, d, "events").withColumn("k", F.col("user_id"))
    old = e.filter("event_id % 2 = 0 and user_id % 3 <> 0").groupBy("k").agg(F.max("event_type").alias("status"))
    new = e.filter("event_id % 2 = 1 and user_id % 4 <> 0").groupBy("k").agg(F.min("event_type").alias("status")).withColumn("status", F.when(F.col("k") % 5 > 0, F.col("status")))
    return r.merge_snapshot(old, new, ["k"], ["status"])


@query("state_last_value", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1")
def _(spark, d):
    return r.last_value(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("state_insert_ignore", """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events e WHERE event_id % 3 <> 0
  AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 30 = 0 AND o.user_id = e.user_id AND o.event_type = e.event_type)) x WHERE n = 1""")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "event_type")
    return r.insert_ignore(e.filter("event_id % 30 = 0"), e.filter("event_id % 3 <> 0"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("state_evolve", "SELECT event_id, event_type, '' AS stage, 0 AS version FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, 'new', CAST(user_id AS INT) FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    e = load(spark, d, "events")
    old, new = e.filter("event_id % 2 = 0").select("event_id", "event_type"), e.filter("event_id % 2 = 1").select("event_id", "event_type", F.lit("new").alias("stage"), F.col("user_id").cast("int").alias("version"))
    return r.evolve(old, new, {"stage": "", "version": 0})


@query("state_audit_rows", """SELECT event_id AS job_id, 'transition' AS event_type, concat('{"from":"queued","to":"claimed","event":"', event_type, '","detail":"', left(repeat(event_type, 300), 1000), '"}') AS detail FROM events""")
def _(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("job_id"), F.lit("queued").alias("from_state"), F.lit("claimed").alias("to_state"), F.col("event_type").alias("event"), F.repeat("event_type", 300).alias("detail"))
    return r.audit_rows(rows)


_CHECKPOINTS = """SELECT id, doc_url AS fallback, CASE WHEN id % 5 = 0 THEN 'not json' WHEN id % 5 = 1 THEN concat('https://raw/', CAST(id AS VARCHAR(20)))
  WHEN id % 5 = 2 THEN concat('{"doc_url":"https://d/', CAST(id AS VARCHAR(20)), '","expected_image_min":', CAST(id % 9 - 4 AS VARCHAR(20)), ',"expected_title":" t "}') WHEN id % 5 = 3 THEN '{"expected_table_min":"x","expected_latex_min":7}' ELSE '' END AS value FROM v_jobs"""
_DECODED = f"""SELECT id, CASE WHEN id % 5 = 2 THEN concat('https://d/', CAST(id AS VARCHAR)) WHEN fallback <> '' THEN fallback WHEN id % 5 = 1 THEN value END AS doc_url, CAST(CASE WHEN id % 5 = 2 THEN greatest(id % 9 - 4, 0) ELSE 0 END AS INT) AS image_min, CASE WHEN id % 5 = 3 THEN 7 ELSE 0 END AS latex_min, CASE WHEN id % 5 = 2 THEN 't' ELSE '' END AS title FROM ({_CHECKPOINTS}) c"""


def _decoded(spark, d):
    return _with(spark, d, _CHECKPOINTS, ["v_jobs"]).select("id", r.checkpoint_decode(F.col("value"), F.col("fallback")).alias("c")).filter("c is not null")


@query("state_checkpoint_decode", f"SELECT id, doc_url, image_min, latex_min, title FROM ({_DECODED}) x WHERE doc_url IS NOT NULL", "v_jobs")
def _(spark, d):
    return _decoded(spark, d).select("id", "c.doc_url", F.col("c.expected_image_min").alias("image_min"), F.col("c.expected_latex_min").alias("latex_min"), F.col("c.expected_title").alias("title"))


@query("state_checkpoint_encode", f"""SELECT id, concat('{{"doc_url":"', doc_url, '","expected_image_min":', CAST(image_min AS VARCHAR), ',"expected_latex_min":', CAST(latex_min AS VARCHAR), ',"expected_table_min":0,"expected_title":"', title, '"}}') AS value FROM ({_DECODED}) x WHERE doc_url IS NOT NULL""", "v_jobs")
def _(spark, d):
    return _decoded(spark, d).select("id", r.checkpoint_encode(F.col("c")).alias("value"))


@query("state_last_reports", """SELECT user_id AS job_id, event_type AS layer, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) x
WHERE n <= CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 8 WHEN 'error' THEN 4 ELSE 0 END""")
def _(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("layer"), F.col("event_id").alias("seq"))
    return r.last_reports(rows, {"click": 12, "view": 8, "error": 4})


#: The files that failed jobs have left: attempts and quality rounds of each user, drafts of some, and the last failure.
_NAME = "lpad(CAST(event_id AS VARCHAR(12)), 9, '0')"
_ARTIFACTS = f"""SELECT user_id AS job_id, concat('01-paper-attempt-', {_NAME}, '.json') AS name, CASE WHEN event_id % 5 = 0 THEN '{{broken' ELSE concat('{{"errors":["e', CAST(event_id % 7 AS VARCHAR(12)), '","x"],"more":{{"deep":[1]}}}}') END AS content FROM events WHERE event_type = 'click'
 UNION ALL SELECT user_id, concat('01-paper-attempt-', {_NAME}, '.md'), CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat('draft ', CAST(event_id AS VARCHAR(12)), chr(10)) END FROM events WHERE event_type = 'click'
 UNION ALL SELECT user_id, concat('07-quality-round-', {_NAME}, '.json'), concat('{{"blocking_warnings":["w', CAST(event_id AS VARCHAR(12)), '"]}}') FROM events WHERE event_type = 'view'
 UNION ALL SELECT user_id, concat('05-quality-round-', {_NAME}, '.md'), concat(' round ', CAST(event_id AS VARCHAR(12))) FROM events WHERE event_type = 'error' AND user_id % 4 = 0
 UNION ALL SELECT user_id, '08-failure.txt', concat(' failed at ', CAST(max(event_id) AS VARCHAR(12)), chr(10)) FROM events GROUP BY user_id"""


@query("src_retry_context", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events),
l AS (SELECT user_id, 1 AS p, event_id, concat('01-paper-attempt-', {_NAME}, ': e', CAST(event_id % 7 AS VARCHAR), ', x') AS line FROM e WHERE event_type = 'click' AND k <= 12 AND event_id % 5 <> 0
 UNION ALL SELECT user_id, 2, event_id, concat('07-quality-round-', {_NAME}, ': w', CAST(event_id AS VARCHAR)) FROM e WHERE event_type = 'view' AND k <= 8
 UNION ALL SELECT user_id, 3, 0, concat('last-job: failed at ', CAST(max(event_id) AS VARCHAR)) FROM events GROUP BY user_id),
f AS (SELECT user_id, list(line ORDER BY p, event_id) AS x FROM l GROUP BY user_id),
m AS (SELECT user_id, max(CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN event_id END) AS r, max(CASE WHEN event_type = 'click' AND k <= 12 AND event_id % 3 <> 0 THEN event_id END) AS a FROM e GROUP BY user_id)
SELECT f.user_id AS job_id, array_to_string(x[-16:], '|') AS feedback, concat(CASE WHEN r IS NOT NULL THEN concat('round ', CAST(r AS VARCHAR), chr(10)) WHEN a IS NOT NULL THEN concat('draft ', CAST(a AS VARCHAR), chr(10)) ELSE '' END) AS markdown FROM f JOIN m ON m.user_id = f.user_id""")
def _(spark, d):
    return r.retry_context(sql(spark, d, _ARTIFACTS)).withColumn("feedback", F.array_join("feedback", "|"))


#: Requests, the listing of them as lines of JSON, written down and read back.
@query("src_listing", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS sender, event_type AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS detail FROM events")
def _(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("sender"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("detail"))
    path = scratch_path(spark, "listing")
    write_listing(rows, path)
    return spark.read.schema("id bigint, sender string, status string, detail string").json(path)
