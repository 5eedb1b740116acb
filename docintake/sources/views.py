"""Views over the shared test tables, in SQL text that Spark and DuckDB read alike (no backslashes, no now(),
no engine-specific functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_jobs": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'article' ELSE 'paper' END AS source_kind,
  CAST(o_custkey AS VARCHAR(20)) AS source_id,
  concat(CASE WHEN o_orderkey % 4 = 0 THEN 'article' ELSE 'paper' END, ':', CAST(o_custkey AS VARCHAR(20))) AS dedupe_key,
  CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'
       WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'done' END AS status,
  5 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey % 3600 END AS start_offset_s,
  CASE WHEN o_orderstatus = 'F' THEN (o_custkey * 37 + o_orderkey) % 12000 ELSE NULL END AS duration_s,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN (o_orderkey * 13) % 7200 ELSE NULL END AS heartbeat_age_s,
  CASE WHEN o_orderstatus = 'P' THEN concat('host-', CAST(o_orderkey % 3 AS VARCHAR(4)), ':', CAST(o_orderkey % 97 AS VARCHAR(4)), ':w') ELSE '' END AS worker_id,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN concat('https://doc/', CAST(o_orderkey AS VARCHAR(20))) ELSE '' END AS doc_url
FROM orders
""",
    "v_usage": """
SELECT event_id AS id, concat('ou_', CAST(user_id AS VARCHAR(20))) AS sender_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued'
       WHEN 'view' THEN 'running' ELSE 'watching' END AS status,
  CASE WHEN event_type = 'purchase' THEN concat('https://doc/', CAST(event_id AS VARCHAR(20))) ELSE '' END AS doc_url,
  ts AS created_at
FROM events
""",
    "v_wf": """
SELECT user_id * 1000 + CAST(floor((rn - 1) / 12) AS BIGINT) AS job_id, rn AS seq, ts, event_id,
  CASE WHEN event_type = 'error' AND rn % 3 = 0 THEN 'fail'
       WHEN event_type = 'signup' AND rn % 5 = 0 THEN 'recover'
       WHEN event_type = 'click' AND rn % 4 = 0 THEN 'retry'
       ELSE CASE (rn - 1) % 12 WHEN 0 THEN 'claim' WHEN 1 THEN 'fetch_started' WHEN 2 THEN 'source_ready'
         WHEN 3 THEN 'generation_started' WHEN 4 THEN 'generation_check_started' WHEN 5 THEN 'draft_ready'
         WHEN 6 THEN 'review_completed' WHEN 7 THEN 'quality_passed' WHEN 8 THEN 'publish_succeeded'
         WHEN 9 THEN 'visual_qa_started' WHEN 10 THEN 'complete' ELSE 'cancel' END END AS event
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e
""",
    "v_issues": """
SELECT event_id AS id,
  CASE WHEN event_id % 3 = 0 THEN 'article' ELSE 'paper' END AS source_kind, CAST(user_id AS VARCHAR(20)) AS source_id,
  CASE event_id % 9 WHEN 0 THEN 'tex_macro' WHEN 1 THEN 'english_caption' WHEN 2 THEN 'figure_marker' WHEN 3 THEN 'math'
    WHEN 4 THEN 'table' WHEN 5 THEN 'heading' WHEN 6 THEN 'layout' WHEN 7 THEN 'factual_risk' ELSE 'other' END AS category,
  CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
  CASE event_type WHEN 'error' THEN '仍有问题' WHEN 'click' THEN '已修正' WHEN 'view' THEN '' WHEN 'signup' THEN '已修正，但仍有风险'
    ELSE concat('event ', CAST(event_id AS VARCHAR(20))) END AS detail, ts AS created_at
FROM events
""",
    "v_blocks": """
SELECT l_orderkey AS page_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS block_no,
  l_quantity * 12 AS top, l_discount * 2000 AS lft, l_quantity * 12 + 8 + l_tax * 600 AS bottom, l_discount * 2000 + 120 AS rgt,
  CASE l_returnflag WHEN 'R' THEN 'heading' WHEN 'A' THEN 'text' ELSE 'figure' END AS cls FROM lineitem
""",
    "v_figures": """
SELECT p_brand AS doc_id, p_type AS label, p_partkey AS pos, concat('fig/', p_name, '.png') AS asset,
  p_size AS row_raw, p_partkey % 7 AS col_raw, p_retailprice AS w FROM part
""",
    "v_messages": """
SELECT c.conv_id * 1000 + c.turn AS message_id, c.conv_id AS thread_id, c.turn, c.role,
  CASE WHEN c.turn % 4 = 0 THEN concat('read https://arxiv.org/abs/', CAST(2000 + c.conv_id % 600 AS VARCHAR(8)), '.', lpad(CAST(c.conv_id * 7 % 100000 AS VARCHAR(8)), 5, '0'), 'v2 and ', coalesce(p.url, ''), ').')
       WHEN c.turn % 4 = 1 THEN concat('see https://huggingface.co/papers/', CAST(2000 + c.conv_id % 600 AS VARCHAR(8)), '.', lpad(CAST(c.conv_id * 7 % 100000 AS VARCHAR(8)), 5, '0'), ' ', coalesce(p.url, ''))
       ELSE c.text END AS content
FROM conversations c LEFT JOIN pages p ON p.page_id = (c.conv_id * 3 + c.turn) % 97
""",
    "v_md": """
SELECT doc_id, lang, source,
  CASE WHEN doc_id % 3 = 0 THEN concat('# [', CAST(doc_id AS VARCHAR(12)), '] t', chr(10), chr(10), 'TL;DR x', chr(10), '## 1. a', chr(10), text)
       WHEN doc_id % 3 = 1 THEN concat('## 2. b', chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| $x_{1}$ | <latex>', chr(92), 'frac{a}{b</latex> |', chr(10), text)
       ELSE text END AS md FROM documents
""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a view over base tables."""
    if name in VIEWS:
        return sql(spark, sf_dir, VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text that names base tables (and the given frames); only the tables it names are read."""
    import re

    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(?i)\b(from|join)\s+{t}\b", text)} | frames
    text = text.replace("{", "{{").replace("}", "}}")
    for t in named:
        text = re.sub(rf"(?i)\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
    return spark.sql(text, **named)


def with_views(text: str, *names: str) -> str:
    """DuckDB text that begins with the named views."""
    recursive = "RECURSIVE " if text.lstrip().upper().startswith("WITH RECURSIVE") else ""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = text.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"WITH {recursive}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"
