"""Message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import messages as m
from docintake.plans.queue import _with
from docintake.plans.registry import query
from docintake.sources.views import load, sql

_PAPER = r"(?i)https?://(?:www\.)?arxiv\.org/(abs|pdf|html)/(\d{4}\.\d{4,5})(v\d+)?(?:\.pdf)?"
_HUB = r"(?i)https?://huggingface\.co/papers/(\d{4}\.\d{4,5})(?:v\d+)?"
_TAIL = r"[.,;，。；）)\]]+$"
_WEB = r"""(?i)https?://[^\s<>''\"\]\)]+"""
_ARTICLES = f"""list_filter(list_transform(regexp_extract_all({{c}}, '{_WEB}'), lambda u: regexp_replace(u, '{_TAIL}', '')), lambda u: NOT regexp_matches(u, '(?i)arxiv\\.org/(abs|pdf|html)/|huggingface\\.co/papers/') AND NOT regexp_matches(lower(u), '\\.pdf([?#]|$)'))"""
_ALL = f"""links AS (SELECT message_id, content, list_concat(
  list_transform(range(1, len(regexp_extract_all(content, '{_PAPER}')) + 1), lambda i: {{'kind': 'paper', 'id': regexp_extract_all(content, '{_PAPER}', 2)[i], 'url': concat(CASE WHEN lower(regexp_extract_all(content, '{_PAPER}', 1)[i]) = 'abs' THEN 'https://arxiv.org/abs/' ELSE 'https://arxiv.org/pdf/' END, regexp_extract_all(content, '{_PAPER}', 2)[i], regexp_extract_all(content, '{_PAPER}', 3)[i])}}),
  list_transform(regexp_extract_all(content, '{_HUB}', 1), lambda x: {{'kind': 'paper', 'id': x, 'url': concat('https://arxiv.org/abs/', x)}})) AS papers, {_ARTICLES.format(c='content')} AS articles FROM v_messages)"""
_PAPERS = f"""WITH {_ALL}, p AS (SELECT message_id, unnest(papers) AS x, generate_subscripts(papers, 1) AS pos FROM links),
 f AS (SELECT message_id, x.kind AS kind, x.id AS source_id, x.url AS url, pos FROM (SELECT *, row_number() OVER (PARTITION BY message_id, x.id ORDER BY pos) AS n FROM p) q WHERE n = 1),
 a AS (SELECT message_id, u, min(pos) AS pos FROM (SELECT message_id, unnest(articles) AS u, generate_subscripts(articles, 1) AS pos FROM links) q GROUP BY 1, 2),
 refs AS (SELECT message_id, kind, source_id, url, 0 AS part, pos FROM f UNION ALL SELECT message_id, 'article', left(sha256(u), 16), u, 1, pos FROM a)"""


@query("ext_links", _PAPERS + " SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY part, pos) - 1 AS INT) AS pos, kind, source_id, url FROM refs", "v_messages")
def _(spark, d):
    return m.links(load(spark, d, "v_messages"))


@query("ext_paper_urls", f"""SELECT message_id, lower(regexp_extract(content, '{_PAPER}', 1)) AS kind, regexp_extract(content, '{_PAPER}', 2) AS paper_id, regexp_extract(content, '{_PAPER}', 3) AS version,
 concat('https://arxiv.org/abs/', regexp_extract(content, '{_PAPER}', 2), regexp_extract(content, '{_PAPER}', 3)) AS url FROM v_messages WHERE regexp_matches(content, '{_PAPER}')""", "v_messages")
def _(spark, d):
    return load(spark, d, "v_messages").select("message_id", F.explode(m.paper_links(F.col("content"))).alias("x")).select("message_id", "x.*")


_BARE = "SELECT conv_id * 1000 + turn AS id, concat(CASE turn % 4 WHEN 0 THEN 'see ' WHEN 1 THEN 'x' WHEN 2 THEN '/' ELSE '(' END, '2505.', lpad(CAST(conv_id % 100000 AS VARCHAR(8)), 5, '0'), CASE turn % 3 WHEN 0 THEN 'v3' WHEN 1 THEN '' ELSE '7' END, ' end') AS t FROM conversations"


@query("ext_bare_ids", f"SELECT id, regexp_extract(t, '(^|[^A-Za-z0-9_./-])(\\d{{4}}\\.\\d{{4,5}})(v\\d+)? end', 2) AS paper_id FROM ({_BARE}) q WHERE regexp_matches(t, '(^|[^A-Za-z0-9_./-])(\\d{{4}}\\.\\d{{4,5}})(v\\d+)? end')")
def _(spark, d):
    return sql(spark, d, _BARE).select("id", F.explode(m.bare_ids(F.col("t"))).alias("paper_id"))


@query("ext_hub_ids", f"SELECT message_id, unnest(regexp_extract_all(content, '{_HUB}', 1)) AS paper_id FROM v_messages", "v_messages")
def _(spark, d):
    return load(spark, d, "v_messages").select("message_id", F.explode(m.hub_ids(F.col("content"))).alias("paper_id"))


_URLS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(regexp_extract(url, '^[^?#]*', 0), '.pdf') WHEN 1 THEN concat(regexp_extract(url, '^[^?#]*', 0), '/pdf/') WHEN 2 THEN 'https://x.feishu.cn/docx/Abc1' WHEN 3 THEN 'ftp://host/a' ELSE url END AS u FROM pages"


@query("ext_supported_articles", f"SELECT page_id, page_id % 6 IN (4, 5) AS ok FROM ({_URLS}) q")
def _(spark, d):
    return sql(spark, d, _URLS).select("page_id", m.supported_article(F.col("u")).alias("ok"))


@query("ext_article_ids", "SELECT page_id, left(sha256(url), 16) AS article_id FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", m.article_id(F.col("url")).alias("article_id"))


_ROUTED = "SELECT v.*, CASE WHEN turn % 7 = 0 THEN 'p2p' ELSE 'group' END AS chat_type, turn % 3 = 0 AS mention, CASE WHEN turn % 11 = 2 THEN '重试' WHEN turn % 11 = 3 THEN '反馈：公式坏了' WHEN turn % 11 = 6 THEN '帮助' ELSE content END AS said, turn % 5 < 2 AS reply FROM v_messages v"


@query("ext_accepted", f"SELECT message_id FROM ({_ROUTED}) q WHERE chat_type = 'p2p' OR mention OR (said = '重试' AND reply)", "v_messages")
def _(spark, d):
    q = _with(spark, d, _ROUTED, ["v_messages"])
    return q.filter(m.accepted(m.is_private(F.col("chat_type")), F.col("mention"), m.is_retry(F.col("said")), F.col("reply"))).select("message_id")


@query("ext_routes", f"""SELECT message_id, CASE WHEN regexp_matches(said, 'https?://') THEN 'enqueue' WHEN said = '重试' THEN 'retry_missing' WHEN chat_type = 'p2p' AND said LIKE '反馈%' THEN 'feedback' WHEN chat_type = 'p2p' AND said = '帮助' THEN 'intro' WHEN chat_type = 'p2p' THEN 'none' WHEN mention THEN 'group_intro' ELSE 'none' END AS route FROM ({_ROUTED}) q""", "v_messages")
def _(spark, d):
    q = _with(spark, d, _ROUTED, ["v_messages"])
    said = F.col("said")
    has = (F.size(m.paper_refs(said)) > 0) | (F.size(m.article_urls(said)) > 0)
    return q.select("message_id", m.route(has, m.is_retry(said), m.is_private(F.col("chat_type")), F.col("mention"), m.is_feedback(said), m.asks_help(said)).alias("route"))


@query("ext_thread_context", """SELECT message_id, has_link, CASE WHEN has_link THEN content ELSE concat(content, chr(10), t) END AS context FROM (SELECT *, regexp_matches(content, 'https?://') AS has_link FROM v_messages) m
 JOIN (SELECT thread_id, string_agg(content, chr(10) ORDER BY turn, message_id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn, message_id) AS n FROM v_messages) q WHERE n <= 3 GROUP BY 1) x ON x.thread_id = m.thread_id""", "v_messages")
def _(spark, d):
    return m.with_thread_context(load(spark, d, "v_messages"), 3).select("message_id", "has_link", "context")


_DOCS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('[doc](https://x.feishu.cn/docx/Tok', CAST(event_id AS VARCHAR(20)), ')') WHEN event_id % 3 = 1 THEN concat('at https://x.feishu.cn/docx/Tok', CAST(event_id AS VARCHAR(20)), '?a=1. ') ELSE 'none' END AS t FROM events"


@query("ext_document_urls", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('https://x.feishu.cn/docx/Tok', CAST(event_id AS VARCHAR)) WHEN 1 THEN concat('https://x.feishu.cn/docx/Tok', CAST(event_id AS VARCHAR), '?a=1') ELSE '' END AS url, CASE WHEN event_id % 3 < 2 THEN concat('Tok', CAST(event_id AS VARCHAR)) ELSE '' END AS token FROM ({_DOCS}) q")
def _(spark, d):
    url = m.document_url(F.col("t"))
    return sql(spark, d, _DOCS).select("event_id", url.alias("url"), m.document_token(url).alias("token"))


_CONTENT = """SELECT c.conv_id * 1000 + c.turn AS id, c.text, CASE c.turn % 4 WHEN 0 THEN concat('{"text":"a', CAST(c.turn AS VARCHAR(9)), '","content":"b"}') WHEN 1 THEN concat('{"content":"b', CAST(c.turn AS VARCHAR(9)), '"}') WHEN 2 THEN '{broken' ELSE c.role END AS content FROM conversations c"""


@query("src_message_text", f"SELECT id, CASE id % 1000 % 4 WHEN 0 THEN concat('a', CAST(id % 1000 AS VARCHAR)) WHEN 1 THEN concat('b', CAST(id % 1000 AS VARCHAR)) ELSE content END AS first_text, CASE id % 1000 % 4 WHEN 0 THEN concat('a', CAST(id % 1000 AS VARCHAR), chr(10), 'b') WHEN 1 THEN concat('b', CAST(id % 1000 AS VARCHAR)) ELSE content END AS all_text FROM ({_CONTENT}) q")
def _(spark, d):
    return sql(spark, d, _CONTENT).select("id", m.plain_text(F.col("content")).alias("first_text"), m.joined_text(F.col("content")).alias("all_text"))


@query("src_message_defaults", "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) WHEN event_id % 3 = 1 THEN concat('om_', CAST(event_id AS VARCHAR)) ELSE '' END AS message_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS chat_type FROM events")
def _(spark, d):
    e = load(spark, d, "events")
    s = lambda c: F.col(c).cast("string")
    rows = e.select(s("event_id").alias("event_id"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("om_"), s("event_id"))).when(F.col("event_id") % 3 == 0, F.lit("")).alias("message_id"), F.when(F.col("event_id") % 3 == 0, s("user_id")).alias("id"), F.lit(None).cast("string").alias("chat_id"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("chat_type"), F.lit("").alias("message_type"), F.lit("").alias("sender_id"), F.lit("").alias("content"))
    return m.with_defaults(rows).select("event_id", "message_id", "chat_type")


# ---------------------------------------------------------------- feedback

_SAID = "SELECT event_id AS id, user_id, value, CASE event_id % 8 WHEN 0 THEN '反馈：公式坏了' WHEN 1 THEN 'hello!' WHEN 2 THEN 'I find the table cut off' WHEN 3 THEN '我想反馈图片' WHEN 4 THEN '怎么用？' WHEN 5 THEN 'x' WHEN 6 THEN 'BUG: crash' ELSE '谢谢' END AS content, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'new' WHEN 2 THEN 'done' ELSE 'triaged' END AS status, CASE WHEN event_id % 6 = 0 THEN 'ai' ELSE '' END AS feedback_source FROM events"


@query("fb_rules", f"SELECT id, content LIKE '反馈%' OR content LIKE '我想反馈%' OR content LIKE 'BUG:%' AS feedback, content = '怎么用？' AS help, content NOT IN ('hello!', '怎么用？', 'x', '谢谢') AS classify FROM ({_SAID}) q")
def _(spark, d):
    c = F.col("content")
    return sql(spark, d, _SAID).select("id", m.is_feedback(c).alias("feedback"), m.asks_help(c).alias("help"), m.worth_classifying(c).alias("classify"))


_RESPONSE = """CASE WHEN id % 11 = 0 THEN '{oops' WHEN id % 7 = 0 THEN '{"is_feedback":"true","confidence":1}' ELSE concat('{"is_feedback":', CASE WHEN id % 13 = 0 THEN 'false' ELSE 'true' END, ',"category":"', CASE WHEN id % 4 = 2 THEN 'UX' ELSE 'odd' END, '","confidence":', CAST(CAST(id % 150 AS DOUBLE) / 100 AS VARCHAR(20)), '}') END"""


@query("fb_decisions", f"""SELECT id, is_feedback, source, category, confidence FROM (SELECT id, CASE WHEN rule THEN true WHEN NOT classify THEN false ELSE ok AND c >= 0.7 END AS is_feedback, CASE WHEN rule THEN 'rule' WHEN NOT classify THEN 'heuristic' ELSE 'ai' END AS source,
 CASE WHEN rule THEN 'other' WHEN classify AND ok AND c >= 0.7 THEN CASE WHEN id % 4 = 2 THEN 'ux' ELSE 'other' END ELSE '' END AS category, CASE WHEN rule THEN 1.0 WHEN classify AND parsed THEN c ELSE 0.0 END AS confidence
 FROM (SELECT id, content LIKE '反馈%' OR content LIKE '我想反馈%' OR content LIKE 'BUG:%' AS rule, content NOT IN ('hello!', '怎么用？', 'x', '谢谢') AS classify, id % 11 <> 0 AND id % 7 <> 0 AS parsed, id % 11 <> 0 AND id % 7 <> 0 AND id % 13 <> 0 AS ok, least(1.0, CAST(id % 150 AS DOUBLE) / 100) AS c FROM ({_SAID}) q) w) z""")
def _(spark, d):
    rows = sql(spark, d, _SAID).withColumn("response", F.expr(_RESPONSE))
    return rows.select("id", m.decide_feedback(F.col("content"), F.col("response")).alias("x")).select("id", "x.*")


@query("fb_counts", f"SELECT CASE status WHEN '' THEN 'unknown' ELSE status END AS status, count(*) AS n FROM ({_SAID}) q WHERE feedback_source = 'ai' OR content LIKE '反馈%' OR content LIKE '我想反馈%' OR content LIKE 'BUG:%' GROUP BY 1")
def _(spark, d):
    return m.feedback_counts(sql(spark, d, _SAID))


@query("fb_visible", f"SELECT id FROM ({_SAID}) q WHERE feedback_source = 'ai' OR content LIKE '反馈%' OR content LIKE '我想反馈%' OR content LIKE 'BUG:%'")
def _(spark, d):
    return m.visible_feedback(sql(spark, d, _SAID)).select("id")


_UPDATES = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN ' Done' WHEN 1 THEN 'lost' ELSE 'planned' END AS new_status FROM events WHERE event_id % 2 = 0"


@query("fb_status_updates", f"SELECT q.id, CASE WHEN q.id % 2 = 0 AND q.id % 3 = 0 THEN 'done' WHEN q.id % 2 = 0 AND q.id % 3 = 2 THEN 'planned' ELSE q.status END AS status FROM ({_SAID}) q")
def _(spark, d):
    return m.update_statuses(sql(spark, d, _SAID), sql(spark, d, _UPDATES))[0].select("id", "status")


@query("fb_status_rejects", f"SELECT id, new_status FROM ({_UPDATES}) q WHERE new_status = 'lost'")
def _(spark, d):
    return m.update_statuses(sql(spark, d, _SAID), sql(spark, d, _UPDATES))[1]


@query("fb_first_contacts", "SELECT user_id AS sender_id, min(event_id) AS seq FROM events GROUP BY 1")
def _(spark, d):
    return m.first_contacts(load(spark, d, "events").select(F.col("user_id").alias("sender_id"), F.col("event_id").alias("seq")))
