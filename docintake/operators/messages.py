"""Chat messages: parsing events, extracting and routing links, classifying feedback."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import filled, hash_id, strip

# What links and commands look like.
PAPER_URL = r"(?i)https?://(?:www\.)?arxiv\.org/(abs|pdf|html)/(\d{4}\.\d{4,5})(v\d+)?(?:\.pdf)?"
BARE_ID = r"(?iU)(?<![\w./-])(\d{4}\.\d{4,5})(?:v\d+)?(?![\w.-])"
HUB_URL = r"(?i)https?://huggingface\.co/papers/(\d{4}\.\d{4,5})(?:v\d+)?"
WEB_URL = r"(?iU)https?://[^\s<>'\"\]\)]+"
CHAT_DOCUMENT = r"^https?://[^/]*(?:feishu|larksuite)\.[^/]+/(?:docx|docs|wiki|sheets|base|mindnotes|minutes)/"
DOCUMENT_URL = r"(?U)https?://[^\s<>()]+/docx/[A-Za-z0-9]+(?:\?[^\s<>()]*)?"
TRAILING = r"[.,;，。；）)\]]+$"
RETRY = r"(?iU)^(?:请|麻烦)?\s*(?:帮我)?\s*(?:重试|再试一次|重新生成|重新读)(?:\s+.*)?[。.!！]?$"
FEEDBACK = r"(?iU)^\s*(?:反馈|建议|问题|bug|吐槽|许愿|需求|feature|issue)\s*[:：,， ]"
FEEDBACK_INTENT = r"(?:我要?反馈|我想反馈|反馈一下|提个反馈|这是反馈|帮我反馈|反馈给你)"
GREETING = r"(?iU)^\s*(?:hello|hi|hey|嗨|你好|您好|在吗|谢谢|感谢|收到|好的|好滴|ok|okay|嗯|行|明白|哈哈|测试)(?:[!！。,.，?？\s]*)$"
HELP_ONLY = r"(?iU)^\s*(?:/?help|帮助|使用说明|怎么用|如何使用|自我介绍|你是谁{names})(?:[!！。,.，?？\s]*)$"
HELP = r"(?iU)^\s*/?help\s*$|帮助|使用说明|怎么用|如何使用|自我介绍|你是谁{names}"
CATEGORIES = ("bug", "quality", "feature", "ux", "other")
FEEDBACK_STATUSES = ("new", "triaged", "planned", "done", "ignored")
THREAD_KEYS = ("thread_id", "root_id", "parent_id", "root_message_id", "parent_message_id", "thread_root_id")
NAME_KEYS = ("name", "display_name", "user_name", "alias", "en_name", "zh_name")
CONFIDENT = 0.7
#: What the bot is called in messages.
BOT_NAMES = ("bot",)

MESSAGE = "event_id string, message_id string, id string, chat_id string, chat_type string, message_type string, sender_id string, content string, mentions array<map<string,string>>, thread_id string, root_id string, parent_id string, root_message_id string, parent_message_id string, thread_root_id string"


def _names(pattern: str, names: tuple[str, ...]) -> str:
    """A name in Latin letters is none within a longer word."""
    edge = r"[\p{IsLatin}\p{Nd}_]"
    latin = lambda x: x.isascii() and x.isalnum()
    whole = lambda n: (f"(?<!{edge})" if latin(n[:1]) else "") + re.escape(n) + (f"(?!{edge})" if latin(n[-1:]) else "")
    return pattern.replace("{names}", "".join("|" + whole(n) for n in names))


# ---------------------------------------------------------------- events


def parse_lines(lines: DataFrame) -> DataFrame:
    """Messages from lines of JSON (``value``); blank and malformed lines are left out. Works on batches and streams."""
    rows = lines.filter(strip("value") != "").select(F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("m"), strip("value").startswith("{").alias("object"))
    return with_defaults(rows.filter(F.col("object") & F.col("m").isNotNull() & (F.coalesce("m.event_id", "m.message_id", "m.id", "m.content").isNotNull())).select("m.*"))


def with_defaults(messages: DataFrame) -> DataFrame:
    """Missing texts are '', and the message id falls back to ``id``."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("event_id", "chat_id", "chat_type", "message_type", "sender_id", "content")}
    return messages.withColumns({**text, "message_id": F.coalesce(filled(F.col("message_id")), F.col("id"), F.lit(""))})


def mentioned(text: Column, mentions: Column, ids: tuple[str, ...] = (), names: tuple[str, ...] = BOT_NAMES) -> Column:
    """Is the bot meant: named in the text, or in a mention; mentions without any readable name count too."""
    lower = F.lower(text)
    named = F.lit(False)
    for n in names:
        named = named | lower.contains("@" + n.lower())
    wanted = [x.lower() for x in (*ids, *names)]
    values = lambda m: F.map_values(m)
    hit = F.exists(mentions, lambda m: F.exists(values(m), lambda v: F.lower(v).isin(wanted)))
    readable = F.exists(mentions, lambda m: F.exists(F.array(*(m[k] for k in NAME_KEYS)), lambda v: F.coalesce(strip(v) != "", F.lit(False))))
    opaque = (F.size(mentions) > 0) & ~F.coalesce(readable, F.lit(False))
    return named | F.coalesce(hit, F.lit(False)) | F.coalesce(opaque, F.lit(False))


def plain_text(content: Column) -> Column:
    """The text of a message: of a JSON object the first of its text and content."""
    is_object = F.ltrim(content).startswith("{")
    field = lambda k: F.when(is_object, F.get_json_object(content, f"$.{k}"))
    return F.coalesce(field("text"), field("content"), content)


def joined_text(content: Column) -> Column:
    """As ``plain_text``, but both fields, a line each."""
    is_object = F.ltrim(content).startswith("{")
    field = lambda k: F.when(is_object, F.get_json_object(content, f"$.{k}"))
    return F.coalesce(filled(F.concat_ws("\n", field("text"), field("content"))), content)


# ---------------------------------------------------------------- links


def paper_links(text: Column) -> Column:
    """array<struct<kind, paper_id, version, url>> of paper URLs, in order."""
    part = lambda g: F.regexp_extract_all(text, F.lit(PAPER_URL), F.lit(g))
    return F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("i"), part(3).alias("v")), lambda x: F.struct(F.lower(x["k"]).alias("kind"), x["i"].alias("paper_id"), x["v"].alias("version"), F.concat(F.when(F.lower(x["k"]) == "abs", F.lit("https://arxiv.org/abs/")).otherwise(F.lit("https://arxiv.org/pdf/")), x["i"], x["v"]).alias("url")))


def bare_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BARE_ID), F.lit(1))


def hub_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HUB_URL), F.lit(1))


def paper_refs(text: Column) -> Column:
    """array<struct<paper_id, url>>: from URLs, then bare ids, then hub URLs; the first of each paper."""
    plain = lambda ids: F.transform(ids, lambda i: F.struct(i.alias("paper_id"), F.concat(F.lit("https://arxiv.org/abs/"), i).alias("url")))
    found = F.concat(F.transform(paper_links(text), lambda x: F.struct(x["paper_id"].alias("paper_id"), x["url"].alias("url"))), plain(bare_ids(text)), plain(hub_ids(text)))
    ids = F.transform(found, lambda x: x["paper_id"])
    return F.filter(found, lambda x, i: F.array_position(ids, x["paper_id"]) == i + 1)


def supported_article(url: Column) -> Column:
    """A page to be read: http(s) with a host, no chat-suite document, no PDF."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(~F.lower(url).rlike(CHAT_DOCUMENT) & ~path.endswith(".pdf") & ~F.rtrim(path, F.lit("/")).endswith("/pdf") & F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & filled(host).isNotNull(), F.lit(False))


def article_urls(text: Column) -> Column:
    """Web pages in order, each once; paper URLs are left out."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(WEB_URL), F.lit(0)), lambda u: F.regexp_replace(u, TRAILING, ""))
    paper = r"(?i)arxiv\.org/(abs|pdf|html)/|huggingface\.co/papers/"
    return F.array_distinct(F.filter(urls, lambda u: ~u.rlike(paper) & supported_article(u)))


def article_id(url: Column) -> Column:
    return hash_id(url)


def links(messages: DataFrame, key: str = "message_id", text: str = "content") -> DataFrame:
    """key, pos, kind (paper, article), source_id, url of each message's links, papers first."""
    papers = F.transform(paper_refs(F.col(text)), lambda x: F.struct(F.lit("paper").alias("kind"), x["paper_id"].alias("source_id"), x["url"].alias("url")))
    articles = F.transform(article_urls(F.col(text)), lambda u: F.struct(F.lit("article").alias("kind"), article_id(u).alias("source_id"), u.alias("url")))
    return messages.select(key, papers.alias("p"), articles.alias("a")).select(key, F.posexplode(F.concat("p", "a")).alias("pos", "x")).select(key, "pos", "x.*")


def document_url(text: Column) -> Column:
    """The chat-suite document in a text or Markdown link, or ''."""
    return F.regexp_replace(F.regexp_extract(strip(text), DOCUMENT_URL, 0), r"[.,;!?]+$", "")


def document_token(url: Column) -> Column:
    return F.regexp_extract(url, r"/docx/([A-Za-z0-9]+)", 1)


# ---------------------------------------------------------------- routing


def is_private(chat_type: Column) -> Column:
    return F.lower(chat_type).isin("p2p", "private")


def is_retry(content: Column, names: tuple[str, ...] = BOT_NAMES) -> Column:
    said = "|".join([*(re.escape(n) for n in names), r"_user_\d+"])
    return strip(F.regexp_replace(strip(plain_text(content)), rf"(?iU)@(?:{said})\s*", "")).rlike(RETRY)


def is_thread_reply(*keys: Column) -> Column:
    return F.exists(F.array(*keys), lambda k: F.coalesce(k.rlike("^omt?_"), F.lit(False)))


def related_messages(own: Column, *keys: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.startswith("om_") & (k != own)))


def related_threads(*keys: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.rlike("^omt?_")))


def accepted(private: Column, mention: Column, retry: Column, reply: Column) -> Column:
    return private | mention | (retry & reply)


def with_thread_context(messages: DataFrame, most: int = 12) -> DataFrame:
    """(message_id, thread_id, turn, content) with ``context``: for messages without a link of their own, the
    first ``most`` messages of their thread, a line each. Threads are cut before they are gathered."""
    has = (F.size(paper_refs(F.col("content"))) > 0) | (F.size(article_urls(F.col("content"))) > 0)
    rows = messages.withColumn("has_link", has)
    first = F.row_number().over(Window.partitionBy("thread_id").orderBy("turn", "message_id"))
    threads = rows.withColumn("n", first).filter(F.col("n") <= most).groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n").alias("thread_text"))
    got = rows.join(threads, "thread_id", "left")
    return got.withColumn("context", F.when(F.col("has_link"), F.col("content")).otherwise(F.concat_ws("\n", "content", "thread_text"))).drop("thread_text")


def related_context(events: DataFrame, messages: DataFrame, most_threads: int = 3, page: int = 12, most_messages: int = 5) -> DataFrame:
    """message_id, ``context``, ``papers`` and ``articles`` of events (message_id, content, private, mention, retry,
    reply, threads, related) in groups that name no link themselves and ask for the bot, by mention or by a retry in a
    thread: the first ``page`` messages of up to ``most_threads`` threads, then up to ``most_messages`` related
    messages, a line each; links are looked for in the event's text and its context. ``messages``: message_id,
    thread_id, turn, content. Threads are cut before they are gathered."""
    own = (F.size(paper_refs(F.col("content"))) > 0) | (F.size(article_urls(F.col("content"))) > 0)
    asked = events.filter(~own & ~F.col("private") & (F.col("mention") | (F.col("retry") & F.col("reply")))).select("message_id", F.col("content").alias("own"), "threads", "related")
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("turn", "message_id"))
    heads = messages.withColumn("n", n).filter(F.col("n") <= page).select("thread_id", "n", "content")
    threads = asked.select("message_id", F.posexplode(F.slice("threads", 1, most_threads)).alias("g", "thread_id")).join(heads, "thread_id").select("message_id", "g", "n", "content")
    named = asked.select("message_id", F.posexplode(F.slice("related", 1, most_messages)).alias("g", "other")).withColumn("g", F.col("g") + most_threads)
    single = named.join(messages.select(F.col("message_id").alias("other"), "content"), "other").select("message_id", "g", F.lit(0).alias("n"), "content")
    lines = threads.unionByName(single).filter("content <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "n", "content"))), lambda x: x["content"]), "\n")
    found = lines.groupBy("message_id").agg(strip(text).alias("context"))
    every = F.concat_ws("\n", "own", "context")
    return asked.join(found, "message_id").select("message_id", "context", paper_refs(every).alias("papers"), article_urls(every).alias("articles"))


def route(has_link: Column, retry: Column, private: Column, mention: Column, feedback: Column, asks_help: Column) -> Column:
    return F.when(has_link, "enqueue").when(retry, "retry_missing").when(private & feedback, "feedback").when(private & asks_help, "intro").when(private, "none").when(mention, "group_intro").otherwise("none")


def first_contacts(messages: DataFrame) -> DataFrame:
    """The first message of each sender (sender_id, seq)."""
    return messages.groupBy("sender_id").agg(F.min("seq").alias("seq"))


# ---------------------------------------------------------------- feedback


def is_feedback(content: Column) -> Column:
    t = strip(plain_text(content))
    return t.rlike(FEEDBACK) | t.rlike(FEEDBACK_INTENT)


def asks_help(content: Column, names: tuple[str, ...] = BOT_NAMES) -> Column:
    return strip(plain_text(content)).rlike(_names(HELP, names))


def worth_classifying(content: Column, names: tuple[str, ...] = BOT_NAMES) -> Column:
    t = strip(plain_text(content))
    return (F.length(t) >= 2) & ~t.rlike(_names(HELP_ONLY, names)) & ~t.rlike(GREETING)


def parse_classifier(text: Column) -> Column:
    """struct<is_feedback, category, confidence> of a classifier's response, or null where it is unusable."""
    t = strip(F.coalesce(text, F.lit("")))
    t = F.when(t.rlike(r"(?s)^```.*```$"), strip(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1))).otherwise(t)
    raw = F.try_parse_json(t)
    flag = F.try_variant_get(raw, "$.is_feedback", "boolean")
    is_bool = F.coalesce(F.schema_of_variant(raw).rlike(r"is_feedback: BOOLEAN"), F.lit(False))
    category = F.lower(strip(F.coalesce(F.try_variant_get(raw, "$.category", "string"), F.lit("other"))))
    given = F.try_variant_get(raw, "$.confidence", "string")
    confidence = F.when(given.isNull(), F.lit(0.0)).otherwise(given.try_cast("double"))
    return F.when(is_bool & confidence.isNotNull(), F.struct(flag.alias("is_feedback"), F.when(category.isin(*CATEGORIES), category).otherwise("other").alias("category"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence")))


def decide_feedback(content: Column, response: Column) -> Column:
    """struct<is_feedback, source, category, confidence>: a rule, else heuristics, else the classifier."""
    p = parse_classifier(response)
    made = lambda yes, source, category, confidence: F.struct(F.lit(yes).alias("is_feedback"), F.lit(source).alias("source"), category.alias("category"), confidence.alias("confidence"))
    zero, none = F.lit(0.0), F.lit("")
    return (
        F.when(is_feedback(content), made(True, "rule", F.lit("other"), F.lit(1.0)))
        .when(~worth_classifying(content) | response.isNull(), made(False, "heuristic", none, zero))
        .when(p.isNull() | ~p["is_feedback"] | (p["confidence"] < CONFIDENT), made(False, "ai", none, F.coalesce(p["confidence"], zero)))
        .otherwise(made(True, "ai", p["category"], p["confidence"]))
    )


def visible_feedback(rows: DataFrame) -> DataFrame:
    return rows.filter(strip(F.coalesce("feedback_source", F.lit(""))).isin("rule", "ai") | is_feedback(F.col("content")))


def feedback_counts(rows: DataFrame) -> DataFrame:
    return visible_feedback(rows).groupBy(F.coalesce(filled(F.col("status")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def update_statuses(rows: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with valid new statuses taken over, updates rejected for their status) by id."""
    valid = F.lower(strip("new_status")).isin(*FEEDBACK_STATUSES)
    good = updates.filter(valid).select("id", F.lower(strip("new_status")).alias("new_status"))
    return rows.join(good, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status"), updates.filter(~F.coalesce(valid, F.lit(False)))
