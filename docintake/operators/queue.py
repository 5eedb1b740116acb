"""Job queue analysis: request deduplication, positions, waiting times, fan-out to watchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import clip, filled, half_even, hash_id

# The reaction that tells a requester of a job's stage.
STAGE_LABELS = {"start": "Get", "downloading": "OnIt", "reading": "StatusReading", "reviewing": "THINKING", "writing": "Typing", "queued": "Get", "claimed": "Get", "running": "OnIt"}
DEFAULT_SECONDS, LEAST_SECONDS, MOST_SECONDS, HISTORY_DAYS = 300, 30, 10800, 14


def dedupe_key(kind: Column, ident: Column) -> Column:
    return F.concat_ws(":", kind, ident)


def dedupe_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each request (request_id, dedupe_key) with ``job_id`` and ``created``: it goes to the active job of its
    key with the smallest id, or else to the one that the first request of the key creates; a created job has
    the negative of that request's id until it is numbered."""
    active = jobs.filter(F.col("status").isin("queued", "running")).groupBy("dedupe_key").agg(F.min("id").alias("active_id"))
    first = requests.groupBy("dedupe_key").agg(F.min("request_id").alias("first_id"))
    got = requests.join(first, "dedupe_key").join(active, "dedupe_key", "left")
    return got.select("request_id", "dedupe_key", F.coalesce("active_id", -F.col("first_id")).alias("job_id"), (F.col("active_id").isNull() & (F.col("request_id") == F.col("first_id"))).alias("created"))


def queue_positions(jobs: DataFrame, block: int = 100_000) -> DataFrame:
    """id and position: 1, 2, ... for queued jobs by id, 0 for others.

    Ids are dealt into blocks; positions are counted within each block, and what lies before a block is a sum
    over the small table of blocks, so no task sees the whole queue."""
    rows = jobs.select("id", (F.col("status") == "queued").alias("queued"), F.floor(F.col("id") / block).alias("block"))
    sizes = rows.groupBy("block").agg(F.count_if("queued").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.sum(F.col("queued").cast("bigint")).over(Window.partitionBy("block").orderBy("id"))
    out = rows.withColumn("place", place).join(before.select("block", F.coalesce("before", F.lit(0)).alias("before")), "block")
    return out.select("id", F.when(F.col("queued"), F.col("place") + F.col("before")).otherwise(0).alias("position"))


def claim_order(jobs: DataFrame, k: int) -> DataFrame:
    """The next ``k`` jobs to be claimed: highest priority, then smallest id."""
    return jobs.filter("status = 'queued'").orderBy(F.desc("priority"), "id").limit(k)


def recent_durations(jobs: DataFrame, as_of: Column, limit: int = 12) -> DataFrame:
    """source_kind and seconds: the median of the plausible durations among the last finished jobs of a kind."""
    n = max(3, limit)
    done = jobs.filter((F.col("status") == "done") & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull() & (F.col("finished_at") >= as_of - F.expr(f"INTERVAL {HISTORY_DAYS} DAYS")))
    last = done.withColumn("n", F.row_number().over(Window.partitionBy("source_kind").orderBy(F.desc("finished_at"), F.desc("id")))).filter(F.col("n") <= n)
    took = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    kinds = jobs.select("source_kind").distinct()
    median = last.filter(took.between(LEAST_SECONDS, MOST_SECONDS)).groupBy("source_kind").agg(F.percentile(took, F.lit(0.5)).alias("m"))
    return kinds.join(median, "source_kind", "left").select("source_kind", F.coalesce(half_even(F.col("m")), F.lit(DEFAULT_SECONDS)).alias("seconds"))


def waiting_time(position: Column, workers: int, seconds: Column) -> tuple[Column, Column]:
    """(seconds to wait, seconds until done) for a queue position."""
    each = F.greatest(seconds, F.lit(60))
    batch = F.floor((F.greatest(position, F.lit(1)) - 1) / max(1, workers)) + 1
    return ((batch - 1) * each).cast("bigint"), (batch * each).cast("bigint")


def duration_text(seconds: Column) -> Column:
    """A duration in words: minutes, or hours and minutes."""
    minutes = F.greatest(half_even(seconds / 60), F.lit(1))
    hours, rest = F.floor(minutes / 60), minutes % 60
    text = lambda c: c.cast("string")
    return F.when(minutes < 60, F.concat(text(minutes), F.lit(" 分钟"))).when(rest == 0, F.concat(text(hours), F.lit(" 小时"))).otherwise(F.concat(text(hours), F.lit(" 小时 "), text(rest), F.lit(" 分钟")))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pending_watchers(watchers: DataFrame) -> DataFrame:
    return watchers.agg(F.count_if(~F.col("notified")).alias("pending"))


def watcher_messages(watchers: DataFrame, jobs: DataFrame) -> DataFrame:
    """What each watcher not yet told is to hear of its finished job, and the status its request gets."""
    ended = jobs.filter(F.col("status").isin("done", "failed")).select(F.col("id").alias("job_id"), "status", "doc_url", "source_id")
    text = F.when(F.col("status") == "done", F.concat(F.lit("done: "), "doc_url")).otherwise(F.concat(F.lit("failed: "), "source_id"))
    return watchers.filter(~F.col("notified")).join(ended, "job_id").select("watcher_id", "job_id", F.col("status").alias("usage_status"), text.alias("message"))


def progress_messages(watchers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Watchers of running jobs with the label of the job's stage."""
    running = jobs.filter("status = 'running'").select(F.col("id").alias("job_id"), "stage")
    return watchers.filter(~F.col("notified")).join(running, "job_id").select("watcher_id", "job_id", stage_label(F.col("stage")).alias("label"))


def stage_label(stage: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in STAGE_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, F.lower(F.trim(F.coalesce(stage, F.lit(""))))), F.lit(""))


def cached_results(requests: DataFrame, papers: DataFrame, articles: DataFrame) -> DataFrame:
    """``requests`` (kind, source_id, url) with ``cached_url``: that of a paper by id, or of an article by the
    hash of its URL, if it is done and has a document."""
    ready = (F.col("status") == "done") & (F.col("doc_url") != "")
    p = papers.filter(ready).select(F.lit("paper").alias("kind"), F.col("paper_id").alias("source_id"), F.col("doc_url").alias("paper_url"))
    a = articles.filter(ready).select(F.lit("article").alias("kind"), F.col("doc_id").alias("hashed"), F.col("doc_url").alias("article_url"))
    got = requests.withColumn("hashed", hash_id(F.col("url"))).join(p, ["kind", "source_id"], "left").join(a, ["kind", "hashed"], "left")
    return got.withColumn("cached_url", F.coalesce("paper_url", "article_url")).drop("hashed", "paper_url", "article_url")


def outcome(cached_url: Column, created: Column) -> Column:
    return F.when(filled(cached_url).isNotNull(), "cached").when(created, "queued").otherwise("watching")


def newest(rows: DataFrame, limit: int, *keys: str, status: str | None = None) -> DataFrame:
    """A list: newest first, at most ``limit`` rows, of one status if given."""
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(*(F.desc(k) for k in keys)).limit(limit)


def batch_plan(items: DataFrame, workers: int, cap: int) -> DataFrame:
    """(batch_id, pos) items, the first ``cap`` of each batch: wave, minutes to wait and range of finish."""
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos"))
    out = items.withColumn("n", n).filter(F.col("n") <= cap).withColumn("wave", F.ceil(F.col("n") / workers).cast("int"))
    return out.select("batch_id", "pos", "wave", ((F.col("wave") - 1) * 2).alias("wait_minutes"), F.greatest(F.lit(3), F.col("wave") * 4).alias("from_minutes"), (F.greatest(F.lit(3), F.col("wave") * 4) + 4).alias("to_minutes"))


def batch_summary(results: DataFrame) -> DataFrame:
    """batch_id, done, failed and the clipped reasons of failures in order (pos, ok, reason)."""
    reasons = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("pos", clip(F.col("reason"), 180).alias("reason")))))
    return results.groupBy("batch_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.array_join(F.transform(reasons, lambda r: r["reason"]), "; ").alias("reasons"))


def idempotency_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)
