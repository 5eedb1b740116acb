"""Usage, feedback and review reports; table maintenance for state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docintake.functions.text import filled, strip

DEFAULT_LIMIT, MOST_LIMIT = 80, 300


def clamp_limit(value: Column) -> Column:
    """A page size from text: 1 to 300, 80 where it is no number."""
    return F.least(F.greatest(F.coalesce(F.trim(value).try_cast("int"), F.lit(DEFAULT_LIMIT)), F.lit(1)), F.lit(MOST_LIMIT))


def status_summary(usage: DataFrame, feedback: DataFrame, jobs: DataFrame, issues: DataFrame, unresolved: Column) -> DataFrame:
    """metric, key, n - one long table: requests, feedback and jobs by status, and single figures."""
    by = lambda df, name: df.groupBy(F.coalesce(filled(F.col("status")), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "key", "n")
    one = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "n")
    parts = [by(usage, "usage"), by(feedback, "feedback"), by(jobs, "jobs"), one(usage, "documents_done", F.count_if((F.col("status") == "done") & (F.col("doc_url") != ""))), one(usage, "active_users", F.count_distinct(filled(F.col("sender_id")))), one(issues, "unresolved_issues", F.count_if(unresolved))]
    return reduce(DataFrame.unionByName, parts)


def latest(rows: DataFrame, limit: int, *keys: str, **equal: str) -> DataFrame:
    """A page: newest first, at most ``limit`` rows; empty filters don't filter."""
    for k, v in equal.items():
        if v:
            rows = rows.filter(F.col(k) == v)
    return rows.orderBy(*(F.desc(k) for k in keys)).limit(limit)


def review_stats(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category", "severity")


def named_senders(rows: DataFrame, cache: DataFrame, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with ``sender_name``: the cached name, else the first non-empty of the resolved fields, else ''."""
    c = cache.select("sender_id", F.col("display_name").alias("__cached"))
    r = resolved.select("sender_id", F.coalesce(*(filled(F.col(f)) for f in fields)).alias("__resolved"))
    got = rows.join(c, "sender_id", "left").join(r, "sender_id", "left")
    return got.withColumn("sender_name", F.coalesce(filled(F.col("__cached")), F.col("__resolved"), F.lit(""))).drop("__cached", "__resolved")


def issue_rows(found: DataFrame) -> DataFrame:
    """Issues to be appended: defaults for empty categories and severities, details clipped."""
    return found.select("source_kind", "source_id", F.coalesce(filled(F.col("category")), F.lit("other")).alias("category"), F.coalesce(filled(F.col("severity")), F.lit("medium")).alias("severity"), F.substring("detail", 1, 1000).alias("detail"))


# ---------------------------------------------------------------- state tables


def upsert(changes: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The state that a change log leads to: of each column the last value that was given (not null)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return changes.groupBy(*keys).agg(*(last(c) for c in columns))


def merge_snapshot(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` overwritten by the non-null values of ``new``; rows of either."""
    a, b = old.select(*keys, *columns), new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def last_value(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the row that comes last."""
    top = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__n", top).filter("__n = 1").drop("__n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` that are to be inserted: keys that ``old`` lacks, the first row of each."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return new.join(old.select(*keys), keys, "left_anti").withColumn("__n", first).filter("__n = 1").drop("__n")


def evolve(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Both tables' rows; columns that one lacks are filled with their defaults."""
    return old.unionByName(new, allowMissingColumns=True).fillna(defaults)


def audit_rows(rows: DataFrame) -> DataFrame:
    """job_id, event_type and the JSON detail of transitions, for an append-only log."""
    body = F.to_json(F.struct(F.col("from_state").alias("from"), F.col("to_state").alias("to"), "event", F.substring("detail", 1, 1000).alias("detail")))
    return rows.select("job_id", F.lit("transition").alias("event_type"), body.alias("detail"))


def checkpoint_decode(value: Column, fallback_url: Column) -> Column:
    """A publish checkpoint from text: struct of doc_url, expected_title and three counts, or null without a
    URL. Text that is no JSON object may itself be the URL; counts are at least 0."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    field = lambda k: F.get_json_object(F.when(raw.startswith("{"), raw), f"$.{k}")
    url = F.trim(F.coalesce(filled(field("doc_url")), filled(fallback_url), F.when(raw.rlike("^https?://"), raw), F.lit("")))
    count = lambda k: F.greatest(F.coalesce(field(k).try_cast("double").try_cast("int"), F.lit(0)), F.lit(0)).alias(k)
    return F.when(url != "", F.struct(url.alias("doc_url"), count("expected_image_min"), count("expected_latex_min"), count("expected_table_min"), F.trim(F.coalesce(field("expected_title"), F.lit(""))).alias("expected_title")))


def checkpoint_encode(c: Column) -> Column:
    """JSON text with sorted keys."""
    return F.to_json(F.struct(*(c[k].alias(k) for k in ("doc_url", "expected_image_min", "expected_latex_min", "expected_table_min", "expected_title"))))


def last_reports(rows: DataFrame, layers: dict[str, int]) -> DataFrame:
    """Of each layer (job_id, layer, seq, body) the last so many reports of a job."""
    n = F.row_number().over(Window.partitionBy("job_id", "layer").orderBy(F.desc("seq")))
    most = F.try_element_at(F.create_map(*(F.lit(x) for kv in layers.items() for x in kv)), F.col("layer"))
    return rows.withColumn("__n", n).filter(F.col("__n") <= most).drop("__n")


#: The reports of a job's folder: name pattern and how many of the last ones count.
LAYERS = {"attempt": (r"^01-.*-attempt-.*\.json$", 12), "quality": (r"^07-quality-round-.*\.json$", 8), "visual": (r"^09-visual-qa\.json$", 1), "failure": (r"^08-failure\.txt$", 1)}
#: One schema for the JSON of all layers; what a layer lacks is null.
REPORT = "errors array<string>, blocking_warnings array<string>, rounds array<struct<round:string,findings:array<struct<detail:string,kind:string,section:string>>>>"
VISUAL_ROUNDS = 4


def read_artifacts(spark: SparkSession, root: str, folder: str = "pipeline_artifacts") -> DataFrame:
    """job_id, name, content of the text files in ``<root>/<job>/<folder>``, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,md,txt}").text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select(F.element_at(parts, -3).alias("job_id"), F.element_at(parts, -2).alias("folder"), F.url_decode(F.element_at(parts, -1)).alias("name"), F.col("value").alias("content"))
    return rows.filter(F.col("folder") == folder).drop("folder")


def retry_context(files: DataFrame, most: int = 16) -> DataFrame:
    """job_id, ``feedback`` (the last ``most`` distinct lines) and ``markdown`` (the draft to go on from, or '') of the
    artifacts of failed jobs (job_id, name, content).

    Feedback, in this order: the errors of the last 12 attempts and the blocking warnings of the last 8 quality rounds,
    both by name, the findings of the last 4 visual rounds, and the last failure. Draft: the final text, else the last
    text of a quality round, else that of the last of these attempts; blank ones don't count. JSON that can't be read,
    or that isn't an object, says nothing."""
    name, text = F.col("name"), F.col("content")
    layer = F.when(F.lit(False), "")
    for k, (pattern, _) in LAYERS.items():
        layer = layer.when(name.rlike(pattern), k)
    rank = F.when(name == "05-final.md", 0).when(name.rlike(r"^05-quality-round-.*\.md$"), 1).when(name.rlike(r"^01-.*-attempt-.*\.md$"), 2)
    rows = files.select("job_id", "name", F.coalesce(text, F.lit("")).alias("content"), layer.alias("layer"), rank.alias("rank"))
    n = F.row_number().over(Window.partitionBy("job_id", "layer").orderBy(F.desc("name")))
    last = F.create_map(*(F.lit(x) for k, (_, m) in LAYERS.items() for x in (k, m)))
    reports = rows.filter("layer is not null").withColumn("n", n).filter(F.col("n") <= F.try_element_at(last, F.col("layer")))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    listed = lambda items: F.when(F.size(items) > 0, F.array(F.concat(stem, F.lit(": "), F.array_join(items, ", "))))
    said = lambda f: F.coalesce(filled(strip(f["detail"])), strip(f["kind"]), F.lit(""))
    where = lambda f: strip(F.coalesce(f["section"], F.lit("")))
    finding = lambda f: F.when(where(f) != "", F.concat(said(f), F.lit(" [section="), where(f), F.lit("]"))).otherwise(said(f))
    line = lambda r: F.when(F.size(r["findings"]) > 0, F.concat(F.lit("visual-round-"), F.coalesce(r["round"], F.lit("?")), F.lit(": "), F.array_join(F.transform(r["findings"], finding), "; ")))
    rounds = F.slice("r.rounds", F.greatest(F.size("r.rounds") - (VISUAL_ROUNDS - 1), F.lit(1)), VISUAL_ROUNDS)
    failure = strip(F.col("content"))
    lines = (
        F.when(F.col("layer") == "attempt", listed(F.col("r.errors"))).when(F.col("layer") == "quality", listed(F.col("r.blocking_warnings")))
        .when(F.col("layer") == "visual", F.array_compact(F.transform(rounds, line))).when(failure != "", F.array(F.concat(F.lit("last-job: "), failure)))
    )
    read = reports.withColumn("r", F.from_json("content", REPORT)).withColumn("lines", lines)
    place = F.array_position(F.lit(list(LAYERS)), F.col("layer"))
    told = read.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "name", "lines"))).alias("x"))
    every = F.array_distinct(F.filter(F.flatten(F.transform(F.filter("x", lambda x: x["lines"].isNotNull()), lambda x: x["lines"])), lambda x: x != ""))
    told = told.select("job_id", F.slice(every, F.greatest(F.size(every) - (most - 1), F.lit(1)), most).alias("feedback"))
    counted = reports.filter("layer = 'attempt'").select("job_id", F.regexp_replace("name", r"json$", "md").alias("name"))
    drafts = rows.filter(F.col("rank").isNotNull() & (strip(F.col("content")) != "")).join(counted.withColumn("counts", F.lit(True)), ["job_id", "name"], "left").filter("rank < 2 or counts")
    draft = drafts.groupBy("job_id").agg(F.max_by("content", F.struct(-F.col("rank"), "name")).alias("content"))
    jobs = files.select("job_id").distinct().join(told, "job_id", "left").join(draft, "job_id", "left")
    return jobs.select("job_id", F.coalesce("feedback", F.array().cast("array<string>")).alias("feedback"), F.coalesce(F.concat(strip(F.col("content")), F.lit("\n")), F.lit("")).alias("markdown"))
