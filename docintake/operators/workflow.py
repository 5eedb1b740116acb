"""The workflow state machine and the analysis of its event log.

A job's log is folded to its state by composition: within a segment of the log every possible start state is
carried through, so segments of one job are folded independently of each other, and a second pass composes
the segments. A job with very many events is thus spread over tasks. Leases, whose holders are names, are carried symbolically.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# States, events and edges of the machine.
STATES = ("queued", "claimed", "fetching", "source_ready", "generating", "generation_checking", "generation_repairing", "reviewing", "quality_checking", "quality_repairing", "publishing", "post_publish_checking", "visual_checking", "visual_repairing", "completed", "needs_source", "generation_incomplete", "quality_failed", "failed", "cancelled")
EVENTS = ("claim", "fetch_started", "source_ready", "source_missing", "generation_started", "generation_check_started", "generation_repair_required", "generation_recheck", "draft_ready", "generation_incomplete", "review_completed", "quality_repair_required", "quality_recheck", "quality_passed", "quality_rejected", "publish_succeeded", "resume_published", "visual_qa_started", "visual_repair_required", "visual_recheck", "complete", "fail", "recover", "retry", "cancel")
TERMINAL = ("completed", "needs_source", "generation_incomplete", "quality_failed", "failed", "cancelled")
RETRYABLE = ("needs_source", "generation_incomplete", "quality_failed", "failed")
EDGES = (
    ("queued", "claim", "claimed"),
    ("claimed", "fetch_started", "fetching"),
    ("fetching", "source_ready", "source_ready"),
    ("fetching", "source_missing", "needs_source"),
    ("source_ready", "generation_started", "generating"),
    ("generating", "generation_check_started", "generation_checking"),
    ("generation_checking", "generation_repair_required", "generation_repairing"),
    ("generation_repairing", "generation_recheck", "generation_checking"),
    ("generating", "draft_ready", "reviewing"),
    ("generation_checking", "draft_ready", "reviewing"),
    ("generating", "generation_incomplete", "generation_incomplete"),
    ("generation_checking", "generation_incomplete", "generation_incomplete"),
    ("generation_repairing", "generation_incomplete", "generation_incomplete"),
    ("reviewing", "review_completed", "quality_checking"),
    ("quality_checking", "quality_repair_required", "quality_repairing"),
    ("quality_repairing", "quality_recheck", "quality_checking"),
    ("quality_checking", "quality_passed", "publishing"),
    ("quality_checking", "quality_rejected", "quality_failed"),
    ("quality_repairing", "quality_rejected", "quality_failed"),
    ("publishing", "publish_succeeded", "post_publish_checking"),
    ("claimed", "resume_published", "post_publish_checking"),
    ("post_publish_checking", "visual_qa_started", "visual_checking"),
    ("visual_checking", "visual_repair_required", "visual_repairing"),
    ("visual_repairing", "visual_recheck", "visual_checking"),
    ("post_publish_checking", "quality_rejected", "quality_failed"),
    ("visual_checking", "quality_rejected", "quality_failed"),
    ("visual_repairing", "quality_rejected", "quality_failed"),
)
FAILURE_KINDS = {"needs_source": "source_unavailable", "generation_incomplete": "generation_incomplete", "quality_failed": "quality_rejected", "failed": "execution_failed", "cancelled": "cancelled"}
COMPLETABLE = ("claimed", "publishing", "post_publish_checking", "visual_checking", "visual_repairing")
LEGACY_STAGES = {"downloading": "fetching", "reading": "generating", "writing": "publishing", "verifying": "post_publish_checking", "visual_qa": "visual_checking", "visual_repair": "visual_repairing", "done": "completed", "summary_incomplete": "generation_incomplete"}
LEGACY_STATUSES = {"queued": "queued", "done": "completed", "failed": "failed", "running": "claimed"}
LOOPS = {"generation": "generation_repair_required", "quality": "quality_repair_required", "visual": "visual_repair_required"}

SEGMENT = 4096


def expanded_edges() -> list[tuple[str, str, str]]:
    """The machine's own edges and those that its policies add where it has none."""
    out = {(s, e): t for s, e, t in EDGES}
    active = [s for s in STATES if s not in TERMINAL]
    policies = [("fail", active, "failed"), ("recover", [s for s in active if s != "queued"], "queued"), ("retry", RETRYABLE, "queued"), ("cancel", active, "cancelled"), ("complete", COMPLETABLE, "completed")]
    for event, states, to in policies:
        for s in states:
            out.setdefault((s, event), to)
    return [(s, e, t) for (s, e), t in out.items()]


def edges_frame(spark: SparkSession, policies: bool = True) -> DataFrame:
    return spark.createDataFrame(expanded_edges() if policies else list(EDGES), "from_state string, event string, to_state string")


def states_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, s in TERMINAL, s in RETRYABLE, s not in TERMINAL) for s in STATES], "state string, terminal boolean, retryable boolean, active boolean")


def queue_status(state: Column) -> Column:
    return F.when(state == "queued", "queued").when(state == "completed", "done").when(state.isin(*TERMINAL), "failed").when(state.isin(*STATES), "running")


def failure_kind(state: Column) -> Column:
    out = F.when(F.lit(False), "")
    for s, k in FAILURE_KINDS.items():
        out = out.when(state == s, k)
    return out.when(state.isin(*STATES), "none")


def _lookup(d: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), value)


def state_from_legacy(status: Column, stage: Column) -> Column:
    """The state that an old (status, stage) pair stands for; null where neither says."""
    stage = F.replace(F.lower(F.trim(F.coalesce(stage, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.coalesce(F.when(stage.isin(*STATES), stage), _lookup(LEGACY_STAGES, stage), _lookup(LEGACY_STATUSES, F.lower(F.trim(F.coalesce(status, F.lit(""))))))


def next_state(log: DataFrame, edges: DataFrame) -> DataFrame:
    """``log`` (state, event) with ``to_state``; null where the machine has no such edge."""
    return log.join(F.broadcast(edges.withColumnRenamed("from_state", "state")), ["state", "event"], "left")


def _table() -> Column:
    """to-state by from-state * events + event (positions; -1: no edge), as a constant array."""
    to = {(s, e): STATES.index(t) for s, e, t in expanded_edges()}
    return F.lit([to.get((s, e), -1) for s in STATES for e in EVENTS])


def _event_number(event: Column) -> Column:
    return F.array_position(F.lit(list(EVENTS)), event).cast("int") - 1


def _carry(acc: Column, event: Column) -> Column:
    """One event through an accumulator struct(state, version, rejected)."""
    to = F.when(event >= 0, F.get(_table(), acc["state"] * len(EVENTS) + event)).otherwise(F.lit(-1))
    ok = to >= 0
    return F.struct(F.when(ok, to).otherwise(acc["state"]).alias("state"), (acc["version"] + ok.cast("int")).alias("version"), (acc["rejected"] + (~ok).cast("int")).alias("rejected"))


def _segments(log: DataFrame, segment: int) -> DataFrame:
    """job_id, segment, xs (events in order, at most ``segment`` where sequence numbers are distinct) and ``ends``:
    (state, version, rejected) after the segment by the state before it. A job's first segment begins in the first
    state; the others are carried from every state."""
    number = F.floor(F.col("seq") / segment)
    x = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("event").alias("event"), _event_number(F.col("event")).alias("e"))
    parts = log.select("job_id", number.alias("segment"), x.alias("x")).groupBy("job_id", "segment").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    parts = parts.withColumn("first", F.min("segment").over(Window.partitionBy("job_id")) == F.col("segment"))
    starts = F.when(F.col("first"), F.array(_start(F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(len(STATES) - 1)), _start))
    return parts.withColumn("ends", F.aggregate("xs", starts, lambda acc, x: F.transform(acc, lambda a: _carry(a, x["e"]))))


def _start(s: Column) -> Column:
    return F.struct(s.cast("int").alias("state"), F.lit(0).alias("version"), F.lit(0).alias("rejected"))


def _compose(acc: Column, ends: Column) -> Column:
    end = F.get(ends, acc["state"])
    return F.struct(end["state"].alias("state"), (acc["version"] + end["version"]).alias("version"), (acc["rejected"] + end["rejected"]).alias("rejected"))


def replay(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """job_id, state, version, rejected from ``log`` (job_id, seq, event): events are taken in the order of seq."""
    jobs = _segments(log, segment).select("job_id", F.struct("segment", "ends").alias("x")).groupBy("job_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    got = jobs.select("job_id", F.aggregate("xs", _start(F.lit(0)), lambda acc, x: _compose(acc, x["ends"])).alias("r"))
    return got.select("job_id", F.get(F.lit(list(STATES)), F.col("r.state")).alias("state"), F.col("r.version").alias("version"), F.col("r.rejected").alias("rejected"))


def audit(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every event of ``log`` with from_state, to_state, accepted, and version, the number of the accepted
    transition in its job. Logs are cut into segments; what each does to every state is put together to the state
    and version that each begins with, and then every segment is folded by itself."""
    parts = _segments(log, segment)
    jobs = parts.select("job_id", F.struct("segment", "ends").alias("x")).groupBy("job_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    none = F.struct(_start(F.lit(0)).alias("now"), F.array().cast("array<struct<segment:bigint,state:int,version:int>>").alias("out"))

    def along(acc: Column, x: Column) -> Column:
        begin = F.struct(x["segment"].alias("segment"), acc["now"]["state"].alias("state"), acc["now"]["version"].alias("version"))
        return F.struct(_compose(acc["now"], x["ends"]).alias("now"), F.array_append(acc["out"], begin).alias("out"))

    begins = jobs.select("job_id", F.explode(F.aggregate("xs", none, along)["out"]).alias("b")).select("job_id", "b.*")
    first = F.struct("state", "version", F.array().cast("array<struct<seq:bigint,event:string,from_no:int,to_no:int,version:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        to = F.when(x["e"] >= 0, F.get(_table(), acc["state"] * len(EVENTS) + x["e"])).otherwise(F.lit(-1))
        version = acc["version"] + (to >= 0).cast("int")
        row = F.struct(x["seq"].alias("seq"), x["event"].alias("event"), acc["state"].alias("from_no"), to.alias("to_no"), version.alias("version"))
        return F.struct(F.when(to >= 0, to).otherwise(acc["state"]).alias("state"), version.alias("version"), F.array_append(acc["out"], row).alias("out"))

    rows = parts.select("job_id", "segment", "xs").join(begins, ["job_id", "segment"]).select("job_id", F.explode(F.aggregate("xs", first, step)["out"]).alias("r"))
    name = lambda c: F.when(c >= 0, F.get(F.lit(list(STATES)), c))
    return rows.select("job_id", "r.seq", "r.event", name(F.col("r.from_no")).alias("from_state"), name(F.col("r.to_no")).alias("to_state"), (F.col("r.to_no") >= 0).alias("accepted"), F.when(F.col("r.to_no") >= 0, F.col("r.version")).alias("version"))


def transition_detail(from_state: Column, to_state: Column, event: Column, detail: Column, most: int = 1000) -> Column:
    """The JSON text of an audit row."""
    return F.to_json(F.struct(from_state.alias("from"), to_state.alias("to"), event.alias("event"), F.substring(detail, 1, most).alias("detail")))


# ---------------------------------------------------------------- leases, by composition
#
# Who holds a job's lease isn't one of a few values, so a segment is carried from every state with a symbolic holder:
# ``holder`` null stands for whoever held it before. The first event that names a worker and would have an effect splits
# such a path: in one branch that worker is the holder (``guard`` says so), in the other it isn't. A segment thus becomes
# a list of paths (begin, guard) -> (state, holder, counts), and two lists compose to one of the same form.

_PATH = "array<struct<begin:int,guard:string,state:int,holder:string,version:bigint,rejected:bigint,ignored:bigint>>"
#: Events of a segment, and segments that are put together in one step.
LEASE_SEGMENT, LEASE_FAN = 4096, 256


def _path(begin: Column, guard: Column, state: Column, holder: Column, version: Column, rejected: Column, ignored: Column) -> Column:
    return F.struct(begin.alias("begin"), guard.alias("guard"), state.alias("state"), holder.alias("holder"), version.alias("version"), rejected.alias("rejected"), ignored.alias("ignored"))


def _lease_rules() -> tuple[list[list[int]], list[list[bool]], int, set[int]]:
    """By event number (-1: none): to-state of each state (-1: no edge), whether each state ignores it; the claim's
    number; the events that end a lease."""
    no = {e: i for i, e in enumerate(EVENTS)}
    to = {(s, e): STATES.index(t) for s, e, t in expanded_edges()}
    tos = [[to.get((s, e), -1) for s in STATES] for e in EVENTS] + [[-1] * len(STATES)]
    quiet = {"fail": ("completed", *RETRYABLE), "complete": ("completed",)}
    ignores = [[s in quiet.get(e, ()) for s in STATES] for e in EVENTS] + [[False] * len(STATES)]
    return tos, ignores, no["claim"], {no[e] for e in ("recover", "complete", "fail", "retry", "cancel")}


def segment_paths(events: list[int], workers: list[str], first: bool, rules: tuple) -> list[tuple]:
    """Paths of a segment. Paths that meet in one state and holder go on as one: each keeps what its counts were more
    than the joint ones when they met, so an event costs a step for each different (state, holder) only."""
    tos, ignores, claim, ends = rules
    # (state, holder) -> [version, rejected, ignored, members]; a member: [begin, guard, more version, rejected, ignored]
    live = {(0, ""): [0, 0, 0, [[0, None, 0, 0, 0]]]} if first else {(s, None): [0, 0, 0, [[s, None, 0, 0, 0]]] for s in range(len(STATES))}
    told: set[tuple[int, str]] = set()

    def into(out: dict, key: tuple, v: int, r: int, i: int, members: list) -> None:
        known = out.get(key)
        if known is None:
            out[key] = [v, r, i, members]
            return
        if len(known[3]) < len(members):
            out[key], known, (v, r, i, members) = (large := [v, r, i, members]), large, known
        for m in members:
            m[2] += v - known[0]
            m[3] += r - known[1]
            m[4] += i - known[2]
        known[3].extend(members)

    for e, w in zip(events, workers, strict=True):
        to, ignore, named = tos[e], ignores[e], e != claim and w != ""
        out: dict[tuple, list] = {}
        for (state, holder), (v, r, i, members) in live.items():
            effect = ignore[state] or to[state] >= 0
            if named and holder != w:
                if holder is None and effect:  # where this worker holds the lease, it isn't lost
                    new = [[m[0], w, *m[2:]] for m in members if (m[0], w) not in told]
                    told.update((m[0], w) for m in new)
                    if new:
                        into(out, (state, w) if ignore[state] else (to[state], "" if e in ends else w), v + (not ignore[state]), r, i + ignore[state], new)
                into(out, (state, holder), v, r + 1, i, members)
            elif ignore[state]:
                into(out, (state, holder), v, r, i + 1, members)
            elif to[state] < 0:
                into(out, (state, holder), v, r + 1, i, members)
            else:
                into(out, (to[state], w if e == claim else "" if e in ends else holder), v + 1, r, i, members)
        live = out
    return [(m[0], m[1], state, holder, v + m[2], r + m[3], i + m[4]) for (state, holder), (v, r, i, members) in live.items() for m in members]


def _lease_paths(parts: DataFrame) -> DataFrame:
    """job_id, at, paths from (job_id, at, first, e, w): a segment's events and workers in order."""

    def run(batches):
        rules = _lease_rules()
        names = ("begin", "guard", "state", "holder", "version", "rejected", "ignored")
        kind = pa.list_(pa.struct([(n, pa.string() if n in ("guard", "holder") else pa.int32() if n in ("begin", "state") else pa.int64()) for n in names]))
        for b in batches:
            paths = [segment_paths(e, w, first, rules) for first, e, w in zip(*(b.column(c).to_pylist() for c in ("first", "e", "w")), strict=True)]
            rows = [[dict(zip(names, p, strict=True)) for p in x] for x in paths]
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("at"), pa.array(rows, kind)], ["job_id", "at", "paths"])

    return parts.mapInArrow(run, f"job_id {parts.schema['job_id'].dataType.simpleString()}, at bigint, paths {_PATH}")


def _then(a: Column, b: Column) -> Column:
    """The paths of what ``a`` stands for and then ``b``."""

    def on(p: Column, q: Column, guard: Column) -> Column:
        return _path(p["begin"], guard, q["state"], F.coalesce(q["holder"], p["holder"]), p["version"] + q["version"], p["rejected"] + q["rejected"], p["ignored"] + q["ignored"])

    def each(p: Column) -> Column:
        follow = F.filter(b, lambda q: q["begin"] == p["state"])
        known = F.filter(follow, lambda q: q["guard"] == p["holder"])
        fixed = F.transform(F.when(F.size(known) > 0, known).otherwise(F.filter(follow, lambda q: q["guard"].isNull())), lambda q: on(p, q, p["guard"]))
        split = F.filter(follow, lambda q: q["guard"].isNull() | ~F.exists(a, lambda o: (o["begin"] == p["begin"]) & o["guard"].eqNullSafe(q["guard"])))
        return F.when(p["holder"].isNull(), F.transform(split, lambda q: on(p, q, q["guard"]))).otherwise(fixed)

    return F.flatten(F.transform(a, each))


def replay_with_leases(log: DataFrame, segment: int = LEASE_SEGMENT, fan: int = LEASE_FAN) -> DataFrame:
    """job_id, state, version, worker, rejected, ignored from ``log`` (job_id, seq, event, worker_id).

    A claim takes the lease for its worker; an event that names another worker than the holder is rejected;
    recovery, completion, failure and retry end the lease; a failure reported after completion is ignored, and
    one that follows a specific failure keeps that; completion may be reported again.

    Segments of a log are folded apart (in Arrow batches: paths that meet are merged, which no built-in
    function can do), and their paths are put together ``fan`` at a time, level by level, so no array
    is longer than a segment or ``fan`` lists of paths; a list has at most a path for each state and worker that the
    segments name while the holder is open."""
    x = F.struct("seq", F.coalesce(_event_number(F.col("event")), F.lit(-1)).alias("e"), F.coalesce("worker_id", F.lit("")).alias("w"))
    parts = log.select("job_id", F.floor(F.col("seq") / segment).alias("at"), x.alias("x"))
    spread = parts.groupBy("job_id").agg(F.min("at").alias("begin"), F.max("at").alias("end"))
    reach = spread.agg(F.max(F.col("end") - F.col("begin"))).first()[0] or 0
    parts = parts.groupBy("job_id", "at").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    if reach:
        parts = parts.join(spread.filter("begin < end").select("job_id", "begin"), "job_id", "left")
    first = F.col("at") == F.coalesce("begin", "at") if reach else F.lit(True)
    parts = _lease_paths(parts.select("job_id", "at", first.alias("first"), F.col("xs.e").alias("e"), F.col("xs.w").alias("w")))
    while reach:  # a level for every factor of ``fan`` in the longest log
        reach //= fan
        parts = parts.select("job_id", F.floor(F.col("at") / fan).alias("up") if reach else F.lit(0).cast("bigint").alias("up"), F.struct("at", "paths").alias("p"))
        parts = parts.groupBy("job_id", "up").agg(F.array_sort(F.collect_list("p")).alias("ps"))
        parts = parts.select("job_id", F.col("up").alias("at"), F.aggregate(F.slice("ps", 2, F.size("ps")), F.get("ps", 0)["paths"].cast(_PATH), lambda acc, p: _then(acc, p["paths"])).alias("paths"))
    got = parts.select("job_id", F.get("paths", 0).alias("r"))
    return got.select("job_id", F.get(F.lit(list(STATES)), F.col("r.state")).alias("state"), F.col("r.version").cast("int").alias("version"), F.col("r.holder").alias("worker_id"), F.col("r.rejected").cast("int").alias("rejected"), F.col("r.ignored").cast("int").alias("ignored"))


def retry_jobs(jobs: DataFrame, watchers: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, watchers and new audit rows after the jobs in ``asked`` (id) were put back by hand.

    Only jobs with status failed go back, and only from a state that the machine lets be retried: they are queued again,
    their error, worker and times are cleared, their version goes up by one, and their watchers are to be told anew."""
    ids = asked.select("id").distinct()
    again = F.col("asked").isNotNull() & (F.col("status") == "failed") & F.col("state").isin(*RETRYABLE)
    rows = jobs.join(ids.withColumn("asked", F.lit(True)), "id", "left").withColumn("again", F.coalesce(again, F.lit(False))).drop("asked")
    put = {"status": F.lit("queued"), "state": F.lit("queued"), "last_event": F.lit("retry"), "error": F.lit(""), "worker_id": F.lit(""), "stage": F.lit("retry_queued"), "state_version": F.coalesce("state_version", F.lit(0)) + 1}
    put |= {c: F.lit(None) for c in ("started_at", "finished_at", "heartbeat_at")}
    done = rows.select(*(F.when(F.col("again"), put[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in put else F.col(c) for c in jobs.columns))
    back = rows.filter("again").select("id", "state")
    told = watchers.join(back.select(F.col("id").alias("job_id"), F.lit(True).alias("__again")), "job_id", "left")
    told = told.withColumn("notified", F.when(F.col("__again"), False).otherwise(F.col("notified"))).select(*watchers.columns)
    move = transition_detail(F.col("state"), F.lit("queued"), F.lit("retry"), F.lit("manual retry"))
    kinds = F.array(F.struct(F.lit("transition").alias("event_type"), move.alias("detail")), F.struct(F.lit("retry").alias("event_type"), F.lit("manual retry").alias("detail")))
    return done, told, back.select("id", F.explode(kinds).alias("r")).select("id", "r.*")


def checkpoints(log: DataFrame) -> DataFrame:
    """The last publish_succeeded detail of each job."""
    return log.groupBy("job_id").agg(F.max_by("detail", F.when(F.col("event") == "publish_succeeded", F.col("seq"))).alias("checkpoint"), F.count_if(F.col("event") == "publish_succeeded").alias("publishes")).filter("publishes > 0")


def resumable(jobs: DataFrame) -> DataFrame:
    """Claimed jobs with a checkpoint: they go on after publishing instead of starting over."""
    return jobs.filter((F.col("state") == "claimed") & F.col("checkpoint").isNotNull())


def stale(jobs: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Running jobs without a heartbeat since ``minutes`` before ``as_of``."""
    return jobs.filter((F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))))


def dead_workers(jobs: DataFrame, host: str, live: DataFrame) -> DataFrame:
    """Running jobs whose worker is of ``host`` and whose process is not among ``live`` (pid)."""
    parts = F.split("worker_id", ":")
    own = jobs.filter((F.col("status") == "running") & (F.get(parts, 0) == host)).withColumn("pid", F.get(parts, 1).try_cast("int"))
    return own.filter("pid is not null").join(live.select("pid"), "pid", "left_anti")


def recovery_rows(jobs: DataFrame, kind: str) -> DataFrame:
    """Two audit rows for each job to be put back in the queue."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    detail = F.concat(F.lit("worker="), text("worker_id"), F.lit(" stage="), text("stage"))
    move = transition_detail(F.col("state"), F.lit("queued"), F.lit("recover"), detail)
    rows = F.array(F.struct(F.lit("transition").alias("event_type"), move.alias("detail")), F.struct(F.lit(kind).alias("event_type"), detail.alias("detail")))
    return jobs.filter("status = 'running'").select("id", F.explode(rows).alias("r")).select("id", "r.*")


def loop_counts(log: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Repairs asked for in each bounded loop of a job, and whether any is above its budget."""
    counts = {k: F.count_if(F.col("event") == e) for k, e in LOOPS.items()}
    out = log.groupBy("job_id").agg(*(c.alias(f"{k}_repairs") for k, c in counts.items()))
    over = F.lit(False)
    for k, n in budgets.items():
        over = over | (F.col(f"{k}_repairs") > n)
    return out.withColumn("over_budget", over)


def broken_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of scenario paths (name, states array) that are no edge of the machine."""
    steps = paths.select("name", F.posexplode("states").alias("pos", "state"))
    steps = steps.withColumn("next", F.lead("state").over(Window.partitionBy("name").orderBy("pos"))).filter("next is not null")
    e = edges.select(F.col("from_state").alias("state"), F.col("to_state").alias("next")).distinct()
    return steps.join(F.broadcast(e), ["state", "next"], "left_anti").select("name", "pos", "state", "next")
