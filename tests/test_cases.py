"""Small cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docintake.functions import text as functions
from docintake.operators import figures, gates, layout, messages, normalise, pages, queue, reports, repos, rota, tex, workflow
from docintake.sources.sinks import json_lines, scratch_path, write_listing
from docintake.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(spark, f, value):
    return one(spark, f(F.lit(value)))


# ---------------------------------------------------------------- messages


def test_lines_that_are_blank_or_malformed_are_skipped(spark):
    lines = spark.createDataFrame([('{"event_id":"e1","id":"om_1","content":"hi"}',), ("",), ("nonsense",), ("{broken",)], "value string")
    got = messages.parse_lines(lines).select("event_id", "message_id", "chat_type").collect()
    assert [tuple(r) for r in got] == [("e1", "om_1", "")]


@pytest.mark.parametrize(
    ("said", "mentions", "want"),
    [("@Bot read", [], True), ("hi", [{"name": "Bot"}], True), ("hi", [{"name": "Ann"}], False), ("hi", [{"id": "x"}], True), ("hi", [], False)],
)
def test_mentions(spark, said, mentions, want):
    df = spark.createDataFrame([(said, mentions)], "t string, m array<map<string,string>>")
    assert df.select(messages.mentioned(F.col("t"), F.col("m"))).first()[0] is want


@pytest.mark.parametrize(
    ("said", "ids"),
    [
        ("https://arxiv.org/abs/2505.18091v2 and https://arxiv.org/pdf/2505.18091.pdf", ["2505.18091"]),
        ("https://arxiv.org/abs/2506.13585，公式看 2511.19416", ["2506.13585", "2511.19416"]),
        ("看2511.19416", []),
        ("https://huggingface.co/papers/2505.18091", ["2505.18091"]),
    ],
)
def test_paper_refs(spark, said, ids):
    assert [r["paper_id"] for r in text(spark, messages.paper_refs, said)] == ids


def test_urls_of_papers(spark):
    assert text(spark, messages.paper_refs, "https://arxiv.org/html/2503.08067v1")[0]["url"] == "https://arxiv.org/pdf/2503.08067v1"


def test_article_urls(spark):
    said = "[https://a.example/x](https://a.example/x) https://a.example/x. https://a.example/y.pdf https://t.feishu.cn/docx/Abc ftp://b/c"
    assert text(spark, messages.article_urls, said) == ["https://a.example/x"]


@pytest.mark.parametrize(("said", "want"), [("@Bot 重试", True), ("请帮我重新生成。", True), ("重试 2505.18091", True), ("不要重试", False)])
def test_retry(spark, said, want):
    assert text(spark, messages.is_retry, said) is want


def test_thread_ids(spark):
    keys = [F.lit(x) for x in ("om_1", "omt_2", "x", "om_1", "om_9")]
    assert one(spark, messages.related_messages(F.lit("om_9"), *keys)) == ["om_1"]
    assert one(spark, messages.related_threads(*keys)) == ["om_1", "omt_2", "om_9"]
    assert one(spark, messages.is_thread_reply(F.lit(None), F.lit("omt_1")))


def test_feedback_decisions(spark):
    ask = lambda said, response: one(spark, messages.decide_feedback(F.lit(said), F.lit(response).cast("string")))
    assert ask("反馈：公式坏了", None)["source"] == "rule"
    assert ask("hello", None)["is_feedback"] is False
    yes = ask("表格被切断了", '```json\n{"is_feedback":true,"category":"UX","confidence":1.7}\n```')
    assert (yes["source"], yes["category"], yes["confidence"]) == ("ai", "ux", 1.0)
    assert ask("表格被切断了", '{"is_feedback":true,"confidence":0.6}')["is_feedback"] is False
    assert ask("表格被切断了", "yes")["is_feedback"] is False


# ---------------------------------------------------------------- workflow, queue, rota


def log(spark, *events):
    return spark.createDataFrame([(1, i + 1, *(e if isinstance(e, tuple) else (e, ""))) for i, e in enumerate(events)], "job_id bigint, seq bigint, event string, worker_id string")


HAPPY = ("claim", "fetch_started", "source_ready", "generation_started", "generation_check_started", "draft_ready", "review_completed", "quality_passed", "publish_succeeded", "visual_qa_started", "complete")


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_replay_of_a_whole_job(spark, segment):
    assert tuple(workflow.replay(log(spark, *HAPPY, "fail"), segment).first()) == (1, "completed", 11, 1)


def test_edges_with_policies():
    assert len(workflow.EDGES) == 27 and len(workflow.expanded_edges()) == 77


def replayed(events):
    """The lease rules as a plain loop over (event, worker)."""
    edges = {(s, e): t for s, e, t in workflow.expanded_edges()}
    state, version, holder, rejected, ignored = "queued", 0, "", 0, 0
    for e, w in events:
        w = w or ""
        if e != "claim" and w and w != holder:
            rejected += 1
        elif e == "fail" and state in ("completed", *workflow.RETRYABLE) or e == "complete" and state == "completed":
            ignored += 1
        elif (state, e) not in edges:
            rejected += 1
        else:
            state, version = edges[state, e], version + 1
            holder = w if e == "claim" else "" if e in ("recover", "complete", "fail", "retry", "cancel") else holder
    return state, version, holder, rejected, ignored


@pytest.mark.parametrize(("segment", "fan"), [(1000, 256), (7, 3), (1, 2)])
def test_segments_of_leases_compose_to_the_plain_loop(spark, segment, fan):
    r = random.Random(1)
    names = ["claim"] * 4 + ["fetch_started", "source_ready", "source_missing", "generation_started", "fail", "recover", "retry", "cancel", "complete", "nonsense", None]
    jobs = {j: [(r.choice(names), r.choice(["a", "b", "c", "", None])) for _ in range(r.choice([1, 5, 30, 120]))] for j in range(40)}
    rows = [(j, 50 + k, e, w) for j, x in jobs.items() for k, (e, w) in enumerate(x)]
    got = workflow.replay_with_leases(spark.createDataFrame(rows, "job_id long, seq long, event string, worker_id string"), segment, fan)
    assert sorted(tuple(x) for x in got.select("job_id", "state", "version", "worker_id", "rejected", "ignored").collect()) == sorted((j, *replayed(x)) for j, x in jobs.items())


def test_leases_of_one_job_with_a_million_events(spark):
    names, workers = ["claim", "claim", "fetch_started", "source_ready", "fail", "retry", "recover", "nonsense"], ["a", "b", ""]
    pick = lambda x, salt: F.get(F.lit(x), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(x))).cast("int"))
    log = spark.range(1_000_000, numPartitions=4).select(F.lit(1).alias("job_id"), F.col("id").alias("seq"), pick(names, 1).alias("event"), pick(workers, 2).alias("worker_id"))
    got = workflow.replay_with_leases(log).select("state", "version", "worker_id", "rejected", "ignored").collect()
    want = replayed((x["event"], x["worker_id"]) for x in log.select("event", "worker_id").toLocalIterator(prefetchPartitions=True))
    assert [tuple(x) for x in got] == [want] and want[1] > 1000


def test_a_lost_lease_changes_nothing(spark):
    rows = log(spark, ("claim", "worker-a"), ("recover", ""), ("claim", "worker-b"), ("fetch_started", "worker-a"), ("fail", "worker-a"))
    got = workflow.replay_with_leases(rows).first()
    assert (got["state"], got["worker_id"], got["rejected"]) == ("claimed", "worker-b", 2)


def test_scenarios_follow_edges(spark):
    paths = spark.createDataFrame([("good", ["queued", "claimed", "fetching"]), ("bad", ["queued", "fetching"])], "name string, states array<string>")
    assert [r["name"] for r in workflow.broken_paths(paths, workflow.edges_frame(spark)).collect()] == ["bad"]


def test_requests_of_one_key_share_a_job(spark):
    requests = spark.createDataFrame([(1, "paper:a"), (2, "paper:a"), (3, "paper:b")], "request_id bigint, dedupe_key string")
    jobs = spark.createDataFrame([(7, "paper:b", "running"), (9, "paper:b", "queued"), (4, "paper:a", "done")], "id bigint, dedupe_key string, status string")
    got = {r["request_id"]: (r["job_id"], r["created"]) for r in queue.dedupe_requests(requests, jobs).collect()}
    assert got == {1: (-1, True), 2: (-1, False), 3: (7, False)}


@pytest.mark.parametrize(("position", "wait", "done"), [(1, 0, 720), (5, 0, 720), (6, 720, 1440)])
def test_waiting_time(spark, position, wait, done):
    assert tuple(spark.range(1).select(*queue.waiting_time(F.lit(position), 5, F.lit(720))).first()) == (wait, done)


def test_rota(spark):
    lists = spark.createDataFrame([(0, "张三, 李四=ou_2\nou_3,ou_2")], "list_id int, text string")
    roster = rota.parse_roster(lists)
    assert [(r["name"], r["user_id"]) for r in roster.orderBy("ordinal").collect()] == [("张三", "张三"), ("李四", "ou_2"), ("ou_3", "ou_3")]
    days = spark.sql("select explode(sequence(date'2026-08-11', date'2026-08-14')) as date")
    got = rota.rotation(days, roster.filter("ordinal < 2"), F.lit("2026-08-12").cast("date")).orderBy("date").collect()
    assert [r["ordinal"] for r in got] == [1, 0, 1, 0]


# ---------------------------------------------------------------- gates and text


def labels(spark, body):
    return text(spark, gates.body_labels, body)


def test_formula_rules(spark):
    assert labels(spark, r"\bmX+\rvx+\tens{K}+\matrix{A}") == ["unsupported-bm-macro", "unsupported-paper-macro", "unsupported-tensor-macro", "unsupported-position-macro"]
    assert labels(spark, r"\begin{bmatrix}a\end{bmatrix}\bmod 2") == []


def test_money_is_no_formula(spark):
    assert text(spark, gates.formula_bodies, "costs $19,627.77 and $5 but $x^2$ is one") == ["x^2"]


def test_agents_report_each_issue_once(spark):
    docs = spark.createDataFrame([(1, "| 1.28^{+0.11}_{-0.10} |\n| 1.28^{+0.11}_{-0.10} |", None), (2, None, "<p>a<br/>## b</p>")], "doc_id bigint, markdown string, xml string")
    got = {(r["doc_id"], r["detail"]) for r in gates.issue_table(gates.inspect(docs)).collect()}
    assert got == {(1, "raw-table-math"), (2, "markdown-heading-inside-paragraph")}


def test_agents_can_be_added(spark):
    docs = spark.createDataFrame([(1, "abc", "")], "doc_id bigint, markdown string, xml string")
    own = {"own": lambda m, x: F.array(gates.issue("own", "markdown", "low", "seen")).cast(gates.ISSUE)}
    assert gates.issue_table(gates.inspect(docs, own)).first()["detail"] == "seen"


def test_completeness(spark):
    good = "# [1] T\n\nTL;DR x\n" + "".join(f"## {i}. s\n{'w ' * 200}\n" for i in range(1, 8)) + "[Figure:1:a] [Figure:2:b] [Figure:3:c]"
    markers = F.lit(["[Figure:1:a]", "[Figure:2:b]", "[Figure:3:c]"])
    assert one(spark, gates.completeness_errors(F.lit(good), markers)) == []
    worse = good.replace("## 7. s", "").replace("[Figure:3:c]", "")
    assert one(spark, gates.completeness_errors(F.lit(worse), markers)) == ["missing-section-7", "too-few-figures:2/3"]


def test_last_complete_suffix(spark):
    good = "# T\n\nTL;DR x\n" + "".join(f"## {i}. s\n{'w ' * 200}\n" for i in range(1, 8))
    docs = spark.createDataFrame([(1, "# draft\nrubbish\n" + good)], "doc_id bigint, markdown string")
    assert gates.last_complete_suffix(docs, F.array().cast("array<string>")).first()["markdown"] == good


def test_last_complete_suffix_by_identifier(spark):
    body = "\nTL;DR x\n" + "".join(f"## {i}. s\n{'w ' * 200}\n" for i in range(1, 8))
    rows = [
        (1, "# [1.2] short\nThe user wants me to draft.\n# [1.2] T" + body, "1.2"),
        (2, "```markdown\n# [a.b] T" + body + "\n```", "a.b"),
        (3, "# [axb] T" + body, "a.b"),
        (4, "# [a] T" + body + "# [b] U\n", "a"),
        (5, "say # [x] T" + body, ""),
        (6, "# T" + body, ""),
        (7, "# [9] t\n" * 10_000 + "# [9] T" + body, "9"),
        (8, None, "9"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, markdown string, own string")
    got = {r["doc_id"]: r["markdown"] for r in gates.last_complete_suffix(docs, F.array().cast("array<string>"), F.col("own")).collect()}
    assert got == {1: "# [1.2] T" + body.rstrip() + "\n", 2: "# [a.b] T" + body.rstrip() + "\n", 5: "# [x] T" + body.rstrip() + "\n", 7: "# [9] T" + body.rstrip() + "\n"}


def test_repair_rounds_end(spark):
    rows = [
        (1, 0, "a", ["x"], ["m:high:z"], "b", None), (1, 1, "b", [], None, None, None), (1, 2, "c", ["y"], None, "c", None),
        (2, 0, "a", ["x", "x"], ["i"], " a ", None), (2, 1, "z", [], None, None, None),
        (3, 0, "a", ["x"], None, None, "no\nanswer"), (3, 1, "a", ["x"], [], "q", None), (3, 2, "q", ["x"], ["late"], "r", None), (3, 3, "r", [], None, None, None),
        (4, 0, "a", ["x"], [], "b", None),
    ]
    df = spark.createDataFrame(rows, f"doc_id bigint, {gates.ROUND}")
    got = {r["doc_id"]: (r["round"], r["reason"], r["markdown"], r["blocking"], r["repair_warnings"], r["feedback"]) for r in gates.repair_outcome(df, 2, F.lit(["old"])).collect()}
    q = "quality-repair:"
    assert got[1] == (1, "passed", "b", [], [q + "m:high:z"], ["old", "x", q + "m:high:z"])
    assert got[2] == (0, "no-change", " a ", ["x"], [q + "i", q + "round-1:no-change"], ["old", "x", q + "i", q + "round-1:no-change"])
    assert got[3] == (2, "spent", "q", ["x"], [q + "round-1:model-call-failed:no answer"], ["old", "x", q + "round-1:model-call-failed:no answer"])
    assert got[4] == (0, "open", "a", ["x"], [], ["old", "x"])


def test_issues_are_computed_once(spark, sf_dir):
    from docintake.plans import registry

    registry.load_all()
    plan = registry.QUERIES["qg_issues"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mathsfit") == 2  # once for either form of the text


def test_repositories_from_named_pages(spark):
    far = "pad " * 80
    docs = spark.createDataFrame(
        [
            (1, "Project page: https://a.example/x/ and more"),
            (2, f"Project page {far} https://a.example/x/ {far}"),
            (3, "see https://none.github.io/p https://a.github.io/p1 here"),
            (4, "https://w.github.io/1 https://w.github.io/2 https://w.github.io/3 https://w.github.io/4 https://a.github.io/p1"),
            (5, "our code is released at https://github.com/own/r.\nProject page: https://a.example/x/"),
            (6, "Project page: http://A.example/x/"),
            (7, None),
        ],
        "doc_id bigint, text string",
    )
    pages = spark.createDataFrame(
        [(1, "https://a.example/x/", "<a href='https://github.com/old/r'>Code</a>"), (2, "https://a.example/x/", "<a href='https://github.com/new/r/issues/1'>Code</a>"), (3, "https://a.github.io/p1", "<script>'https://gitlab.com/s/t'</script>"), (4, "https://none.github.io/p", "<p>x</p>"), (5, None, "<a href='https://github.com/q/q'>Code</a>")],
        "page_id bigint, url string, html string",
    )
    assert sorted(tuple(x) for x in repos.repositories(docs, pages).collect()) == [(1, "https://github.com/new/r"), (3, "https://gitlab.com/s/t"), (5, "https://github.com/own/r")]
    src = spark.createDataFrame([(1, "% FILE: a.tex\nsee % x\n% FILE: b.bib\nhttps://github.com/c/d", "pdf"), (2, "% FILE: b.bbl\nhttps://github.com/c/d", "body " * 9 + "\nReferences\nhttps://github.com/c/d"), (3, None, None)], "doc_id bigint, text string, pdf string")
    got = {r["doc_id"]: r["text"] for r in repos.source_text(src, fallback="pdf").collect()}
    assert "github" not in "".join(got.values()) and got[1].startswith("\nsee ") and got[2].startswith("body body") and got[3] == ""


@pytest.mark.parametrize("said", [r"a{b{c}d}{e}\{f\}", "}{a}{", "{" * 50 + "x" + "}" * 50, r"\\{x} \{ {", "no", "{\U000f0100}", ""])
def test_marked_braces_go_back(spark, said):
    marked = text(spark, functions.mark_braces, said)
    assert text(spark, functions.unmark_braces, marked) == said
    if "\U000f0100" not in said and said.count("{") == said.count("}") and "\\" not in said:
        assert "{" not in marked.partition("}{")[2]


def test_arguments_of_any_depth(spark):
    deep = "{" * 50 + "x" + "}" * 50
    assert text(spark, normalise.strip_visible_macros, rf"\textbf{{a {{b}} c}} \emph{{x \textbf{{y {{z}} w}}}} \textbf {{q}} \textbfTitle \textbf{{{deep}}}") == f"a {{b}} c x y {{z}} w q Title {deep}"
    assert text(spark, normalise.repair_formula, rf"\matrix{{{deep}}} \tr{{ A_{{b}} }} \text{{if {{x}}}} \boldsymbol{{x_{{i}}}} \bm{{\mathbf{{x}}}}") == rf"\mathbf{{{deep}}} {{A_{{b}}}}^\top \mathrm{{if {{x}}}} \mathbf{{x_{{i}}}} \mathbf{{x}}"
    macro = F.array(F.struct(F.lit("nrm").alias("name"), F.lit("|#1|_2").alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    assert text(spark, lambda c: normalise.expand_formula_macros(c, none, macro), rf"\nrm{{{deep}}} \nrm{{\nrm{{b}}}}") == f"|{deep}|_2 ||b|_2|_2"


def spread(blocks, placed, loose):
    """Snapshots among blocks, as a plain loop."""
    at = {}
    for snap, anchor in placed:
        at.setdefault(anchor + 1, []).append(f"s{snap}")
    points = [i + 1 for i, b in enumerate(blocks) if not b.startswith("[ArticleImage:")] or [len(blocks)]
    for k, snap in enumerate(loose):
        want = points[round(k * (len(points) - 1) / max(1, len(loose) - 1)) if len(loose) > 1 else 0]
        while at.get(want) and want < len(blocks):
            want += 1
        at.setdefault(want, []).append(f"s{snap}")
    out = []
    for i in range(len(blocks) + 1):
        out += at.get(i, []) + blocks[i : i + 1]
    return out


def test_snapshots_pass_over_taken_places(spark):
    r = random.Random(4)
    blocks, placed, loose, want = [], [], [], {}
    for page in range(150):
        mine = [r.choice(["text", "text", "[ArticleImage:1:x]"]) + str(k) for k in range(r.randint(0, 9))]
        snaps = list(range(r.randint(0, 8)))
        anchored = [(s, r.randrange(len(mine))) for s in snaps if mine and r.random() < 0.5]
        free = [s for s in snaps if s not in dict(anchored)]
        blocks += [(page, 0, 10 + 3 * k, b) for k, b in enumerate(mine)]
        placed += [(page, 0, 10 + 3 * a, s, f"s{s}") for s, a in anchored]
        loose += [(page, 0, s, f"s{s}") for s in free]
        want[page] = spread(mine, anchored, free)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = pages.interleave(frame(blocks, "page_id long, section int, pos long, text string"), frame(placed, "page_id long, section int, pos long, snap long, text string"), frame(loose, "page_id long, section int, snap long, text string"))
    rows = got.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("x")).select("page_id", "x.text").collect()
    assert {x["page_id"]: x["text"] for x in rows} == {k: v for k, v in want.items() if v}


def test_references_are_read_as_html_does(spark):
    import html
    from html.entities import html5

    r = random.Random(6)
    names = sorted(html5)
    said = ["&lt", "&ltx;", "&notit;", "&notin;", "&", "&;", "&#", "&#x", "&#;", "a&#65b", "&#x41g", "&#0;", "&#128;", "&#x81;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x0000000000041;", "&#11;", "&#xfdd0;", "&#x1ffff;", "&#x1F600;", "&amp;amp;amp;amp;lt;", "&NotEqualTilde;", "&unknown;", "&&lt;;", "&a" * 30, "&" + "x" * 40 + ";", None]
    said += ["".join(r.choice([f"&{r.choice(names)}", "&" + r.choice(names)[: r.randint(1, 5)], f"&#{r.randrange(70000)};", f"&#x{r.randrange(0x110000):x}", " t ", "é", ";"]) for _ in range(8)) for _ in range(300)]
    said += [f"&{n}" for n in names]

    def thrice(t):
        for _ in range(3):
            t = html.unescape(t)
        return t

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string")
    got = [x["d"] for x in rows.select("k", functions.entity_decode(F.col("t")).alias("d")).orderBy("k").collect()]
    assert [(t, g) for t, g in zip(said, got) if g != (t if t is None else thrice(t))] == []
    plan = rows.select(functions.entity_decode(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_code_is_told_from_math(spark):
    said = {"get_item": True, "alpha_beta": False, "x_i": False, "foo.bar()": False, "call_me(a_b)": True, "run(a_b)": True, "f(a_b)": False, "load(x)": False, "log(a_b)": False, "a_b = c": False, "load_all": True, " my_var ": True, "my_var\nx": False, "load(&quot;a_b&quot;)": True, r"\x_yy": False, "": False}
    rows = spark.createDataFrame(list(said.items()), "t string, w boolean").select("t", "w", normalise.code_like(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows if r["got"] != r["w"]] == []


def test_tokens_and_problems_know_their_source(spark):
    said = r"a<p>&lt;p&gt;<latex>x<br/>y</latex></p> b <latex class='k'>u{<b></latex><div></div><LATEX>\\alpha</LATEX > &lt;br&gt;"
    docs = spark.createDataFrame([(1, said), (2, None), (3, "plain")], "doc_id bigint, text string")
    got = normalise.compiled_tokens(docs).orderBy("doc_id", "pos").collect()
    mine = [r for r in got if r["doc_id"] == 1]
    assert [(r["kind"], r["value"]) for r in mine] == [("text", "a"), ("formula", "x y"), ("text", " b "), ("formula", "u{<b>"), ("formula", r"\alpha"), ("text", " <br>")]
    assert [said[r["start"] : r["end"]] for r in mine] == ["a<p>&lt;p&gt;", "<latex>x<br/>y</latex>", "</p> b ", "<latex class='k'>u{<b></latex>", r"<LATEX>\\alpha</LATEX >", " &lt;br&gt;"]
    whole = "".join(f"<latex>{r['value']}</latex>" if r["kind"] == "formula" else r["value"] for r in mine)
    assert whole == text(spark, normalise.compile_markup, said) and [r["doc_id"] for r in got if r["doc_id"] > 1] == [3]
    found = {(r["code"], r["severity"]): said[r["start"] : r["end"]] for r in normalise.markup_problems(docs).collect()}
    assert found == {("unknown-html-in-formula", "high"): "<b>", ("unbalanced-braces", "high"): "u{<b>", ("recovered-formula-wrapper", "info"): said}


def test_feedback_of_errors(spark):
    got = one(spark, gates.generation_feedback(F.lit(["missing-h1", "missing-section-3", "too-few-figures:1/3", " document-too-short "]), F.lit(2)))
    assert got == ["attempt 2: [missing-h1] " + gates.FEEDBACK["missing-h1"], "attempt 2: [missing-section-3] 缺少第 3 章二级标题及正文；必须补齐该章，不能只放空标题", "attempt 2: [too-few-figures:1/3] 关键图 marker 数量不足（1/3）；按方法、实验、分析位置恢复要求数量", "attempt 2: [document-too-short] document-too-short"]


def test_retry_context_of_folders(spark, tmp_path):
    def put(job, name, content):
        folder = tmp_path / job / "pipeline_artifacts"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))

    for k in range(14):
        put("a", f"01-paper-attempt-{k:02}.json", {"errors": [f"e{k}", "x"] if k != 5 else []})
        put("a", f"01-paper-attempt-{k:02}.md", f"draft {k}\n" if k < 13 else " ")
    put("a", "07-quality-round-1.json", {"blocking_warnings": ["w"], "other": {"deep": [1]}})
    put("a", "07-quality-round-2.json", "{broken")
    put("a", "09-visual-qa.json", {"rounds": [{"round": k, "findings": [{"detail": f"d{k}", "section": "s"}, {"kind": "k"}] if k != 3 else []} for k in range(1, 7)]})
    put("a", "08-failure.txt", " timed out \n")
    put("b", "05-final.md", "\n")
    put("b", "05-quality-round-1.md", "one\n\n")
    put("b", "05-quality-round-2.md", "two")
    put("c", "09-visual-qa.json", [])
    got = {r["job_id"]: (r["feedback"], r["markdown"]) for r in reports.retry_context(reports.read_artifacts(spark, str(tmp_path))).collect()}
    want = [f"01-paper-attempt-{k:02}: e{k}, x" for k in range(2, 14) if k != 5] + ["07-quality-round-1: w"] + [f"visual-round-{k}: d{k} [section=s]; k" for k in (4, 5, 6)] + ["last-job: timed out"]
    assert got == {"a": (want[-16:], "draft 12\n"), "b": ([], "two\n"), "c": ([], "")}


def test_tree_and_summary_of_sources(spark, tmp_path):
    for paper, n in (("p", 3), ("q", 250)):
        for k in range(n):
            f = tmp_path / paper / ("a" if k % 2 else "a-b") / f"{k:03}.tex"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text("x" * (k + 1))
    got = {r["paper_id"]: (r["files"], r["tree"].split("\n")) for r in tex.source_tree(tex.read_inventory(spark, str(tmp_path))).collect()}
    assert got["p"] == (3, ["a/001.tex", "a-b/000.tex", "a-b/002.tex"])
    assert got["q"][0] == 250 and len(got["q"][1]) == 201 and got["q"][1][-1] == "[TRUNCATED]" and got["q"][1][124:126] == ["a/249.tex", "a-b/000.tex"]
    papers = spark.createDataFrame([("p", "T", "abc", None, ["w"]), ("q", None, None, "pd", None)], "paper_id string, title string, source string, pdf_text string, warnings array<string>")
    rows = spark.createDataFrame([("p",), ("p",), ("z",)], "paper_id string")
    assert sorted((tuple(r) for r in tex.paper_summary(papers, rows, rows.limit(1)).collect()), key=str) == [("p", "T", 3, 0, 2, 1, ["w"]), ("q", None, 0, 2, 0, 0, [])]


def test_failed_jobs_are_put_back(spark):
    kind = "id bigint, status string, state string, error string, worker_id string, stage string, started_at timestamp, finished_at timestamp, heartbeat_at timestamp, state_version int, extra string"
    import datetime

    t = datetime.datetime(2026, 1, 1)
    rows = [(1, "failed", "failed", "boom", "w", "x", t, t, t, 4, "k"), (2, "failed", "cancelled", "c", "w", "x", t, t, t, 1, "k"), (3, "running", "failed", "", "w", "x", t, None, t, None, "k"), (4, "failed", "needs_source", "n", "w", "x", t, t, t, None, "k"), (5, "failed", "failed", "e", "w", "x", t, t, t, 2, "k")]
    jobs, watchers, events = workflow.retry_jobs(spark.createDataFrame(rows, kind), spark.createDataFrame([(10, 1, True), (11, 1, False), (12, 2, True), (13, 5, True)], "watcher_id bigint, job_id bigint, notified boolean"), spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (9,)], "id bigint"))
    got = {r["id"]: tuple(r)[1:] for r in jobs.collect()}
    assert got[1] == ("queued", "queued", "", "", "retry_queued", None, None, None, 5, "k") and got[4] == ("queued", "queued", "", "", "retry_queued", None, None, None, 1, "k")
    assert all(got[r[0]] == r[1:] for r in rows if r[0] in (2, 3, 5))
    assert sorted(tuple(r) for r in watchers.collect()) == [(10, 1, False), (11, 1, False), (12, 2, True), (13, 5, True)]
    assert sorted((r["id"], r["event_type"]) for r in events.collect()) == [(1, "retry"), (1, "transition"), (4, "retry"), (4, "transition")]


def test_missing_figures_of_the_method(spark):
    base = "# t\n## 1. a\nx\n## 3. Method\ny\n## 4. z\nw  \n\n"
    docs = spark.createDataFrame([(1, base), (2, "l\n" * 12), (3, base + "[Figure:1:overview]"), (4, base + "[Figure:7:a][Figure:8:b][Figure:9:c]"), (5, base)], "doc_id bigint, text string")
    rows = [(d, k, m, f"fig/{s}.png", c, None) for d in (1, 2, 3, 4) for k, (m, s, c) in enumerate([("[Figure:1:overview]", "overview", r"The \textbf{whole}  thing"), ("[Figure:2:acc]", "acc", "accuracy"), ("[Figure:3:arch]", "arch", "")])]
    inserts = spark.createDataFrame(rows, "doc_id bigint, n int, marker string, asset string, caption string, description string")
    got = {r["doc_id"]: r["text"] for r in figures.ensure_priority_markers(docs, inserts).collect()}
    block = f"\n{figures.PRIORITY_LEAD}\n[Figure:1:overview]\n**图：The whole thing**\n\n{figures.PRIORITY_LEAD}\n[Figure:3:arch]\n\n"
    assert got[1] == base.rstrip().replace("## 3. Method\n", "## 3. Method\n" + block) + "\n" and got[5] == base
    assert got[2] == "l\n" * 8 + block + "l\n" * 4 and got[3].count(figures.PRIORITY_LEAD) == 1
    got = {r["doc_id"]: r["text"] for r in figures.ensure_referenced_markers(docs, inserts).collect()}
    one = f"\n{figures.METHOD_LEAD}\n[Figure:1:overview]\n**图：The whole thing**\n\n"
    assert got[1] == base.rstrip().replace("y\n## 4", "y\n" + one + "## 4") + "\n" and got[2] == "l\n" * 12
    assert "**图：arch**" in got[3] and got[4].endswith("[Figure:9:c]") and got[5] == base


def test_dangling_tail(spark):
    assert text(spark, gates.has_dangling_tail, "这个方法 comput。下一句") is True
    assert text(spark, gates.has_dangling_tail, "only English comput.") is False


def test_structure_error(spark):
    guard = lambda a, b: one(spark, gates.structure_error(F.lit(a), F.lit(b), F.lit(["[M]"])))
    assert guard("# a\n[M]", "b [M]") == "lost H1"
    assert guard("# a\n[M]", "# a") == "lost marker [M]"
    assert guard("x" * 1300, "x" * 700) == "was truncated"
    assert guard("# a TL;DR", "# a TL;DR") == ""


def test_formula_tags(spark):
    assert text(spark, normalise.math_to_tags, r"\(k=4\) and \[a\]").split() == ["<latex>k=4</latex>", "and", "<latex>a</latex>"]


def test_polish_keeps_protected_parts(spark):
    docs = spark.createDataFrame([(r"\textbf{a} <code>\textbf{b}</code>",)], "text string")
    assert normalise.polish(docs).first()["text"] == "a <code>\\textbf{b}</code>\n"


# ---------------------------------------------------------------- TeX


FIGURE = r"""
\begin{figure}
\includegraphics{a}\includegraphics[width=1cm]{b.png} \caption{First \textbf{one}}\label{fig:1}
\includegraphics{c}\\ \includegraphics{d} \caption{Second}\label{fig:2}
\end{figure}
"""
SUBFIGURE = r"\begin{figure}\begin{subfigure}\includegraphics{x}\caption{p}\end{subfigure}\includegraphics{y}\includegraphics{z}\caption{Whole}\label{w}\end{figure}"


@pytest.fixture
def files(spark):
    rows = [("p", "main.tex", FIGURE + r"\def\us{Our Net} \newcommand{\R}{\mathbb{R}} \newcommand{\sq}[1]{#1^2} \newcommand{\two}[2]{#1#2}"), ("p", "sec/method.tex", SUBFIGURE), ("p", "x.bib", "@a")]
    return spark.createDataFrame(rows, "paper_id string, path string, content string")


def test_figures_and_grids(files):
    got = [(r["tex_file"], r["figure_index"], r["asset"], r["row"], r["col"], r["caption"], r["label"]) for r in tex.figures(files).orderBy("figure_index", "asset_index").collect()]
    assert got[:3] == [("sec/method.tex", 0, a, 0, i, "Whole", "w") for i, a in enumerate("xyz")]
    assert got[3:5] == [("main.tex", 1, "a", 0, 0, "First one", "fig:1"), ("main.tex", 1, "b.png", 0, 1, "First one", "fig:1")]
    assert got[5:] == [("main.tex", 2, "c", 0, 0, "Second", "fig:2"), ("main.tex", 2, "d", 1, 0, "Second", "fig:2")]


def test_captions(files):
    assert [r["caption"] for r in tex.captions(files).orderBy("n").collect()] == ["p", "Whole", "First one", "Second"]


def test_assets_resolve_by_place_then_stem(spark, files):
    inventory = spark.createDataFrame([("p", "sec/x.pdf"), ("p", "y.png"), ("p", "deep/z.jpg")], "paper_id string, path string")
    got = {r["asset"]: r["path"] for r in tex.resolve_assets(tex.figures(files), inventory).collect()}
    assert (got["x"], got["y"], got["z"], got["a"]) == ("sec/x.pdf", "y.png", "deep/z.jpg", "a")


def test_macros(spark, files):
    docs = tex.concatenate_files(files)
    words = {r["name"]: r["value"] for r in tex.text_macros(docs).collect()}
    assert words["us"] == "Our Net"
    formulas = {(r["name"], r["arguments"]) for r in tex.formula_macros(docs).collect()}
    assert formulas == {("us", 0), ("R", 0), ("sq", 1)}
    said = spark.createDataFrame([("p", r"\us is \usable")], "paper_id string, source string")
    assert tex.expand_macros(said, tex.text_macros(docs)).first()["source"] == r"Our Net is \usable"


def test_tables_and_contexts(spark):
    docs = spark.createDataFrame([("p", r"see \ref{t} here \begin{table}\begin{tabular}x\end{tabular}\end{table} \begin{table}none\end{table}")], "paper_id string, source string")
    assert tex.tables(docs).count() == 1
    seen = spark.createDataFrame([("p", "t"), ("p", "gone")], "paper_id string, label string")
    assert [r["label"] for r in tex.reference_contexts(docs, seen).collect()] == ["t"]


def test_files_are_read_and_listed(spark, tmp_path):
    (tmp_path / "p1" / "sec").mkdir(parents=True)
    (tmp_path / "p1" / "main.tex").write_text("a\nb")
    (tmp_path / "p1" / "sec" / "f.png").write_bytes(b"\x89PNG")
    assert [tuple(r) for r in tex.read_files(spark, str(tmp_path)).collect()] == [("p1", "main.tex", "a\nb")]
    assert [tuple(r) for r in tex.file_inventory(spark, str(tmp_path)).collect()] == [("p1", "sec/f.png", 4)]


# ---------------------------------------------------------------- pages


def blocks(spark, html, url="https://h.example/a/"):
    return pages.page_blocks(spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string"))


def test_sections_in_order(spark):
    html = '<title>T</title><p>intro</p><h2>One</h2><p>aa</p><figure><img src="i.png"><figcaption>cap</figcaption></figure><h2>Two</h2><h2>Three</h2><p>bb</p><nav><p>menu</p></nav>'
    got = [(r["title"], r["blocks"]) for r in pages.sections(blocks(spark, html)).orderBy("section").collect()]
    assert got == [("正文", ["intro"]), ("One", ["aa", "[ArticleImage:1] cap"]), ("Three", ["bb"])]
    none = spark.createDataFrame([], "page_id bigint, value bigint")
    assert [r["blocks"] for r in pages.sections(blocks(spark, html), none).orderBy("section").collect()][1] == ["aa"]


def test_unclosed_paragraphs_lose_their_text(spark):
    assert [r["text"] for r in blocks(spark, "<p>lost<p>kept</p>").filter("kind = 'text'").collect()] == ["kept"]


def test_math_inside_and_outside_of_paragraphs(spark):
    got = blocks(spark, "<p>a <d-math>x</d-math> b</p><d-math>y</d-math>")
    assert [r["text"] for r in got.filter("kind = 'text'").collect()] == ["a <latex>x</latex> b", "<latex>y</latex>"]
    assert pages.listed(got, "math").count() == 2


def test_visual_contents_name_images(spark):
    html = '<nav class="visual-toc"><img src="t.png"><d-tochead>1. Method</d-tochead></nav><h2>Method</h2><p>body</p>'
    got = pages.sections(blocks(spark, html)).first()
    assert got["blocks"][0] == "[ArticleImage:1] Method" and pages.images(blocks(spark, html)).first()["url"] == "https://h.example/a/t.png"


def test_anchors_and_repositories(spark):
    html = '<p><a href="/x">x</a> <a href="https://github.com/o/r">our <b>code</b></a></p>'
    rows = pages.anchors(blocks(spark, html))
    assert [(r["href"], r["text"]) for r in rows.orderBy("pos").collect()] == [("https://h.example/x", "x"), ("https://github.com/o/r", "our code")]
    page = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    assert repos.repos_in_anchors(rows, page).first()["repo"] == "https://github.com/o/r"


def test_image_kinds(spark):
    rows = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n00"),), (bytearray(b"<svg>"),), (bytearray(b"xx"),)], "c binary")
    assert [r[0] for r in rows.select(pages.image_kind(F.col("c"))).collect()] == ["png", "svg", ""]


def test_rendered_rows(spark):
    body = json.dumps({"sections": [{"title": " A ", "level": 2, "blocks": [" x ", ""]}, {"title": "B", "level": 2, "blocks": []}], "links": [{"text": "Code", "href": "u"}]})
    got = pages.rendered_rows(spark.createDataFrame([(1, body)], "page_id bigint, json string")).collect()
    assert [(r["title"], r["blocks"]) for r in got] == [("A", ["Links: Code u", "x"])]


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><id>1</id><title>A\n  b</title><summary>s</summary><author><name>N N</name></author><category term="cs.CL"/></entry></feed>')
    got = pages.feed_entries(spark, str(tmp_path / "f.xml")).first()
    assert (got["title"], got["authors"], got["categories"]) == ("A b", ["N N"], ["cs.CL"])


# ---------------------------------------------------------------- figures and layout


def test_markers_go_behind_their_heading(spark):
    docs = spark.createDataFrame([(1, "# t\n## 3. Method\nx\n[Figure:2:b]")], "doc_id bigint, text string")
    want = spark.createDataFrame([(1, "[Figure:1:a]", "method"), (1, "[Figure:2:b]", "method")], "doc_id bigint, marker string, section string")
    assert figures.insert_markers(docs, want).first()["text"] == "# t\n## 3. Method\n[Figure:1:a]\nx\n[Figure:2:b]"


def test_model_repairs(spark):
    body = json.dumps({"repairs": [{"block_id": "a", "mode": "text", "text": "x"}, {"block_id": "zz", "mode": "text", "text": "x"}, {"block_id": "b", "mode": "table", "text": "x"}, {"block_id": "c", "mode": "text", "text": " "}, {"block_id": "d", "mode": "text", "text": "y"}]})
    answers = spark.createDataFrame([(1, body)], "page_id bigint, response string")
    known = spark.createDataFrame([(1, k, "text") for k in "abcd"], "page_id bigint, block_id string, kind string")
    assert [r["reason"] for r in layout.repair_decisions(answers, known, 1).orderBy("pos").collect()] == ["accepted", "unknown-block", "wrong-mode", "empty", "over-limit"]


# ---------------------------------------------------------------- streams and sinks


def test_stream_of_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_id":"1","message_id":"om_1","content":"https://arxiv.org/abs/2505.18091"}\nbroken\n')
    got = streams.run_available(streams.link_stream(streams.message_stream(spark, str(tmp_path / "in"))), "links")
    assert [(r["message_id"], r["source_id"]) for r in got.collect()] == [("om_1", "2505.18091")]


def test_stale_jobs_are_recovered_once(spark, tmp_path):
    src = str(tmp_path / "beats")
    schema = "job_id bigint, ts timestamp"
    for i, rows in enumerate([[(1, "2026-01-01 00:00:00"), (2, "2026-01-01 00:00:00")], [(2, "2026-01-01 00:20:00")], [(2, "2026-01-01 00:45:00")]]):
        spark.createDataFrame(rows, "job_id bigint, t string").select("job_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{src}/{i}")
    beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = streams.run_available(streams.stale_stream(beats, 10), "stale").collect()
    assert sorted((r["job_id"], r["event"]) for r in got if r["job_id"] == 1) == [(1, "recover")]


def test_listings(spark):
    path = scratch_path(spark, "listing")
    write_listing(spark.createDataFrame([(1, "a")], "id int, name string"), path)
    assert spark.read.text(path).first()[0] == '{"id":1,"name":"a"}'
    assert json_lines(spark.createDataFrame([(1,)], "id int")).first()[0] == '{"id":1}'


# ---------------------------------------------------------------- formula markup, drafts, anchors, threads


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("说明：<p><latex>V=[T;F;M]</latex></p>结束", "说明：<latex>V=[T;F;M]</latex>结束"),
        ("<p>&lt;p&gt;<latex>x<br/>y</latex>&lt;/p&gt;</p>", "<latex>x y</latex>"),
        ("<latex>x<span>y</span></latex>", "<latex>x<span>y</span></latex>"),
        (r"<latex>\\mathbf{x}=\\mathcal{N}(x)\\mathrm{d}x\\begin{aligned}a\\ b\\j\\le i</latex>", r"<latex>\mathbf{x}=\mathcal{N}(x)\mathrm{d}x\begin{aligned}a\\ b\\j\le i</latex>"),
        ("a &lt;p&gt; kept &lt;/p&gt; b", "a &lt;p&gt; kept &lt;/p&gt; b"),
    ],
)
def test_markup_is_compiled(spark, said, want):
    assert text(spark, normalise.compile_markup, said) == want


def test_diagnostics_of_markup(spark):
    assert text(spark, normalise.markup_diagnostics, "<latex>x<span>y</span></latex> <latex>a{b</latex> <latex>a<br/>b</latex>") == ["unknown-html-in-formula", "unknown-html-in-formula", "unbalanced-braces"]
    issues = one(spark, gates.formula_agent(F.lit("<latex>x<span>y</span></latex>"), F.lit("")))
    assert ("formula", "markdown", "high", "unknown-html-in-formula") in [tuple(i) for i in issues]


@pytest.mark.parametrize(
    ("body", "ok"),
    [("x^{2}", True), (" ", False), ("a\ufffdb", False), (r"{\rm x}", False), (r"a\quadb", False), (r"\end{foo}", False), (r"\begin{aligned}a\end{aligned}", True), (r"\alpha these are words here", False), (r"\left( a", False), ("中", False), (r"\RequirePackage x", False)],
)
def test_valid_formulas(spark, body, ok):
    assert text(spark, normalise.valid_formula, body) is ok


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (r"\begin{cases}a, & x>0  \frac{b}{c}, & x<0\end{cases}", r"\begin{cases}a & x>0 \\ \frac{b}{c} & x<0\end{cases}"),
        (r"\begin{cases}a & x \\ b & y\end{cases}", r"\begin{cases}a & x \\ b & y\end{cases}"),
        (r"q\to p", r"q\to p"),
        (r"A^\to p", r"A^\top"),
        (r"\dots \vector{x}", r"\dots \mathbf{x}"),
        (r"\tr{A_{i}} \theta", r"{A_{i}}^\top \theta"),
    ],
)
def test_paper_commands_are_repaired(spark, body, want):
    assert text(spark, normalise.repair_formula, body) == want


def test_polish_recovers_wrappers_and_macros(spark):
    pair = "array<struct<name:string,value:string>>"
    df = spark.createDataFrame([(1, r"公式：<p><latex>V=\vx</latex></p> by \ours now", ([("ours", "Our Model")], [("vx", r"\mathbf{x}")], []))], f"doc_id int, text string, m struct<prose:{pair},plain:{pair},argument:{pair}>")
    assert normalise.polish(df, macros="m").first()["text"] == "公式：<latex>V=\\mathbf{x}</latex> by Our Model now\n"


def test_drafts_under_one_title_are_told_apart(spark):
    whole = "# T\n\n**TL;DR** x\n" + "".join(f"\n## {k}. Part\n" + "words of the part. " * 30 for k in range(1, 8))
    df = spark.createDataFrame([(1, "# T\nshort\n" + whole), (2, "# T\nshort"), (3, "no title")], "doc_id int, markdown string")
    got = {r["doc_id"]: r["markdown"] for r in gates.last_complete_suffix(df, F.array().cast("array<string>")).collect()}
    assert got == {1: whole}


def test_anchors_in_navigation(spark):
    rows = spark.createDataFrame([(1, "https://p.example/x/", '<nav><a href="https://github.com/a/b">Code <b>here</b></a></nav><a href="y">z<a href="w">open')], "page_id bigint, url string, html string")
    got = [(r["href"], r["text"]) for r in pages.anchors(pages.page_blocks(rows)).orderBy("pos").collect()]
    assert got == [("https://github.com/a/b", "Code here")]
    assert repos.repos_in_anchors(pages.anchors(pages.page_blocks(rows)), rows).first()["repo"] == "https://github.com/a/b"


def test_overviews_come_first_and_odd_headings_last(spark):
    snaps = spark.createDataFrame([(1, "overview", 200, 11, "b"), (1, "overview", 100, 10, "a"), (1, "figure", 5, 12, "c")], "page_id bigint, kind string, y int, n bigint, caption string")
    assert [tuple(r) for r in pages.overview_sections(snaps).collect()] == [(1, -1, "原网页标题区和可视目录", 1, ["[ArticleImage:10] a", "[ArticleImage:11] b"])]
    sections = spark.createDataFrame([(1, 0, "Title"), (1, 1, "Later")], "page_id bigint, section bigint, title string")
    q = spark.createDataFrame([(1, 1, ""), (1, 2, "Nothing like it"), (1, 3, "2. later")], "page_id bigint, snap bigint, heading string")
    assert {r["snap"]: r["section"] for r in pages.match_sections(q, sections).collect()} == {1: 0, 2: 1, 3: 1}


def test_links_of_related_messages(spark):
    events = spark.createDataFrame(
        [(1, "@Bot look", False, True, False, False, [7], []), (2, "重试", False, False, True, True, [7], []), (3, "hi", False, False, False, False, [7], []), (4, "x", True, True, False, False, [7], []), (5, "y", False, True, False, False, [], [70])],
        "message_id bigint, content string, private boolean, mention boolean, retry boolean, reply boolean, threads array<bigint>, related array<bigint>",
    )
    said = spark.createDataFrame([(70, 7, 0, "原消息 https://arxiv.org/abs/2604.12946"), (71, 7, 1, "more")], "message_id bigint, thread_id bigint, turn int, content string")
    got = {r["message_id"]: [x["paper_id"] for x in r["papers"]] for r in messages.related_context(events, said).collect()}
    assert got == {1: ["2604.12946"], 2: ["2604.12946"], 5: ["2604.12946"]}


def test_audits_of_cut_logs_are_those_of_whole_ones(spark):
    r = __import__("random").Random(3)
    rows = [(j, k, r.choice(workflow.EVENTS)) for j in range(4) for k in range(60)]
    log = spark.createDataFrame(rows, "job_id bigint, seq bigint, event string")
    whole, cut = (sorted(map(tuple, workflow.audit(log, n).collect()), key=repr) for n in (1000, 7))
    assert whole == cut and len(cut) == 240 and any(x[5] for x in cut) and not all(x[5] for x in cut)
    assert sorted(map(tuple, workflow.replay(log, 7).collect())) == sorted(map(tuple, workflow.replay(log, 1000).collect()))
