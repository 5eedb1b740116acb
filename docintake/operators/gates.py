"""Quality gates over a corpus of generated documents: agents that report issues, completeness and structure
checks, review responses, and the ledgers of repair rounds.

Agents are Column expressions from (markdown, xml) to an array of issues, kept in a registry that users can
extend; ``inspect`` runs them in order and keeps the first of equal issues.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import braces_balanced, clip, filled, once, ordered_distinct, squeeze, strip
from docintake.operators.normalise import RAW_UNCERTAINTY, markup_diagnostics

ISSUE = "array<struct<agent:string,stage:string,severity:string,detail:string>>"
#: A placeholder for a figure in generated text.
MARKER = r"\[\w*Figure:[^\]]+\]"

# What must not be in a formula, by name.
FORMULA_RULES = (
    (r"\\bm(?!athbf\b|od\b|atrix\b)", "unsupported-bm-macro"),
    (r"\\(?:rv|erv|erm)[A-Za-z]+|\\et[A-Z][A-Za-z]*|\\t[A-Z][A-Za-z]+|\\rm(?!athrm\b)[A-Za-z]+", "unsupported-paper-macro"),
    (r"\\(?:tens|etens|mathsfit)\s*\{", "unsupported-tensor-macro"),
    (r"\\(?:matrix|vector|tr)\s*\{", "unsupported-position-macro"),
    (r"\\(?:le\s+ft|ri\s+ght|in\s+fty|ap\s+prox)\b|\^\\to\s+p\b", "split-latex-command"),
    (r"\\(?:qquad|quad)[A-Za-z]", "joined-spacing-command"),
    (r"\\(?:overline|underline|hat|widehat|tilde|widetilde|bar|vec|dot|ddot|check|breve|acute|grave)(?:\s+[A-Za-z]|[A-Z])", "fused-accent-command"),
    (r"<\s*/?\s*(?:br|p|div)\b[^<>]*>", "html-tag-in-formula"),
    (r"<\s*/?\s*latex\b[^<>]*>", "nested-latex-tag"),
    (r"\\mbox\s*\{", "mbox-command-in-formula"),
    (r"\\boldsymbol\s*\{", "boldsymbol-command-in-formula"),
    (r"\\(?:text|textnormal|textbf|textit|textsc|textrm|emph)\s*\{", "text-command-in-formula"),
    (r"\\operatorname\s*\{", "operatorname-command-in-formula"),
    (r"\\(?:label|ref|eqref|tag)\s*\{", "publish-metadata-command"),
    (r"\\(?:def|newcommand|renewcommand|usepackage|RequirePackage)\b", "latex-definition-command"),
    (r"\\begin\s*\{(?!aligned|align|array|matrix|pmatrix|bmatrix|cases)", "unsupported-begin-env"),
    (r"[\x{4e00}-\x{9fff}]", "cjk-inside-formula"),
)
FORMATTING_COMMANDS = r"\\(?:textnormal|operatorname|textbf|textit|textsc|textrm|emph|mathcal|mathbb|mathsf|mathit|mathrm|mathbf|mathtt)"
DANGLING = ("comput", "eval", "gener", "gen", "informat", "meas", "measu", "oper", "pred", "represent", "rep", "verbal")
# Formulas by their forms, amounts of money, sentences and their last words.
TAGGED, DISPLAYED, INLINE = r"(?s)<latex>(.*?)</latex>", r"(?s)\$\$(?!\$)([^$\n].{0,1200}?)\$\$(?!\$)", r"(?<!\$)\$([^$\n]{1,240}?)\$(?!\$)"
MONEY = r"(?iU)(?<!\\)\$(?=\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:USD|CNY|RMB|美元|元))?(?=\s*(?:[^\d\w]|$)))"
SENTENCE_END, CHINESE, LAST_WORD = r"[\n。！？；.!?;]", r"[\x{4e00}-\x{9fff}]", r"(?U)\b([A-Za-z]{3,12})\s*$"
# Patterns of the agents.
DOWNGRADED_FORMULA = r"<code>[^<]*(?:\\[A-Za-z]+|[_^]\{|\\frac|\\sum|\\mathbb)"
RAW_PARAGRAPH, ESCAPED_PARAGRAPH = r"(?i)</?p(?:\s[^>]*)?>", r"(?i)&lt;/?p(?:\s[^&]*)&gt;"
SWALLOWED = r"(?is)<p(?:\s[^>]*)?>.*?<br\s*/?>\s*"
SWALLOWED_TABLE = r"\|[^\n<]*\|\s*<br\s*/?>\s*\|[\s:|\-]+\|"
SUPPLEMENT, LOGO_FIGURE = "图表补充", r"(?i)(logo|brand|icon).{0,60}\[\w*Figure:"
BLOCKING = (
    "image-anchor-lookup-failed:", "image-anchor-missing:", "image-insert-failed:", "image-block-id-missing:", "image-anchor-refresh-failed:", "image-move-failed:", "image-marker-remove-failed:",
    "post-publish:marker-left-after-publish",
)
REFUSALS = ("i'm sorry, but i cannot assist", "i’m sorry, but i cannot assist", "i cannot assist with that request", "i can't assist with that request", "sorry, i can’t help", "抱歉，我无法", "不能协助")
UNRESOLVED = ("仍有", "仍然", "仍存在", "未解决", "未修复", "尚未", "无法判断", "无法确认", "无法修复", "需要人工", "需要检查", "可能错误", "可能不", "疑似", "存在风险", "事实风险")
RESOLVED = ("已修", "修正", "清理", "已清", "已改", "改为", "调整为", "中文化", "已保留", "均已保留", "未新增", "未补回", "按要求", "避免", "保持", "未改变", "更自然", "已简", "已补", "已统一")
PROMPT_LEAKS = ("the user wants me to", "let me carefully follow the rules", "let me carefully follow all the rules", "i'm instructed to generate", "i’m instructed to generate")
TRANSIENT_ERRORS = ("timeout", "timed out", "temporarily", "connection reset", "connection refused", "rate limit", "too many requests", "429", "502", "503", "504")
ERROR_TEXTS = {"document-too-short": "the document is too short", "missing-h1": "the first line is no title", "leading-code-fence": "the document begins with a code fence", "prompt-leak": "the document repeats its instructions", "duplicate-h1": "there is more than one title", "missing-tldr": "there is no TL;DR"}

# What a writer is told of each error; ``{}`` stands for the code's parameter.
FEEDBACK = {
    "missing-h1": "第一个非空行不是 H1；最终输出必须直接以 `# ` 标题开始",
    "leading-code-fence": "全文被 Markdown 代码围栏包裹；必须删除最外层围栏",
    "prompt-leak": "正文泄露了模型的思考或指令复述；必须删除这些前置解释",
    "duplicate-h1": "存在重复 H1 或重复完整文档；只保留一份最终文档",
    "missing-tldr": "缺少 TL;DR；必须在标题后保留清晰的一句话摘要",
    "retry-from-previous-failed-draft": "这是上一任务留下的失败稿；以历史失败账本为验收清单完成修复",
}
FEEDBACK_FORMS = (
    (r"(?s)^missing-section-(?:.*-)?(.*)$", "缺少第 {} 章二级标题及正文；必须补齐该章，不能只放空标题"),
    (r"(?s)^too-few-figures:(.*)$", "关键图 marker 数量不足（{}）；按方法、实验、分析位置恢复要求数量"),
)

PROTECTED = r"(?s)<latex>.*?</latex>|<code>.*?</code>"


def issue(agent: str, stage: str, severity: str, detail: Column | str) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(agent).alias("agent"), F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), detail.alias("detail"))


def when_issue(condition: Column, *args) -> Column:
    return F.when(condition, issue(*args))


def _compact(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts)).cast(ISSUE)


def formula_bodies(text: Column) -> Column:
    """Formulas: tagged spans, then raw display and inline spans of what is left, amounts of money guarded."""
    raw = F.regexp_replace(F.regexp_replace(text, TAGGED, " "), MONEY, "")
    return F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for c, p in ((text, TAGGED), (raw, DISPLAYED), (raw, INLINE))))


def body_labels(body: Column) -> Column:
    """The names of the rules that a formula breaks."""
    hits = [F.when(body.rlike(p), F.lit(label)) for p, label in FORMULA_RULES]
    count = lambda c: F.regexp_count(body, F.lit(rf"\\{c}(?![A-Za-z])"))
    return F.array_compact(F.array(*hits, F.when(count("left") != count("right"), F.lit("unbalanced-left-right")), F.when(~braces_balanced(body), F.lit("unbalanced-braces"))))


def raw_display_math(text: Column) -> Column:
    return text.rlike(r"(?<!\\)\$\$|\\\[|\\\]")


def formula_agent(markdown: Column, xml: Column) -> Column:
    parts = [_labelled(markup_diagnostics(markdown), "markdown")]
    for stage, text in (("markdown", markdown), ("xml", xml)):
        labels = F.flatten(F.transform(formula_bodies(text), body_labels))
        parts.append(_labelled(labels, stage))
        parts.append(_compact(when_issue(raw_display_math(text), "formula", stage, "medium", "raw-dollar-display-math")))
    return F.concat(*parts)


def _labelled(labels: Column, stage: str) -> Column:
    return F.transform(labels, lambda x: issue("formula", stage, "high", x)).cast(ISSUE)


def xml_agent(markdown: Column, xml: Column) -> Column:
    downgraded = xml.rlike(DOWNGRADED_FORMULA)
    left = F.transform(F.regexp_extract_all(xml, F.lit(MARKER), F.lit(0)), lambda m: issue("xml", "xml", "medium", F.concat(F.lit("unpublished-marker:"), m))).cast(ISSUE)
    return F.concat(_compact(when_issue(downgraded, "xml", "xml", "high", "latex-downgraded-to-code")), left)


def has_raw_uncertainty(text: Column, stage: str) -> Column:
    """A value with raw super- and subscript errors in a table line, or in a table element."""
    open_text = F.regexp_replace(text, "(?i)" + PROTECTED, " ")
    units = F.regexp_extract_all(open_text, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0)) if stage == "xml" else F.filter(F.split(open_text, r"\r\n|[\n\r]"), lambda x: x.contains("|"))
    return F.exists(units, lambda x: x.rlike("(?U)" + RAW_UNCERTAINTY))


def format_agent(markdown: Column, xml: Column) -> Column:
    parts = []
    for stage, text in (("markdown", markdown), ("xml", xml)):
        open_text = F.regexp_replace(text, PROTECTED, "\x00")
        parts.append(when_issue(open_text.rlike(FORMATTING_COMMANDS), "format", stage, "high", "raw-tex-formatting-command"))
        if stage == "markdown":
            parts.append(when_issue(text.rlike(RAW_PARAGRAPH), "format", stage, "high", "raw-html-paragraph-tag"))
        else:
            parts.append(when_issue(text.rlike(ESCAPED_PARAGRAPH), "format", stage, "high", "escaped-html-paragraph-tag"))
            parts.append(when_issue(text.rlike(SWALLOWED + r"#{2,6}\s+"), "format", stage, "high", "markdown-heading-inside-paragraph"))
            parts.append(when_issue(text.rlike(SWALLOWED + SWALLOWED_TABLE), "format", stage, "high", "markdown-table-inside-paragraph"))
            parts.append(when_issue(text.rlike(SWALLOWED + MARKER), "format", stage, "high", "figure-marker-inside-paragraph"))
        parts.append(when_issue(has_raw_uncertainty(text, stage), "format", stage, "high", "raw-table-math"))
    return _compact(*parts)


def figure_agent(markdown: Column, xml: Column) -> Column:
    return _compact(when_issue(markdown.contains(SUPPLEMENT), "figure", "markdown", "medium", "figure-supplement-section"), when_issue(markdown.rlike(LOGO_FIGURE), "figure", "markdown", "medium", "possible-logo-figure"))


def has_dangling_tail(text: Column) -> Column:
    """A sentence with Chinese characters that ends in the stem of an English word."""
    clean = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", "\n"), r"[*_`#>\-]+", " ")
    lines = F.filter(F.split(clean, SENTENCE_END), lambda x: x.rlike(CHINESE))
    return F.exists(lines, lambda x: F.lower(F.regexp_extract(strip(x), LAST_WORD, 1)).isin(*DANGLING))


def text_agent(markdown: Column, xml: Column) -> Column:
    parts = []
    for stage, text in (("markdown", markdown), ("xml", xml)):
        parts.append(when_issue(text.rlike(r"(?<!\?)\?\?(?!\?)"), "text", stage, "medium", "unresolved-question-placeholder"))
        parts.append(when_issue(text.contains("[TRUNCATED]"), "text", stage, "medium", "source-truncated-marker"))
        parts.append(when_issue(has_dangling_tail(text), "text", stage, "medium", "possible-truncated-english-tail"))
    return _compact(*parts)


AGENTS: dict[str, Callable[[Column, Column], Column]] = {"formula": formula_agent, "xml": xml_agent, "format": format_agent, "figure": figure_agent, "text": text_agent}


def inspect(docs: DataFrame, agents: dict[str, Callable[[Column, Column], Column]] | None = None, key: str = "doc_id") -> DataFrame:
    """key and ``issues`` (in agent order, the first of equal ones) of documents (key, markdown, xml).

    Each agent's column is computed in a projection of its own, so that no single expression grows too large
    to be compiled."""
    rows = docs.select(key, F.coalesce("markdown", F.lit("")).alias("markdown"), F.coalesce("xml", F.lit("")).alias("xml"))
    names = list(agents or AGENTS)
    rows = rows.withColumns({f"__{n}": (agents or AGENTS)[n](F.col("markdown"), F.col("xml")) for n in names})
    return rows.select(key, ordered_distinct(F.concat(*(F.col(f"__{n}") for n in names))).alias("issues"))


def issue_table(inspected: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per issue. The outer form of explode keeps Spark from inferring a filter on the array's size, which it
    would push below the projections that compute the issues, and so compute every rule twice."""
    rows = inspected.select(key, F.posexplode_outer("issues").alias("pos", "i"))
    return rows.filter("pos is not null").select(key, "pos", "i.*")


def warning(i: Column) -> Column:
    return F.concat_ws(":", F.lit("quality"), i["agent"], i["stage"], i["severity"], i["detail"])


def prepublish_warnings(issues: Column) -> Column:
    return F.filter(F.transform(issues, warning), lambda w: ~w.contains(":unpublished-marker:"))


def blocking(w: Column) -> Column:
    """Does a warning stop publication? The first matching rule decides."""
    bare = F.regexp_replace(w, "^post-publish:", "")
    return (
        F.when(bare.startswith("quality:") & bare.contains(":high:"), True)
        .when(bare.rlike(r"^visual-qa:(recheck:)?high:table-(overflow|clipped):"), False)
        .when(w.rlike(r"^visual-qa:(recheck:)?high:"), True)
        .when(w.rlike(r"^visual-qa:(remote|recheck)-error:"), True)
        .when(w.rlike(f"^({'|'.join(BLOCKING)})"), True)
        .otherwise(False)
    )


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return strip(F.regexp_extract(text, r"(?U)^\x{feff}*\s*(\S[^\n\r]*)", 1))


def completeness_errors(text: Column, markers: Column) -> Column:
    """What a generated document lacks, as codes in a fixed order."""
    line = first_line(text)
    titles = F.regexp_count(text, F.lit(r"(?m)^\s*#\s+\S"))
    named = F.regexp_count(text, F.lit(r"#\s+\[[^\]\n]+\]"))
    present = F.size(F.filter(markers, lambda m: text.contains(m)))
    needed = F.least(F.lit(3), F.size(markers))
    sections = F.regexp_extract_all(text, F.lit(r"(?m)^##\s+([1-7])(?:[.、]|\s)"), F.lit(1))
    missing = once(sections, lambda x: F.array(*(F.when(~F.array_contains(x, str(n)), f"missing-section-{n}") for n in range(1, 8))))
    leak = once(F.lower(text), lambda x: x.rlike("|".join(map(re.escape, PROMPT_LEAKS))))
    codes = [
        F.when(F.length(strip(text)) < 1800, "document-too-short"),
        F.when(~line.rlike(r"^#\s+\S"), "missing-h1"),
        F.when(line.startswith("```"), "leading-code-fence"),
        F.when(leak, "prompt-leak"),
        F.when((titles > 1) | (named > 1), "duplicate-h1"),
        F.when(~text.contains("TL;DR"), "missing-tldr"),
    ]
    few = F.when(present < needed, F.concat(F.lit("too-few-figures:"), present.cast("string"), F.lit("/"), needed.cast("string")))
    return F.array_compact(F.concat(F.array(*codes), missing, F.array(few)))


def structure_warnings(errors: Column) -> Column:
    return F.transform(errors, lambda e: F.concat(F.lit("quality:structure:markdown:high:"), e))


def error_text(code: Column) -> Column:
    """What an error code means; codes with a parameter keep it."""
    section, figures = F.regexp_extract(code, r"^missing-section-(\d+)$", 1), F.regexp_extract(code, r"^too-few-figures:(.*)$", 1)
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in ERROR_TEXTS.items() for x in kv)), code)
    return F.coalesce(known, F.when(section != "", F.concat(F.lit("section "), section, F.lit(" is missing"))), F.when(figures != "", F.concat(F.lit("figures placed: "), figures)), code)


def generation_feedback(codes: Column, attempt: Column) -> Column:
    """What the next attempt is told of the errors of one: the attempt, the code, and what it means, if that is known."""
    table = F.create_map(*(F.lit(x) for kv in FEEDBACK.items() for x in kv))

    def said(raw: Column) -> Column:
        code = strip(F.coalesce(raw, F.lit("")))
        text = F.coalesce(F.try_element_at(table, code), code)
        for pattern, form in reversed(FEEDBACK_FORMS):
            before, _, after = form.partition("{}")
            text = F.when(code.rlike(pattern), F.concat(F.lit(before), F.regexp_extract(code, pattern, 1), F.lit(after))).otherwise(text)
        return F.concat(F.lit("attempt "), attempt.cast("string"), F.lit(": ["), code, F.lit("] "), text)

    return F.transform(codes, said)


def published_errors(content: Column, title: Column, terms: Column, latex_min: Column, table_min: Column) -> Column:
    """What a delivered document lacks against what was to be delivered."""
    block = strip(F.regexp_replace(F.regexp_extract(content, r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1), r"<[^>]+>", ""))
    latex, tables = F.regexp_count(content, F.lit("<latex>")), F.regexp_count(content, F.lit(r"(?i)<table(?:\s|>)"))
    missing = F.transform(F.filter(F.transform(terms, lambda t: strip(t)), lambda t: (t != "") & ~content.contains(t)), lambda t: F.concat(F.lit("missing-term:"), F.substring(t, 1, 80)))
    ratio = lambda name, n, m: F.when((m > 0) & (n < m), F.concat(F.lit(f"{name}:"), n.cast("string"), F.lit("/"), m.cast("string")))
    tail = F.array_compact(F.array(F.when(content.rlike(MARKER), "marker-left-after-publish"), ratio("missing-latex", latex, latex_min), ratio("missing-tables", tables, table_min)))
    found = F.concat(F.array_compact(F.array(F.when((title != "") & (block == ""), "missing-title"))), missing, tail)
    return F.when(strip(content) == "", F.array(F.lit("fetch-empty"))).otherwise(ordered_distinct(found))


def post_publish(warnings: Column) -> Column:
    return ordered_distinct(F.transform(warnings, lambda w: F.concat(F.lit("post-publish:"), w)))


# ---------------------------------------------------------------- reviews


def strip_fences(c: Column) -> Column:
    t = strip(c)
    inner = F.regexp_extract(t, r"(?s)^```(?:json|markdown)?(.*)```$", 1)
    return F.when(t.rlike(r"(?s)^```.*```$") & (F.length(t) >= 6), strip(inner)).otherwise(c)


def clean_enum(c: Column, default: str) -> Column:
    return F.coalesce(filled(F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))), F.lit(default))


def unresolved(category: Column, detail: Column) -> Column:
    """Is a review issue still open? Words of open points win over words of settled ones; remarks on marker
    names alone are none."""
    d = strip(F.coalesce(detail, F.lit("")))
    name_only = (category == "figure_marker") & d.rlike("marker 名称|marker名|文件名") & d.rlike("像机构|Logo|缩写") & ~d.rlike("错位|周围段落|丢失")
    return F.when(d == "", False).when(F.coalesce(name_only, F.lit(False)), False).when(d.rlike("|".join(UNRESOLVED)), True).when(d.rlike("|".join(RESOLVED)), False).otherwise(True)


def review_issues(responses: DataFrame) -> DataFrame:
    """doc_id, pos, category, severity, detail of the open issues in responses (doc_id, text): JSON, maybe in
    a fence; what is no JSON object gives one issue that says so."""
    text = strip(strip_fences(F.col("text")))
    body = F.from_json(text, "struct<markdown:string,issues:array<struct<category:string,severity:string,detail:string>>>")
    is_json, is_object = F.try_parse_json(text).isNotNull(), text.startswith("{")
    listed = F.transform(F.coalesce(body["issues"], F.array().cast("array<struct<category:string,severity:string,detail:string>>")), lambda i: F.struct(clean_enum(i["category"], "other").alias("category"), clean_enum(i["severity"], "low").alias("severity"), F.substring(strip(F.coalesce(i["detail"], F.lit(""))), 1, 1000).alias("detail")))
    said = lambda s, d: F.array(F.struct(F.lit("other").alias("category"), F.lit(s).alias("severity"), F.lit(d).alias("detail")))
    found = F.when(~is_json, said("low", "review returned non-json markdown")).when(~is_object, said("medium", "review returned non-object json")).otherwise(F.filter(listed, lambda i: unresolved(i["category"], i["detail"])))
    return responses.select("doc_id", F.posexplode(found).alias("pos", "i")).select("doc_id", "pos", "i.*")


def refusal(text: Column) -> Column:
    t = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    out = F.lit(False)
    for r in REFUSALS:
        out = out | t.contains(r)
    return out


def numbered_section(text: Column, n: int) -> Column:
    return strip(F.regexp_extract(text, rf"(?ms)^##\s+{n}(?:[.、]|\s).*?(?=^##\s+{n + 1}(?:[.、]|\s)|\Z)", 0))


def structure_error(original: Column, reviewed: Column, markers: Column) -> Column:
    """What a review lost, or '': the first of the rules."""
    o, r = strip(original), strip(reviewed)
    lost = F.get(F.filter(markers, lambda m: o.contains(m) & ~r.contains(m)), 0)
    a, b = F.length(numbered_section(o, 3)), F.length(numbered_section(r, 3))
    return (
        F.when(o.startswith("# ") & ~first_line(r).startswith("# "), "lost H1")
        .when(o.contains("TL;DR") & ~r.contains("TL;DR"), "lost TL;DR")
        .when((a >= 600) & (b < a * 0.8), "truncated method section")
        .when((F.length(o) >= 1200) & (F.length(r) < F.length(o) * 0.65), "was truncated")
        .when(lost.isNotNull(), F.concat(F.lit("lost marker "), lost))
        .otherwise("")
    )


def transient_error(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(TRANSIENT_ERRORS))


# ---------------------------------------------------------------- ledgers


def repair_ledger(rounds: DataFrame) -> DataFrame:
    """doc_id, chosen round, passed, rounds, and whether a round changed nothing, from (doc_id, round,
    blocking, markdown): the first round without blocking warnings, else the last."""
    w = Window.partitionBy("doc_id").orderBy("round")
    rows = rounds.withColumn("same", F.coalesce(F.col("markdown") == F.lag("markdown").over(w), F.lit(False)))
    first = F.min(F.when(F.col("blocking") == 0, F.col("round")))
    return rows.groupBy("doc_id").agg(F.coalesce(first, F.max("round")).alias("chosen"), first.isNotNull().alias("passed"), F.count(F.lit(1)).alias("rounds"), F.bool_or("same").alias("stalled"))


ROUND = "round int, markdown string, blocking array<string>, issues array<string>, candidate string, error string"


def repair_outcome(rounds: DataFrame, max_rounds: int = 2, prior: Column | None = None) -> DataFrame:
    """How the repair of each document ended, from its recorded rounds (doc_id, round from 0, markdown, ``blocking``
    warnings, and of the repair call the ``issues`` it named, its ``candidate`` text, or its ``error``).

    The loop ends with the first round that has no blocking warnings, that is number ``max_rounds``, or whose candidate
    changed nothing; rounds recorded after it don't count. Gives doc_id, the ``round``, ``reason`` (passed, spent,
    no-change; open where the recorded rounds end before), the markdown, its ``blocking`` warnings, the
    ``repair_warnings`` and the ``feedback`` that a further round would be told, each once, in order of appearance."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    strings = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    number = lambda tail: F.concat(F.lit("quality-repair:round-"), (F.col("round") + 1).cast("string"), F.lit(tail))
    failed, called = F.col("error").isNotNull(), F.col("candidate").isNotNull()
    same = called & ~failed & (strip(text("candidate")) == strip(text("markdown")))
    said = F.transform(strings("issues"), lambda i: F.concat(F.lit("quality-repair:"), i))
    said = F.when(failed, F.array(F.concat(number(":model-call-failed:"), clip(squeeze(F.col("error")), 180)))).when(same, F.array_append(said, number(":no-change"))).otherwise(said)
    reason = F.when(F.size(strings("blocking")) == 0, "passed").when(F.col("round") >= max_rounds, "spent").when(same, "no-change").otherwise("open")
    rows = rounds.filter(F.col("round") <= max_rounds).select("doc_id", "round", reason.alias("reason"), F.when(same, F.col("candidate")).otherwise(text("markdown")).alias("markdown"), strings("blocking").alias("blocking"), said.alias("said"))
    one = F.struct("round", "reason", "markdown", "blocking", "said")
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("rs"))  # max_rounds + 1 of each document
    ends = F.filter(F.transform("rs", lambda r: F.when(r["reason"] != "open", r["round"])), lambda x: x.isNotNull())
    parts = parts.withColumn("end", F.coalesce(F.get(ends, 0), F.element_at("rs", -1)["round"]))
    parts = parts.withColumn("rs", F.filter("rs", lambda r: r["round"] <= F.col("end"))).withColumn("last", F.element_at("rs", -1))
    before = F.filter("rs", lambda r: ~r["reason"].isin("passed", "spent"))
    told = F.flatten(F.transform(before, lambda r: F.concat(r["blocking"], r["said"])))
    first = F.array().cast("array<string>") if prior is None else prior
    return parts.select(
        "doc_id", F.col("end").alias("round"), F.col("last.reason").alias("reason"), F.col("last.markdown").alias("markdown"), ordered_distinct(F.col("last.blocking")).alias("blocking"),
        ordered_distinct(F.flatten(F.transform(before, lambda r: r["said"]))).alias("repair_warnings"), ordered_distinct(F.concat(first, told)).alias("feedback"),
    )


def failure_ledger(rows: DataFrame, keep: int = 16) -> DataFrame:
    """The last ``keep`` distinct failures of each job in order of first appearance (job_id, seq, text)."""
    text = clip(squeeze(F.col("text")), 700)
    first = rows.withColumn("text", text).filter("text <> ''").groupBy("job_id", "text").agg(F.min("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return first.withColumn("n", n).filter(F.col("n") <= keep).select("job_id", "seq", "text")


def unwrap_outer_fence(text: Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(r"(?s)^```(?:markdown|md)?\s*\n.*\n```$"), strip(F.regexp_extract(t, r"(?s)^```(?:markdown|md)?\s*\n(.*)\n```$", 1))).otherwise(text)


def with_title(text: Column, title: Column) -> Column:
    """The document with its title as first line: prepended, or moved up where it stands further down."""
    found = F.regexp_extract(text, r"(?m)^#\s+[^\n]+", 0)
    rest = strip(F.replace(text, found, F.lit("")))
    return F.when(first_line(text).rlike(r"^#\s+\S"), text).when(found != "", F.concat(found, F.lit("\n\n"), rest)).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


def last_complete_suffix(docs: DataFrame, markers: Column, identifier: Column | None = None) -> DataFrame:
    """doc_id and the last suffix, from a title on, that has no completeness errors.

    A title is a line that begins with ``# ``; with ``identifier`` it is ``# [identifier]``, wherever it stands (``''``:
    with anything in the brackets), of the document without an outer fence. Drafts under one title are told apart by
    their place. A suffix that holds a second title isn't complete, so only the one from the last title on can be: it
    is the last match and what follows the last match, and no other suffix is ever built."""
    text = F.col("markdown") if identifier is None else unwrap_outer_fence(F.col("markdown"))
    if identifier is None:
        title = F.lit(r"(?m)^#\s+\S")
    else:
        exact = F.concat(F.lit("\\Q"), F.replace(identifier, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        title = F.concat(F.lit(r"(?U)#\s+\["), F.when(identifier == "", r"[^\]\n]+").otherwise(exact), F.lit(r"\]"))
    found = lambda t: F.try_element_at(F.regexp_extract_all(t, title, F.lit(0)), F.lit(-1))
    suffix = lambda t: F.concat(found(t), F.element_at(F.split(t, title), -1))
    whole = suffix if identifier is None else lambda t: F.concat(strip(suffix(t)), F.lit("\n"))
    complete = lambda x: x.isNotNull() & (F.size(completeness_errors(x, markers)) == 0)
    # a filter on a projected suffix would cut it anew for each rule; a generator's argument is computed once
    return docs.select("doc_id", F.explode(once(text, lambda t: F.filter(F.array(whole(t)), complete))).alias("markdown"))
