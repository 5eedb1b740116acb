"""Code repositories that belong to documents: from their own text, or from project pages that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import filled
from docintake.operators.pages import anchors, page_blocks

# Hosts, and words that tell a project's own code.
FORGES = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org")
BLOCKED_OWNERS = ("topics", "features", "collections", "marketplace", "explore")
BLOCKED_SECTIONS = ("issues", "pulls", "projects", "stars", "followers", "following")
HUB_SECTIONS = ("papers", "docs", "spaces")
NO_PROJECT_HOSTS = ("arxiv.org", "openreview.net", "doi.org", "aclanthology.org", "paperswithcode.com", "fonts.googleapis.com", "cdn.jsdelivr.net")
CODE_WORDS = ("code", "github", "gitlab", "repository", "repo", "source", "implementation", "代码", "仓库", "源码")
PROJECT_WORDS = ("project page", "project website", "official project", "code is available", "code available", "repository is available", "项目主页", "项目网站", "代码仓库")
URL = r"""(?U)https?://[^\s<>{}\\"'`]+"""
RELEASED = r"\b(?:our\s+)?code\s+(?:is\s+)?(?:available|released|open[- ]sourced)\b"
OFFICIAL = r"\b(?:source\s+code|official\s+implementation|our\s+implementation|codebase|repository|repo)\b"


def clean_url(c: Column) -> Column:
    """A web address without trailing punctuation, or null."""
    u = F.replace(F.regexp_replace(F.trim(c), r"[).,;:!?，。；：）\]]+$", ""), F.lit("&amp;"), F.lit("&"))
    return F.when(u.rlike(r"^https?://[^/?#\s]+"), u)


def urls(text: Column) -> Column:
    """Cleaned addresses of a text, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), clean_url)))


def canonical_repo(c: Column) -> Column:
    """The address of the repository that a URL points into, or null."""
    u = clean_url(c)
    scheme, host = F.regexp_extract(u, "^(https?)://", 1), F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    a, b = F.get(parts, 0), F.get(parts, 1)
    made = F.concat(scheme, F.lit("://"), host, F.lit("/"), a, F.lit("/"), b)
    forge = host.isin(*FORGES) & b.isNotNull() & ~F.lower(a).isin(*BLOCKED_OWNERS) & ~F.lower(b).isin(*BLOCKED_SECTIONS)
    hub = (host == "huggingface.co") & b.isNotNull() & ~a.isin(*HUB_SECTIONS)
    return F.when(forge | hub, made).when((host == "sourceforge.net") & b.isNotNull(), F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, "/+$", "")))


def drop_bibliography(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the lines that follow the mark of a bibliography file, up to the next file's mark."""
    w = Window.partitionBy(key).orderBy("at")
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    mark = F.when(F.col("line").startswith("% FILE:"), F.lower(F.trim("line")).rlike(r"\.(bib|bbl)$"))
    rows = rows.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))).filter("not inside")
    kept = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias(text))
    return docs.select(key).join(kept, key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def strip_comments(c: Column) -> Column:
    r"""TeX without comments; \% stays, \\% begins one."""
    return F.regexp_replace(c, r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")


def cut_references(c: Column, share: float = 0.35) -> Column:
    """The text before its list of references: the first such heading that begins after a share of the text."""
    heading = r"(?im)^\s*(?:#+\s*|\\section\*?\{\s*)?(?:references|bibliography)\s*\}?\s*$"
    least = F.floor(F.length(c) * share).cast("int")
    # a share that ends within a line must not look like the line's beginning
    cut = F.when((least == 0) | (F.substr(c, least, F.lit(1)) == "\n"), "").otherwise("\x01")
    at = F.regexp_instr(F.concat(cut, F.substr(c, least + 1, F.length(c))), F.lit(heading)) - F.length(cut)
    return F.when(at > 0, F.rtrim(F.substr(c, F.lit(1), least + at - 1))).otherwise(c)


def repos_in_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the repository that the text most clearly calls its own: each address is judged by the rest of its
    line; the best score above 0 wins, then the first."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.col("line").contains("://"))
    rows = lines.select(key, "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(URL), F.lit(0))).alias("n", "url"))
    rows = rows.withColumn("repo", canonical_repo(F.col("url"))).filter("repo is not null")
    around = F.lower(F.replace(F.col("line"), F.col("url"), F.lit(" ")))
    score = F.when(around.rlike(RELEASED), 200).otherwise(0) + F.when(around.rlike(OFFICIAL), 100).otherwise(0) - F.when(F.ltrim("line").rlike("^(%|//|#)"), 80).otherwise(0) - F.when(around.contains("template") | F.lower("repo").contains("template"), 300).otherwise(0)
    rows = rows.withColumn("score", score).filter("score > 0")
    return rows.groupBy(key).agg(F.max_by(F.struct("repo", "score"), F.struct("score", -F.col("line_no"), -F.col("n"))).alias("m")).select(key, "m.repo", "m.score")


def project_page(c: Column) -> Column:
    """May a URL be a project's page?"""
    host, lower = F.lower(F.regexp_extract(c, r"^https?://([^/?#]+)", 1)), F.lower(c)
    return ~host.rlike("|".join(h.replace(".", r"\.") for h in NO_PROJECT_HOSTS)) & lower.rlike(r"github\.io|/project|project\.")


def project_context(text: Column, url: Column) -> Column:
    """Does the text speak of a project near its first mention of the URL (160 characters before, 80 after, under
    either scheme)?"""
    lower = F.lower(text)
    out = F.lit(False)
    for scheme in ("http://", "https://"):
        u = F.concat(F.lit(scheme), F.regexp_replace(F.lower(url), "^https?://", ""))
        at = F.position(u, lower)
        near = F.substr(lower, F.greatest(at - 160, F.lit(1)), at - F.greatest(at - 160, F.lit(1)) + F.length(u) + 80)
        said = F.lit(False)
        for w in PROJECT_WORDS:
            said = said | near.contains(w)
        out = out | ((at > 0) & said)
    return out


def repos_in_anchors(anchor_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id and repository of pages: the anchor whose words and target speak most of code (the first of the
    best), else the first forge address anywhere in the HTML."""
    rows = anchor_rows.withColumn("repo", canonical_repo(F.col("href"))).filter("repo is not null")
    label = F.lower(F.concat_ws(" ", "text", "href"))
    said = F.lit(False)
    for w in CODE_WORDS:
        said = said | label.contains(w)
    score = F.when(said, 100).otherwise(0) + F.when(F.lower("repo").rlike(r"(github|gitlab)\.com/"), 20).otherwise(0)
    best = rows.withColumn("score", score).filter("score > 0").groupBy("page_id").agg(F.max_by("repo", F.struct("score", -F.col("pos"))).alias("a"))
    found = F.array_compact(F.transform(urls(F.col("html")), canonical_repo))
    forge = F.get(F.filter(found, lambda r: F.lower(r).rlike(r"(github|gitlab)\.com/")), 0)
    plain = pages.select("page_id", F.coalesce(forge, F.get(found, 0)).alias("b"))
    return plain.join(best, "page_id", "left").select("page_id", F.coalesce("a", "b").alias("repo")).filter("repo is not null")


def resolve(docs: DataFrame, page_repos: DataFrame, most: int = 4) -> DataFrame:
    """doc_id and repository of documents (doc_id, text): their own, else that of the first of up to ``most``
    distinct project pages that has one (page_repos: url, repo)."""
    own = repos_in_text(docs).select("doc_id", F.col("repo").alias("own"))
    pages = F.slice(F.filter(urls(F.col("text")), project_page), 1, most)
    named = docs.select("doc_id", F.posexplode(pages).alias("pos", "url")).join(page_repos, "url").groupBy("doc_id").agg(F.min_by("repo", "pos").alias("named"))
    return docs.select("doc_id").join(own, "doc_id", "left").join(named, "doc_id", "left").select("doc_id", F.coalesce("own", "named").alias("repo")).filter("repo is not null")


def source_text(docs: DataFrame, key: str = "doc_id", text: str = "text", fallback: str | None = None) -> DataFrame:
    """Where a document's own links stand: its source without bibliography files and comments, or, where that is blank,
    the ``fallback`` text before its references."""
    own = drop_bibliography(docs.select(key, F.coalesce(text, F.lit("")).alias(text)), key, text).withColumn(text, strip_comments(F.col(text)))
    if fallback is None:
        return own
    rest = docs.select(key, cut_references(F.coalesce(fallback, F.lit(""))).alias("__rest"))
    return own.join(rest, key).select(key, F.when(F.trim(F.col(text)) != "", F.col(text)).otherwise(F.col("__rest")).alias(text))


def named_pages(docs: DataFrame, most: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, url of the first ``most`` distinct addresses of a text that look like a project's page, or that the
    text speaks of as one."""
    found = F.filter(urls(F.col(text)), lambda u: project_page(u) | project_context(F.col(text), u))
    return docs.filter(F.col(text).contains("://")).select(key, F.posexplode(F.slice(found, 1, most)).alias("pos", "url"))


def page_repositories(named: DataFrame, pages: DataFrame) -> DataFrame:
    """url, repo of the addresses in ``named`` that ``pages`` (page_id, url, html) holds: of several pages with one
    address the one with the largest id. Addresses meet page ids first; only the html of pages that some document names
    is read further and parsed."""
    thin = pages.select("page_id", clean_url(F.col("url")).alias("url")).filter("url is not null")
    wanted = thin.join(named.select("url").distinct(), "url").groupBy("url").agg(F.max("page_id").alias("page_id"))
    rows = pages.select("page_id", "url", "html").join(wanted.select("page_id"), "page_id", "left_semi")
    found = repos_in_anchors(anchors(page_blocks(rows)), rows)
    return wanted.join(found, "page_id").select("url", "repo")


def repositories(docs: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """doc_id and repository of documents (doc_id, text): what the text clearly calls its own, else that of the first of
    up to ``most`` project pages that has one. Documents and pages meet by the address as it stands; one that very many
    documents name has one row on the pages' side, so that a join can split it. Small jobs send the pages' side instead."""
    own = repos_in_text(docs).select("doc_id", F.col("repo").alias("own"))
    # addresses leave the texts before the join, which shuffles none
    named = named_pages(docs, most).join(own, "doc_id", "left_anti")
    by_page = named.join(page_repositories(named, pages), "url").groupBy("doc_id").agg(F.min_by("repo", "pos").alias("repo"))
    return own.withColumnRenamed("own", "repo").unionByName(by_page)


def rewrite_line(markdown: Column, repo: Column, label: str = "代码仓库") -> Column:
    """The document with the address in its repository row or line replaced, or the line dropped without one."""
    row = rf"(?m)^\|\s*{label}\s*\|[^\n]*$"
    line = rf"(?m)^[-*]?\s*{label}[:：][^\n]*$"
    new = F.coalesce(filled(repo), F.lit(""))
    safe = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    put = F.regexp_replace(F.regexp_replace(markdown, F.lit(row), F.concat(F.lit(f"| {label} | "), safe, F.lit(" |"))), F.lit(line), F.concat(F.lit(f"{label}："), safe))
    gone = F.regexp_replace(F.regexp_replace(markdown, row + r"\n?", ""), line + r"\n?", "")
    return F.regexp_replace(F.when(new != "", put).otherwise(gone), r"\n{3,}", "\n\n")
