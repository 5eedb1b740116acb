"""TeX sources: ranked files, cleaned text, and captions, figures, tables and macros as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.batches import exploded
from docintake.functions.text import WHITE, braces_balanced, clip, squeeze

# Parts of a file's name that say where it belongs, in reading order.
PARTS = ("abstract", "intro", "prelim", "background", "observation", "method", "approach", "experiment", "evaluation", "result", "ablation", "analysis", "conclusion", "appendix")
MOST_FILES, MOST_CAPTIONS, MOST_TABLES = 80, 80, 8
FORBIDDEN = r"\\(?:begin|end|def|newcommand|renewcommand|usepackage|RequirePackage|input|include|includegraphics|citep?|ref|label|url|href)\b"
CAPTION = re.compile(r"\\(?:caption\*?(?:\[[^\]]*\])?|captionof\{figure\}(?:\[[^\]]*\])?)\{")
GRAPHIC = re.compile(r"\\(?:includegraphics|begin\{overpic\})(?:\[[^\]]*\])?\{([^}]+)\}")
ROW_BREAK = re.compile(r"\\\\|\\(?:vspace|smallskip|medskip|bigskip|par)(?![A-Za-z])")
LABEL = re.compile(r"\\label\{([^}]+)\}")
REFERENCE = re.compile(r"\\(?:ref|autoref|cref|Cref)\{")
SPACES = re.compile(f"[{WHITE}]+")
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".eps")


def file_rank(path: Column) -> Column:
    p = F.lower(path)
    rank = F.when(~p.endswith(".tex"), 100)
    for i, part in enumerate(PARTS):
        rank = rank.when(p.contains(part), i)
    return rank.when(p.rlike(r"(^|/)main\.tex$"), 50).otherwise(60)


def read_files(spark, root: str, pattern: str = "*.{tex,bib,bbl}") -> DataFrame:
    """paper_id (the first folder below ``root``), path and content of source files, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("content"))
    below = F.regexp_extract("f", re.escape(root.rstrip("/").removeprefix("file://")) + r"/(.*)$", 1)
    return files.select(F.substring_index(below, "/", 1).alias("paper_id"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "content")


def file_inventory(spark, root: str, suffixes: tuple[str, ...] = (".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg"), most: int = 240) -> DataFrame:
    """paper_id, path, length of asset files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.regexp_extract("path", re.escape(root.rstrip("/").removeprefix("file:").lstrip("/")) + r"/(.*)$", 1)
    rows = files.select(F.substring_index(below, "/", 1).alias("paper_id"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "length")
    rows = rows.filter(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("path"))
    return rows.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def read_inventory(spark, root: str) -> DataFrame:
    """paper_id, path, length of all files below ``root`` that aren't empty; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.regexp_extract("path", re.escape(root.rstrip("/").removeprefix("file:").lstrip("/")) + r"/(.*)$", 1)
    return files.select(F.substring_index(below, "/", 1).alias("paper_id"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "length")


def source_tree(inventory: DataFrame, most: int = 200) -> DataFrame:
    """paper_id, files, and ``tree``: the first ``most`` paths (paper_id, path), folder by folder, a line each, and a
    line that says so where there are more. Only these are ever gathered."""
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.split("path", "/")))
    size = inventory.groupBy("paper_id").agg(F.count(F.lit(1)).alias("files"))
    first = inventory.select("paper_id", "path").withColumn("n", n).filter(F.col("n") <= most)
    lines = first.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("lines"))
    tree = F.array_join(F.when(F.col("files") > most, F.array_append("lines", F.lit("[TRUNCATED]"))).otherwise(F.col("lines")), "\n")
    return lines.join(size, "paper_id").select("paper_id", "files", tree.alias("tree"))


def paper_summary(papers: DataFrame, figure_rows: DataFrame, table_rows: DataFrame) -> DataFrame:
    """One row a paper (paper_id, title, source, pdf_text, warnings) for its listing: lengths, how many figures and tables
    its source has, and what its parsing warned of."""
    count = lambda rows, name: rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias(name))
    size = lambda c: F.length(F.coalesce(c, F.lit(""))).alias(f"{c.removesuffix('_text')}_chars")
    got = papers.join(count(figure_rows, "figures"), "paper_id", "left").join(count(table_rows, "tables"), "paper_id", "left")
    none = F.array().cast("array<string>")
    return got.select("paper_id", "title", size("source"), size("pdf_text"), F.coalesce("figures", F.lit(0)).alias("figures"), F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("warnings", none).alias("parse_warnings"))


def concatenate_files(files: DataFrame, order: str = "path", most: int = MOST_FILES) -> DataFrame:
    """paper_id and its best ranked files on end, each after a line that names it."""
    k = F.struct(file_rank(F.col("path")).alias("r"), F.lower("path").alias("p"), F.col(order).alias("o"))
    rows = files.withColumn("k", k).withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("k"))).filter(F.col("n") <= most)
    part = F.concat(F.lit("% FILE: "), "path", F.lit("\n"), "content")
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("source"))


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")


def clean_latex(c: Column) -> Column:
    """Plain text of a caption or macro body."""
    c = F.regexp_replace(c, r"\\(?:textsc|textbf|textit|emph|mathrm|mathbf|mathtt)\s*\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, r"\\(?:xspace|NB|DX|lpk|wx|qz)(?![A-Za-z])(?:\s*\{([^{}]*)\})?", "$1")
    c = F.regexp_replace(c, r"\\(?:citep?|ref|label|url|href)\s*\{[^{}]*\}", "")
    return F.regexp_replace(squeeze(F.regexp_replace(c, r"[{}]", "")), r"(?U)\s+([,.;:!?。；：！？])", "$1")


def clip_tail(c: Column, n: int) -> Column:
    return clip(c, n, "\n\n[TRUNCATED]")


def clip_with_appendix(c: Column, n: int) -> Column:
    """Long sources keep their beginning and the start of an appendix that begins after a third of ``n``."""
    at = F.array_min(F.filter(F.array(*(F.when(F.regexp_instr(c, F.lit(p)) > 0, F.regexp_instr(c, F.lit(p)) - 1) for p in (r"(?i)\\appendix\b", r"(?i)\\section\*?\{(?:Appendix|Supplement)", r"(?i)% FILE: [^\n]*(?:appendix|supplement)"))), lambda x: x.isNotNull()))
    room = min(24_000, n // 3)
    both = F.concat(F.rtrim(F.substring(c, 1, n - room - 80), F.lit("\n ")), F.lit("\n\n[TRUNCATED: middle left out, appendix kept]\n\n"), F.trim(F.substr(c, at.cast("int") + 1, F.lit(room)), F.lit("\n ")), F.lit("\n\n[TRUNCATED]"))
    return F.when(F.length(c) <= n, c).when(at.isNull() | (at < n // 3), clip_tail(c, n)).otherwise(both)


def source_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("paper_id").agg(F.sum(F.length("content")).alias("chars"), F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum(F.length(F.trim("content"))), F.lit(0)) == 0).alias("needs_source"))


def needs_source(docs: DataFrame) -> DataFrame:
    """Documents without any source text, with the warnings that say why."""
    why = F.filter("warnings", lambda w: w.rlike("(?i)source|eprint|download"))
    return docs.filter(F.trim(F.coalesce("source", F.lit(""))) == "").select("doc_id", F.array_join(why, "; ").alias("warnings"))


def tables(docs: DataFrame) -> DataFrame:
    """paper_id, n and text of table environments that hold a tabular."""
    found = F.regexp_extract_all(strip_comments(F.col("source")), F.lit(r"(?s)\\begin\{table\*?\}.*?\\end\{table\*?\}"), F.lit(0))
    rows = F.slice(F.filter(found, lambda b: b.contains("tabular")), 1, MOST_TABLES)
    return docs.select("paper_id", F.posexplode(rows).alias("n", "text")).withColumn("text", clip_tail(F.trim("text"), 5000))


# ---------------------------------------------------------------- what needs a scan of braces


def brace_end(s: str, at: int) -> int:
    """Position of the brace that closes the one at ``at``, or -1; escaped characters don't count."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(s, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return m.start()
    return -1


def spans_after(pattern: re.Pattern, s: str) -> Iterator[tuple[re.Match, int, str]]:
    """(match, end of its braces, their content) for matches that end in an opening brace."""
    for m in pattern.finditer(s):
        end = brace_end(s, m.end() - 1)
        if end >= 0:
            yield m, end, s[m.end() : end]


def segments(block: str) -> Iterator[tuple[str, str, str]]:
    """(text, caption, label) of the parts of a figure environment: one for each caption, or the whole
    environment where it holds sub-figures or no caption."""
    labels = LABEL.findall(block)
    found = list(spans_after(CAPTION, block))
    if r"\begin{subfigure" in block and len(GRAPHIC.findall(block)) > 1 or not found:
        yield block, found[-1][2] if found else "", (labels[-1] if found else labels[0]) if labels else ""
        return
    before = 0
    for i, (m, end, body) in enumerate(found):
        after = found[i + 1][0].start() if i + 1 < len(found) else len(block)
        own = LABEL.findall(block[end + 1 : after]) or LABEL.findall(block[before:after])
        yield block[before : m.start()], body, own[0] if own else ""
        before = end + 1


def graphics(text: str) -> Iterator[tuple[str, int, int]]:
    """(path, row, column) of the graphics of a segment; a line break or vertical space begins a row."""
    row = col = last = 0
    for i, m in enumerate(GRAPHIC.finditer(text)):
        if i:
            row, col = (row + 1, 0) if ROW_BREAK.search(text, last, m.start()) else (row, col + 1)
        last = m.end()
        yield m[1].strip(), row, col


def _explode(rows, schema: str):
    """A mapInArrow function from ``rows(path, content) -> iterator of tuples``, over (paper_id, path, content)."""
    return exploded(lambda i, p, c: ((i, *r) for r in rows(p, c or "")), schema), schema


def captions(files: DataFrame) -> DataFrame:
    """paper_id, n, caption: cleaned captions of all files in rank order, at most MOST_CAPTIONS a paper."""
    run, schema = _explode(lambda p, c: ((p, i, b) for i, (_, _, b) in enumerate(spans_after(CAPTION, c)) if b), "paper_id string, path string, at bigint, body string")
    rows = files.select("paper_id", "path", strip_comments(F.col("content")).alias("content")).mapInArrow(run, schema)
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy(file_rank(F.col("path")), F.lower("path"), "at")) - 1
    rows = rows.select("paper_id", n.alias("n"), clip_tail(clean_latex(squeeze(F.col("body"))), 1200).alias("caption"))
    return rows.filter(F.col("n") < MOST_CAPTIONS)


def figures(files: DataFrame) -> DataFrame:
    """paper_id, tex_file, figure_index, asset_index, asset, row, col, caption, label of every graphic; figures are
    numbered over a paper's files in rank order."""

    def rows(path: str, content: str):
        at = 0
        for m in re.finditer(r"(?s)\\begin\{figure\*?\}.*?\\end\{figure\*?\}", content):
            for text, caption, label in segments(m[0]):
                found = list(graphics(text))
                for i, (asset, row, col) in enumerate(found):
                    yield path, at, i, asset, row, col, caption, label.strip()
                at += bool(found)

    run, schema = _explode(rows, "paper_id string, tex_file string, at bigint, asset_index bigint, asset string, row_raw bigint, col_raw bigint, caption string, label string")
    got = files.filter(F.lower("path").endswith(".tex")).select("paper_id", "path", strip_comments(F.col("content")).alias("content")).mapInArrow(run, schema)
    number = F.dense_rank().over(Window.partitionBy("paper_id").orderBy(file_rank(F.col("tex_file")), F.lower("tex_file"), "at")) - 1
    w = Window.partitionBy("paper_id", "tex_file", "at")
    got = got.withColumn("figure_index", number).withColumn("row", F.dense_rank().over(w.orderBy("row_raw")) - 1)
    got = got.withColumn("col", F.dense_rank().over(Window.partitionBy("paper_id", "tex_file", "at", "row_raw").orderBy("col_raw")) - 1)
    return got.select("paper_id", "tex_file", "figure_index", "asset_index", "asset", "row", "col", clip_tail(clean_latex(squeeze(F.col("caption"))), 1200).alias("caption"), "label")


def resolve_assets(figures_: DataFrame, inventory: DataFrame) -> DataFrame:
    """``figures_`` with ``path``: the file meant, beside the TeX file, else below the root, with the usual
    suffixes if it has none, else any file with its stem, else what the source says."""
    folder = F.regexp_replace("tex_file", r"[^/]*$", "")
    suffix = F.when(F.col("asset").rlike(r"\.[A-Za-z]{2,4}$"), F.array(F.lit(""))).otherwise(F.lit(list(SUFFIXES)))
    rows = figures_.withColumn("__id", F.struct("paper_id", "tex_file", "figure_index", "asset_index"))
    tries = rows.select("__id", "paper_id", F.posexplode(F.concat(F.transform(suffix, lambda s: F.concat(folder, "asset", s)), F.transform(suffix, lambda s: F.concat("asset", s)))).alias("p", "path"))
    hit = tries.join(inventory.select("paper_id", "path"), ["paper_id", "path"]).groupBy("__id").agg(F.min_by("path", "p").alias("exact"))
    stem = lambda c: F.lower(F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1))
    by_stem = inventory.groupBy("paper_id", stem(F.col("path")).alias("__stem")).agg(F.min("path").alias("near"))
    got = rows.join(hit, "__id", "left").withColumn("__stem", stem(F.col("asset"))).join(by_stem, ["paper_id", "__stem"], "left")
    return got.withColumn("path", F.coalesce("exact", "near", "asset")).drop("__id", "__stem", "exact", "near")


_DEFINITIONS = (re.compile(r"\\def\\([A-Za-z]+)\s*\{"), re.compile(r"\\(?:re)?newcommand\*?\s*\{\\([A-Za-z]+)\}\s*\{"), re.compile(r"\\(?:re)?newcommand\*?\s*\\([A-Za-z]+)\s*\{"))
_WITH_ARGUMENT = (re.compile(r"\\(?:re)?newcommand\*?\s*(?:\{\\([A-Za-z]+)\}|\\([A-Za-z]+))\s*(?:\[(\d+)\])?\s*\{"), re.compile(r"\\def\\([A-Za-z]+)()((?:#\d+)*)\s*\{"))


def text_macros(docs: DataFrame) -> DataFrame:
    """paper_id, name, value of macros without arguments whose cleaned value has at most 80 characters; of
    several definitions the last counts."""

    def rows(_, content: str):
        for k, pattern in enumerate(_DEFINITIONS):
            for m, _, body in spans_after(pattern, content):
                if body and "#" not in body:
                    yield k, m.start(), m[1], body

    run, schema = _explode(rows, "paper_id string, k bigint, at bigint, name string, body string")
    got = docs.select("paper_id", F.lit("").alias("path"), strip_comments(F.col("source")).alias("content")).mapInArrow(run, schema)
    got = got.withColumn("value", clean_latex(F.col("body"))).filter(F.length("value").between(1, 80))
    return got.groupBy("paper_id", "name").agg(F.max_by("value", F.struct("k", "at")).alias("value"))


def formula_macros(docs: DataFrame) -> DataFrame:
    """paper_id, name, arguments (0 or 1), body of macros that can safely be expanded in formulas."""
    def rows(_, content: str):
        for k, pattern in enumerate(_WITH_ARGUMENT):
            for m, _, body in spans_after(pattern, content):
                n = (int(m[3]) if m[3] else 0) if not k else m[3].count("#")
                if n < 2:
                    yield k, m.start(), m[1] or m[2], n, body.strip()

    run, schema = _explode(rows, "paper_id string, k bigint, at bigint, name string, arguments bigint, body string")
    got = docs.select("paper_id", F.lit("").alias("path"), strip_comments(F.col("source")).alias("content")).mapInArrow(run, schema)
    b = F.col("body")
    safe = F.length(b).between(1, 240) & ~b.rlike(FORBIDDEN) & braces_balanced(b) & ~F.when(F.col("arguments") == 0, b.contains("#")).otherwise(b.rlike("#(?!1)"))
    return got.filter(safe).groupBy("paper_id", "name", "arguments").agg(F.max_by("body", F.struct("k", "at")).alias("body"))


def expand_macros(docs: DataFrame, macros: DataFrame, text: str = "source") -> DataFrame:
    """``docs`` with the macros of their paper written out in ``text``, longest names first. A paper's macros
    are a handful of definitions, gathered in one array."""
    listed = macros.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("k"), "name", "value"))).alias("__m"))
    empty = F.array().cast("array<struct<k:int,name:string,value:string>>")
    got = docs.join(listed, "paper_id", "left")
    quoted = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    new = F.aggregate(F.coalesce("__m", empty), F.col(text), lambda acc, m: F.regexp_replace(acc, F.concat(F.lit(r"\\"), m["name"], F.lit(r"(?![A-Za-z])\s*")), F.concat(quoted(m["value"]), F.lit(" "))))
    return got.withColumn(text, new).drop("__m")


def reference_contexts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """paper_id, label and all passages of the source that refer to it (220 characters before the reference to 260
    after), in their order, joined by a double bar. A source is read once, however many labels there are; labels of a
    paper are part of it, gathered in one array."""

    def rows(paper_id: str, source: str | None, wanted: list[str]):
        source, names, sizes = source or "", set(wanted), sorted({len(x) for x in wanted})
        found: dict[str, list[tuple[int, int]]] = {}
        for m in REFERENCE.finditer(source):
            for end in (m.end() + n for n in sizes):
                if source.startswith("}", end) and source[m.end() : end] in names:
                    found.setdefault(source[m.end() : end], []).append((m.start(), end + 1))
        for label, places in found.items():
            passages = (f"{source[max(start - 220, 0) : start]}[ref]{source[end : end + 260]}" for start, end in places)
            yield paper_id, label, " || ".join(SPACES.sub(" ", x).strip(" ") for x in passages)

    want = labels.filter("label <> ''").groupBy("paper_id").agg(F.collect_set("label").alias("labels"))
    schema = "paper_id string, label string, context string"
    return docs.select("paper_id", "source").join(want, "paper_id").select("paper_id", "source", "labels").mapInArrow(exploded(rows, schema), schema)
