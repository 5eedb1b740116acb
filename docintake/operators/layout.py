"""Layout audit over geometry tables: overlaps, overflow, counts against expectations, sampling, and the
placement of snapshots by nearest preceding heading or text (as-of joins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import filled
from docintake.operators.gates import RAW_UNCERTAINTY

FINDING = ("page_id", "kind", "severity", "block_no", "detail")
# What formatting that leaked into the page looks like.
LEAKS = (r"\\(?:textbf|textit|textsc|mathrm|operatorname|mathbf|mathcal)(?:\b|(?=[A-Z]))", r"(?<!\\)\$\$", r"\\\(|\\\)|\\\[|\\\]", r"(?m)^\s*\|\s*[-:]+(?:\s*\|\s*[-:]+)+\s*\|?\s*$", RAW_UNCERTAINTY)
HARMLESS = ("formula-count-drift", "image-too-wide", "large-empty-viewport")


def overlaps(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks that follow each other by (top, left) and overlap by more than 80 by 10 pixels, unless one
    lies within the other or both are wrappers of one class at the same height."""
    w = Window.partitionBy("page_id").orderBy("top", "lft", "block_no")
    rows = blocks.withColumn("p", F.lag(F.struct("block_no", "top", "lft", "bottom", "rgt", "cls")).over(w)).filter("p is not null")
    wide = F.least("p.rgt", "rgt") - F.greatest("p.lft", "lft")
    high = F.least("p.bottom", "bottom") - F.greatest("p.top", "top")
    p = {k: F.col(f"p.{k}") for k in ("top", "lft", "bottom", "rgt")}
    c = {k: F.col(k) for k in ("top", "lft", "bottom", "rgt")}
    holds = lambda a, b: (a["top"] <= b["top"] + 2) & (a["bottom"] >= b["bottom"] - 2) & (a["lft"] <= b["lft"] + 2) & (a["rgt"] >= b["rgt"] - 2)
    same = (F.col("p.cls") == F.col("cls")) & (F.abs(p["top"] - c["top"]) < 2)
    return rows.filter((wide > 80) & (high > 10) & ~holds(p, c) & ~holds(c, p) & ~same).select("page_id", F.col("p.block_no").alias("a"), F.col("block_no").alias("b"), F.bround(high).cast("bigint").alias("px"))


def _finding(rows: DataFrame, when: Column, kind: str, severity: Column | str, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.filter(when).select("page_id", F.lit(kind).alias("kind"), severity.alias("severity"), "block_no", detail.alias("detail"))


def image_findings(images: DataFrame) -> DataFrame:
    """Findings on images (page_id, block_no, lft, rgt, editor_left, editor_right, blank_total, blank_top,
    blank_bottom): out of the text area, nearly as wide as it, or with large blank borders."""
    over = F.col("rgt") - F.col("editor_right")
    room = F.col("editor_right") - F.col("editor_left")
    pixels = lambda c: F.bround(F.greatest(c, F.lit(0.0))).cast("bigint").cast("string")
    severe = (F.col("blank_total") > 0.72) | (F.col("blank_bottom") > 0.62) | (F.col("blank_top") > 0.55)
    notable = (F.col("blank_total") > 0.46) | (F.col("blank_bottom") > 0.38) | (F.col("blank_top") > 0.30)
    parts = [
        _finding(images, (over > 12) | (F.col("lft") < F.col("editor_left") - 12), "image-overflow", "high", F.concat(pixels(over), F.lit("px"))),
        _finding(images, F.col("rgt") - F.col("lft") > room * 0.94, "image-too-wide", "medium", F.lit("")),
        _finding(images, notable, "image-large-white-border", F.when(severe, "high").otherwise("medium"), F.concat(pixels(F.col("blank_total") * 100), F.lit("%"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def count_findings(pages: DataFrame) -> DataFrame:
    """Findings on what a page renders against what it should (page_id, images, tables, formulas, want_images,
    want_tables, want_formulas, invalid, raw); a few formulas fewer are drift where nothing else is wrong."""
    ratio = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
    missing = F.col("want_formulas") - F.col("formulas")
    slack = F.greatest(F.lit(1), F.ceil(F.col("want_formulas") / 100))
    drift = (missing <= slack) & (F.col("invalid") == 0) & (F.col("raw") == 0)
    rows = F.array(
        F.when((F.col("want_images") > 0) & (F.col("images") < F.col("want_images")), F.struct(F.lit("missing-image").alias("kind"), F.lit("high").alias("severity"), ratio("images", "want_images").alias("detail"))),
        F.when((F.col("want_tables") > 0) & (F.col("tables") < F.col("want_tables")), F.struct(F.lit("missing-table").alias("kind"), F.lit("high").alias("severity"), ratio("tables", "want_tables").alias("detail"))),
        F.when((F.col("want_formulas") > 0) & (missing > 0), F.struct(F.when(drift, "formula-count-drift").otherwise("missing-formula").alias("kind"), F.when(drift, "medium").otherwise("high").alias("severity"), ratio("formulas", "want_formulas").alias("detail"))),
    )
    return pages.select("page_id", F.explode(F.array_compact(rows)).alias("f")).select("page_id", "f.*")


def empty_tables(tables: DataFrame) -> DataFrame:
    return tables.filter((F.coalesce("rows", F.lit(0)) < 1) | (F.coalesce("cells", F.lit(0)) < 1))


def distinct_findings(findings: DataFrame, order: str) -> DataFrame:
    """The first of findings equal in kind, section, image and detail."""
    n = F.row_number().over(Window.partitionBy("page_id", "kind", "section", "image_name", "detail").orderBy(order))
    return findings.withColumn("__n", n).filter("__n = 1").drop("__n")


def sample_evenly(items: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each group, spread evenly over its order; all where there are no more; the middle for n = 1."""
    w = Window.partitionBy(group)
    rows = items.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__m", F.count(F.lit(1)).over(w))
    if n <= 0:
        return rows.filter(F.lit(False)).drop("__i", "__m")
    if n == 1:
        keep = F.col("__i") == F.floor(F.col("__m") / 2)
    else:
        # i is taken if it is the rounded place of some k: the nearest k's are tried.
        k = F.col("__i") * (n - 1) / (F.col("__m") - 1)
        place = lambda x: F.bround(x * (F.col("__m") - 1) / (n - 1))
        keep = (place(F.floor(k)) == F.col("__i")) | (place(F.ceil(k)) == F.col("__i"))
    return rows.filter((F.col("__m") <= n) | keep).drop("__i", "__m")


def distinct_viewports(views: DataFrame, order: str, step: int = 120) -> DataFrame:
    """The first viewport of each page at each rounded scroll position."""
    n = F.row_number().over(Window.partitionBy("page_id", F.bround(F.col("scroll_top") / step)).orderBy(order))
    return views.withColumn("__n", n).filter("__n = 1").drop("__n")


def distinct_targets(targets: DataFrame, order: str) -> DataFrame:
    """The first target of each page by its first filled of link, position and section."""
    key = F.coalesce(filled(F.col("href")), filled(F.col("scroll_top").cast("string")), filled(F.col("section")), F.lit(""))
    n = F.row_number().over(Window.partitionBy("page_id", key).orderBy(order))
    return targets.withColumn("__n", n).filter("__n = 1").drop("__n")


def run_metrics(images: DataFrame) -> DataFrame:
    over = F.col("rgt") - F.col("editor_right")
    return images.groupBy("page_id").agg(F.count(F.lit(1)).alias("image_observations"), F.greatest(F.lit(0.0), F.bround(F.max(over), 1)).alias("max_overflow"), F.count_if(over > 12).alias("overflowing"))


def leaked_formatting(text: Column) -> Column:
    """The first hit of each pattern of leaked formatting."""
    hits = [F.regexp_extract(text, ("(?U)" if p == RAW_UNCERTAINTY else "") + p, 0) for p in LEAKS]
    return F.filter(F.transform(F.array(*hits), lambda x: F.substring(x, 1, 50)), lambda x: x != "")


def blocking_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("kind").isin(*HARMLESS))


def finding_warning(kind: Column, severity: Column, section: Column, image: Column, detail: Column) -> Column:
    where = F.coalesce(filled(image), filled(section), F.lit(""))
    return F.concat_ws(":", F.lit("visual-qa"), severity, kind, filled(where), detail)


def resize_proposals(findings: DataFrame, images: DataFrame) -> DataFrame:
    """page_id, block_no, width and height for overflowing images: 82 % of the text area, at least 320, with the
    ratio kept; changes of up to 4 pixels are left out. Images are found by block, else by name."""
    by_id = images.select("page_id", "block_no", F.col("width").alias("w1"), F.col("height").alias("h1"))
    by_name = images.groupBy("page_id", "name").agg(F.max_by(F.struct("block_no", "width", "height"), "block_no").alias("n"))
    got = findings.join(by_id, ["page_id", "block_no"], "left").join(by_name, ["page_id", "name"], "left")
    width, height = F.coalesce("w1", "n.width"), F.coalesce("h1", "n.height")
    target = F.greatest(F.lit(320), F.least(F.coalesce(F.when(width > 0, width), F.col("editor_width")), F.floor(F.col("editor_width") * 0.82))).cast("bigint")
    rows = got.filter(width.isNotNull() & (F.col("editor_width") > 0) & ~((width > 0) & (target >= width - 4)))
    return rows.select("page_id", F.coalesce(F.when(F.col("w1").isNotNull(), F.col("block_no")), F.col("n.block_no")).alias("block_no"), target.alias("width"), F.when((width > 0) & (height > 0), F.greatest(F.lit(1), F.bround(height * target / width))).otherwise(height).cast("bigint").alias("height"))


def order_candidates(blocks: DataFrame, hinted: DataFrame, limit: int) -> DataFrame:
    """Blocks to be repaired: hinted ones first, then by id; at most ``limit`` a page."""
    got = blocks.join(hinted.select("page_id", "block_no", F.lit(0).alias("__h")).distinct(), ["page_id", "block_no"], "left")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy(F.coalesce("__h", F.lit(1)), "block_no"))
    return got.withColumn("rank", n).filter(F.col("rank") <= limit).drop("__h")


def repair_decisions(responses: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """Which of a model's block repairs are accepted (page_id, response JSON; candidates page_id, block_id, kind):
    unknown blocks, modes that don't fit the block's kind and empty texts are refused; at most ``most`` a page."""
    body = F.from_json("response", "struct<repairs:array<struct<block_id:string,mode:string,text:string>>>")
    rows = responses.select("page_id", F.posexplode(body["repairs"]).alias("pos", "r")).select("page_id", "pos", "r.*")
    got = rows.join(candidates, ["page_id", "block_id"], "left")
    reason = F.when(F.col("kind").isNull(), "unknown-block").when(~F.coalesce(F.col("mode") == F.col("kind"), F.lit(False)), "wrong-mode").when(filled(F.trim("text")).isNull(), "empty")
    n = F.row_number().over(Window.partitionBy("page_id", reason.isNull()).orderBy("pos"))
    return got.withColumn("reason", F.coalesce(reason, F.when(n > most, "over-limit"), F.lit("accepted"))).select("page_id", "pos", "block_id", "reason")


def round_audit(rounds: DataFrame) -> DataFrame:
    """page_id and status of inspect-repair rounds (page_id, round, findings, blocking, changed, error)."""
    last = lambda c: F.max_by(c, "round")
    got = rounds.groupBy("page_id").agg(F.count(F.lit(1)).alias("rounds"), last("findings").alias("f"), last("blocking").alias("b"), last("changed").alias("c"), last("error").alias("e"))
    status = F.when(F.coalesce(F.col("e"), F.lit("")) != "", "error").when(F.col("f") == 0, "passed").when(F.col("b") == 0, "passed-with-warnings").when(~F.col("c"), "stalled").otherwise("issues")
    return got.select("page_id", "rounds", status.alias("status"))


def last_json_object(lines: DataFrame) -> DataFrame:
    """The last line of each log (log_id, line_no, line) that is a JSON object."""
    rows = lines.filter(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull())
    return rows.groupBy("log_id").agg(F.max_by("line", "line_no").alias("object"), F.max("line_no").alias("line_no"))


# ---------------------------------------------------------------- placement


def distinct_rects(rects: DataFrame, order: str, grid: int = 12, limit: int = 40) -> DataFrame:
    """The first of rectangles equal on a grid of pixels (halves rounded up), the topmost ``limit`` of a page."""
    cell = [F.floor(F.col(c) / grid + 0.5) for c in ("top", "lft", "rgt", "bottom")]
    n = F.row_number().over(Window.partitionBy("page_id", "cls", *cell).orderBy(order))
    rows = rects.withColumn("__n", n).filter("__n = 1").drop("__n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("top", order))).filter(F.col("rank") <= limit)


def nearest_above(items: DataFrame, marks: DataFrame, keys: list[str], slack: int, value: str) -> DataFrame:
    """As-of join: ``items`` (keys, top, ...) with the ``value`` of the last of ``marks`` (keys, top, value) that
    lies more than ``slack`` pixels above; items without one get null. Both are merged in one ordered window."""
    a = items.withColumn("__at", F.col("top") - slack).withColumn("__v", F.lit(None).cast(marks.schema[value].dataType)).withColumn("__k", F.lit(0))
    b = marks.select(*keys, F.col("top").alias("__at"), F.col(value).alias("__v"), F.lit(1).alias("__k"))
    # At equal heights items come first, as a mark must lie strictly above.
    w = Window.partitionBy(*keys).orderBy("__at", "__k", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.filter("__k = 0").drop("__at", "__v", "__k")
