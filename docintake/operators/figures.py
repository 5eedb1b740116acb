"""Figure ranking, grouping and selection, and the source tables they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import WHITE, filled, once, squeeze, strip
from docintake.operators.normalise import map_parts, strip_visible_macros
from docintake.operators.substrings import held_by

# Names that make a figure likely to matter, best first, and other word lists.
PREFERRED = ("introfig", "fig1", "main", "framework", "overall", "teacher_training", "inference", "world_state", "sparse_attention", "blade", "workflow", "asav3", "mask_generation", "teaser", "attn_proportion", "proportion", "flops", "overview", "pipeline", "method", "architecture", "attention", "heatmap", "patterns", "ablation", "scaling", "warmup")
EVIDENCE = ("architecture", "overview", "pipeline", "workflow", "framework", "overall design", "block diagram", "schematic", "sparse attention", "world state bank", "teacher backbone", "student generator", "coarse-to-fine", "流程", "架构", "框架", "模块", "箭头", "输入", "输出")
PRIORITY_TOKENS = ("introfig", "fig1", "arch", "architecture", "overview", "pipeline", "workflow", "framework", "teaser", "overall", "method", "inference", "teacher", "student", "world", "state")
METRICS = ("pretrain loss", "training loss", "perplexity", "ppl", "benchmark", "accuracy")
ANALYSIS = ("ablation", "sensitivity", "appendix", "supplement", "failure", "scaling", "learnable sink", "with and without", "pilot", "training signal", "warmup", "detach", "sliding-window", "消融", "敏感", "附录", "失败")
EXPERIMENTS = ("experiment", "benchmark", "comparison", "result", "quality", "validation", "accuracy", "loss", "rank", "实验", "结果", "对比", "指标")
METHOD = ("overview", "workflow", "framework", "architecture", "mechanism", "attention", "pipeline", "流程", "架构", "框架", "机制")
TITLES = (("architecture", "方法架构图"), ("overview", "整体设计图"), ("attention", "注意力对比图"), ("ablation", "消融实验图"), ("speed", "速度与性能对比图"), ("memory", "显存与性能对比图"), ("perplexity", "困惑度结果图"), ("comparison", "对比结果图"), ("qualitative", "定性对比图"))
FORMATS = ("png", "jpg", "jpeg", "pdf", "eps", "ps")
APPENDIX_PENALTY = 70
# Ranks of figures: (words of the label, words of the path, rank), the first that fits; then ranks by place.
RANKS = (
    (("workflow",), ("workflow", "blade"), 0),
    (("mask_generation",), ("asav3",), 1),
    (("model-arch", "architecture"), ("overview", "architecture"), 4),
    (("mask_visualization",), (), 12),
    (("ssim_compare",), (), 35),
)
RANK_APPENDIX, RANK_GALLERY, RANK_IN_SOURCE, RANK_OTHER, RANK_FIRST, RANK_PLACES = 75, 80, 10, 60, 6, 20


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def is_content(path: Column, label: Column, caption: Column, listed: Column) -> Column:
    """Is a figure content, not a logo or icon? ``listed``: does the source name it as a figure."""
    p, s, l, c = F.lower(path), F.lower(stem(path)), F.lower(F.coalesce(label, F.lit(""))), F.lower(F.trim(F.coalesce(caption, F.lit(""))))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    bad = F.concat(F.lit("/"), p).rlike("/(assets|logos?|brand|icons?)/") & p.rlike("[^/]/(assets|logos?|brand|icons?)/") | s.isin("logo", "mm", "minimax", "brand", "icon", "favicon") | s.rlike("logo|favicon|brandmark") | l.rlike("logo|icon|brand")
    bare = (c == "") | (c == name) | (c == s)
    return F.when(bad, False).when(bare, listed).otherwise(~c.rlike(r"^(?:logo|icon|brand|mm|minimax)(?:\.\w+)?$"))


def in_appendix(path: Column, label: Column, tex_file: Column) -> Column:
    return F.array_contains(F.split(F.lower(path), "/"), "appendix") | F.lower(label).contains("appendix") | F.lower(tex_file).contains("appendix")


def in_gallery(path: Column, label: Column) -> Column:
    p = F.lower(path)
    return any_of(p, ("extracted", "/baseline", "/asa/", "/sta/", "/svg/")) | F.lower(stem(path)).rlike(r"^frame_\d+$") | F.lower(label).rlike("^fig:(wan|cogvideo)_")


def is_priority(path: Column, evidence: Column) -> Column:
    """Figures that explain a method: by what is said of them, else by name unless they show metrics."""
    s, e = F.lower(stem(path)), F.lower(F.coalesce(evidence, F.lit("")))
    named = F.arrays_overlap(F.split(s, "[^a-z0-9]+"), F.lit(list(PRIORITY_TOKENS))) | any_of(s, ("model_arch", "model-arch", "method_overview", "method-overview"))
    return F.when(any_of(e, EVIDENCE), True).when(any_of(e, METRICS), False).otherwise(named)


def figure_rank(path: Column, label: Column, tex_file: Column, caption: Column, figure_index: Column) -> Column:
    """The least of what the rules give; smaller is better."""
    p, l, c = F.lower(F.concat_ws(" ", F.replace(path, F.lit("/"), F.lit(" ")), stem(path))), F.lower(label), F.lower(caption)
    appendix = in_appendix(path, label, tex_file)
    base = F.when(appendix, RANK_APPENDIX).when(in_gallery(path, label), RANK_GALLERY)
    for in_label, in_path, rank in RANKS:
        base = base.when(any_of(l, in_label) | any_of(p, in_path), rank)
    base = base.when(tex_file != "", RANK_IN_SOURCE).otherwise(RANK_OTHER)
    placed = F.when(~appendix & figure_index.isNotNull(), RANK_FIRST + F.least(F.greatest(figure_index, F.lit(0)), F.lit(RANK_PLACES)))
    said = F.concat_ws("\n", p, l, c)  # lower-cased once a figure, not once a name; no name holds a line end
    named = once(said, lambda x: F.coalesce(*(F.when(x.contains(n), i + 2) for i, n in enumerate(PREFERRED)))) + F.when(appendix, APPENDIX_PENALTY).otherwise(0)
    return F.least(base, placed, F.when(is_priority(path, caption), 3), named).cast("int")


def frame_number(path: Column) -> Column:
    return F.coalesce(filled(F.regexp_extract(F.lower(stem(path)), r"frame_(\d+)", 1)).cast("int"), F.lit(0))


def cap_labels(figures: DataFrame) -> DataFrame:
    """At most two figures of a label in input order, one of galleries; figures without label stay."""
    n = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("pos"))
    most = F.when(in_gallery(F.col("asset"), F.col("label")), 1).otherwise(2)
    return figures.withColumn("__n", n).filter((F.col("label") == "") | (F.col("__n") <= most)).drop("__n")


def with_fallbacks(figures: DataFrame, assets: DataFrame) -> DataFrame:
    """The figures and the assets that none of them shows."""
    more = assets.join(figures.select("doc_id", "asset"), ["doc_id", "asset"], "left_anti")
    return figures.unionByName(more, allowMissingColumns=True)


def panels(figures: DataFrame, low: int = 2, high: int = 16) -> DataFrame:
    """Multi-panel groups by file, figure, label and caption with 2 to 16 panels; a group ranks as its best."""
    keys = ["doc_id", "tex_file", "figure_index", "label", "caption"]
    rows = figures.filter((F.col("label") != "") & (F.col("caption") != ""))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).filter(F.col("n").between(low, high))


def singles(figures: DataFrame, groups: DataFrame) -> DataFrame:
    """Figures that are no panel of a group."""
    return figures.join(groups, ["doc_id", "tex_file", "figure_index", "label", "caption"], "left_anti")


def select_figures(candidates: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, place, asset: the ``n`` best ranked, each path once (doc_id, asset, rank, frame)."""
    w = Window.partitionBy("doc_id")
    once = candidates.groupBy("doc_id", "asset").agg(F.min(F.struct("rank", "frame", "asset")).alias("k"))
    rows = once.withColumn("place", F.row_number().over(w.orderBy("k")))
    return rows.filter(F.col("place") <= n).select("doc_id", "place", "asset", F.col("k.rank").alias("rank"))


def caption_lookup(assets: DataFrame, figures: DataFrame) -> DataFrame:
    """``assets`` (doc_id, asset) with the caption of the figure with that path, else with that stem, else of a
    caption that names the stem; the first in order."""
    f = figures.select("doc_id", F.lower("asset").alias("path"), F.lower(stem(F.col("asset"))).alias("stem"), "caption", "pos")
    a = assets.select("doc_id", "asset", F.lower("asset").alias("path"), F.lower(stem(F.col("asset"))).alias("stem")).distinct()
    first = lambda by: f.groupBy("doc_id", by).agg(F.min_by("caption", "pos").alias(f"by_{by}"))
    got = a.join(first("path"), ["doc_id", "path"], "left").join(first("stem"), ["doc_id", "stem"], "left")
    left = got.filter("by_path is null and by_stem is null").select("doc_id", F.col("stem").alias("pattern")).distinct()
    captions = f.filter("caption is not null").groupBy("doc_id", "caption").agg(F.min("pos").alias("pos"))
    said = held_by(left, captions.withColumn("text", F.lower("caption")), ["doc_id"])
    every = left.filter("pattern = ''").join(captions, "doc_id").select("doc_id", "pattern", "caption", "pos")
    said = said.unionByName(every).groupBy("doc_id", F.col("pattern").alias("stem")).agg(F.min_by("caption", "pos").alias("by_text"))
    return got.join(said, ["doc_id", "stem"], "left").select("doc_id", "asset", F.coalesce("by_path", "by_stem", "by_text").alias("caption"))


def section_target(text: Column) -> Column:
    t = F.lower(text)
    return F.when(any_of(t, ANALYSIS), "analysis").when(any_of(t, EXPERIMENTS), "experiments").when(any_of(t, METHOD), "method").otherwise("")


def placeholders(figures: DataFrame) -> DataFrame:
    """doc_id, n and the marker of each selected figure."""
    return figures.select("doc_id", "asset", F.col("place").alias("n"), F.concat(F.lit("[Figure:"), F.col("place").cast("string"), F.lit(":"), stem(F.col("asset")), F.lit("]")).alias("marker"))


def marker_counts(docs: DataFrame, markers: DataFrame) -> DataFrame:
    """expected and missing markers of each document (doc_id, text)."""
    got = markers.join(docs, "doc_id").withColumn("there", F.col("text").contains(F.col("marker")))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(~F.col("there")).alias("missing"))


def looks_english(text: Column) -> Column:
    letters, cjk = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return letters > F.greatest(F.lit(8), cjk * 2)


def display_caption(caption: Column, path: Column, most: int = 36) -> Column:
    """A short caption: its first clause; English ones become a title by keyword, else the file's name."""
    text = F.regexp_replace(F.regexp_replace(caption, r"\\([A-Za-z]{3,})(?![A-Za-z])", "$1"), r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"^[ .。:：;\-—]+|[ .。:：;\-—]+$", "")
    name = F.trim(F.translate(stem(path), "_-", "  "))
    text = F.coalesce(filled(text), F.replace(stem(path), F.lit("_"), F.lit(" ")))
    label = F.trim(F.regexp_extract(text, r"(?is)^\s*(?:fig(?:ure)?\.?\s*\d*[:：.-]?\s*)?(?:\([a-z]\)[:：]?\s*)?([^.;。；]{4,80})", 1))
    label = F.coalesce(filled(label), text)
    title = F.coalesce(*(F.when(F.lower(label).contains(k), F.lit(t)) for k, t in TITLES), filled(name), F.lit("关键图表"))
    label = F.when(looks_english(label), title).otherwise(label)
    return F.coalesce(filled(F.when(F.length(label) > most, F.concat(F.rtrim(F.substring(label, 1, most)), F.lit("..."))).otherwise(label)), F.lit("图"))


def compact_grid(figures: DataFrame) -> DataFrame:
    """Sparse row and column numbers of a figure's panels made contiguous from 0."""
    rows = F.dense_rank().over(Window.partitionBy("doc_id", "label").orderBy("row_raw")) - 1
    cols = F.dense_rank().over(Window.partitionBy("doc_id", "label", "row_raw").orderBy("col_raw")) - 1
    return figures.withColumn("row", rows).withColumn("col", cols)


def grid_columns(n: Column) -> Column:
    return F.when(n <= 4, n).when(n % 4 == 0, 4).when(n % 3 == 0, 3).when(n % 5 == 0, 5).otherwise(4)


def grid_layout(figures: DataFrame) -> DataFrame:
    """Each panel's row and column: its own (doc_id, label, pos, row, col) where all differ, else filled in by
    order into as many columns as suit their number."""
    w = Window.partitionBy("doc_id", "label")
    size = figures.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row", "col").alias("cells"), F.greatest(F.max("row"), F.max("col")).alias("most"))
    rows = figures.withColumn("i", F.row_number().over(w.orderBy("row", "col", "pos")) - 1).join(size, ["doc_id", "label"])
    own, cols = (F.col("cells") == F.col("n")) & (F.col("most") > 0), grid_columns(F.col("n"))
    return rows.select("doc_id", "label", "pos", F.when(own, F.col("row")).otherwise(F.floor(F.col("i") / cols)).cast("int").alias("grid_row"), F.when(own, F.col("col")).otherwise(F.col("i") % cols).cast("int").alias("grid_col"))


def grid_labels(panels_: DataFrame, axis: str) -> DataFrame:
    """doc_id, label, axis number and its name, for grids in which every row or column has one file stem of its
    own (doc_id, label, asset, and the number in column ``axis``)."""
    per = panels_.groupBy("doc_id", "label", axis).agg(F.count_distinct(stem(F.col("asset"))).alias("k"), F.min(stem(F.col("asset"))).alias("name"))
    usable = per.groupBy("doc_id", "label").agg(F.max("k").alias("k"), F.count_distinct("name").alias("names"), F.count(F.lit(1)).alias("n")).filter("k = 1 and names = n")
    return per.join(usable.select("doc_id", "label"), ["doc_id", "label"]).select("doc_id", "label", axis, "name")


def display_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Display width by aspect ratio, and the height that keeps it."""
    r = width / height
    w = F.when(r >= 3.2, 720).when(r >= 2.3, 680).when(r <= 0.75, 440).when(r <= 1.15, 560).otherwise(640)
    ok = (width > 0) & (height > 0)
    return F.when(ok, w).otherwise(640), F.when(ok, F.greatest(F.lit(1), F.bround(w * height / width))).otherwise(0).cast("int")


def unrenderable(figures: DataFrame, selected: DataFrame) -> DataFrame:
    """Documents with figures of which none was selected, with their formats."""
    left = figures.join(selected.select("doc_id"), "doc_id", "left_anti")
    return left.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(F.lower(F.regexp_extract("asset", r"\.([^./]+)$", 1)))), ",").alias("formats"))


# Heads behind which missing figures go, and what is said before them.
PRIORITY_HEADS = ("## 3.", "## 方法", "## 2.", "## 核心", "## 关键")
METHOD_HEADS = ("## 3.", "## 方法", "## 核心方法", "## 模型", "## 框架")
PRIORITY_LEAD, METHOD_LEAD = "这张图概括了论文中最关键的流程或方法结构。", "原文的方法总览图如下。"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def short_caption(caption: Column, most: int = 180) -> Column:
    text = squeeze(map_parts(F.coalesce(caption, F.lit("")), strip_visible_macros))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("...")))


def _missing(docs: DataFrame, inserts: DataFrame, most: int) -> DataFrame:
    """doc_id, lines, and ``lack``: the first ``most`` figures (marker, caption, name) in order that a document (doc_id,
    text) has no marker of, of inserts (doc_id, n, marker, asset, caption, description) that explain a method."""
    said = F.concat_ws(" ", "caption", "description")
    rows = inserts.filter(is_priority(F.col("asset"), said)).join(docs.select("doc_id", "text"), "doc_id").filter(~F.col("text").contains(F.col("marker")))
    one = F.struct("n", "marker", F.coalesce("caption", F.lit("")).alias("caption"), stem(F.col("asset")).alias("name"))
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).filter(F.col("k") <= most)
    lack = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("lack"))
    return docs.select("doc_id", "text").join(lack, "doc_id", "left").withColumn("lines", F.split(F.rtrim(F.col("text"), F.lit(WHITE)), LINE_END))


def _first(lines: Column, heads: tuple[str, ...], after: Column | int = 0) -> Column:
    """The number of the first line behind ``after`` that begins with one of the heads, or 0."""
    hit = lambda x: F.exists(F.lit(list(heads)), lambda h: F.startswith(strip(x), h))
    return F.array_position(F.transform(lines, lambda x, i: hit(x) & (i >= after)), True).cast("int")


def _put(at: Column, block: Column) -> Column:
    lines = F.concat(F.slice("lines", 1, at), block, F.slice("lines", at + 1, F.greatest(F.size("lines") - at, F.lit(0))))
    return F.concat(strip(F.array_join(lines, "\n")), F.lit("\n"))


def ensure_priority_markers(docs: DataFrame, inserts: DataFrame, most: int = 2) -> DataFrame:
    """Documents with up to ``most`` missing figures of the method behind the head of the method's section, or the first
    head, or the eighth line, each with its caption."""
    rows = _missing(docs, inserts, most)
    head, any_head = _first(F.col("lines"), PRIORITY_HEADS), _first(F.col("lines"), ("## ",))
    at = once(head, lambda head: F.when(head > 0, head).otherwise(once(any_head, lambda x: F.when(x > 0, x).otherwise(F.least(F.size("lines"), F.lit(8))))))
    caption = lambda m: F.when(m["caption"] != "", F.array(F.concat(F.lit("**图："), short_caption(m["caption"]), F.lit("**")))).otherwise(F.array().cast("array<string>"))
    one = lambda m, i: F.concat(F.when(i > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.array(F.lit(PRIORITY_LEAD), m["marker"]), caption(m))
    block = F.concat(F.array(F.lit("")), F.flatten(F.transform("lack", one)), F.array(F.lit("")))
    return rows.select("doc_id", F.when(F.col("lack").isNull(), F.col("text")).otherwise(once(at, lambda at: _put(at, block))).alias("text"))


def ensure_referenced_markers(docs: DataFrame, inserts: DataFrame, most: int = 1, enough: int = 3) -> DataFrame:
    """Documents with fewer than ``enough`` distinct markers, with up to ``most`` missing figures of the method at the
    end of the method's section; a document without one stays as it is."""
    rows = _missing(docs, inserts, most)
    held = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\[\w*Figure:[^\]]+\])"), F.lit(1))))
    # a head is looked for once a text, not once a line
    behind = lambda head: F.array_position(F.transform("lines", lambda x, i: (i >= head) & strip(x).rlike(r"^##\s+")), True).cast("int")
    place = lambda head: once(behind(head), lambda after: F.when(after > 0, after - 1).otherwise(F.size("lines")))
    at = once(_first(F.col("lines"), METHOD_HEADS), lambda head: F.when(head > 0, place(head)).otherwise(0))
    one = lambda m: F.array(F.lit(""), F.lit(METHOD_LEAD), m["marker"], F.concat(F.lit("**图："), short_caption(F.coalesce(filled(m["caption"]), m["name"])), F.lit("**")), F.lit(""))
    go = F.col("lack").isNotNull() & (held < enough)
    put = once(at, lambda at: F.when(at > 0, _put(at, F.flatten(F.transform("lack", one)))))
    return rows.select("doc_id", F.coalesce(F.when(go, put), F.col("text")).alias("text"))


def insert_markers(docs: DataFrame, markers: DataFrame, most: int = 2) -> DataFrame:
    """Documents (doc_id, text) with up to ``most`` missing markers put after the heading that names their
    section (doc_id, marker, section), in order; markers whose section has no heading are left out."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    heads = lines.filter(F.col("line").rlike(r"^##\s"))
    lacking = markers.join(docs, "doc_id").filter(~F.col("text").contains(F.col("marker"))).drop("text")
    lacking = lacking.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("marker"))).filter(F.col("n") <= most)
    places = lacking.join(heads, "doc_id").filter(F.lower("line").contains(F.lower(F.col("section")))).groupBy("doc_id", "marker", "n").agg(F.min("at").alias("at"))
    rows = lines.select("doc_id", F.col("at").cast("double").alias("at"), F.lit(0).alias("n"), "line").unionByName(places.select("doc_id", (F.col("at") + 0.5).alias("at"), "n", F.col("marker").alias("line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "line"))), lambda x: x["line"]), "\n").alias("text"))
