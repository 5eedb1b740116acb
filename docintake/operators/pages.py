"""Web articles: one pass over the HTML of a pages table gives ordered blocks; everything else is relational.

``page_blocks`` is the only place where HTML is parsed. It is a job over the table: each task streams its pages
through Python's own HTML tokenizer and gives rows (page_id, pos, kind, value, text), which are meant to be
written down once and read by all that follows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.batches import exploded
from docintake.functions.text import filled
from docintake.operators.substrings import held_by
from docintake.sources.sinks import scratch_path

TEXT_TAGS = frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"))
SKIPPED_TAGS = frozenset(("script", "style", "nav", "footer", "header", "aside", "noscript"))
BOILERPLATE = ("authors", "affiliations", "published", "references", "citation")
# Claims without content.
EMPTY_CLAIMS = (r"(?i)^(we\s+)?find\s+that\s*[\.:;,!?。！？；：]*$", r"(?i)^we\s+show\s+that\s*[\.:;,!?。！？；：]*$", r"(?i)^the\s+results\s+show\s+that\s*[\.:;,!?。！？；：]*$")
BLOCK = "page_id bigint, pos bigint, kind string, value bigint, text string"
CAPS = {"code": 4000, "table": 4000, "math": 1200}
DEFAULT_TITLE = "正文"
OVERVIEW_TITLE = "原网页标题区和可视目录"
# Words of links that matter.
IMPORTANT = r"(?i)github|gitlab|huggingface|repository|repo|code|paper|arxiv|demo|api|modelscope|在线体验|仓库|代码"


def _clean(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


class _Blocks(HTMLParser):
    """Collects (kind, value, text). An opening text tag starts its text anew, so what an unclosed one held is
    lost; void tags stay open until an enclosing tag closes; text outside of text tags isn't collected."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.rows, self.open, self.skip, self.images = url, [], [], 0, 0
        self.toc, self.toc_image, self.toc_titles = False, 0, {}
        self.figure_image = 0
        self.buffers: dict[str, list[str]] = {}
        self.title = ""
        self.href, self.label = "", []
        self.captions: dict[int, list[int]] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.open.append(tag)
        self.toc |= tag == "nav" and "visual-toc" in a.get("class", "")
        self.skip += tag in SKIPPED_TAGS
        if tag == "title":
            self.buffers["title"] = []
        elif tag == "meta" and (a.get("property") or a.get("name")) and a.get("content"):
            key, value = a.get("property") or a.get("name"), a["content"].strip()
            self.rows.append(("meta", 0, f"{key}\t{value}"))
            if key in ("og:title", "twitter:title") and not self.title:
                self.title = value
        if self.skip:
            if self.toc and tag == "img":
                self.toc_image = self.image(a, False)
            elif self.toc and tag == "d-tochead":
                self.buffers["toc"] = []
        elif tag in TEXT_TAGS:
            self.buffers["text"] = []
        elif tag == "img":
            n = self.image(a, True)
            if n and "figure" in self.open:
                self.figure_image = n
        elif tag in ("d-math", "pre", "code", "table", "figcaption"):
            self.buffers["code" if tag == "pre" else tag] = []
        if tag == "a" and a.get("href"):
            self.href, self.label = urljoin(self.url, a["href"]), []

    def image(self, a: dict, block: bool) -> int:
        src = a.get("src") or a.get("data-src") or a.get("data-original")
        if not src:
            return 0
        self.images += 1
        self.rows.append(("image_url", self.images, urljoin(self.url, src)))
        self.captions[self.images] = [len(self.rows)]
        self.rows.append(("image" if block else "toc_image", self.images, a.get("alt", "")))
        return self.images

    def take(self, name: str, glue: str = " ") -> str:
        return glue.join(self.buffers.pop(name, []))

    def caption(self, n: int, text: str) -> None:
        for i in self.captions[n]:
            self.rows[i] = (self.rows[i][0], n, text)

    def handle_endtag(self, tag):
        if tag == "a" and self.href:  # also in navigation, where pages keep their code links
            self.rows.append(("anchor", 0, f"{self.href}\t{_clean(' '.join(self.label))}"))
            self.href = ""
        if tag in SKIPPED_TAGS and self.skip:
            self.skip -= 1
        if tag == "d-tochead" and "toc" in self.buffers:
            title = _clean(self.take("toc"))
            if title and self.toc_image:
                self.caption(self.toc_image, title)
                self.toc_titles[heading_key(title)] = self.toc_image
        self.toc &= tag != "nav"
        if tag == "title":
            got = _clean(self.take("title"))
            self.rows.append(("title", 0, got))
            self.title = self.title or got
        if not self.skip:
            self.close_content(tag)
        if tag in self.open:
            self.open = self.open[: len(self.open) - 1 - self.open[::-1].index(tag)]

    def close_content(self, tag: str) -> None:
        if tag == "d-math" and "d-math" in self.buffers:
            math = _clean(self.take("d-math"))
            if math:
                self.rows.append(("math", 0, math))
                if "text" in self.buffers and any(t in TEXT_TAGS for t in self.open):
                    self.buffers["text"].append(f"<latex>{math}</latex>")
                else:
                    self.rows.append(("text", 0, f"<latex>{math}</latex>"))
        elif tag in TEXT_TAGS:
            text = _clean(self.take("text"))
            if useful(text):
                if tag[0] == "h":
                    if text.lower() not in BOILERPLATE and text.lower() != self.title.strip().lower():
                        self.rows.append(("heading", int(tag[1]), text))
                        if n := self.toc_titles.get(heading_key(text)):
                            self.captions[n].append(len(self.rows))
                            self.rows.append(("image", n, text))
                else:
                    self.rows.append(("text", 0, text))
        elif tag == "pre":
            code = self.take("code", "\n").strip()
            if code:
                self.rows += [("code", 0, code), ("text", 0, f"[Code] {code[:1200]}")]
        elif tag == "table":
            cells = _clean(self.take("table"))
            if cells:
                self.rows += [("table", 0, cells), ("text", 0, f"[Table] {cells[:1200]}")]
        elif tag == "figcaption":
            text = _clean(self.take("figcaption"))
            if text and self.figure_image:
                self.caption(self.figure_image, text)

    def handle_data(self, data):
        if self.href:
            self.label.append(data)
        if "toc" in self.buffers:
            self.buffers["toc"].append(data)
        elif self.skip:
            if "title" in self.buffers:
                self.buffers["title"].append(data)
        elif "d-math" in self.buffers:
            self.buffers["d-math"].append(data)
        else:
            inside = any(t in TEXT_TAGS for t in self.open)
            for name in ("title", "code", "table", "figcaption", *(["text"] if inside else [])):
                if name in self.buffers:
                    self.buffers[name].append(data)


def useful(text: str) -> bool:
    return len(text) >= 2 and not any(re.search(p, text) for p in EMPTY_CLAIMS)


def heading_key(text: str) -> str:
    return re.sub(r"^\d+(?:\.\d+)*\.?\s*", "", _clean(text).lower())


def page_blocks(pages: DataFrame) -> DataFrame:
    """Rows (BLOCK) of pages (page_id, url, html), in document order. Kinds: title, meta (key, tab, value), heading
    (value: level), text, image (value: number), toc_image, image_url, code, table, math, anchor (href, tab, text)."""

    def rows(page_id: int, url: str | None, html: str | None):
        parser = _Blocks(url or "")
        parser.feed(html or "")
        parser.close()
        for i, (kind, value, text) in enumerate(parser.rows):
            yield page_id, i, kind, value, text

    return pages.select("page_id", "url", "html").mapInArrow(exploded(rows, BLOCK), BLOCK)


# ---------------------------------------------------------------- relational steps


def useful_text(c: Column) -> Column:
    out = F.length(c) >= 2
    for p in EMPTY_CLAIMS:
        out = out & ~c.rlike(p)
    return out


def heading_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"^\d+(?:\.\d+)*\.?\s*", "")


def titles(blocks: DataFrame) -> DataFrame:
    """page_id, title, author, published, site_name: from meta rows, the title falling back to the title tag."""
    key, value = F.substring_index("text", "\t", 1), F.expr("substring(text, locate('\t', text) + 1)")
    first = lambda *names: F.min_by(F.when((F.col("kind") == "meta") & key.isin(*names), value), F.when((F.col("kind") == "meta") & key.isin(*names), F.col("pos")))
    tag = F.min_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("pos")))
    got = blocks.groupBy("page_id").agg(first("og:title", "twitter:title").alias("a"), tag.alias("b"), first("author", "article:author").alias("author"), first("article:published_time", "date").alias("published"), first("og:site_name").alias("site_name"))
    return got.select("page_id", F.coalesce(filled(F.col("a")), F.col("b"), F.lit("")).alias("title"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("author", "published", "site_name")))


def sections(blocks: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """page_id, section, title, level, blocks: a heading starts a section, what stands before the first has the
    default title, sections without blocks are left out. Images that aren't ``available`` (page_id, value) go."""
    rows = blocks.filter(F.col("kind").isin("heading", "text", "image"))
    if available is not None:
        images = rows.filter("kind = 'image'").join(available, ["page_id", "value"], "left_semi").select(rows.columns)
        rows = rows.filter("kind <> 'image'").unionByName(images)
    w = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    text = F.when(F.col("kind") == "image", F.trim(F.concat(F.lit("[ArticleImage:"), F.col("value").cast("string"), F.lit("] "), "text"))).otherwise(F.col("text"))
    body = F.array_sort(F.collect_list(F.when((F.col("kind") != "heading") & (text != ""), F.struct("pos", text.alias("t")))))
    head = lambda c: F.max(F.when(F.col("kind") == "heading", F.col(c)))
    got = rows.groupBy("page_id", "section").agg(F.coalesce(head("text"), F.lit(DEFAULT_TITLE)).alias("title"), F.coalesce(head("value"), F.lit(0)).alias("level"), F.transform(body, lambda x: x["t"]).alias("blocks"))
    return got.filter(F.size("blocks") > 0)


def images(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, n, url, caption of each image."""
    url = blocks.filter("kind = 'image_url'").select("page_id", F.col("value").alias("n"), F.col("text").alias("url"))
    said = blocks.filter(F.col("kind").isin("image", "toc_image")).groupBy("page_id", F.col("value").alias("n")).agg(F.max_by("text", "pos").alias("caption"))
    return url.join(said, ["page_id", "n"], "left")


def anchors(blocks: DataFrame) -> DataFrame:
    """page_id, pos, href, text."""
    return blocks.filter("kind = 'anchor'").select("page_id", "pos", F.substring_index("text", "\t", 1).alias("href"), F.expr("substring(text, locate('\t', text) + 1)").alias("text"))


def important_links(anchor_rows: DataFrame, pattern: str = IMPORTANT, most: int = 12) -> DataFrame:
    """The first ``most`` distinct links of each page whose text or target matters."""
    first = anchor_rows.filter(F.concat_ws(" ", "text", "href").rlike(pattern)).groupBy("page_id", "href").agg(F.min(F.struct("pos", "text")).alias("f"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("f.pos"))
    return first.withColumn("n", n).filter(F.col("n") <= most).select("page_id", "n", "href", F.col("f.text").alias("text"))


def main_text(section_rows: DataFrame, most: int = 100_000) -> DataFrame:
    """page_id and the text of all sections, headings marked, clipped."""
    part = F.concat(F.when(F.col("title") != DEFAULT_TITLE, F.concat(F.lit("## "), "title", F.lit("\n\n"))).otherwise(""), F.array_join("blocks", "\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("t")))), lambda x: x["t"]), "\n\n")
    return section_rows.groupBy("page_id").agg(text.alias("t")).select("page_id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("\n\n[TRUNCATED]"))).otherwise(F.col("t")).alias("text"))


def listed(blocks: DataFrame, kind: str) -> DataFrame:
    """page_id, n, text of a page's code, table or math blocks, clipped."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return blocks.filter(F.col("kind") == kind).select("page_id", n.alias("n"), F.substring("text", 1, CAPS[kind]).alias("text"))


def inline_math(c: Column, most: int = 80) -> Column:
    """Distinct math of a text: display, bracketed, then inline."""
    found = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(?s)\$\$(.{2,240}?)\$\$", r"(?s)\\\[(.{2,240}?)\\\]", r"(?<!\$)\$([^$\n]{2,240})\$(?!\$)")))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.trim(x))), 1, most)


def too_thin(text: Column, structured: Column, least: int = 600) -> Column:
    """Less than ``least`` characters besides markers and white space, and nothing structured."""
    return (F.length(F.regexp_replace(F.regexp_replace(text, r"\[ArticleImage:\d+\]", ""), r"(?U)\s+", "")) < least) & (structured == 0)


def visually_dense(url: Column, html: Column, hosts: tuple[str, ...] = (), tags: tuple[str, ...] = ("canvas", "svg", "video", "iframe", "figure"), most: int = 20) -> Column:
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    count = F.regexp_count(html, F.lit("(?i)<(?:" + "|".join(tags) + r")\b"))
    return host.isin(*hosts) | html.rlike(r"(?i)<d-(?:article|front-matter)\b") | (count >= most)


def number_images(image_rows: DataFrame) -> DataFrame:
    """Placeholders of all of a page's images in order; who publishes fewer filters by ``place``."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("n"))
    return image_rows.withColumn("place", n).select("page_id", "n", "place", F.concat(F.lit("[Figure:"), F.col("place").cast("string"), F.lit(":image-"), F.col("n").cast("string"), F.lit("]")).alias("marker"))


def substitute_markers(lines: DataFrame, numbered: DataFrame) -> DataFrame:
    """Lines (page_id, pos, text) with ``[ArticleImage:n] caption`` replaced by the image's placeholder and its
    caption on a line, or by the caption alone where the image has none."""
    pattern = r"^\[ArticleImage:(\d+)\]\s*(.*)$"
    rows = lines.withColumn("n", filled(F.regexp_extract("text", pattern, 1)).cast("bigint"))
    got = rows.join(numbered.select("page_id", "n", "marker"), ["page_id", "n"], "left")
    caption = F.regexp_extract("text", pattern, 2)
    return got.select("page_id", "pos", F.when(F.col("n").isNull(), F.col("text")).when(F.col("marker").isNull(), caption).otherwise(F.concat("marker", F.lit("\n"), caption)).alias("text"))


def marked_documents(lines: DataFrame, numbered: DataFrame) -> DataFrame:
    """page_id and the page's lines (page_id, pos, text) on end, with placeholders put in (see ``substitute_markers``)."""
    rows = substitute_markers(lines, numbered)
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def section_material(section_rows: DataFrame, most: int = 80, clip: int = 60_000) -> DataFrame:
    """page_id and the first sections written out under numbered heads, clipped."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("section"))
    rows = section_rows.withColumn("n", n).filter(F.col("n") <= most)
    part = F.concat(F.lit("[Section "), F.col("n").cast("string"), F.lit(" | h"), F.col("level").cast("string"), F.lit("] "), "title", F.lit("\n"), F.array_join("blocks", "\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"]), "\n\n")
    return rows.groupBy("page_id").agg(F.substring(text, 1, clip).alias("material"))


def match_sections(snapshots: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Each snapshot (page_id, snap, heading) with its section: equal normalised titles (the last of them), else the
    longest title that contains or is contained in its heading, else the first section without a heading and the
    last one with a heading that fits none."""
    s = section_rows.select("page_id", "section", heading_norm(F.col("title")).alias("key"))
    q = snapshots.withColumn("key", heading_norm(F.col("heading")))
    equal = q.join(s, ["page_id", "key"]).groupBy("page_id", "snap").agg(F.max("section").alias("equal"))
    t = s.withColumnRenamed("key", "title_key")
    near = q.join(t, "page_id").filter((F.col("key") != "") & (F.col("title_key") != "") & (F.col("key").contains(F.col("title_key")) | F.col("title_key").contains(F.col("key"))))
    near = near.groupBy("page_id", "snap").agg(F.max_by("section", F.struct(F.length("title_key"), -F.col("section"))).alias("near"))
    first = s.groupBy("page_id").agg(F.min("section").alias("first"), F.max("section").alias("last"))
    got = q.select("page_id", "snap", "heading").join(equal, ["page_id", "snap"], "left").join(near, ["page_id", "snap"], "left").join(first, "page_id", "left")
    return got.select("page_id", "snap", F.coalesce("equal", "near", F.when(F.coalesce("heading", F.lit("")) == "", F.col("first")).otherwise(F.col("last"))).alias("section"))


def overview_sections(snapshots: DataFrame) -> DataFrame:
    """The section that pages with overview snapshots (page_id, kind, y, n, caption) begin with: their images, from top
    to bottom. Its number is -1, before all others."""
    block = F.trim(F.concat(F.lit("[ArticleImage:"), F.col("n").cast("string"), F.lit("] "), F.coalesce("caption", F.lit(""))))
    got = snapshots.filter("kind = 'overview'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "n", block.alias("t")))).alias("x"))
    return got.select("page_id", F.lit(-1).cast("bigint").alias("section"), F.lit(OVERVIEW_TITLE).alias("title"), F.lit(1).cast("bigint").alias("level"), F.transform("x", lambda x: x["t"]).alias("blocks"))


#: Words of more blocks of a section are frequent.
RARE = 64


def anchor_snapshots(snapshots: DataFrame, block_rows: DataFrame, least: int = 24, overlap: float = 0.72) -> DataFrame:
    """Similarity join: each snapshot (page_id, section, snap, needle) with the block (page_id, section, pos, text)
    of its section that contains its text (or, from ``least`` characters on, is contained), else that shares at least
    ``overlap`` (above 0) of the smaller word set; the first of the best."""
    keys = ["page_id", "section"]
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0))))
    squeezed = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    q = snapshots.select(*keys, "snap", squeezed(F.col("needle")).alias("needle")).filter(F.length("needle") >= least)
    b = block_rows.select(*keys, "pos", squeezed(F.col("text")).alias("text")).filter("text is not null")
    needles, blocks = _written(q.select(*keys, "needle").distinct(), "needles"), _written(b.groupBy(*keys, "text").agg(F.min("pos").alias("pos")), "texts")
    inside = held_by(needles.withColumnRenamed("needle", "pattern"), blocks, keys).withColumnRenamed("pattern", "needle")
    around = held_by(blocks.filter(F.length("text") >= least).withColumnRenamed("text", "pattern"), needles.select("*", F.col("needle").alias("text")), keys).drop("pattern")
    held = _written(inside.unionByName(around).groupBy(*keys, "needle").agg(F.min("pos").alias("pos")), "held")
    left = _written(needles.join(held, [*keys, "needle"], "left_anti").select(*keys, "needle", words(F.col("needle")).alias("a")), "words")
    sets = blocks.groupBy(*keys, words(F.col("text")).alias("b")).agg(F.min("pos").alias("pos"))
    near = left.join(_nearest(left.select(*keys, "a").distinct(), sets, keys, overlap), [*keys, "a"]).select(*keys, "needle", "pos", "score")
    best = held.withColumn("score", F.lit(2.0)).unionByName(near)
    return q.join(best, [*keys, "needle"]).groupBy(*keys, "snap").agg(F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("m")).select(*keys, "snap", "m.*")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    """keys, a, pos, score: for each word set a the row of ``right`` (keys, b, pos) that shares the largest part of the
    smaller set, if at least ``overlap``, then the smallest pos.

    Pairs that share a rare word (of at most RARE sets of the keys in ``right``) are compared as they are. All pairs are
    compared by their frequent words alone, as classes of sets with the same ones and the same size: this never gives a
    pair more than it has, and its due where it shares no rare word, so the better of both is exact. Only the classes
    are compared each with each: they are as many as there are different sets of frequent words."""
    score = lambda both, m, n: F.size(both) / F.greatest(F.least(m, n), F.lit(1))
    best = lambda rows, by: rows.groupBy(*by).agg(F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("top")).select(*by, "top.*")
    a = _written(left.withColumn("aid", F.monotonically_increasing_id()), "left")
    b = _written(right.withColumn("bid", F.monotonically_increasing_id()), "right")
    aw, bw = a.select(*keys, "aid", F.explode("a").alias("word")), b.select(*keys, "bid", F.explode("b").alias("word"))
    shared = bw.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df")).join(aw.select(*keys, "word").distinct(), [*keys, "word"], "left_semi")
    shared = _written(shared, "shared")
    rare, frequent = shared.filter(F.col("df") <= RARE).select(*keys, "word"), shared.filter(F.col("df") > RARE).select(*keys, "word")
    pairs = aw.join(bw.join(rare, [*keys, "word"]), [*keys, "word"]).select("aid", "bid").distinct()
    pairs = pairs.join(a, "aid").join(b.drop(*keys), "bid").withColumn("score", score(F.array_intersect("a", "b"), F.size("a"), F.size("b")))
    pairs = pairs.filter(F.col("score") >= overlap).select(*keys, "a", "pos", "score")
    often = lambda rows, i: rows.join(frequent, [*keys, "word"]).groupBy(*keys, i).agg(F.array_sort(F.collect_list("word")).alias("f"))
    ca = _written(a.join(often(aw, "aid"), [*keys, "aid"]).select(*keys, "a", "f", F.size("a").alias("m")), "often")
    cb = b.join(often(bw, "bid"), [*keys, "bid"]).groupBy(*keys, F.col("f").alias("g"), F.size("b").alias("n")).agg(F.min("pos").alias("pos"))
    classes = ca.select(*keys, "f", "m").distinct().join(cb, keys).withColumn("score", score(F.array_intersect("f", "g"), F.col("m"), F.col("n")))
    classes = best(classes.filter(F.col("score") >= overlap), [*keys, "f", "m"])
    return best(pairs.unionByName(ca.join(classes, [*keys, "f", "m"]).select(*keys, "a", "pos", "score")), [*keys, "a"])


def interleave(block_rows: DataFrame, placed: DataFrame, loose: DataFrame, image: str = r"^\[\w*Image:") -> DataFrame:
    """page_id, section, order, text: a section's blocks (pos, text) with snapshots behind their anchors (page_id,
    section, pos, snap, text), and those without an anchor (page_id, section, snap, text) spread evenly over the places
    behind its blocks of text. A place that is taken is passed over for the next free one; the last place holds any
    number. A section without blocks gets the loose ones in their order.

    The places that are wanted don't decrease, so the free places, numbered, are given out by one running maximum: the
    i-th gets number i + max(r(j) - j) over j <= i, r(j) being the number of free places before the one it wants."""
    keys = ["page_id", "section"]
    w = Window.partitionBy(*keys)
    blocks = block_rows.select(*keys, "pos", "text", (F.row_number().over(w.orderBy("pos")) - 1).alias("i"))
    size = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    anchored = placed.join(blocks.select(*keys, "pos", "i"), [*keys, "pos"]).select(*keys, (F.col("i") + 1).alias("at"), "snap", "text")
    # free places: 1 to n - 1, without those behind an anchor
    taken = anchored.select(*keys, "at").distinct()
    free = blocks.filter("i > 0").select(*keys, F.col("i").alias("at")).join(taken, [*keys, "at"], "left_anti")
    free = free.withColumn("rank", F.row_number().over(w.orderBy("at")) - 1)
    # wanted places: those behind text, evenly
    behind = blocks.filter(~F.col("text").rlike(image)).select(*keys, (F.col("i") + 1).alias("at"))
    behind = behind.withColumn("k", F.row_number().over(w.orderBy("at")) - 1)
    points = behind.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    rest = loose.withColumn("j", F.row_number().over(w.orderBy("snap")) - 1).withColumn("m", F.count(F.lit(1)).over(w)).join(size, keys, "left").join(points, keys, "left")
    rest = rest.withColumn("k", F.bround(F.col("j") * (F.col("points") - 1) / F.greatest(F.col("m") - 1, F.lit(1))).cast("int"))
    rest = rest.join(behind, [*keys, "k"], "left").withColumn("at", F.coalesce("at", "n", F.lit(0)))
    # r: free places before the wanted one, from both kinds of rows in order of place
    line = rest.select(*keys, "at", F.lit(1).alias("kind"), "j", "snap", "text", "n").unionByName(free.select(*keys, "at", F.lit(2).alias("kind")), allowMissingColumns=True)
    before = F.count_if(F.col("kind") == 2).over(w.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1))
    wants = line.withColumn("r", F.coalesce(before, F.lit(0))).filter("kind = 1")
    wants = wants.withColumn("rank", F.when(F.col("at") < F.col("n"), F.col("j") + F.max(F.col("r") - F.col("j")).over(w.orderBy("j"))))
    got = wants.withColumnRenamed("at", "wanted").join(free, [*keys, "rank"], "left")
    order = lambda p, s: F.struct(p.cast("double").alias("p"), s.cast("bigint").alias("s")).alias("order")
    out = blocks.select(*keys, order(F.col("i"), F.lit(-1)), "text").unionByName(anchored.select(*keys, order(F.col("at") - 0.5, F.col("snap")), "text"))
    return out.unionByName(got.select(*keys, order(F.coalesce("at", "n", F.lit(0)) - 0.25, F.col("snap")), "text"))


def image_kind(content: Column) -> Column:
    """png, jpeg, gif, webp or svg by the first bytes of a binary column, else ''."""
    head = F.hex(F.substring(content, 1, 12))
    text = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.ltrim(text).rlike(r"(?s)^(<\?xml.*)?<svg"), "svg").otherwise("")


def rendered_rows(rows: DataFrame) -> DataFrame:
    """Sections from a browser's JSON (page_id, json): cleaned, empty ones dropped, the important links as a line
    in the first section."""
    kind = "struct<sections:array<struct<title:string,level:int,blocks:array<string>>>,links:array<struct<text:string,href:string>>>"
    body = F.from_json("json", kind)
    clean = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    got = rows.select("page_id", body.alias("b")).select("page_id", F.posexplode("b.sections").alias("section", "s"), "b.links")
    links = F.array_join(F.transform(F.slice("links", 1, 12), lambda x: F.concat(clean(x["text"]), F.lit(" "), x["href"])), "; ")
    blocks = F.filter(F.transform("s.blocks", clean), lambda x: x != "")
    with_links = F.when((F.col("section") == 0) & (F.size("links") > 0), F.concat(F.array(F.concat(F.lit("Links: "), links)), blocks)).otherwise(blocks)
    return got.select("page_id", "section", clean(F.col("s.title")).alias("title"), F.col("s.level").alias("level"), with_links.alias("blocks")).filter(F.size("blocks") > 0)


def meta_lookup(html: Column, name: str) -> Column:
    """The content of a named meta tag."""
    return F.trim(F.regexp_extract(html, rf'<meta name="{re.escape(name)}" content="([^"]*)"', 1))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two literals."""
    at = F.locate(start, text)
    rest = F.when(at > 0, F.substr(text, at + len(start), F.length(text)))
    stop = F.instr(rest, end)
    return F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise("")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


def feed_entries(spark, path: str) -> DataFrame:
    """id, title, summary, authors, categories of the entries of Atom files."""
    schema = "id string, title string, summary string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return rows.select("id", clean(F.col("title")).alias("title"), clean(F.col("summary")).alias("summary"), F.filter(F.transform("author", lambda a: clean(a["name"])), lambda x: x != "").alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"))
