"""Figure and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import figures as f
from docintake.operators import tex as t
from docintake.plans.queue import _with
from docintake.plans.registry import query
from docintake.sources.views import load, sql

_FIGS = "SELECT doc_id, label, pos, CASE pos % 5 WHEN 0 THEN concat('img/overview_', CAST(pos AS VARCHAR(9)), '.png') WHEN 1 THEN concat('appendix/f', CAST(pos AS VARCHAR(9)), '.pdf') WHEN 2 THEN concat('a/frame_', CAST(pos AS VARCHAR(9)), '.jpg') WHEN 3 THEN concat('a/logo', CAST(pos AS VARCHAR(9)), '.png') ELSE concat('a/p', CAST(pos AS VARCHAR(9)), '.svg') END AS asset, CASE WHEN pos % 3 = 0 THEN 'the accuracy' ELSE 'a caption' END AS caption, 'main.tex' AS tex_file, CAST(pos % 30 AS INT) AS figure_index FROM v_figures"


def _figs(spark, d):
    return _with(spark, d, _FIGS, ["v_figures"])


_COLS = lambda: (F.col("asset"), F.col("label"), F.col("tex_file"), F.col("caption"), F.col("figure_index"))
#: Ranks of the made-up figures, worked out by hand from the rules.
_RANK = "CASE pos % 5 WHEN 0 THEN CASE WHEN pos % 3 = 0 THEN least(4, 6 + pos % 30) ELSE least(3, 6 + pos % 30) END WHEN 1 THEN 75 WHEN 2 THEN CAST(6 + least(pos % 30, 20) AS INT) ELSE CAST(least(10, 6 + pos % 30) AS INT) END"


@query("fig_content", f"SELECT doc_id, pos, pos % 5 <> 3 AS content, pos % 5 = 1 AS appendix, pos % 5 = 2 AS gallery FROM ({_FIGS}) x", "v_figures")
def _(spark, d):
    path, label, tex, caption, _ = _COLS()
    return _figs(spark, d).select("doc_id", "pos", f.is_content(path, label, caption, F.lit(True)).alias("content"), f.in_appendix(path, label, tex).alias("appendix"), f.in_gallery(path, label).alias("gallery"))


@query("fig_rank", f"SELECT doc_id, pos, CAST({_RANK} AS INT) AS rank, CASE WHEN pos % 5 = 2 THEN CAST(pos AS INT) ELSE 0 END AS frame FROM ({_FIGS}) x", "v_figures")
def _(spark, d):
    return _figs(spark, d).select("doc_id", "pos", f.figure_rank(*_COLS()).alias("rank"), f.frame_number(F.col("asset")).alias("frame"))


@query("fig_cap_labels", f"SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) AS n FROM ({_FIGS}) x) q WHERE n <= CASE WHEN pos % 5 = 2 THEN 1 ELSE 2 END", "v_figures")
def _(spark, d):
    return f.cap_labels(_figs(spark, d)).select("doc_id", "pos")


@query("fig_fallbacks", f"SELECT doc_id, asset FROM ({_FIGS}) x WHERE pos % 2 = 0 UNION ALL SELECT doc_id, asset FROM ({_FIGS}) x WHERE pos % 3 = 0 AND pos % 2 <> 0", "v_figures")
def _(spark, d):
    x = _figs(spark, d).select("doc_id", "asset", "pos")
    return f.with_fallbacks(x.filter("pos % 2 = 0").drop("pos"), x.filter("pos % 3 = 0").drop("pos"))


_GROUPS = f"SELECT doc_id, tex_file, figure_index % 3 AS figure_index, label, caption, count(*) AS n, min({_RANK}) AS rank FROM ({_FIGS}) x GROUP BY 1, 2, 3, 4, 5 HAVING count(*) BETWEEN 2 AND 16"


def _panels(spark, d):
    x = _figs(spark, d).withColumn("rank", f.figure_rank(*_COLS())).withColumn("figure_index", F.col("figure_index") % 3)
    return x, f.panels(x)


@query("fig_panels", f"SELECT doc_id, tex_file, CAST(figure_index AS INT) AS figure_index, label, caption, n, CAST(rank AS INT) AS rank FROM ({_GROUPS}) g", "v_figures")
def _(spark, d):
    return _panels(spark, d)[1]


@query("fig_singles", f"SELECT x.doc_id, x.pos FROM ({_FIGS}) x WHERE NOT EXISTS (SELECT 1 FROM ({_GROUPS}) g WHERE g.doc_id = x.doc_id AND g.figure_index = x.figure_index % 3 AND g.label = x.label AND g.caption = x.caption)", "v_figures")
def _(spark, d):
    return f.singles(*_panels(spark, d)).select("doc_id", "pos")


def _selected(spark, d):
    x = _figs(spark, d).filter(f.is_content(F.col("asset"), F.col("label"), F.col("caption"), F.lit(True)))
    return f.select_figures(x.select("doc_id", "asset", f.figure_rank(*_COLS()).alias("rank"), f.frame_number(F.col("asset")).alias("frame")))


_SELECTED = f"SELECT doc_id, asset, rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank, frame, asset) AS place FROM (SELECT doc_id, asset, CAST({_RANK} AS INT) AS rank, CASE WHEN pos % 5 = 2 THEN CAST(pos AS INT) ELSE 0 END AS frame FROM ({_FIGS}) x WHERE pos % 5 <> 3) q"


@query("fig_select", f"SELECT doc_id, CAST(place AS INT) AS place, asset, rank FROM ({_SELECTED}) s WHERE place <= 5", "v_figures")
def _(spark, d):
    return _selected(spark, d)


@query("fig_placeholders", f"SELECT doc_id, asset, CAST(place AS INT) AS n, concat('[Figure:', CAST(place AS VARCHAR), ':', regexp_extract(asset, '([^/]*)[.][a-z]+$', 1), ']') AS marker FROM ({_SELECTED}) s WHERE place <= 5", "v_figures")
def _(spark, d):
    return f.placeholders(_selected(spark, d))


@query("fig_marker_counts", f"SELECT doc_id, count(*) AS expected, count(*) FILTER (place > 2) AS missing FROM ({_SELECTED}) s WHERE place <= 5 GROUP BY doc_id", "v_figures")
def _(spark, d):
    m = f.placeholders(_selected(spark, d))
    docs = m.filter("n <= 2").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("marker")), "\n").alias("text"))
    return f.marker_counts(docs, m)


@query("fig_caption_lookup", "SELECT doc_id, asset, CASE WHEN k % 3 = 2 THEN NULL ELSE concat('c', CAST(pos AS VARCHAR)) END AS caption FROM (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN asset WHEN 1 THEN concat('other/', regexp_extract(asset, '([^/]*)$', 1)) ELSE concat('none', CAST(pos AS VARCHAR), '.png') END AS asset, pos % 3 AS k FROM (SELECT doc_id, pos, concat('d/f', CAST(pos AS VARCHAR), '.png') AS asset FROM v_figures) y) z", "v_figures")
def _(spark, d):
    own = load(spark, d, "v_figures").select("doc_id", "pos", F.concat(F.lit("d/f"), F.col("pos").cast("string"), F.lit(".png")).alias("asset"), F.concat(F.lit("c"), F.col("pos").cast("string")).alias("caption"))
    asked = own.select("doc_id", F.when(F.col("pos") % 3 == 0, F.col("asset")).when(F.col("pos") % 3 == 1, F.concat(F.lit("other/f"), F.col("pos").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("none"), F.col("pos").cast("string"), F.lit(".png"))).alias("asset"))
    return f.caption_lookup(asked, own)


@query("fig_priority", f"SELECT doc_id, pos, pos % 5 = 0 AND pos % 3 <> 0 AS priority FROM ({_FIGS}) x", "v_figures")
def _(spark, d):
    return _figs(spark, d).select("doc_id", "pos", f.is_priority(F.col("asset"), F.col("caption")).alias("priority"))


@query("fig_section_target", f"SELECT doc_id, pos, CASE WHEN pos % 5 = 1 THEN 'analysis' WHEN pos % 3 = 0 THEN 'experiments' WHEN pos % 5 = 0 THEN 'method' ELSE '' END AS target FROM ({_FIGS}) x", "v_figures")
def _(spark, d):
    return _figs(spark, d).select("doc_id", "pos", f.section_target(F.concat_ws(" ", "asset", "caption")).alias("target"))


@query("fig_compact_grid", "SELECT doc_id, label, pos, CAST(dense_rank() OVER (PARTITION BY doc_id, label ORDER BY row_raw) - 1 AS INT) AS row, CAST(dense_rank() OVER (PARTITION BY doc_id, label, row_raw ORDER BY col_raw) - 1 AS INT) AS col FROM v_figures", "v_figures")
def _(spark, d):
    return f.compact_grid(load(spark, d, "v_figures")).select("doc_id", "label", "pos", "row", "col")


@query("fig_grid_layout", """SELECT doc_id, label, pos, CAST(CASE WHEN own THEN row_raw ELSE i // c END AS INT) AS grid_row, CAST(CASE WHEN own THEN col_raw ELSE i % c END AS INT) AS grid_col FROM (SELECT *, cells = n AND most > 0 AS own, CASE WHEN n <= 4 THEN n WHEN n % 4 = 0 THEN 4 WHEN n % 3 = 0 THEN 3 WHEN n % 5 = 0 THEN 5 ELSE 4 END AS c FROM (
 SELECT v.*, row_number() OVER (PARTITION BY v.doc_id, v.label ORDER BY row_raw, col_raw, pos) - 1 AS i, s.n, s.cells, s.most FROM v_figures v JOIN (SELECT doc_id, label, count(*) AS n, count(DISTINCT (row_raw, col_raw)) AS cells, greatest(max(row_raw), max(col_raw)) AS most FROM v_figures GROUP BY 1, 2) s ON s.doc_id = v.doc_id AND s.label = v.label) q) z""", "v_figures")
def _(spark, d):
    return f.grid_layout(load(spark, d, "v_figures").withColumnsRenamed({"row_raw": "row", "col_raw": "col"}))


@query("fig_display_size", "SELECT pos, CASE WHEN r >= 3.2 THEN 720 WHEN r >= 2.3 THEN 680 WHEN r <= 0.75 THEN 440 WHEN r <= 1.15 THEN 560 ELSE 640 END AS width, CAST(greatest(1, round_even(CASE WHEN r >= 3.2 THEN 720 WHEN r >= 2.3 THEN 680 WHEN r <= 0.75 THEN 440 WHEN r <= 1.15 THEN 560 ELSE 640 END * h / w, 0)) AS INT) AS height FROM (SELECT pos, w, row_raw * 40 AS h, w / (row_raw * 40) AS r FROM v_figures) x", "v_figures")
def _(spark, d):
    w, h = f.display_size(F.col("w"), F.col("row_raw") * 40)
    return load(spark, d, "v_figures").select("pos", w.alias("width"), h.alias("height"))


@query("fig_unrenderable", f"SELECT doc_id, string_agg(DISTINCT x, ',' ORDER BY x) AS formats FROM (SELECT doc_id, regexp_extract(asset, '[.]([a-z]+)$', 1) AS x FROM ({_FIGS}) f WHERE doc_id NOT IN (SELECT doc_id FROM v_figures WHERE pos % 7 = 0 AND pos < 300)) q GROUP BY 1", "v_figures")
def _(spark, d):
    return f.unrenderable(_figs(spark, d), load(spark, d, "v_figures").filter("pos % 7 = 0 and pos < 300"))


@query("fig_grid_labels", "SELECT doc_id, label, pos AS row, concat('f', CAST(pos AS VARCHAR)) AS name FROM v_figures", "v_figures")
def _(spark, d):
    x = load(spark, d, "v_figures").select("doc_id", "label", F.col("pos").alias("row"), F.concat(F.lit("d/f"), F.col("pos").cast("string"), F.lit(".png")).alias("asset"))
    return f.grid_labels(x, "row")


@query("fig_display_caption", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '方法架构图' ELSE concat('my file ', CAST(doc_id AS VARCHAR)) END AS caption FROM documents")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Figure 3: The proposed architecture of it. More").otherwise("Plain words about something long").alias("c"), F.concat(F.lit("a/my_file-"), F.col("doc_id").cast("string"), F.lit(".png")).alias("p"))
    return docs.select("doc_id", f.display_caption(F.col("c"), F.col("p")).alias("caption"))


# ---------------------------------------------------------------- sources

_FILES = "SELECT p_brand AS paper_id, p_partkey AS n, CASE p_partkey % 6 WHEN 0 THEN 'main.tex' WHEN 1 THEN concat('sec/method', CAST(p_partkey AS VARCHAR(9)), '.tex') WHEN 2 THEN concat('ref', CAST(p_partkey AS VARCHAR(9)), '.bib') WHEN 3 THEN concat('appendix/a', CAST(p_partkey AS VARCHAR(9)), '.tex') WHEN 4 THEN concat('Intro', CAST(p_partkey AS VARCHAR(9)), '.tex') ELSE concat('x', CAST(p_partkey AS VARCHAR(9)), '.tex') END AS path, concat(p_type, ' 50% off ', p_name) AS content FROM part"
_FILE_RANK = "CASE n % 6 WHEN 0 THEN 50 WHEN 1 THEN 5 WHEN 2 THEN 100 WHEN 3 THEN 13 WHEN 4 THEN 1 ELSE 60 END"


def _files(spark, d):
    return sql(spark, d, _FILES)


@query("tex_file_rank", f"SELECT paper_id, n, {_FILE_RANK} AS rank FROM ({_FILES}) x")
def _(spark, d):
    return _files(spark, d).select("paper_id", "n", t.file_rank(F.col("path")).alias("rank"))


@query("tex_corpus", f"SELECT paper_id, string_agg(concat('% FILE: ', path, chr(10), content), chr(10) || chr(10) ORDER BY {_FILE_RANK}, lower(path), n) AS source FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {_FILE_RANK}, lower(path), n) AS k FROM ({_FILES}) x) q WHERE k <= 80 GROUP BY 1")
def _(spark, d):
    return t.concatenate_files(_files(spark, d).withColumn("size", F.col("n")), order="size")


@query("tex_strip_comments", f"SELECT n, regexp_replace(content, '%.*$', '') AS content FROM ({_FILES}) x")
def _(spark, d):
    return _files(spark, d).select("n", t.strip_comments(F.col("content")).alias("content"))


_TEX = "SELECT p_partkey AS n, concat('x ', chr(92), 'textbf{', p_name, '} {y} ', chr(92), 'cite{a} . ', chr(92), 'label{fig:', CAST(p_partkey AS VARCHAR(9)), '}') AS s FROM part"


@query("tex_clean", "SELECT p_partkey AS n, concat('x ', p_name, ' y.') AS s FROM part")
def _(spark, d):
    return sql(spark, d, _TEX).select("n", t.clean_latex(F.col("s")).alias("s"))


@query("tex_tail_clip", "SELECT doc_id, CASE WHEN length(t) > 500 THEN concat(left(t, 500), chr(10), chr(10), '[TRUNCATED]') ELSE t END AS s FROM (SELECT doc_id, trim(text, chr(10) || ' ') AS t FROM documents) x")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", t.clip_tail(F.trim(F.col("text"), F.lit("\n ")), 500).alias("s"))


@query("tex_clip_with_appendix", """SELECT doc_id, CASE WHEN length(t) <= 900 THEN t WHEN a < 300 THEN concat(left(t, 900), chr(10), chr(10), '[TRUNCATED]')
 ELSE concat(rtrim(left(t, 520), chr(10) || ' '), chr(10), chr(10), '[TRUNCATED: middle left out, appendix kept]', chr(10), chr(10), trim(substr(t, a + 1, 300), chr(10) || ' '), chr(10), chr(10), '[TRUNCATED]') END AS s
FROM (SELECT doc_id, t, strpos(t, chr(92) || 'appendix') - 1 AS a FROM (SELECT doc_id, concat(trim(text, chr(10) || ' '), chr(92), 'appendix extra ', left(text, 50)) AS t FROM documents WHERE doc_id % 7 <> 0) x) y""".replace("concat(trim(text, chr(10) || ' '), chr(92), 'appendix extra ', left(text, 50)) AS t", "trim(concat(trim(text, chr(10) || ' '), chr(92), 'appendix extra ', left(text, 50)), chr(10) || ' ') AS t"))
def _(spark, d):
    s = F.trim(F.concat(F.trim(F.col("text"), F.lit("\n ")), F.lit("\\appendix extra "), F.substring("text", 1, 50)), F.lit("\n "))
    return load(spark, d, "documents").filter("doc_id % 7 <> 0").select("doc_id", t.clip_with_appendix(s, 900).alias("s"))


@query("tex_summary", f"SELECT paper_id, sum(length(content)) AS chars, count(*) AS files, count(*) = 0 AS needs_source FROM ({_FILES}) x GROUP BY 1")
def _(spark, d):
    return t.source_summary(_files(spark, d))


@query("tex_needs_source", "SELECT doc_id, 'source-missing: no files' AS warnings FROM documents WHERE doc_id % 5 = 0")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("source"), F.array(F.lit("figure-note"), F.lit("source-missing: no files")).alias("warnings"))
    return t.needs_source(docs)
