"""Layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import layout as y
from docintake.plans.queue import _with
from docintake.plans.registry import query
from docintake.sources.views import load, sql


@query("vq_overlaps", """SELECT page_id, a, b, CAST(round_even(h, 0) AS BIGINT) AS px FROM (SELECT page_id, pb AS a, block_no AS b, least(prgt, rgt) - greatest(plft, lft) AS w, least(pbottom, bottom) - greatest(ptop, top) AS h,
  (ptop <= top + 2 AND pbottom >= bottom - 2 AND plft <= lft + 2 AND prgt >= rgt - 2) OR (top <= ptop + 2 AND bottom >= pbottom - 2 AND lft <= plft + 2 AND rgt >= prgt - 2) OR (pcls = cls AND abs(ptop - top) < 2) AS same
 FROM (SELECT *, lag(block_no) OVER w AS pb, lag(top) OVER w AS ptop, lag(lft) OVER w AS plft, lag(bottom) OVER w AS pbottom, lag(rgt) OVER w AS prgt, lag(cls) OVER w AS pcls FROM v_blocks WINDOW w AS (PARTITION BY page_id ORDER BY top, lft, block_no)) q WHERE pb IS NOT NULL) z WHERE w > 80 AND h > 10 AND NOT same""", "v_blocks")
def _(spark, d):
    return y.overlaps(load(spark, d, "v_blocks"))


_IMAGES = "SELECT page_id, block_no, lft, rgt, CAST(100.0 AS DOUBLE) AS editor_left, CAST(240.0 AS DOUBLE) AS editor_right, CAST(block_no % 10 AS DOUBLE) / 10 AS blank_total, CAST(block_no % 7 AS DOUBLE) / 10 AS blank_top, CAST(block_no % 9 AS DOUBLE) / 10 AS blank_bottom FROM v_blocks WHERE cls = 'figure'"


@query("vq_image_findings", f"""SELECT page_id, 'image-overflow' AS kind, 'high' AS severity, block_no, concat(CAST(CAST(round_even(greatest(rgt - editor_right, 0.0), 0) AS BIGINT) AS VARCHAR), 'px') AS detail FROM ({_IMAGES}) i WHERE rgt - editor_right > 12 OR lft < editor_left - 12
UNION ALL SELECT page_id, 'image-too-wide', 'medium', block_no, '' FROM ({_IMAGES}) i WHERE rgt - lft > (editor_right - editor_left) * 0.94
UNION ALL SELECT page_id, 'image-large-white-border', CASE WHEN blank_total > 0.72 OR blank_bottom > 0.62 OR blank_top > 0.55 THEN 'high' ELSE 'medium' END, block_no, concat(CAST(CAST(round_even(blank_total * 100, 0) AS BIGINT) AS VARCHAR), '%') FROM ({_IMAGES}) i WHERE blank_total > 0.46 OR blank_bottom > 0.38 OR blank_top > 0.30""", "v_blocks")
def _(spark, d):
    return y.image_findings(_with(spark, d, _IMAGES, ["v_blocks"]))


_PAGES = "SELECT page_id, count(*) FILTER (WHERE cls = 'figure') AS images, count(*) FILTER (WHERE cls = 'text') AS tables, count(*) * 40 AS formulas, page_id % 4 AS want_images, page_id % 3 AS want_tables, count(*) * 40 + page_id % 5 - 1 AS want_formulas, page_id % 2 AS invalid, 0 AS raw FROM v_blocks GROUP BY page_id"


@query("vq_count_findings", f"""SELECT page_id, 'missing-image' AS kind, 'high' AS severity, concat(CAST(images AS VARCHAR), '/', CAST(want_images AS VARCHAR)) AS detail FROM ({_PAGES}) p WHERE want_images > 0 AND images < want_images
UNION ALL SELECT page_id, 'missing-table', 'high', concat(CAST(tables AS VARCHAR), '/', CAST(want_tables AS VARCHAR)) FROM ({_PAGES}) p WHERE want_tables > 0 AND tables < want_tables
UNION ALL SELECT page_id, CASE WHEN ok THEN 'formula-count-drift' ELSE 'missing-formula' END, CASE WHEN ok THEN 'medium' ELSE 'high' END, concat(CAST(formulas AS VARCHAR), '/', CAST(want_formulas AS VARCHAR))
  FROM (SELECT *, want_formulas - formulas <= greatest(1, ceil(want_formulas / 100)) AND invalid = 0 AS ok FROM ({_PAGES}) p) q WHERE want_formulas > formulas""", "v_blocks")
def _(spark, d):
    return y.count_findings(_with(spark, d, _PAGES, ["v_blocks"]))


@query("vq_empty_tables", "SELECT page_id, block_no FROM v_blocks WHERE cls = 'text' AND (block_no % 4 < 1 OR page_id % 5 < 1)", "v_blocks")
def _(spark, d):
    t = load(spark, d, "v_blocks").filter("cls = 'text'").withColumns({"rows": F.col("block_no") % 4, "cells": F.col("page_id") % 5})
    return y.empty_tables(t).select("page_id", "block_no")


_FOUND = "SELECT page_id, block_no, cls AS kind, CAST(block_no % 2 AS VARCHAR(4)) AS section, '' AS image_name, CAST(top > 200 AS VARCHAR(8)) AS detail FROM v_blocks"


@query("vq_distinct_findings", f"SELECT page_id, kind, section, image_name, detail, min(block_no) AS block_no FROM ({_FOUND}) f GROUP BY 1, 2, 3, 4, 5", "v_blocks")
def _(spark, d):
    return y.distinct_findings(_with(spark, d, _FOUND, ["v_blocks"]), "block_no")


@query("vq_sample_evenly", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events)
SELECT user_id, event_id FROM r WHERE m <= 8 OR i IN (SELECT CAST(round_even(k * (r.m - 1) / 7, 0) AS BIGINT) FROM range(8) t(k))""")
def _(spark, d):
    return y.sample_evenly(load(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 8)


@query("vq_distinct_viewports", "SELECT page_id, min(block_no) AS block_no FROM v_blocks GROUP BY page_id, round_even(top / 120, 0)", "v_blocks")
def _(spark, d):
    return y.distinct_viewports(load(spark, d, "v_blocks").withColumn("scroll_top", F.col("top")), "block_no").select("page_id", "block_no")


@query("vq_distinct_targets", "SELECT page_id, min(block_no) AS block_no FROM (SELECT page_id, block_no, CASE WHEN block_no % 3 = 0 THEN cls WHEN block_no % 3 = 1 THEN CAST(block_no % 4 AS VARCHAR) ELSE concat('s', cls) END AS k FROM v_blocks) q GROUP BY page_id, k", "v_blocks")
def _(spark, d):
    b, n = load(spark, d, "v_blocks"), F.col("block_no")
    t = b.select("page_id", "block_no", F.when(n % 3 == 0, F.col("cls")).otherwise("").alias("href"), F.when(n % 3 == 1, n % 4).alias("scroll_top"), F.concat(F.lit("s"), "cls").alias("section"))
    return y.distinct_targets(t, "block_no").select("page_id", "block_no")


@query("vq_run_metrics", f"SELECT page_id, count(*) AS image_observations, greatest(0.0, round_even(max(rgt - editor_right), 1)) AS max_overflow, count(*) FILTER (rgt - editor_right > 12) AS overflowing FROM ({_IMAGES}) i GROUP BY page_id", "v_blocks")
def _(spark, d):
    return y.run_metrics(_with(spark, d, _IMAGES, ["v_blocks"]))


@query("vq_leaked_formatting", "SELECT doc_id, CASE WHEN regexp_matches(md, '(^|[^\\\\])\\$\\$') THEN 1 ELSE 0 END AS leaks FROM v_md WHERE doc_id % 3 <> 1", "v_md")
def _(spark, d):
    return load(spark, d, "v_md").filter("doc_id % 3 <> 1").select("doc_id", F.size(F.filter(y.leaked_formatting(F.col("md")), lambda x: x == "$$")).alias("leaks"))


@query("vq_warnings", f"SELECT page_id, block_no, concat('visual-qa:high:', kind, ':', section, ':', detail) AS warning FROM ({_FOUND}) f WHERE kind <> 'image-too-wide'", "v_blocks")
def _(spark, d):
    f = y.blocking_findings(_with(spark, d, _FOUND, ["v_blocks"]))
    return f.select("page_id", "block_no", y.finding_warning(F.col("kind"), F.lit("high"), F.col("section"), F.col("image_name"), F.col("detail")).alias("warning"))


_SIZED = "SELECT page_id, block_no, concat('n', CAST(block_no AS VARCHAR(9))) AS name, CAST(300 + (page_id * 7 + block_no) % 600 AS BIGINT) AS width, CAST(200 + page_id % 400 AS BIGINT) AS height FROM v_blocks WHERE cls = 'figure'"


@query("vq_resize", f"""SELECT page_id, block_no, t AS width, CAST(greatest(1, round_even(height * t / width, 0)) AS BIGINT) AS height FROM (SELECT *, CAST(greatest(320, least(width, floor(CAST(600 AS DOUBLE) * CAST(0.82 AS DOUBLE)))) AS BIGINT) AS t FROM ({_SIZED}) s WHERE page_id % 2 = 0) q WHERE NOT t >= width - 4""", "v_blocks")
def _(spark, d):
    images = _with(spark, d, _SIZED, ["v_blocks"])
    found = images.filter("page_id % 2 = 0").select("page_id", F.when(F.col("block_no") % 2 == 0, F.col("block_no")).otherwise(-1).alias("block_no"), "name", F.lit(600).alias("editor_width"))
    return y.resize_proposals(found, images)


@query("vq_candidates", "SELECT page_id, block_no, CAST(n AS INT) AS rank FROM (SELECT page_id, block_no, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN cls = 'text' THEN 0 ELSE 1 END, block_no) AS n FROM v_blocks) q WHERE n <= 3", "v_blocks")
def _(spark, d):
    b = load(spark, d, "v_blocks").select("page_id", "block_no", "cls")
    return y.order_candidates(b, b.filter("cls = 'text'"), 3).select("page_id", "block_no", "rank")


_ROUNDS = "SELECT user_id AS page_id, event_id AS round, event_id % 4 AS findings, event_id % 2 AS blocking, event_id % 3 = 0 AS changed, CASE WHEN event_type = 'error' THEN 'x' ELSE '' END AS error FROM events"


@query("vq_round_audit", f"""SELECT page_id, rounds, CASE WHEN error <> '' THEN 'error' WHEN findings = 0 THEN 'passed' WHEN blocking = 0 THEN 'passed-with-warnings' WHEN NOT changed THEN 'stalled' ELSE 'issues' END AS status
FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS rounds, row_number() OVER (PARTITION BY page_id ORDER BY round DESC) AS n FROM ({_ROUNDS}) r) q WHERE n = 1""")
def _(spark, d):
    return y.round_audit(sql(spark, d, _ROUNDS))


@query("vq_last_json", "SELECT user_id AS log_id, arg_max(props, event_id) AS object, max(event_id) AS line_no FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def _(spark, d):
    lines = load(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("log "), "props")).otherwise(F.col("props")).alias("line"))
    return y.last_json_object(lines)


@query("art_distinct_rects", """SELECT page_id, block_no, CAST(n AS INT) AS rank FROM (SELECT page_id, block_no, row_number() OVER (PARTITION BY page_id ORDER BY top, block_no) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, cls, floor(top / 12 + 0.5), floor(lft / 12 + 0.5), floor(rgt / 12 + 0.5), floor(bottom / 12 + 0.5) ORDER BY block_no) AS k FROM v_blocks) q WHERE k = 1) z WHERE n <= 5""", "v_blocks")
def _(spark, d):
    return y.distinct_rects(load(spark, d, "v_blocks"), "block_no", 12, 5).select("page_id", "block_no", "rank")


@query("art_nearest_heading", """SELECT f.page_id, f.block_no, (SELECT max(h.block_no) FROM v_blocks h WHERE h.page_id = f.page_id AND h.cls = 'heading' AND h.top = (SELECT max(g.top) FROM v_blocks g WHERE g.page_id = f.page_id AND g.cls = 'heading' AND g.top < f.top - 12)) AS heading FROM v_blocks f WHERE f.cls = 'figure'""", "v_blocks")
def _(spark, d):
    b = load(spark, d, "v_blocks")
    heads = b.filter("cls = 'heading'").select("page_id", "top", F.col("block_no").alias("heading"))
    return y.nearest_above(b.filter("cls = 'figure'").select("page_id", "block_no", "top"), heads, ["page_id"], 12, "heading").select("page_id", "block_no", "heading")


@query("art_nearest_text", """SELECT f.page_id, f.block_no, (SELECT max(h.block_no) FROM v_blocks h WHERE h.page_id = f.page_id AND h.block_no % 2 = f.block_no % 2 AND h.cls = 'text' AND h.top = (SELECT max(g.top) FROM v_blocks g WHERE g.page_id = f.page_id AND g.block_no % 2 = f.block_no % 2 AND g.cls = 'text' AND g.top < f.top - 8)) AS anchor FROM v_blocks f WHERE f.cls = 'figure'""", "v_blocks")
def _(spark, d):
    b = load(spark, d, "v_blocks").withColumn("section", F.col("block_no") % 2)
    texts = b.filter("cls = 'text'").select("page_id", "section", "top", F.col("block_no").alias("anchor"))
    return y.nearest_above(b.filter("cls = 'figure'").select("page_id", "section", "block_no", "top"), texts, ["page_id", "section"], 8, "anchor").select("page_id", "block_no", "anchor")
