"""Queries over TeX sources, message lines and pages that are built from whole texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import figures as fig
from docintake.operators import layout as lay
from docintake.operators import messages as m
from docintake.operators import pages as p
from docintake.operators import tex as t
from docintake.plans.queue import _with
from docintake.plans.registry import query
from docintake.sources.sinks import scratch_path
from docintake.sources.views import load, sql


def _said(*parts: str) -> str:
    """SQL that joins parts: ``=expression`` as it is, anything else as a literal (backslashes and line ends by code)."""
    out = []
    for x in parts:
        if x.startswith("="):
            out.append(x[1:])
        else:
            out += [f"'{y}'" if y not in ("\\", "\n") else f"chr({ord(y)})" for y in x.replace("\\", "\0\\\0").replace("\n", "\0\n\0").split("\0") if y]
    return f"concat({', '.join(out)})"


_ID = "=CAST(doc_id AS VARCHAR(20))"
_TABLE = _said("\\begin{table}\\begin{tabular}{l} a & ", _ID, " \\end{tabular}\\end{table}")
_BODY = _said(
    "=coalesce(text, '')", "\n\\begin{figure}\n\\includegraphics[width=3cm]{img/a", _ID, ".png} \\\\ \\includegraphics{b}\n\\caption{About ", "=lang", "}\\label{fig:", _ID, "}\n\\end{figure}\n", f"={_TABLE}",
    "\n\\newcommand{\\modelname}{Great ", "=lang", "}\n\\newcommand{\\nrm}[1]{|#1|}\n\\def\\vx{\\mathbf{x}}\nAs \\ref{fig:", _ID, "} shows\nby \\modelname here\n",
)
_FILES = f"SELECT CAST(doc_id AS VARCHAR(20)) AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'main.tex' ELSE 'sec/intro.tex' END AS path, lang, {_BODY} AS content FROM documents"


def _files(spark, d):
    return sql(spark, d, _FILES).select("paper_id", "path", "content")


def _docs(spark, d):
    return sql(spark, d, _FILES).select("paper_id", F.col("content").alias("source"))


@query("tex_captions", f"SELECT paper_id, CAST(0 AS INT) AS n, concat('About ', lang) AS caption FROM ({_FILES}) x")
def _(spark, d):
    return t.captions(_files(spark, d))


@query("tex_tables", f"SELECT CAST(doc_id AS VARCHAR) AS paper_id, 0 AS n, {_TABLE} AS text FROM documents")
def _(spark, d):
    return t.tables(_docs(spark, d))


_FIGURES = f"SELECT paper_id, path AS tex_file, CAST(0 AS INT) AS figure_index, CAST(k AS BIGINT) AS asset_index, CASE k WHEN 0 THEN concat('img/a', paper_id, '.png') ELSE 'b' END AS asset, CAST(k AS INT) AS row, CAST(0 AS INT) AS col, concat('About ', lang) AS caption, concat('fig:', paper_id) AS label FROM ({_FILES}) x, range(2) r(k)"


@query("tex_figures", _FIGURES)
def _(spark, d):
    return t.figures(_files(spark, d))


#: Asset files: beside the TeX file, below the root, elsewhere under the stem, or not at all.
_ASSETS = "SELECT CAST(doc_id AS VARCHAR(20)) AS paper_id, CASE doc_id % 4 WHEN 0 THEN concat('img/a', CAST(doc_id AS VARCHAR(20)), '.png') WHEN 1 THEN 'sec/b.pdf' WHEN 2 THEN 'other/B.jpg' ELSE 'none.txt' END AS path FROM documents"


@query("tex_assets", "SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(k AS BIGINT) AS asset_index, CASE WHEN k = 0 THEN concat('img/a', CAST(doc_id AS VARCHAR), '.png') WHEN doc_id % 4 = 1 THEN 'sec/b.pdf' WHEN doc_id % 4 = 2 THEN 'other/B.jpg' ELSE 'b' END AS path FROM documents, range(2) r(k)")
def _(spark, d):
    return t.resolve_assets(t.figures(_files(spark, d)), sql(spark, d, _ASSETS)).select("paper_id", "asset_index", "path")


@query("tex_text_macros", f"SELECT paper_id, 'modelname' AS name, concat('Great ', lang) AS value FROM ({_FILES}) x")
def _(spark, d):
    return t.text_macros(_docs(spark, d)).filter("name = 'modelname'")


@query("tex_formula_macros", f"SELECT paper_id, name, arguments, body FROM (SELECT paper_id, 'nrm' AS name, CAST(1 AS BIGINT) AS arguments, '|#1|' AS body FROM ({_FILES}) x UNION ALL SELECT paper_id, 'vx', 0, concat(chr(92), 'mathbf{{x}}') FROM ({_FILES}) y) z")
def _(spark, d):
    return t.formula_macros(_docs(spark, d)).filter("name in ('nrm', 'vx')")


@query("tex_expand_macros", f"SELECT paper_id, concat('by Great ', lang, ' here') AS said FROM ({_FILES}) x")
def _(spark, d):
    docs = _docs(spark, d)
    return t.expand_macros(docs, t.text_macros(docs).filter("name = 'modelname'")).select("paper_id", F.regexp_extract("source", r"(?m)^by .* here$", 0).alias("said"))


@query("tex_reference_contexts", "SELECT CAST(doc_id AS VARCHAR) AS paper_id, concat('fig:', CAST(doc_id AS VARCHAR)) AS label, true AS named FROM documents")
def _(spark, d):
    got = t.reference_contexts(_docs(spark, d), t.figures(_files(spark, d)))
    return got.select("paper_id", "label", F.col("context").contains("As [ref] shows by").alias("named"))


# ---------------------------------------------------------------- messages

#: A line of JSON for each message, with blank and broken ones between.
_LINES = "SELECT message_id, thread_id, turn, content, CASE turn % 5 WHEN 3 THEN '  ' WHEN 4 THEN concat('{broken ', role) ELSE to_json(named_struct('event_id', concat('e', CAST(message_id AS STRING)), 'id', concat('om_', CAST(message_id AS STRING)), 'content', content)) END AS value FROM v_messages"


@query("src_parse_lines", "SELECT concat('e', CAST(message_id AS VARCHAR)) AS event_id, concat('om_', CAST(message_id AS VARCHAR)) AS message_id, '' AS chat_type, content FROM v_messages WHERE turn % 5 < 3 AND content IS NOT NULL", "v_messages")
def _(spark, d):
    lines = _with(spark, d, _LINES, ["v_messages"]).filter("content is not null").select("value")
    return m.parse_lines(lines).select("event_id", "message_id", "chat_type", "content")


@query("src_mentioned", "SELECT message_id, turn % 4 IN (0, 1, 3) AS named FROM v_messages WHERE content IS NOT NULL", "v_messages")
def _(spark, d):
    rows = load(spark, d, "v_messages").filter("content is not null")
    said = F.when(F.col("turn") % 4 == 0, F.concat("content", F.lit(" @BOT read"))).otherwise(F.regexp_replace("content", "@", " "))
    who = F.when(F.col("turn") % 4 == 1, F.array(F.create_map(F.lit("name"), F.lit("Bot")))).when(F.col("turn") % 4 == 2, F.array(F.create_map(F.lit("name"), F.lit("Ann")))).when(F.col("turn") % 4 == 3, F.array(F.create_map(F.lit("id"), F.lit("x"))))
    return rows.select("message_id", m.mentioned(said, F.coalesce(who, F.array().cast("array<map<string,string>>"))).alias("named"))


_KEYS = "SELECT message_id, CASE turn % 3 WHEN 0 THEN concat('omt_', CAST(thread_id AS VARCHAR(20))) WHEN 1 THEN concat('om_', CAST(message_id AS VARCHAR(20))) ELSE concat('om_', CAST(message_id - 1 AS VARCHAR(20))) END AS a, CASE turn % 2 WHEN 0 THEN concat('om_', CAST(message_id - 1 AS VARCHAR(20))) ELSE concat('x', CAST(turn AS VARCHAR(20))) END AS b FROM v_messages"


@query("ext_related", f"SELECT message_id, a LIKE 'omt!_%' ESCAPE '!' OR a LIKE 'om!_%' ESCAPE '!' OR b LIKE 'om!_%' ESCAPE '!' AS reply, array_to_string(list_distinct(list_filter([a, b], lambda x: starts_with(x, 'om_') AND x <> concat('om_', CAST(message_id AS VARCHAR)))), ',') AS messages FROM ({_KEYS}) k", "v_messages")
def _(spark, d):
    k = _with(spark, d, _KEYS, ["v_messages"])
    own = F.concat(F.lit("om_"), F.col("message_id").cast("string"))
    return k.select("message_id", m.is_thread_reply(F.col("a"), F.col("b")).alias("reply"), F.array_join(m.related_messages(own, F.col("a"), F.col("b")), ",").alias("messages"))


_ASKED = "SELECT message_id, thread_id, turn, content, regexp_extract(content, 'https?://', 0) <> '' AS linked, thread_id % 4 = 0 AS private, turn % 4 = 2 AS mention, turn % 4 = 3 AS retry, thread_id % 2 = 1 AS reply FROM v_messages WHERE content IS NOT NULL"


@query("ext_related_context", f"""WITH e AS (SELECT * FROM ({_ASKED}) q WHERE NOT linked AND NOT private AND (mention OR retry AND reply)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn, message_id) AS n FROM v_messages WHERE content IS NOT NULL) y WHERE n <= 12),
parts AS (SELECT e.message_id, k AS g, h.n, h.content FROM e, range(3) r(k), h WHERE h.thread_id = e.thread_id + k UNION ALL SELECT e.message_id, 10 + k, 0, v.content FROM e, range(2) r(k), v_messages v WHERE v.message_id = e.thread_id * 1000 + 5000 + k AND v.content IS NOT NULL)
SELECT message_id, trim(string_agg(content, chr(10) ORDER BY g, n), concat(chr(10), chr(9), ' ')) AS context FROM parts WHERE content <> '' GROUP BY 1""", "v_messages")
def _(spark, d):
    rows = _with(spark, d, _ASKED, ["v_messages"])
    thread = F.col("thread_id")
    rows = rows.withColumn("threads", F.array(thread, thread + 1, thread + 2, thread + 3)).withColumn("related", F.array(thread * 1000 + 5000, thread * 1000 + 5001))
    return m.related_context(rows, rows.select("message_id", "thread_id", "turn", "content")).select("message_id", "context")


# ---------------------------------------------------------------- pages, figures, layout


@query("art_listed", "SELECT page_id, 0 AS n, concat('x = ', left(trim(regexp_replace(regexp_extract(html, '<title>([^<&]*)', 1), '[ ]+', ' ', 'g')), 500)) AS text FROM pages")
def _(spark, d):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<&]*)", 1), "[ ]+", " "))
    pages = load(spark, d, "pages").withColumn("html", F.concat("html", F.lit("<pre>x = "), F.substring(title, 1, 500), F.lit("</pre>")))
    return p.listed(p.page_blocks(pages), "code")


@query("art_image_kinds", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'svg' ELSE '' END AS kind FROM documents")
def _(spark, d):
    heads = F.lit(["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "3C73766720", "2E"])
    head = F.unhex(F.element_at(heads, (F.col("doc_id") % 6 + 1).cast("int")))
    return load(spark, d, "documents").select("doc_id", p.image_kind(F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("kind"))


_JSON = "SELECT doc_id AS page_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' '{flag})) AS t, lang FROM documents"


@query("art_rendered", f"SELECT page_id, k AS section, concat('T', k, ' ', lang) AS title, CAST(2 AS INT) AS level, CASE k WHEN 0 THEN concat('Links: Code https://g/', page_id, '|', t) ELSE t END AS blocks FROM ({_JSON.format(flag=', ' + chr(39) + 'g' + chr(39))}) x, range(2) r(k) WHERE t <> '' OR k = 0")
def _(spark, d):
    rows = sql(spark, d, _JSON.format(flag=""))
    section = lambda k: F.struct(F.concat(F.lit(f" T{k}  "), "lang").alias("title"), F.lit(2).alias("level"), F.array(F.concat(F.lit(" "), "t", F.lit("\n")), F.lit("  ")).alias("blocks"))
    link = F.struct(F.lit(" Code ").alias("text"), F.concat(F.lit("https://g/"), F.col("page_id").cast("string")).alias("href"))
    body = F.to_json(F.struct(F.array(section(0), section(1)).alias("sections"), F.array(link).alias("links")))
    return p.rendered_rows(rows.select("page_id", body.alias("json"))).withColumn("rest", F.array_join(F.slice("blocks", 2, 1), "|")).select("page_id", "section", "title", "level", F.when(F.col("section") == 0, F.concat(F.get("blocks", 0), F.lit("|"), "rest")).otherwise(F.array_join("blocks", "|")).alias("blocks"))


@query("fig_insert_markers", "SELECT doc_id, concat(t, chr(10), '## Method', chr(10), '[Figure:1:a]', chr(10), 'x', chr(10), '## Results', chr(10), 'y') AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) x")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n## Method\nx\n## Results\ny")).alias("text"))
    marks = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("[Figure:1:a]").alias("marker"), F.lit("method").alias("section")), F.struct(F.lit("[Figure:2:b]").alias("marker"), F.lit("appendix of nothing").alias("section")))).alias("m"))
    return fig.insert_markers(docs, marks.select("doc_id", "m.*"))


_BLOCKS = "SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN 'b1' WHEN 1 THEN 'b9' ELSE 'b2' END AS block_id, CASE doc_id % 4 WHEN 3 THEN 'table' ELSE 'text' END AS mode, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '') AS t FROM documents"


@query("vq_repair_decisions", "SELECT doc_id AS page_id, 0 AS pos, CASE doc_id % 4 WHEN 1 THEN 'b9' WHEN 0 THEN 'b1' ELSE 'b2' END AS block_id, CASE doc_id % 4 WHEN 1 THEN 'unknown-block' WHEN 3 THEN 'wrong-mode' ELSE CASE WHEN regexp_matches(coalesce(text, ''), '^[^A-Za-z]*$') THEN 'empty' ELSE 'accepted' END END AS reason FROM documents")
def _(spark, d):
    rows = sql(spark, d, _BLOCKS)
    response = F.to_json(F.struct(F.array(F.struct("block_id", "mode", F.col("t").alias("text"))).alias("repairs")))
    known = rows.select("page_id", F.explode(F.lit(["b1", "b2"])).alias("block_id"), F.lit("text").alias("kind"))
    return lay.repair_decisions(rows.select("page_id", response.alias("response")), known, 5)


@query("src_tree", """WITH f AS (SELECT coalesce(source, '') AS paper_id, concat(coalesce(lang, 'x'), '/', CAST(doc_id AS VARCHAR), '.tex') AS path, coalesce(lang, 'x') AS folder FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY folder, path) AS n, count(*) OVER (PARTITION BY paper_id) AS files FROM f)
SELECT paper_id, files, concat(string_agg(path, chr(10) ORDER BY n), CASE WHEN files > 20 THEN concat(chr(10), '[TRUNCATED]') ELSE '' END) AS tree FROM k WHERE n <= 20 GROUP BY paper_id, files""")
def _(spark, d):
    path = F.concat(F.coalesce("lang", F.lit("x")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tex"))
    return t.source_tree(load(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("paper_id"), path.alias("path")), 20)


_PAPERS = "SELECT doc_id AS paper_id, concat('T', CAST(doc_id AS VARCHAR(12))) AS title, text AS source, CASE WHEN doc_id % 2 = 0 THEN lang END AS pdf_text, doc_id % 4 = 0 AS warned FROM documents"


@query("tex_paper_summary", f"""SELECT p.paper_id, title, length(coalesce(source, '')) AS source_chars, length(coalesce(pdf_text, '')) AS pdf_chars, coalesce(f.n, 0) AS figures, coalesce(g.n, 0) AS tables, CASE WHEN warned THEN 'no figures|late' ELSE '' END AS parse_warnings
FROM ({_PAPERS}) p LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) f ON f.user_id = p.paper_id LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) g ON g.user_id = p.paper_id""")
def _(spark, d):
    papers = sql(spark, d, _PAPERS).withColumn("warnings", F.when(F.col("warned"), F.lit(["no figures", "late"]))).drop("warned")
    events = load(spark, d, "events").select(F.col("user_id").alias("paper_id"), "event_type")
    return t.paper_summary(papers, events.filter("event_type = 'click'"), events.filter("event_type = 'view'")).withColumn("parse_warnings", F.array_join("parse_warnings", "|"))


_LINES_OF = "SELECT doc_id AS page_id, CAST(k AS BIGINT) AS pos, CASE k WHEN 1 THEN concat('[ArticleImage:', CAST(doc_id % 5 AS VARCHAR(4)), ']  Caption ', lang) ELSE coalesce(text, '') END AS text FROM documents, (VALUES (0), (1), (2)) v(k)"


@query("art_documents", f"""SELECT doc_id AS page_id, concat(coalesce(text, ''), chr(10), CASE WHEN doc_id % 5 < 3 THEN concat('[Figure:', CAST(doc_id % 5 + 1 AS VARCHAR), ':image-', CAST(doc_id % 5 AS VARCHAR), ']', chr(10)) ELSE '' END, 'Caption ', lang, chr(10), coalesce(text, '')) AS text FROM documents
WHERE NOT regexp_matches(coalesce(text, ''), '^[[]ArticleImage:')""")
def _(spark, d):
    lines = sql(spark, d, _LINES_OF)
    images = lines.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("n"))
    return p.marked_documents(lines, p.number_images(images))


#: Documents under a head of their method, and two figures each of which the first stands in some of them already.
_FIGURED = "SELECT doc_id, concat('# t', chr(10), '## 3. Method', chr(10), 'x', chr(10), '## 4. End', chr(10), CASE WHEN doc_id % 3 = 0 THEN '[Figure:1:overview]' ELSE '' END, coalesce(text, ''), '.') AS text FROM documents"


def _inserts(docs):
    kind = "array<struct<marker:string,asset:string,caption:string>>"
    rows = docs.select("doc_id", F.posexplode(F.from_json(F.lit('[{"marker":"[Figure:1:overview]","asset":"fig/overview.png","caption":"The whole"},{"marker":"[Figure:2:arch]","asset":"fig/arch.pdf","caption":""}]'), kind)).alias("n", "f"))
    return rows.select("doc_id", "n", "f.*", F.lit(None).cast("string").alias("description"))


_ENDS = r"'\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"


@query("fig_priority_markers", f"""SELECT doc_id, concat(regexp_replace(replace(text, concat('Method', chr(10)), concat('Method', chr(10), chr(10), CASE WHEN contains(text, '[Figure:1:overview]') THEN '' ELSE concat('{fig.PRIORITY_LEAD}', chr(10), '[Figure:1:overview]', chr(10), '**图：The whole**', chr(10), chr(10)) END, '{fig.PRIORITY_LEAD}', chr(10), '[Figure:2:arch]', chr(10), chr(10))), {_ENDS}, chr(10), 'g'), chr(10)) AS text
FROM (SELECT doc_id, concat('# t', chr(10), '## 3. Method', chr(10)) AS head, text FROM ({_FIGURED}) y) x WHERE NOT contains(substr(text, 20), concat('Method', chr(10)))""")
def _(spark, d):
    docs = sql(spark, d, _FIGURED)
    return fig.ensure_priority_markers(docs, _inserts(docs))


@query("fig_referenced_markers", f"""SELECT doc_id, CASE WHEN n >= 3 THEN text ELSE concat(regexp_replace(concat('# t', chr(10), '## 3. Method', chr(10), 'x', chr(10), chr(10), '{fig.METHOD_LEAD}', chr(10), CASE WHEN contains(text, '[Figure:1:overview]') THEN concat('[Figure:2:arch]', chr(10), '**图：arch**') ELSE concat('[Figure:1:overview]', chr(10), '**图：The whole**') END, chr(10), chr(10), substr(text, 20)), {_ENDS}, chr(10), 'g'), chr(10)) END AS text
FROM (SELECT doc_id, text, len(list_distinct(regexp_extract_all(text, '[[][A-Za-z0-9_]*Figure:[^]]+[]]'))) AS n FROM ({_FIGURED}) y) x""")
def _(spark, d):
    docs = sql(spark, d, _FIGURED)
    return fig.ensure_referenced_markers(docs, _inserts(docs))


#: A feed whose entries' summaries are the documents' whole texts.
_CLEAN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\u009f]', ' ', 'g'), '[\\s  -     　]+', ' ', 'g'))"


@query("src_feed", f"SELECT CAST(doc_id AS VARCHAR) AS id, concat('About ', coalesce(lang, '')) AS title, {_CLEAN} AS summary, 'Ann|Bob' AS authors, 'cs.LG' AS categories FROM documents")
def _(spark, d):
    docs = load(spark, d, "documents")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    title = F.concat(F.lit(" About\n  "), F.coalesce("lang", F.lit("")), F.lit(" "))
    people = F.array(*(F.struct(F.lit(x).alias("name")) for x in (" Ann", "Bob ", " ")))
    entries = docs.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), body.alias("summary"), people.alias("author"), F.array(F.struct(F.lit("cs.LG").alias("_term"))).alias("category"))
    path = scratch_path(spark, "feed")
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return p.feed_entries(spark, path).withColumns({c: F.array_join(c, "|") for c in ("authors", "categories")})
