"""Findings of round 3: odd rows beside their SQL, and steps whose cost must not outgrow their input."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docintake.functions import text as text_
from docintake.functions.batches import exploded
from docintake.operators import figures as fig
from docintake.operators import messages as m
from docintake.operators import pages as pages_
from docintake.operators import repos
from tools.compare import compare, connect


def agrees(spark, tmp_path, name, **tables):
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return compare(spark, connect(str(tmp_path)), str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name])


def test_a_marker_goes_into_a_text_of_many_lines(spark):
    """A head was looked for again at every line."""
    docs = spark.createDataFrame([(1, "# t\n## 3. Method\nx\n" + "line\n" * 60_000 + "## 4. End\ny")], "doc_id bigint, text string")
    inserts = spark.createDataFrame([(1, 0, "[Figure:1:overview]", "fig/overview.png", "The whole", None)], "doc_id bigint, n int, marker string, asset string, caption string, description string")
    start = time.time()
    got = fig.ensure_referenced_markers(docs, inserts).first().text.split("\n")
    assert time.time() - start < 60
    assert got[60_003:60_008] == ["", fig.METHOD_LEAD, "[Figure:1:overview]", "**图：The whole**", ""]
    assert got[60_008] == "## 4. End"


@pytest.mark.parametrize("name", ["art_blocks", "art_titles"])
def test_unfinished_references(spark, tmp_path, name):
    pages = spark.createDataFrame([(1, "https://a.example/x", "<head><title>a&amp</title></head><p>b &am; &lt c &amp;lt; d &copy</p>")], "page_id bigint, url string, html string")
    assert agrees(spark, tmp_path, name, pages=pages) == ""


def test_a_name_within_a_word_is_none(spark):
    said = ["la esrabota", "Bot2 x", "robot", "你好bot在吗", "Bot!", "the bot"]
    rows = spark.createDataFrame([(x,) for x in said], "c string").select(m.asks_help(F.col("c"))).collect()
    assert [r[0] for r in rows] == [False, False, False, True, True, True]


@pytest.mark.parametrize(("name", "texts"), [("art_rendered", ["... 12", "", "a b"]), ("qg_structure_guard", ["a", "", "long " * 300])])
def test_short_texts(spark, tmp_path, name, texts):
    docs = spark.createDataFrame([(6 + 12 * i, x, "en", "web") for i, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    assert agrees(spark, tmp_path, name, documents=docs) == ""


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_captions_that_name_a_stem(spark):
    """Against a plain loop; assets and captions of a document aren't compared each with each."""
    asked = [(d, x) for d in (1, 2) for x in ("a/b.png", "Fig.png", "fig1.png", "schaltplan_a.png", "none.png", "ü.svg", "x" * 40 + ".png")]
    said = [(1, "x/q.png", "See Schaltplan_A, fig1", 4), (1, "x/r.png", "the fig12", 3), (1, "x/s.png", None, 1), (1, "x/t.png", "Über b", 2), (2, "x/u.png", "x" * 41, 1), (2, "x/v.png", "", 0)]
    got = fig.caption_lookup(spark.createDataFrame(asked, "doc_id bigint, asset string"), spark.createDataFrame(said, "doc_id bigint, asset string, caption string, pos bigint"))
    stem = lambda a: a.lower().split("/")[-1].rsplit(".", 1)[0]
    want = {(d, a): next((c for e, _, c, _ in sorted(said, key=lambda r: r[3]) if e == d and c is not None and stem(a) in c.lower()), None) for d, a in asked}
    assert {(r.doc_id, r.asset): r.caption for r in got.collect()} == want
    assert "Contains(" not in plan_of(got)


def test_snapshots_find_the_best_block(spark):
    """Against a plain loop over all pairs, with words of few and of many blocks; none are compared as texts."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"], k=6) + rng.choices([f"w{i}" for i in range(60)], k=rng.randint(0, 3)))
    blocks = [(1, s, i, text() if i % 9 else "alpha beta gamma delta eps") for s in (0, 1) for i in range(300)]
    snaps = [(1, s, i, text() if i % 5 else blocks[i][3][1:-1] + "") for s in (0, 1) for i in range(120)]
    got = pages_.anchor_snapshots(spark.createDataFrame(snaps, "page_id bigint, section bigint, snap bigint, needle string"), spark.createDataFrame(blocks, "page_id bigint, section bigint, pos bigint, text string"))
    want = {}
    for _, s, n, needle in snaps:
        a, best = set(needle.split()), None
        for _, t, pos, x in blocks:
            b = set(x.split())
            held = needle in x or len(x) >= 24 and x in needle
            score = 2.0 if held else len(a & b) / min(len(a), len(b))
            if s == t and len(needle) >= 24 and score >= 0.72 and (best is None or (score, -pos) > (best[0], -best[1])):
                best = (score, pos)
        if best:
            want[s, n] = best
    assert {(r.section, r.snap): (r.score, r.pos) for r in got.collect()} == want
    assert len({x for x, _ in want.values()}) > 2
    assert "Contains(" not in plan_of(got)


def test_a_suffix_is_cut_once(spark, sf_dir):
    """Each rule of completeness cut the suffix anew."""
    plan = plan_of(entry.queries()["qg_last_complete"](spark, sf_dir))
    assert plan.count("split(") == 1


def test_python_holds_pieces_only():
    """A batch of many rows was one list, and what it gave one frame."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(3000)), "t": ["ab" * 500] * 2999 + ["c" * 900_000]})
    out = list(exploded(lambda k, t: ((k, t), (k, None)), "k bigint, t string", 1 << 16)(iter([batch])))
    assert [r for b in out for r in b.column(0).to_pylist()] == [k for k in range(3000) for _ in (0, 1)]
    assert [b.column(1)[0].as_py() for b in out[:1]] == ["ab" * 500]
    assert max(b.nbytes for b in out[:-2]) < 1 << 17
    assert list(exploded(lambda k, t: (), "k bigint, t string")(iter([batch]))) == []


def test_names_are_looked_for_in_one_text(spark):
    """Path, label and caption were lower-cased anew for each name."""
    rows = spark.createDataFrame([("a/Teaser.png", "l", "c"), ("a/x.png", "Fig:WARMUP", "introfig"), ("a/z.png", "l", "")], "p string, l string, c string")
    rank = fig.figure_rank(F.col("p"), F.col("l"), F.lit(""), F.col("c"), F.lit(None).cast("int"))
    got = rows.select(rank.alias("r"))
    assert [r.r for r in got.collect()] == [3, 2, 60]
    assert plan_of(got).count("x_") < 60


def test_braces_of_a_long_text_are_counted_fast(spark):
    """Each character without a brace was a match of its own."""
    start = time.time()
    docs = spark.range(400).select(F.concat(F.repeat(F.concat(F.lit("plain words "), F.col("id").cast("string")), 9000), F.lit(r" \a{b{c}}")).alias("t"))
    assert docs.select(F.max(text_.brace_height(F.col("t")))).first()[0] == 2
    assert time.time() - start < 20


def test_documents_texts_are_not_shuffled_for_their_pages(spark):
    docs = spark.createDataFrame([(1, "project page: https://a.github.io/x")], "doc_id bigint, text string")
    pages = spark.createDataFrame([(1, "https://a.github.io/x", "<a href='https://github.com/a/b'>Code</a>")], "page_id bigint, url string, html string")
    got = repos.repositories(docs, pages)
    assert [tuple(r) for r in got.collect()] == [(1, "https://github.com/a/b")]
    assert not re.search(r"Join LeftAnti.*\n[^\n]*Project \[doc_id#\d+L?, text", plan_of(got))
