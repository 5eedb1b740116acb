"""Findings of round 4: no image, label or reference is left out, however many there are."""

from __future__ import annotations

import re
import time

import __spark_entry__ as entry
from docintake.operators import tex


def test_all_images_of_a_page_get_a_placeholder(spark, tmp_path):
    """Those behind the 32nd were given as captions alone."""
    html = lambda n: "<p>ab</p>" + "".join(f'<img src="/{i}.png" alt="c{i}">' for i in range(1, n + 1))
    pages = spark.createDataFrame([(k, "https://h.example/x", html(n)) for k, n in ((1, 200), (2, 32), (3, 0))], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.pos): r.text for r in entry.queries()["art_images"](spark, str(tmp_path)).collect()}
    assert got == {(k, i): f"[Figure:{i}:image-{i}]\nc{i}" if i else "ab" for k, n in ((1, 200), (2, 32), (3, 0)) for i in range(n + 1)}


def contexts(spark, source, labels):
    docs = spark.createDataFrame([("p", source)], "paper_id string, source string")
    got = tex.reference_contexts(docs, spark.createDataFrame([("p", x) for x in labels], "paper_id string, label string")).collect()
    assert len({r.label for r in got}) == len(got)
    return {r.label: r.context for r in got}


def test_all_labels_and_references_have_their_passages(spark):
    """Labels behind the 40th had none, and references behind the second; passages ended at the next reference to the
    same label. Against a plain loop."""
    labels = [f"fig:{i}" for i in range(100)] + ["a.b", "a+b", r"x\E y", "ü", "", "none", "e}f"]
    said = "".join(f"Wörter\u2003 {i}\n\t\\{c}{{{labels[i * 7 % 104]}}} then\x1c \\ref{{a_b}} " for i in range(400) for c in ("ref", "autoref", "cref", "Cref")) + r"\ref{e}f} \ref{} \eqref{none} \ref{none"
    want = {}
    for x in filter(None, labels):
        spans = [m.span() for m in re.finditer(r"\\(?:ref|autoref|cref|Cref)\{" + re.escape(x) + r"\}", said)]
        if spans:
            want[x] = " || ".join(re.sub("[\t\n \u2003]+", " ", said[max(a - 220, 0) : a] + "[ref]" + said[b : b + 260]).strip(" ") for a, b in spans)
    assert len(want) == 105
    assert contexts(spark, said, [*labels, labels[0], None]) == want


def test_a_source_is_read_once_for_all_its_labels(spark):
    """It was cut anew, and copied, for each label."""
    names, start = [f"l{i}" for i in range(8000)], time.time()
    got = contexts(spark, "".join(f"{x} \\ref{{{x}}} " + "word " * 20 for x in names), names)
    assert len(got) == 8000 and got["l7999"].split("[ref]")[0].endswith("l7999 ")
    assert time.time() - start < 30
