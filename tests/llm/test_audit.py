"""Filter interaction audit: against SQL, brute force on odd inputs, and the sketch by itself."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docintake.llm import audit
from tools.compare import compare, connect

GOOD = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, GOOD, "a"),
    (2, GOOD, "a"),
    (2, GOOD, "a"),
    (None, GOOD, "a"),
    (3, None, None),
    (4, "", ""),
    (5, " \t\n", "b"),
    (6, "AB $", "b"),
    (7, "x " * 60, "b"),
    (8, GOOD + "\u00a0É", "b"),
    (9, GOOD.upper(), "b"),
    (10, "word " * 60_000, "c"),
    (11, "word " * 60_000, "a"),
    (0, GOOD, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (7, 1, None), (99, 1, 1), (None, 1, 1), (10, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in ROWS], "doc_id bigint, text string, source string, bits int, hash string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def plain(rows, labels):
    def words(t):
        for c in "\t\n\v\f\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    docs = []
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        own = [x for x in labels if i is not None and x[0] == i]
        docs.append((s or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shap = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                live = [d for d in mine if not any(d[1][x] for x in order[:k])]
                gone = [d for d in live if d[1][c]]
                redundant = sum(d[1][c] for d in mine) - len(gone)
                alone = sum(d[1][c] and sum(d[1].values()) == 1 for d in mine)
                out[part, order, k + 1] = [len(live) - len(gone), len(gone), redundant, alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shap[c] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shap[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_counts_are_those_of_brute_force(docs, labels):
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == plain(ROWS, LABELS)


def test_no_labels_and_empty_tables(docs, labels):
    assert sorted(tuple(r) for r in audit.audit(docs).collect()) == plain(ROWS, [])
    assert audit.audit(docs.filter(F.lit(False)), labels).count() == 0
    assert sorted(tuple(r) for r in audit.audit(docs, labels.filter(F.lit(False))).collect()) == plain(ROWS, [])


def test_query_gives_what_sql_gives(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op12", audit.query, audit.SQL) == ""


@pytest.mark.parametrize("slots", [1 << 14, 1 << 16])
def test_sketch_clears_unique_texts_only(spark, slots):
    n = 3000
    df = spark.range(n).select(F.xxhash64("id").alias("hash"))
    twice = df.limit(50).unionByName(df).repartition(7)
    bits = audit.sketch(twice, slots)
    h = np.array([r[0] for r in df.collect()])
    maybe = audit.may_repeat(h, bits)
    again = np.array([r[0] for r in twice.groupBy("hash").count().filter("count > 1").collect()])
    assert maybe[np.isin(h, again)].all() and len(again) == 50
    if slots == 1 << 16:
        assert maybe.sum() < 0.1 * n
    at = audit.probes(h, slots)
    count = np.zeros(slots, int)
    for row in np.concatenate([at, audit.probes(again, slots)]):
        count[list(set(row.tolist()))] += 1
    assert (np.unpackbits(bits).astype(bool) == (count > 1)).all()


def test_a_full_sketch_gives_the_same(docs, labels, monkeypatch):
    monkeypatch.setattr(audit, "slots_for", lambda n: audit.CHUNKS * 8)
    monkeypatch.setattr(audit, "may_repeat", lambda h, bits: np.ones(len(h), bool))
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == plain(ROWS, LABELS)


def test_matrices_add_up():
    names, m = audit.matrices()
    assert len(names) == 5 * math.factorial(5)
    first = np.array([s == 1 for _, s in names])
    assert (m["redundant"][first] == 0).all() and (m["shapley"].reshape(120, 5, 32).sum(axis=1) == 120 * (np.arange(32) > 0)).all()


def test_slots_are_bounded():
    assert audit.slots_for(10**12) == audit.MAX_SLOTS and audit.slots_for(0) == audit.CHUNKS * 64
