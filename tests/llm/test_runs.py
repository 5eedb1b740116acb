"""Periodic runs: against plain loops on random and odd texts, and the extensions by themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docintake.llm import runs

LONG = " ".join(f"a{i % 977} b{i % 7}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a", "ä\u00a0b ä\u00a0b " * 5, "la " * 5000 + "end", LONG, "a b a b a b a b a b c c c c c c c", "same one", "same one"]


def plain(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted((s, q, e - s) for (s, e), q in best.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(w, found):
    drop = {i for s, q, n in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", "r") for i, t in enumerate(TEXTS)] + [(None, "b " * 9, 1, "k", "r"), (3, "a", 1, "k", "r")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, key string, runs string")


def test_runs_are_those_of_plain_loops(docs):
    got = sorted(repr((r["doc_id"], r["n_words"], [(x["start"], x["period"], x["length"]) for x in r["runs"]], r["collapsed"])) for r in runs.periodic_runs(docs).collect())
    want = []
    for i, t in [*enumerate(TEXTS), (None, "b " * 9), (3, "a")]:
        w = words_of(t)
        found = plain(w) if i != 10 else [r for r in plain_long(w)]
        want.append(repr((i, len(w), found, collapsed(w, found))))
    assert got == sorted(want)


def plain_long(w):
    """As ``plain``, with numpy for one period."""
    a = np.unique(w, return_inverse=True)[1]
    best = {}
    for q in range(1, len(a) // 4 + 1):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e + q - s >= max(6, 4 * q):
                best.setdefault((s, e + q), q)
    return sorted((s, q, e - s) for (s, e), q in best.items())


def test_many_small_texts_in_a_piece():
    r = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(1, 6)):
            w = [r.randrange(k) for k in [r.choice([1, 2, 3, 30])] for _ in range(r.randint(0, 120))]
            for _ in range(r.randint(0, 3)):
                if len(w) > 8:
                    a = r.randrange(len(w))
                    p = r.randint(1, max(1, (len(w) - a) // 3))
                    for i in range(a, a + r.randint(1, len(w) - a)):
                        w[i] = w[a + (i - a) % p]
            docs.append(w)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = runs.piece_runs(np.array([x for d in docs for x in d], np.int64), owner, len(docs)).tolist()
        assert got == [[t, s, s + n, q] for t, d in enumerate(docs) for s, q, n in plain(d)]


def test_places_are_extended_in_parts(monkeypatch):
    w = np.array([0, 1] * 40 + [2] * 50 + list(range(3, 30)) * 5)
    want = runs.piece_runs(w, np.zeros(len(w), np.int64), 1).tolist()
    monkeypatch.setattr(runs, "MANY", 7)
    assert runs.piece_runs(w, np.zeros(len(w), np.int64), 1).tolist() == want
    assert want == [[0, s, s + n, q] for s, q, n in plain(w.tolist())]


def test_extensions_are_common_prefixes():
    r = np.random.default_rng(2)
    for n, k in ((1, 1), (12, 1), (40, 2), (400, 2), (400, 1)):
        w = np.append(r.integers(0, k, n), k)
        e = runs.Extensions(w)
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
        i, j = i[i != j], j[i != j]

        def common(a, b):
            m = 0
            while max(a, b) + m <= n and w[a + m] == w[b + m]:
                m += 1
            return m

        assert e.query(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_difference_cover():
    assert {(a - b) % runs.V for a in runs.COVER for b in runs.COVER} == set(range(runs.V))


def test_query_on_planted_repetitions(spark, docs, tmp_path):
    rows = [(i, " ".join(random.Random(i).choice(["a", "b", "c"]) for _ in range(i % 90)), "en", "s", 1) for i in range(400)] + [(5000, None, "en", "s", 1), (None, "a b c", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in runs.query(spark, str(tmp_path)).filter("doc_id is not null").collect())
    want = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in rows[:-1]:
        w, h = words_of(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = plain(w)
        best = max(((n, -s, -q) for s, q, n in found), default=None)
        first = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
        want.append((i, len(found), *first, sha("".join(f"{s},{n},{q}\n" for s, q, n in found)), sha(collapsed(w, found))))
    assert got == sorted(want) and any(x[1] for x in want)


def test_empty_table(docs):
    assert runs.periodic_runs(docs.filter(F.lit(False))).count() == 0
