"""Periodic runs of words: every maximal stretch in which words repeat with a period, four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
``max(6, 4 * q)`` words, which no neighbouring word extends with period q.

Texts are taken in pieces of about 1 MB, whose words become exact numbers (Arrow's dictionary), with a number of its
own between two texts, so that no match reaches across:

1. Harmonic grid: a run with period q has at least 3q places whose word equals the one q further on, so one of the
   places 0, 2q, 4q, ... lies in it together with the q that follow. A few of these equalities are compared for all
   places of one q at once; over all q that is n log n steps.
2. What is left is extended to both sides by longest common extensions (``Extensions``): only suffixes at places of a
   difference cover modulo 13 are sorted (by doubling), neighbours' common prefixes go into a sparse table, and
   a query compares at most 12 words, up to where both places are sampled, before it takes a range minimum. The sort
   is over those texts of a piece that have such places at all, once forwards and once backwards.
3. A stretch that is found with several periods has the smallest of them.

Defined cases: null, empty and blank texts have no words and no runs; a text is never cut: a very long one is a piece by
itself, with some 60 bytes of arrays a word, and its places are extended ``MANY`` at a time; repeated rows, and rows
without id, are rows of their own; runs with one start and different periods are all given; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import WHITE, flat, pieces_of, spans, table

TIMES, LEAST = 4, 6
#: A difference cover: any two residues modulo V become members when the same number below V is added to both.
V, COVER = 13, (0, 1, 3, 9)
#: Places that are extended at once.
MANY = 1 << 18

_AT = np.full(V, -1, np.int64)
_AT[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([[next(k for k in range(V) if _AT[(a + k) % V] >= 0 and _AT[(b + k) % V] >= 0) for b in range(V)] for a in range(V)])


class Extensions:
    """Longest common extensions of places of ``w``, which must hold numbers that occur once wherever an extension has
    to end, and one of them last."""

    def __init__(self, w: np.ndarray):
        self.n, self.w = len(w), np.concatenate([w, np.zeros(V, w.dtype)])
        places = (np.arange(0, self.n, V)[:, None] + np.array(COVER)).reshape(-1)
        places = places[places < self.n]
        levels = [self._blocks(places)]
        step = len(COVER)
        while levels[-1].max() + 1 < len(places):
            r = levels[-1]
            follow = np.zeros(len(r), np.int64)
            follow[:-step] = r[step:] + 1
            levels.append(np.unique(r * (len(r) + 1) + follow, return_inverse=True)[1])
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        self.table = [self._neighbours(order, places, levels)]
        while (h := 1 << len(self.table) - 1) < len(self.table[-1]):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-h], t[h:]))

    def _blocks(self, places: np.ndarray) -> np.ndarray:
        """Ranks of the V words that begin at each place."""
        bits = max(1, int(self.w.max()).bit_length())
        at_once = max(1, 62 // bits)
        keys = []
        for a in range(0, V, at_once):
            k = np.zeros(len(places), np.int64)
            for j in range(a, min(V, a + at_once)):
                k = (k << bits) | self.w[places + j]
            keys.append(k)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        out = np.empty(len(places), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _neighbours(self, order: np.ndarray, places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of sampled suffixes that follow each other: whole blocks by the levels' ranks, then words."""
        a, b = order[:-1].copy(), order[1:].copy()
        for t in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[t][a] == levels[t][b])
            a[same] += len(COVER) << t
            b[same] += len(COVER) << t
        size = places[a] - places[order[:-1]]
        more, k = np.arange(len(a)), 0
        while len(more):
            more = more[self.w[places[a[more]] + k] == self.w[places[b[more]] + k]]
            size[more] += 1
            k += 1
        return size

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on (never one place)."""
        need = _SHIFT[i % V, j % V]
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        sampled = [live[need == 0]]
        live = live[need > 0]
        for k in range(V - 1):
            live = live[self.w[i[live] + k] == self.w[j[live] + k]]
            if not len(live):
                break
            sampled.append(live[need[live] == k + 1])
            out[live] = k + 1
            live = live[need[live] > k + 1]
        s = np.concatenate(sampled)
        if len(s):
            x, y = (self.rank[(p // V) * len(COVER) + _AT[p % V]] for p in (i[s] + need[s], j[s] + need[s]))
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((hi - lo).astype(float))[1] - 1
            for t in np.unique(level):
                at = np.flatnonzero(level == t)
                m = self.table[t]
                out[s[at]] += np.minimum(m[lo[at]], m[hi[at] - (1 << int(t))])
        return out


def grid(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid places that may lie in a run; ``longest``: words of the longest text."""
    places, periods = [], []
    for q in range(1, longest // TIMES + 1):
        hit = np.flatnonzero(w[: -q : 2 * q] == w[q :: 2 * q]) * (2 * q)
        if len(hit):
            hit = hit[hit + 2 * q < len(w)]
            for k in dict.fromkeys((q, q // 2, q // 4, 3 * q // 4, q // 8)):
                hit = hit[w[hit + k] == w[hit + q + k]]
            if len(hit):
                places.append(hit)
                periods.append(np.full(len(hit), q))
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *places]), np.concatenate([z, *periods])


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period), sorted, those with the smallest period of their stretch."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def runs_of(w: np.ndarray, places: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs that hold the places; ``w`` begins and ends with unique numbers."""
    n, found = len(w), np.zeros((0, 3), np.int64)
    parts = [(places[k : k + MANY], periods[k : k + MANY]) for k in range(0, len(places), MANY)]
    forth = Extensions(w)
    ahead = [forth.query(g, g + q) for g, q in parts]
    del forth  # its tables, before those of the other direction
    back = Extensions(w[::-1])
    for (g, q), f in zip(parts, ahead, strict=True):
        start = g - back.query(n - g, n - g - q)
        end = g + f + q
        ok = end - start >= np.maximum(LEAST, TIMES * q)
        found = smallest_periods(np.concatenate([found, np.stack([start, end, q], axis=1)[ok]]))
    return found


def piece_runs(words: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Rows (text, start, end, period) for words as numbers; ``owner``: the text of each, ascending."""
    if not len(words):
        return np.zeros((0, 4), np.int64)
    base = int(words.max()) + 1

    def joined(words, owner, texts):
        """All texts on end, each before a number of its own, after one such number; where each text begins."""
        count = np.bincount(owner, minlength=texts)
        begin = np.concatenate([[0], np.cumsum(count + 1)]) + 1
        w = base + np.arange(begin[-1])
        w[np.arange(len(words)) + owner + 1] = words
        return w, begin, count

    w, begin, count = joined(words, owner, texts)
    places, periods = grid(w, int(count.max()))
    if not len(places):
        return np.zeros((0, 4), np.int64)
    # the texts that have such places, alone
    text = np.searchsorted(begin, places, side="right") - 1
    kept = np.unique(text)
    held = np.isin(owner, kept)
    some, new, _ = joined(words[held], np.searchsorted(kept, owner[held]), len(kept))
    at = np.searchsorted(kept, text)
    some = np.unique(some, return_inverse=True)[1]
    found = runs_of(some, places - begin[text] + new[at], periods)
    t = np.searchsorted(new, found[:, 0], side="right") - 1
    return np.stack([kept[t], found[:, 0] - new[t], found[:, 1] - new[t], found[:, 2]], axis=1)


KIND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, ``runs`` by start and period, and ``collapsed``: the words joined by single spaces, without those
    that a run contains after its first period."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def piece(b):
        raw, off = flat(b.column("text"))
        start, end, owner = spans(raw, off, WHITE)
        size = end - start
        edges = np.concatenate([[0], np.cumsum(size)])
        letters = raw[~WHITE[raw]]  # the words' bytes on end
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(letters)])
        numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        found = piece_runs(numbers, owner, b.num_rows)
        count = np.bincount(owner, minlength=b.num_rows)
        first = np.concatenate([[0], np.cumsum(count)])
        cover = np.zeros(len(size) + 1, np.int64)
        np.add.at(cover, first[found[:, 0]] + found[:, 1] + found[:, 3], 1)
        np.add.at(cover, first[found[:, 0]] + found[:, 2], -1)
        keep = np.cumsum(cover[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=b.num_rows))])
        lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)).cast(pa.large_string()).cast(pa.string()))
        runs = np.searchsorted(found[:, 0], np.arange(b.num_rows + 1))
        fields = pa.StructArray.from_arrays([pa.array(found[:, 1]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 3])], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([b.column("key"), pa.array(count), pa.ListArray.from_arrays(pa.array(runs, pa.int32()), fields), pc.binary_join(lists, " ")], ["key", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            yield from map(piece, pieces_of(b, "text"))

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words bigint, runs {KIND}, collapsed string").withColumnRenamed("key", key)


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, where texts whose key's crc32 is divisible by ten end in a repetition of some of their own words
    (the words then stand one space apart)."""
    t, h = F.col(text).cast("string"), F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(t, r"[ \t-\r]+"), lambda x: x != "")
    rows = df.select(F.col(key).alias("key"), t.alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("bigint")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    new = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("w", at(i).cast("int"))), " ")
    return rows.select(F.col("key").alias(key), F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    got = got.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    milli = ((1000 * length - (1000 * length) % period) / period).cast("bigint")
    return got.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
