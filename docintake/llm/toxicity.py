"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

``fit`` trains a numpy classifier over hashed words from confirmed toxic examples plus unlabelled text,
with the class-prior-corrected, non-negative risk estimator of Kiryo et al. (2017); ``score_column`` gives
the score of whole texts as a Column.

The model is a linear one over the set of distinct words of a text (not over frequencies, so one abusive
word weighs as much in a long text as in a short one), and over word beginnings that some words of a text share
(``BEGINNINGS``, ``TIERS``), for languages that inflect. Words are ASCII-lower-cased runs of letters, digits
and non-ASCII bytes, hashed to ``SLOTS`` slots; slots seen in fewer than ``MIN_DOCS`` sampled texts carry
no weight.

Bounds: at most ``MAX_POSITIVE`` toxic examples and ``MAX_UNLABELLED`` unlabelled texts are used, picked by
a hash of the key; every text is scored.

Defined cases: null and empty texts get the score of a text without words; rows of labels with null doc_id
or toxic are not used; several labels of one document count as their maximum; without any toxic example
every score is 0; repeated rows each get their score; of several texts under one id the largest is learned from;
very long texts are scored whole; a score of exactly ``THRESHOLD`` is toxic; other columns of documents are ignored
(``stage``: kept, whatever their names); empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import ASCII_LOWER, NOT_WORD, Adam, bounded_sample, crc_mod, flat, mix, pieces_of, sigmoid, span_hashes, spans, stored, table, with_texts

BITS = 18
SLOTS = 1 << BITS
MIN_DOCS = 5
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
EPOCHS, RATE, DECAY = 80, 0.02, 1e-4
LOWER = 2.5
#: Bytes of the word beginnings that are features too, and how many words of a text must share one.
BEGINNINGS, TIERS = (5, 7), (1, 2, 4)
#: Parts of the rows for setting the threshold.
FOLDS = 3


def word_slots(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owners) of the features of each value, ordered by owner: its distinct words, and the beginnings that
    one, two or four of these share."""
    raw = ASCII_LOWER[raw]
    start, end, owner = spans(raw, off, NOT_WORD)
    h = span_hashes(raw, start, end)
    whose = owner.astype(np.uint64)
    _, at = np.unique(mix(h ^ mix(whose + np.uint64(1))), return_index=True)
    start, end, whose, h = start[at], end[at], whose[at], h[at]
    out = [whose << np.uint64(BITS) | h >> np.uint64(64 - BITS)]
    for n in BEGINNINGS:
        long = end - start > n
        h, w = span_hashes(raw, start[long], start[long] + n), whose[long]
        _, first, count = np.unique(mix(h ^ mix(w + np.uint64(1))), return_index=True, return_counts=True)
        for t in TIERS:
            i = first[count >= t]
            out.append(w[i] << np.uint64(BITS) | mix(h[i] + np.uint64(8 * t + n)) >> np.uint64(64 - BITS))
    both = np.unique(np.concatenate(out))
    return (both & np.uint64(SLOTS - 1)).astype(np.int64), (both >> np.uint64(BITS)).astype(np.int64)


def packed_slots(slots: np.ndarray) -> bytes:
    """Ascending slots as compressed differences."""
    return zlib.compress(np.diff(slots, prepend=0).astype("<u4").tobytes(), 1)


def unpacked_slots(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int32)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n`` and ``slots`` (their number, and ``packed_slots``) in place of the text."""
    keep = [c for c in df.columns if c != text]
    src = df.select(*keep, F.col(text).alias("text"))

    def run(batches):
        for whole in batches:
            for b in pieces_of(whole, "text"):
                slot, owner = word_slots(*flat(b.column("text")))
                cut = np.searchsorted(owner, np.arange(b.num_rows + 1))
                data = [packed_slots(slot[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(np.diff(cut), pa.int32()), pa.array(data, pa.binary())], [*keep, "n", "slots"])

    return src.mapInArrow(run, ", ".join(f"{k} {src.schema[k].dataType.simpleString()}" for k in keep) + ", n int, slots binary")


@dataclass
class Model:
    """``weight`` by slot, ``bias``, and the class prior that the risk estimator used."""

    weight: np.ndarray
    bias: float
    prior: float


class Rows:
    """Sets of slots on end: ``slot``, and ``length`` of each row. Few large arrays, which go back to the system."""

    def __init__(self, slot: np.ndarray, length: np.ndarray):
        self.slot, self.length = slot, length

    @classmethod
    def of(cls, rows: Rows | list[np.ndarray]) -> Rows:
        if isinstance(rows, Rows):
            return rows
        return cls(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.array([len(r) for r in rows], np.int64))

    def __len__(self) -> int:
        return len(self.length)

    def part(self, use: np.ndarray) -> Rows:
        """The rows for which ``use`` holds."""
        return Rows(self.slot[np.repeat(use, self.length)], self.length[use])

    def known(self, index: np.ndarray) -> Rows:
        """The slots by ``index``, those of -1 left out."""
        slot = index[self.slot]
        keep = slot >= 0
        row = np.repeat(np.arange(len(self), dtype=np.int32), self.length)
        return Rows(slot[keep], np.bincount(row[keep], minlength=len(self)))

    def sums(self, weight: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(self), weight.dtype), np.flatnonzero(self.length)
        if len(some):
            out[some] = np.add.reduceat(weight[self.slot], (np.cumsum(self.length) - self.length)[some])
        return out


class _Sparse:
    """Binary sparse rows: sums of weights by row, and the transpose."""

    def __init__(self, rows: Rows | list[np.ndarray], slots: int):
        rows = Rows.of(rows)
        self.n, self.slots, self.slot, length = len(rows), slots, rows.slot, rows.length
        self.some = np.flatnonzero(length)
        self.at = (np.cumsum(length) - length)[self.some]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), length)[np.argsort(self.slot, kind="stable")]
        times = np.bincount(self.slot, minlength=slots)
        self.used = np.flatnonzero(times)
        self.begin = (np.cumsum(times) - times)[self.used]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, w.dtype)
        if len(self.some):
            out[self.some] = np.add.reduceat(w[self.slot], self.at)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.slots, g.dtype)
        if len(self.used):
            out[self.used] = np.add.reduceat(g[self.row], self.begin)
        return out


def risk(p: _Sparse, u: _Sparse, weight: np.ndarray, bias: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """prior * E_p[l(f)] and E_u[l(-f)] - prior * E_p[l(-f)] for the sigmoid loss l(z) = sigmoid(-z), and the step's
    gradient: of both together, or, where the second is negative, of minus the second alone."""
    sp, su = sigmoid(p.dot(weight) + bias), sigmoid(u.dot(weight) + bias)
    first, second = prior * (1 - sp).mean(), su.mean() - prior * sp.mean()
    gp = sp * (1 - sp) * (prior if second < 0 else -2 * prior) / p.n
    gu = su * (1 - su) * (-1 if second < 0 else 1) / u.n
    return first, second, p.back(gp) + u.back(gu), float(gp.sum() + gu.sum())


def threshold(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The highest cut with the least estimated error, prior * misses + max(0, unlabelled above - prior * hits), of
    the scores of rows that the fit did not see."""
    every = np.unique(np.concatenate([p, u]))
    cut = np.append((every[1:] + every[:-1]) / 2, every[-1])
    miss = np.searchsorted(np.sort(p), cut) / len(p)
    above = 1 - np.searchsorted(np.sort(u), cut) / len(u)
    error = prior * miss + np.maximum(0, above - prior * (1 - miss))
    return float(cut[error <= error.min() + 1e-12].max())


def descend(positive: Rows, unlabelled: Rows, prior: float, epochs: int) -> np.ndarray:
    """Weights by slot that minimise prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the
    sigmoid loss; where the second part is negative its gradient is reversed, as nnPU does."""
    dp, du = (np.bincount(x.slot, minlength=SLOTS) for x in (positive, unlabelled))
    known = np.flatnonzero(dp + du >= MIN_DOCS)
    index = np.full(SLOTS, -1, np.int32)
    index[known] = np.arange(len(known))
    p, u = (_Sparse(rows.known(index), len(known)) for rows in (positive, unlabelled))
    # Weights begin at the log-odds between the two samples less LOWER standard errors, where these are positive: the
    # loss isn't convex. They stay at 0 or more: words are evidence of toxicity or none, and length is none against it.
    odds = np.log((dp + 0.5) / (p.n + 1)) - np.log((du + 0.5) / (u.n + 1))
    odds = np.maximum(odds - LOWER * np.sqrt(1 / (dp + 0.5) + 1 / (du + 0.5)), 0)
    par = {"w": odds[known].astype(np.float32), "b": np.full(1, -1.0, np.float32)}
    opt = Adam(par, RATE)
    for _ in range(epochs):
        _, _, g, gb = risk(p, u, par["w"], par["b"][0], prior)
        opt.step({"w": g + DECAY * par["w"], "b": np.array([gb], np.float32)})
        np.maximum(par["w"], 0, out=par["w"])
    weight = np.zeros(SLOTS, np.float32)
    weight[known] = par["w"]
    return weight


def train(positive: Rows | list[np.ndarray], unlabelled: Rows | list[np.ndarray], prior: float, epochs: int = EPOCHS) -> Model:
    """``descend`` on all rows; the bias is set by the same risk of the zero-one loss, on scores that each part of the
    rows gets from the others (``FOLDS`` parts)."""
    both = Rows.of(positive), Rows.of(unlabelled)
    if not all(map(len, both)):
        return Model(np.zeros(SLOTS, np.float32), -50.0, prior)
    prior = min(max(prior, 1e-4), 0.9999)
    weight = descend(*both, prior, epochs)
    scores = [np.zeros(len(rows), np.float32) for rows in both]
    for f in range(FOLDS):
        out = [np.arange(len(rows)) % FOLDS == f for rows in both]
        w = descend(*(rows.part(~x) if len(rows) > FOLDS else rows for rows, x in zip(both, out, strict=True)), prior, epochs)
        for score, rows, x in zip(scores, both, out, strict=True):
            score[x] = rows.part(x).sums(w)
    return Model(weight, -threshold(*scores, prior), prior)


def fit(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None) -> Model:
    """Learn from rows for which ``use`` (an expression over ``key``) holds. ``prior``: the class prior;
    by default the toxic share of the usable labels."""
    known = labels.filter(use & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    if prior is None:
        prior = float(known.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0)
    toxic = bounded_sample(known.filter("y = 1").select(key), key, MAX_POSITIVE).select(key, F.lit(1).alias("y"))
    plain = bounded_sample(docs.filter(use & F.col(key).isNotNull()).select(key), key, MAX_UNLABELLED).select(key, F.lit(0).alias("y"))
    rows = stored(features(with_texts(toxic.unionByName(plain), docs, key, text).select("y", text), text), "pu").toArrow()  # bounded by the two limits
    packed = rows.column("slots").combine_chunks()
    order = sorted(range(len(packed)), key=lambda i: packed[i].as_buffer().to_pybytes())  # it decides who is in which part
    y, n = (rows.column(c).to_numpy() for c in ("y", "n"))
    sets = {}
    for k in (0, 1):
        own = [i for i in order if y[i] == k]
        end = np.cumsum(n[own], dtype=np.int64)
        slot = np.empty(int(end[-1]) if own else 0, np.int32)
        for i, e in zip(own, end.tolist(), strict=True):
            slot[e - n[i] : e] = unpacked_slots(packed[i].as_buffer())
        sets[k] = Rows(slot, n[own].astype(np.int64))
    return train(sets[1], sets[0], prior)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    raw, off = flat(texts)
    slot, owner = word_slots(raw, off)
    return sigmoid(np.bincount(owner, model.weight[slot], len(off) - 1) + model.bias)


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([x], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(score_texts(shared.value, b.column(0)) for b in pieces_of(batch, "text"))]))

    return score(text)


THRESHOLD = 0.5


def learnable(key: str = "doc_id") -> Column:
    return crc_mod(F.col(key), 5) != 0


def production(spark: SparkSession, sf_dir: str) -> Model:
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = production(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier calls toxic go; the columns stay as they are."""
    return docs.filter(score_column(spark, production(spark, sf_dir), F.col("text")) < THRESHOLD)
