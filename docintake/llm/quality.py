"""Quality by attention-based multiple-instance learning.

A text is a bag of passages (``PASSAGE`` white-space words each, the whole text). Every passage is encoded
(byte histogram and word figures, then a learned dense layer), gated attention (Ilse et al., 2018) learned
from document labels weighs the passages, and the weighted passage representation is scored.

``fit`` learns from a bounded sample of labelled rows (``MAX_LABELLED`` rows and ``MAX_PASSAGES`` passages, picked by
a hash of the key; texts of more than ``MAX_BAG`` passages are left out); ``score_column`` scores every whole text.

Defined cases: null and empty texts are one empty passage and get that passage's score; rows of labels with
null doc_id or quality are not used; several labels of one document count as their minimum; without labels
every score is 0.5; repeated rows each get their score; of several texts under one id the largest is learned from;
very long texts are scored whole; a score of exactly ``THRESHOLD`` counts as good; other columns of documents are
ignored (``stage``: kept, whatever their names); empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docintake.llm.common import ASCII_LOWER, WHITE, Adam, bounded_sample, crc_mod, flat, pieces_of, sigmoid, span_hashes, spans, stored, table, with_texts

PASSAGE = 64
HIST = 160
INPUTS = HIST + 6
HIDDEN, GATE = 32, 16
MAX_LABELLED = 8000
#: Passages that are learned from, in all and of one text: longer texts are scored but not learned from.
MAX_PASSAGES, MAX_BAG = 200_000, 2_000
#: Passes over the sample (more where it is small, so that there are STEPS steps at least).
EPOCHS, STEPS, BATCH, RATE = 14, 1200, 128, 0.004
#: Bytes below 128 have a cell each; others share 32 by their upper bits.
CELL = np.concatenate([np.arange(128), 128 + (np.arange(128) >> 2)])


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, first passage of each value and the end); every value has at least one."""
    n = len(off) - 1
    start, end, owner = spans(raw, off, WHITE)
    words = np.bincount(owner, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(words)])
    count = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    place = np.arange(len(start)) - first_word[owner]
    of = first[owner] + place // PASSAGE  # the passage of each word
    # The passage of each byte: it begins with the passage's first word; bytes before a text's first word go with it.
    begins = np.zeros(len(raw) + 1, np.int64)
    np.add.at(begins, start[(place % PASSAGE == 0) & (place > 0)], 1)
    bounds = np.bincount(off[1:-1], minlength=len(raw) + 1) if n > 1 else 0
    of_byte = np.cumsum(begins + bounds)[: len(raw)] if len(raw) else np.zeros(0, np.int64)
    if n > 1 and len(raw):  # values without a second passage advance by the border alone
        text_of = np.searchsorted(off, np.arange(len(raw)), side="right") - 1
        within = np.cumsum(begins)[: len(raw)]
        base = np.concatenate([[0], np.cumsum(begins)])[off[:-1]]
        of_byte = first[text_of] + within - base[text_of]
    hist = np.bincount(of_byte * HIST + CELL[raw], minlength=total * HIST).reshape(total, HIST).astype(np.float32)
    size = hist.sum(1)
    x = np.zeros((total, INPUTS), np.float32)
    x[:, :HIST] = np.sqrt(hist / np.maximum(size, 1)[:, None])
    inside = np.bincount(of, minlength=total).astype(np.float32)
    safe = np.maximum(inside, 1)
    hashes = span_hashes(ASCII_LOWER[raw], start, end)
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=total)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    in_text = np.bincount(owner[order][new], minlength=n) / np.maximum(words, 1)
    whose = np.repeat(np.arange(n), count)
    lengths = np.bincount(of, end - start, total)
    x[:, HIST] = distinct / safe
    x[:, HIST + 1] = in_text[whose]
    x[:, HIST + 2] = np.log1p(words)[whose] / 10
    x[:, HIST + 3] = lengths / safe / 10
    x[:, HIST + 4] = inside / PASSAGE
    x[:, HIST + 5] = np.sqrt(np.maximum(np.bincount(of, (end - start).astype(float) ** 2, total) / safe - (lengths / safe) ** 2, 0)) / 10
    return x, first


@dataclass
class Model:
    par: dict[str, np.ndarray] | None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Logits by bag and what the backward pass needs."""
        p = self.par
        h = np.maximum(x @ p["W"] + p["c"], 0)
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        at = first[:-1]
        whose = np.repeat(np.arange(len(at)), np.diff(first))
        w = np.exp(e - np.maximum.reduceat(e, at)[whose])
        w /= np.add.reduceat(w, at)[whose]
        z = np.add.reduceat(h * w[:, None], at)
        return z @ p["o"] + p["b"], h, t, g, w, z, whose

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        return sigmoid(self.forward(x, first)[0]) if self.par and n else np.full(n, 0.5)


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Adam on the log loss of the document labels, the rarer class weighted up to 3 times."""
    if not bags or y.min() == y.max():
        return Model(None)
    r = np.random.default_rng(seed)
    par = {"W": r.normal(0, 1 / 5, (INPUTS, HIDDEN)), "c": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "a": r.normal(0, 0.3, GATE), "o": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    model, opt = Model(par), Adam(par, RATE)
    epochs = max(EPOCHS, STEPS // -(-len(bags) // BATCH))
    for epoch in range(epochs):
        opt.rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = r.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            x = np.concatenate([bags[k] for k in part])
            first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in part])])
            logit, h, t, g, w, z, whose = model.forward(x, first)
            d = ((sigmoid(logit) - y[part]) / len(part)).astype(np.float32)
            dz = d[:, None] * par["o"]
            hz = (h * dz[whose]).sum(1)
            de = w * (hz - np.add.reduceat(w * hz, first[:-1])[whose])
            dt, dg = de[:, None] * par["a"] * g * (1 - t * t), de[:, None] * par["a"] * t * g * (1 - g)
            dh = (w[:, None] * dz[whose] + dt @ par["V"].T + dg @ par["U"].T) * (h > 0)
            grads = {"W": x.T @ dh, "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "o": z.T @ d, "b": np.array([d.sum()], np.float32)}
            opt.step({k: v + 1e-5 * par[k] for k, v in grads.items()})
    return model


def fit(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    known = labels.filter(use & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("y"))
    src = with_texts(bounded_sample(known, key, MAX_LABELLED), docs, key, text).select(key, "y", F.col(text).alias("text"))

    def run(batches):
        for whole in batches:
            for b in pieces_of(whole, "text"):
                x, first = passages(*flat(b.column("text")))
                bags = [x[i:j].astype(np.float16).tobytes() for i, j in zip(first, first[1:], strict=False)]
                out = pa.RecordBatch.from_arrays([b.column(key), b.column("y"), pa.array(np.diff(first)), pa.array(bags, pa.binary())], [key, "y", "passages", "bag"])
                yield out.filter(pa.array(np.diff(first) <= MAX_BAG))

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    bags = stored(src.mapInArrow(run, f"{key} {kinds[key]}, y {kinds['y']}, passages bigint, bag binary"), "mil")
    so_far = F.sum("passages").over(Window.orderBy(F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0))
    use = bags.select(key, "passages").withColumn("total", so_far).filter(F.col("total") <= MAX_PASSAGES)  # MAX_LABELLED thin rows at most
    rows = bags.join(F.broadcast(use.select(key)), key).orderBy(key).collect()  # bounded by MAX_PASSAGES
    bags = [np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, INPUTS) for r in rows]
    return train(bags, np.array([float(r["y"]) for r in rows], np.float32))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)  # some thousand floats

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([x], ["text"])
        parts = [shared.value.score(*passages(*flat(b.column(0)))) for b in pieces_of(batch, "text")]
        return pa.array(np.concatenate([np.zeros(0), *parts]).astype(float))

    return score(text)


THRESHOLD = 0.3


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
    """Pipeline stage: documents that the classifier calls poor go; the columns stay as they are."""
    return docs.filter(score_column(spark, production(spark, sf_dir), F.col("text")) >= THRESHOLD)
