"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter n-grams (``GRAMS`` bytes of the lower-cased UTF-8
text, everything but letters read as one kind of gap). Each language has up to ``CLUSTERS`` centroids from
spherical k-means; a text gets the language of the centroid with the largest cosine, and is rejected where
that cosine lies further out than ``REJECT`` of the centroid's own training texts.

Document frequencies are counted over all learnable texts; the centroids are fitted on at most
``PER_LANGUAGE`` texts of each language, picked by a hash of the key.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; a text whose
n-grams were never seen gets the first language with score 0 and is rejected; rows without a language are
not learned from; without any learnable row everything is ``und``; repeated rows each get their result; of several
texts under one key and language the largest is learned from; very long texts are read whole; of equal cosines the
first language in order counts; other columns are ignored, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docintake.llm.common import crc_mod, flat, hash_below, pieces_of, stored, table, with_texts

BITS = 12
DIMS = 1 << BITS
GRAMS = (1, 2, 3, 4)
CLUSTERS, ROUNDS = 4, 12
PER_LANGUAGE = 1200
REJECT = 0.005
#: Vectors in memory at once.
ROWS, BYTES = 256, 1 << 20

_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def term_counts(texts: pa.Array) -> np.ndarray:
    """n-gram counts (values x DIMS)."""
    raw, off = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    gap = max(GRAMS)  # after each value, so that no n-gram reaches into the next
    line = np.zeros(len(raw) + (n + 1) * gap, np.uint32)
    whose = np.full(len(line), n)
    at = np.arange(len(raw)) + owner * gap
    line[at] = _LETTER[raw]
    whose[at] = owner
    out = np.zeros(n * DIMS)
    code = np.zeros(len(line), np.uint32)
    for k in range(1, max(GRAMS) + 1):
        code = code * np.uint32(0x01000193) + np.roll(line, 1 - k) + np.uint32(1)
        if k in GRAMS:
            # A gram belongs to the value of its first letter; grams that begin in a gap are left out.
            keep = (whose < n) & (line > 0)
            slot = (code[keep] + np.uint32(k)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
            out += np.bincount(whose[keep] * DIMS + slot.astype(np.int64), minlength=n * DIMS)
    return out.reshape(n, DIMS)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(term_counts(texts)) * idf).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(texts with each slot, texts) over all rows: summed by partition, then by slot (DIMS + 1 rows)."""

    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for whole in batches:
            for b in pieces_of(whole, "text", BYTES, ROWS):
                total += (term_counts(b.column("text")) > 0).sum(0)
                n += b.num_rows
        slots = np.append(np.flatnonzero(total), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(np.append(total[slots[:-1]], n), pa.int64())], ["slot", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means; starts from mutually distant rows, so the same rows give the same result."""
    centres = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    limits: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(texts, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1)
        return [self.langs[i] for i in best], score, (score < self.limits[best]) | (score <= 0)


def fit(docs: DataFrame, use: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    learn = docs.filter(use & F.col(lang).isNotNull() & F.col(text).isNotNull())
    df, n = document_frequencies(learn, text)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0).astype(np.float32)
    # PER_LANGUAGE keys of each language, by a hash: a threshold for each language leaves some more, and these are ranked.
    named = learn.select(F.col(key).alias("key"), F.col(lang).alias("lang"))
    sizes = stored(named.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")), "languages")
    some = named.join(sizes, "lang").filter(hash_below(F.col("key"), F.lit(2.0 * PER_LANGUAGE) / F.col("n"))).select("lang", "key").distinct()
    picked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))).filter(F.col("rank") <= PER_LANGUAGE)
    # The picked rows are bounded by PER_LANGUAGE times the languages, which is what allows the broadcast.
    sample = with_texts(picked.select("lang", F.col("key").alias("__key")), learn.select(F.col(key).alias("__key"), F.col(text).alias("text")), "__key", "text").select("lang", "text")

    def vector_rows(batches):
        for whole in batches:
            for b in pieces_of(whole, "text", BYTES, ROWS):
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([v.tobytes() for v in vectors(b.column("text"), idf).astype(np.float16)], pa.binary())], ["lang", "v"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.frombuffer(v, np.float16) for v in sorted(pdf["v"])], np.float32)
        x = x[(x * x).sum(1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "reach": []})
        c = cluster(x, CLUSTERS)
        cos = x @ c.T
        own = cos.argmax(1)
        reach = [float(np.quantile(cos[own == i, i], REJECT)) if (own == i).any() else 1.0 for i in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "reach": reach})

    rows = stored(sample.mapInArrow(vector_rows, "lang string, v binary").groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, reach double"), "centroids").orderBy("lang", F.xxhash64("centroid")).collect()
    c = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(-1, DIMS)
    return Model(idf, c, [r["lang"] for r in rows], np.array([r["reach"] for r in rows]))


def language_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang, score, rejected>: ``lang`` is the nearest language also where it is rejected."""
    shared = spark.sparkContext.broadcast(model)  # CLUSTERS * DIMS floats a language

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(x: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([x], ["text"])
        langs, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
        for b in pieces_of(batch, "text", BYTES, ROWS):
            lang, score, far = shared.value.predict(b.column(0))
            langs += lang
            scores.append(score)
            rejected.append(far)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], ["lang", "score", "rejected"])

    lettered = text.rlike(r"\p{L}")
    return F.when(lettered, nearest(text)).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", reject: bool = True) -> DataFrame:
    """key, ``lang_pred`` (``und`` where rejected, if ``reject``), ``score``, ``rejected``."""
    got = docs.select(F.col(key), language_column(docs.sparkSession, model, F.col(text)).alias("got"))
    lang = F.when(F.col("got.rejected"), "und").otherwise(F.col("got.lang")) if reject else F.col("got.lang")
    return got.select(key, lang.alias("lang_pred"), F.col("got.score").alias("score"), F.col("got.rejected").alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return identify(docs, model, reject=False).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
