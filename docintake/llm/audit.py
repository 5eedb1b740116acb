"""Filter interaction audit: what each of five filters removes in every order of application, by part of the corpus.

1. ``flags``: one thin row per document with the filters that it fails as bits, and two hashes of its text.
2. ``sketch``: every task counts its texts' hashes in a counting Bloom filter, and sends the slots that it met once and
   more often; streams of these are merged into counters that stop at two, and the slots that reached two are kept.
   A text with a slot below two is nobody's copy: the sketch never errs that way.
3. ``first_ids``: only texts that the sketch doesn't clear are shuffled, whole, for the smallest id of each; copies
   within a task are put together before. Digests name the texts that occur under several ids.
4. ``masks``: the flags, with the duplicates' bit added, become counts per part and set of failed filters.
5. ``orders``: all 120 orders and five steps are fixed 0/1 matrices over these 32 counts.

The sketch has ``SLOTS`` slots a text, up to ``MAX_SLOTS`` (64 MB as bits, which bounds what is collected and
broadcast). Beyond some 70 million texts slots are shared more often, so that more unique texts are shuffled than need
be; the result is exact all the same.

Defined cases: null text is the empty text, of which rows with a null text are copies; empty and blank texts have no
words; very long texts are taken whole; a null source is the part ``''``; rows with equal ids are documents of their
own, and no duplicates of each other, as neither id is smaller; a row without id has no smaller one and is no smaller
one; of several labels of one id the larger counts; without labels nothing good or toxic is lost; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import stored, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
#: Slots a text of the sketch, and at most; probes a text; chunks in which slots are merged.
SLOTS, MAX_SLOTS, PROBES, CHUNKS = 16, 1 << 29, 2, 256
UPPER = bytes(range(65, 91))


def own_filters(text: str) -> int:
    """Bits of the filters that need no other document: A few words, B few distinct ones, C capitals, D marks."""
    raw = text.encode()
    words = raw.split()  # bytes are split at space and tab to carriage return
    a = len(words) < MIN_WORDS
    b = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    c = 100 * (len(raw) - len(raw.translate(None, UPPER))) > MAX_UPPER_PERCENT * len(text)
    d = len(raw.translate(None, MARKS)) < len(raw)
    return a | b << 1 | c << 2 | d << 3


def with_text(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(part).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), name.alias("part"), body.alias("body"), F.xxhash64(body).alias("hash"), F.unhex(F.sha2(body, 256)).alias("digest"))


def flags(texts: DataFrame) -> DataFrame:
    """key, part, bits, hash, digest."""

    def run(batches):
        for b in batches:
            bits = [own_filters(x) for x in b.column("body").to_pylist()]
            rest = [n for n in b.schema.names if n != "body"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(bits, pa.int32())], [*rest, "bits"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, part string, hash bigint, digest binary, bits int")


# ---------------------------------------------------------------- the counting sketch


def slots_for(texts: int) -> int:
    return int(min(MAX_SLOTS, max(CHUNKS * 64, 1 << (SLOTS * max(texts, 1) - 1).bit_length())))


def probes(hashes: np.ndarray, slots: int) -> np.ndarray:
    """``PROBES`` slots of each hash, by row."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


def sketch(hashes: DataFrame, slots: int) -> np.ndarray:
    """Bits of the slots that texts met at least twice."""
    width = slots // CHUNKS

    def fold(once, more, new):
        once, n = np.unique(np.concatenate([once, *new]), return_counts=True)
        return once, np.union1d(more, once[n > 1])

    def count(batches):
        once, more, new, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for b in batches:
            at = probes(b.column("hash").to_numpy(zero_copy_only=False), slots)
            at[:, 1:][at[:, 1:] == at[:, :1]] = -1  # a text counts once in a slot
            new.append(at[at >= 0])
            size += len(new[-1])
            if size > max(len(once), 1 << 17):
                once, more, new, size = *fold(once, more, new), [], 0
        once, more = fold(once, more, new)
        chunk = np.searchsorted(once, np.arange(CHUNKS + 1) * width), np.searchsorted(more, np.arange(CHUNKS + 1) * width)
        held = [i for i in range(CHUNKS) if chunk[0][i] < chunk[0][i + 1]]
        cut = lambda x, k, i: (x[chunk[k][i] : chunk[k][i + 1]] - i * width).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([cut(once, 0, i) for i in held], pa.binary()), pa.array([cut(more, 1, i) for i in held], pa.binary())], ["chunk", "once", "more"])

    def merge(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for chunk, once, more in zip(b.column("chunk").to_pylist(), b.column("once").to_pylist(), b.column("more").to_pylist(), strict=True):
                met, twice = seen.setdefault(chunk, (np.zeros(width, bool), np.zeros(width, bool)))
                at = np.frombuffer(once, "<u4")
                twice[at[met[at]]] = True
                met[at] = True
                twice[np.frombuffer(more, "<u4")] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(x[1]).tobytes() for x in seen.values()], pa.binary())], ["chunk", "bits"])

    counted = hashes.select("hash").mapInArrow(count, "chunk int, once binary, more binary")
    merged = counted.repartition("chunk").mapInArrow(merge, "chunk int, bits binary")
    out = np.zeros((CHUNKS, width // 8), np.uint8)
    for r in merged.collect():  # one row for each chunk: slots / 8 bytes together
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def may_repeat(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = probes(hashes, 8 * len(bits))
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def not_cleared(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose ``hash`` the sketch doesn't clear; only hashes go to Python."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def repeats(h):
        import pandas as pd

        return pd.Series(may_repeat(h.to_numpy(np.int64), sent.value))

    return rows.filter(repeats("hash"))


def first_ids(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """digest, first: the smallest id of each text that occurs under several ids."""
    again = not_cleared(texts.select("key", "body", "hash"), bits)
    whole = again.groupBy("body").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    return whole.select(F.unhex(F.sha2("body", 256)).alias("digest"), "first")


# ---------------------------------------------------------------- counts of masks, and orders


def masks(marked: DataFrame, labels: DataFrame | None) -> DataFrame:
    """part, mask, n, good, toxic. Only what fails a filter can be lost, so only that meets the labels."""
    thin = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    if labels is not None:
        told = labels.groupBy(F.col("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic")
        lost = marked.filter("mask <> 0").join(told, "key").groupBy("part", "mask")
        lost = lost.agg(F.lit(0).cast("bigint").alias("n"), F.sum(F.col("good").cast("bigint")).alias("good"), F.sum(F.col("toxic").cast("bigint")).alias("toxic"))
        thin = thin.unionByName(lost)
    return thin.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


@lru_cache(maxsize=1)
def matrices() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each row, and for each count the 0/1 rows over the 32 masks."""
    fails = (np.arange(32)[:, None] >> np.arange(5)) & 1 == 1
    names, kept, removed, redundant, alone = [], [], [], [], []
    for order in permutations(range(5)):
        before = np.zeros(32, bool)
        for step, f in enumerate(order):
            names.append(("".join(FILTERS[i] for i in order), step + 1))
            removed.append(fails[:, f] & ~before)
            redundant.append(fails[:, f] & before)
            alone.append(np.arange(32) == 1 << f)
            before = before | fails[:, f]
            kept.append(~before)
    out = {k: np.array(v, np.int64) for k, v in (("kept", kept), ("removed", removed), ("redundant", redundant), ("unique_fails", alone))}
    letter = np.array([FILTERS.index(o[s - 1]) for o, s in names])
    total = np.array([out["removed"][letter == f].sum(axis=0) for f in range(5)])
    return names, out | {"shapley": total[letter]}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of masks (32 of a part at most)."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))

    def run(batches):
        names, m = matrices()
        for b in batches:
            for part, held in zip(b.column("part").to_pylist(), b.column("held").to_pylist(), strict=True):
                n = {k: np.zeros(32, np.int64) for k in ("n", "good", "toxic")}
                for x in held:
                    for k in n:
                        n[k][x["mask"]] = x[k]
                got = {k: m[k] @ n["n"] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
                got |= {"good_lost": m["removed"] @ n["good"], "toxic_lost": m["removed"] @ n["toxic"]}
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array([x[0] for x in names]), pa.array([x[1] for x in names], pa.int32()), *(pa.array(got[k]) for k in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{k} bigint" for k in COUNTS))


def audit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``labels``: the documents' key, and 1 in ``quality`` and ``toxic`` where they are known to be so."""
    texts = with_text(docs, key, text, part)
    thin = stored(flags(texts), "audit-flags")
    bits = sketch(thin, slots_for(thin.count()))
    firsts = stored(first_ids(texts, bits), "audit-firsts")
    joined = thin.join(firsts, "digest", "left")
    mask = F.col("bits") + F.when(F.col("key") > F.col("first"), 16).otherwise(0)
    marked = stored(joined.select("key", "part", mask.alias("mask")), "audit-masks")
    known = labels.select(F.col(key).alias("key"), F.col(quality).alias("quality"), F.col(toxic).alias("toxic")) if labels is not None else None
    return orders(masks(marked, known))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper FROM d),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END ||
  CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * upper > 5 * length(w.t) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END ||
  CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w JOIN e ON w.t = e.t LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || g.c || h.c || i.c AS filter_order FROM x a, x b, x g, x h, x i
  WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS earlier FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (SELECT part, filter_order, step, c,
  sum(CASE WHEN len(fails) = 0 OR NOT regexp_matches(fails, '[' || earlier || c || ']') THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(fails, c) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || ' ]')) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(fails, c) AND earlier <> '' AND regexp_matches(fails, '[' || earlier || ' ]') THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN contains(fails, c) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || ' ]')) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN contains(fails, c) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || ' ]')) THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r
"""
