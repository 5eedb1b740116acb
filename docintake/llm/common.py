"""Helpers shared by the corpus operators: reading tables, shared scratch tables, bounded samples,
and vectorised byte-level work on Arrow string columns."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session may leave it unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_dir.setdefault(app, tempfile.mkdtemp(prefix="docintake-"))
    return base.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared place and read it back: lineage ends there, so a lost
    executor costs at most a re-read. The folder goes when the driver's Python ends, or by ``forget``."""
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/docintake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(forget)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete all stored tables. Call it when no result that reads them is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; what is left lies in the scratch folder
            _written.clear()


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text of ``col`` modulo ``n``."""
    return F.crc32(col.cast("string")) % n


def hash_below(col: Column, share: Column | float) -> Column:
    """Whether the hash of ``col`` lies in the lowest ``share`` of its range."""
    return F.xxhash64(col) / F.lit(2.0**64) + 0.5 <= share


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct keys, those with the smallest hashes (the same whatever the partitioning), each
    with its largest row. A threshold on the hash, from the number of keys, comes first, so that what is sorted
    and sent to one task is some ``2 * limit`` rows, whatever the number of partitions and repeats."""
    n = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    if n > 2 * limit:
        df = df.filter(hash_below(F.col(key), 1.5 * limit / n))
    rest = [c for c in df.columns if c != key]
    df = df.groupBy(key).agg(F.max(F.struct(*rest)).alias("__rest")).select(key, "__rest.*") if rest else df.distinct()
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def with_texts(sample: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Join the texts to a bounded sample of ids (the broadcast side: its row limit bounds it); of several texts
    under one id the largest counts, so the result is bounded as well."""
    found = docs.select(F.col(key), F.col(text).cast("string").alias(text)).join(F.broadcast(sample), key)
    return found.groupBy(*sample.columns).agg(F.max(text).alias(text))


# ---------------------------------------------------------------- Arrow strings as bytes


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all values on end, offsets of len + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces_of(batch: pa.RecordBatch, text: str, most: int = 1 << 20, rows: int = 1 << 30):
    """Cut a batch into row slices of about ``most`` text bytes and at most ``rows`` rows, so that numpy
    temporaries stay small however long the texts are (one text is never cut)."""
    lengths = np.diff(flat(batch.column(text))[1])
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def spans(raw: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, owner) of every maximal run of bytes for which ``separator[byte]`` is False; runs end at
    the borders of the values."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes at a time are mixed in, beginning with the length, so a
    difference anywhere changes every bit; spans above ``LONG_SPAN`` bytes get their BLAKE2b digest."""
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(start):
        return h
    pad = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", pad.data, strides=(1,))
    for k in range(0, min(int(size.max()), LONG_SPAN), 8):
        more = np.flatnonzero(size > k) if k else slice(None)
        left = np.minimum(size[more] - k, 8)
        h[more] = mix(h[more] ^ (eight[start[more] + k] & _MASK[left])) * _ODD
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Space and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True

#: All ASCII but letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = False
for _r in (range(48, 58), range(65, 91), range(97, 123)):
    NOT_WORD[list(_r)] = False


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Plain Adam over a dict of numpy parameters."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
