"""Near-duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

1. ``sketch``: words are lower-cased (A-Z) runs of non-white bytes; a text's set is its distinct 5-word
   shingles. Each distinct word of a batch gets a 64-bit BLAKE2b digest under a key that every run draws anew, so that
   no text can be written to collide; shingles are sums of these under odd factors. ``K`` minima under random functions give ``BANDS`` band keys of ``ROWS`` minima
   each; of every minimum the low ``B`` bits are kept, packed in ``K * B / 8`` bytes.
2. Texts with equal sets (their size and two 64-bit sums over their keyed hashes) form one class; only the class's
   smallest id goes on.
3. Classes that share a band key meet in buckets. There the similarity is estimated by bit counts on the
   packed signatures, corrected for chance collisions (1 in 2**B), and pairs of at least ``LOOSE`` are
   joined to loose clusters. At a similarity of 0.75 a pair shares no band once in some 30 million times,
   and is estimated below ``LOOSE`` (5 standard errors less) about as rarely.
4. Within a loose cluster the full texts meet and links are confirmed on their words, not on hashes; components of confirmed links
   are the result. Comparisons that can't change a component any more are left out; pairs are never emitted,
   only spanning edges, so output is linear in the rows.

Large buckets and clusters are cut into blocks, so that no group meets in one task: buckets into pairs of
blocks of ``BUCKET_BLOCK`` signatures; clusters first into blocks (twice, differently dealt), which joins
nearly everything, and then every row that is not in its cluster's largest component so far is compared with
all blocks of the cluster. Nothing is capped.

Defined cases: null and empty texts and texts of white space have no set, and are linked with nothing; texts
of fewer than five words have their whole word sequence as one shingle; rows with a null id are linked with
nothing and kept; rows of one id are one document; very long texts are taken whole (one text's shingles are in one
task's memory); an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import ASCII_LOWER, WHITE, flat, mix, pieces_of, spans, stored, table
from docintake.llm.components import components

WORDS = 5
BANDS, ROWS, B = 64, 5, 4
K = BANDS * ROWS
SAME, ALL = 75, 100  # linked where ALL * intersection >= SAME * union
LOOSE = 0.62
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 2048, 512, 1_000_000

_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def numbered_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of lower-cased texts: each word's number, the distinct words by number, and the text of each word. Numbers are
    exact: Arrow's dictionary compares the words themselves."""
    raw = ASCII_LOWER[raw]
    start, end, owner = spans(raw, off, WHITE)
    edges = np.concatenate([[0], np.cumsum(end - start)]).astype("<i8")
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(raw[~WHITE[raw]])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary, owner


def shingle_places(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all shingles, in order, repeats included."""
    n = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    whose = np.repeat(np.arange(texts), count)
    at = first[whose] + np.arange(len(whose)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return at, np.minimum(n, WORDS)[whose], whose


def shingles(raw: np.ndarray, off: np.ndarray, secret: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of all shingles."""
    word, distinct, owner = numbered_words(raw, off)
    digest = b"".join(hashlib.blake2b(x, digest_size=8, key=secret).digest() for x in distinct.to_pylist())
    pad = np.concatenate([np.frombuffer(digest, "<u8").astype(np.uint64)[word], np.zeros(WORDS, np.uint64)])
    at, size, whose = shingle_places(owner, len(off) - 1)
    h = size.astype(np.uint64)
    for k in range(WORDS):
        h = h + np.where(k < size, pad[at + k], np.uint64(0)) * _ODD[k]
    return mix(h), whose


def exact_shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, texts) of all shingles: equal numbers mean equal words."""
    word, distinct, owner = numbered_words(raw, off)
    none = len(distinct)
    pad = np.concatenate([word, np.full(WORDS, none)])
    at, size, whose = shingle_places(owner, len(off) - 1)
    name = pad[at]
    for k in range(1, WORDS):
        name = np.unique(name * (none + 1) + np.where(k < size, pad[at + k], none), return_inverse=True)[1]
    return name, whose


def sketches(raw: np.ndarray, off: np.ndarray, secret: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By value: set size, two sums over the set's hashes, band keys (n x BANDS int32), packed bits (n x K*B/8)."""
    total = len(off) - 1
    h, whose = shingles(raw, off, secret)
    _, at = np.unique(mix(h ^ mix(whose.astype(np.uint64) + np.uint64(1))), return_index=True)
    at.sort()
    h, whose = h[at], whose[at]
    n = np.bincount(whose, minlength=total)
    has = np.flatnonzero(n)
    one, two = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    keys, bits = np.zeros((total, BANDS), np.int32), np.zeros((total, K * B // 8), np.uint8)
    if len(has):
        begin = np.concatenate([[0], np.cumsum(n[has])[:-1]])
        one[has], two[has] = np.add.reduceat(h, begin), np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
        low = (h >> np.uint64(32)).astype(np.uint32)
        least = np.empty((K, len(has)), np.uint32)
        value = np.empty_like(low)
        for k in range(K):
            np.multiply(low, _MUL[k], out=value)
            np.add(value, _ADD[k], out=value)
            np.minimum.reduceat(value, begin, out=least[k])
        m = mix(least.T.astype(np.uint64) + np.uint64(1))
        band = m.reshape(len(has), BANDS, ROWS) * _ODD[:ROWS]
        keys[has] = (mix(band.sum(2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        nibble = (m & np.uint64(15)).astype(np.uint8)
        bits[has] = nibble[:, ::2] | nibble[:, 1::2] << 4
    return n, one.view(np.int64), two.view(np.int64), keys, bits


def sketch(df: DataFrame, key: str = "doc_id", text: str = "text", secret: bytes | None = None) -> DataFrame:
    """id, n, set_a, set_b, bands array<int>, bits binary - one row per input row. Sketches can be compared with each
    other if they have one ``secret`` (drawn here if it isn't given)."""
    secret = secret or secrets.token_bytes(32)
    src = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for b in pieces_of(whole, "text", 512 << 10, 4096):
                n, one, two, keys, bits = sketches(*flat(b.column("text")), secret)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two), bands, pa.array([x.tobytes() for x in bits], pa.binary())], ["id", "n", "set_a", "set_b", "bands", "bits"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n bigint, set_a bigint, set_b bigint, bands array<int>, bits binary")


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of rows of packed signatures (as 64-bit words)."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    d &= np.uint64(0x1111111111111111)
    same = 1 - np.bitwise_count(d).sum(1) / K
    chance = 2.0**-B
    return (same - chance) / (1 - chance)


def words_of(col: pa.Array) -> np.ndarray:
    """Packed signatures as rows of 64-bit words."""
    width = K * B // 8
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(len(col), width // 8)


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def whole_groups(batches, group: str):
    """Batches of sorted rows, dealt anew so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(group).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut == 0 and (not held or held[-1].column(group)[-1].as_py() == g[-1]):
            held.append(b)
            continue
        held.append(b.slice(0, cut))
        yield pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks().to_batches()[0] if any(x.num_rows for x in held) else None
        held = [b.slice(cut)]
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks().to_batches()[0]


def loose_edges(buckets: DataFrame) -> DataFrame:
    """Spanning edges of the pairs in each cell (cell, part, cross, id, n, bits) that are estimated similar;
    in a cell with ``cross`` only rows of different parts are compared."""

    def run(batches):
        for b in whole_groups(batches, "cell"):
            if b is None:
                continue
            cell, part, cross, ids, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "part", "cross", "id", "n"))
            bits = words_of(b.column("bits"))
            nodes, back = np.unique(ids, return_inverse=True)
            up = np.arange(len(nodes))  # a root for each node; pairs of one root need no look
            at = np.arange(len(cell) - 1)
            for lag in range(1, len(cell)):
                at = at[at + lag < len(cell)]
                at = at[cell[at] == cell[at + lag]]
                if not len(at):
                    break
                a = at[~cross[at] | (part[at] != part[at + lag])]
                a = a[up[back[a]] != up[back[a + lag]]]
                a = a[ALL * np.minimum(n[a], n[a + lag]) >= SAME * np.maximum(n[a], n[a + lag])]
                a = a[estimate(bits[a], bits[a + lag]) >= LOOSE]
                if len(a):
                    u = Union(0)
                    u.up = up.tolist()
                    for i, j in zip(back[a].tolist(), back[a + lag].tolist(), strict=True):
                        u.join(i, j)
                    up = np.array([u.find(i) for i in range(len(nodes))])
            moved = np.flatnonzero(up != np.arange(len(nodes)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[up[moved]]), pa.array(nodes[moved])], ["a", "b"])

    kind = buckets.schema["id"].dataType.simpleString()
    dealt = buckets.repartition("cell").sortWithinPartitions("cell").select("cell", "part", "cross", "id", "n", "bits")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Are two distinct sorted sets linked?"""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return ALL * both >= SAME * (len(x) + len(y) - both)


def confirmed_edges(rows: DataFrame) -> DataFrame:
    """Spanning edges of the confirmed links in each cell (cell, asks, target, id, component, n, bits, text):
    rows with ``asks`` are compared with rows that are a ``target``. Rows of one ``component`` are joined already."""

    def run(batches):
        for group in whole_groups(batches, "cell"):
            if group is None:
                continue
            edge = np.flatnonzero(np.diff(group.column("cell").to_numpy())) + 1
            for i, j in zip([0, *edge], [*edge, group.num_rows], strict=True):
                if j - i > 1 and (got := confirm(group.slice(i, j - i))):
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], group.column("id").type), pa.array([y for _, y in got], group.column("id").type)], ["a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("cell").sortWithinPartitions("cell").select("cell", "asks", "target", "id", "component", "n", "bits", "text")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def confirm(cell: pa.RecordBatch) -> list[tuple[int, int]]:
    asks, target, ids, comp, n = (cell.column(k).to_numpy(zero_copy_only=False) for k in ("asks", "target", "id", "component", "n"))
    bits = words_of(cell.column("bits"))
    h, whose = exact_shingles(*flat(cell.column("text")))
    cut = np.searchsorted(whose, np.arange(len(ids) + 1))
    sets: dict[int, np.ndarray] = {}
    u = Union(len(ids))
    by = np.argsort(comp, kind="stable")
    for p, q in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
        if comp[p] == comp[q]:
            u.join(p, q)
    others = np.flatnonzero(target)
    found, pairs = [], []
    for i in np.flatnonzero(asks):
        o = others[(ids[others] != ids[i]) & (comp[others] != comp[i]) & ~(asks[others] & (others < i))]
        o = o[ALL * np.minimum(n[o], n[i]) >= SAME * np.maximum(n[o], n[i])]
        e = estimate(bits[o], bits[i]) if len(o) else np.zeros(0)
        keep = e >= LOOSE
        pairs.append((np.full(keep.sum(), i), o[keep], e[keep]))
    if not pairs:
        return []
    a, b, e = (np.concatenate(x) for x in zip(*pairs, strict=True))
    for k in np.argsort(-e, kind="stable").tolist():  # the likeliest first: they join most, and the rest needs no look
        i, j = int(a[k]), int(b[k])
        if u.find(i) == u.find(j):
            continue
        for x in (i, j):
            if x not in sets:
                sets[x] = np.unique(h[cut[x] : cut[x + 1]])
        if linked(sets[i], sets[j]):
            u.join(i, j)
            found.append((ids[i], ids[j]))
    return found


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size), component (smallest id reachable by links) - one row per input row."""
    marks = stored(sketch(docs, key, text), "sketches")
    classes = stored(marks.filter("n > 0 and id is not null").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")

    # Buckets of classes that share a band key.
    band = classes.select("id", F.posexplode("bands").alias("band", "hash")).select("id", (F.shiftleft(F.col("band").cast("bigint"), 32) + F.col("hash").cast("bigint") + F.lit(1 << 31)).alias("bucket"))
    shared = stored(band.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    parts = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    rows = band.join(shared, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", "bucket"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cells = rows.select("id", "part", (F.col("parts") > 1).alias("many"), (low != high).alias("cross"), F.when(F.col("parts") > 1, F.xxhash64("bucket", low, high)).otherwise(F.col("bucket")).alias("cell"))
    pairs = stored(loose_edges(cells.drop("many").join(classes.select("id", "n", "bits"), "id")), "loose")
    loose = components(pairs).withColumnsRenamed({"node": "id", "component": "cluster"})

    # Full sets of the members of each loose cluster.
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    members = loose.join(classes.select("id", "n", "bits"), "id")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))
    members = stored(members.join(stored(sizes, "clusters"), "cluster").join(texts, "id"), "members")
    yes, no = F.lit(True), F.lit(False)

    def block(seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")

    def among(rows: DataFrame, seed: int) -> DataFrame:
        return confirmed_edges(rows.select(F.xxhash64("cluster", block(seed)).alias("cell"), yes.alias("asks"), yes.alias("target"), "id", "component", "n", "bits", "text"))

    def joined(edges: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.drop("component").join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    edges = stored(among(members.withColumn("component", F.col("id")), 0), "links")
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        edges = stored(edges.unionByName(among(joined(edges, large), 1)), "links")
        now = stored(joined(edges, large), "large")
        count = now.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
        top = count.groupBy("cluster").agg(F.max_by("component", "size").alias("top"), F.sum("size").alias("all"), F.max("size").alias("most"))
        now = now.join(stored(top, "largest"), "cluster").withColumn("groups", F.ceil((F.col("all") - F.col("most")) / CLUSTER_BLOCK).cast("int")).filter("groups > 0")
        out = F.col("component") != F.col("top")
        group = F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")).cast("int")
        targets = now.select("*", block(3).alias("at"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("by"), no.alias("asks"), yes.alias("target"))
        asking = now.filter(out).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), group.alias("by"), yes.alias("asks"), no.alias("target"))
        rest = targets.unionByName(asking).select(F.xxhash64("cluster", "at", "by").alias("cell"), "asks", "target", "id", "component", "n", "bits", "text")
        edges = stored(edges.unionByName(confirmed_edges(rest)), "links")
    final = components(edges).withColumnsRenamed({"node": "id"})
    named = stored(classes.select("set_a", "set_b", "n", "id").join(final, "id", "left").select("set_a", "set_b", "n", F.coalesce("component", "id").alias("component")), "named")
    out = marks.select("id", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components_of(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component only the document with the smallest id stays; columns as they are."""
    gone = components_of(docs).filter("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(stored(gone, "copies"), "doc_id", "left_anti")


SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k, len(w) AS m FROM lists),
runs AS (SELECT doc_id, k, m, concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) AS sh FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
sh AS (SELECT DISTINCT doc_id, sh FROM runs WHERE k <= greatest(m - 4, 1)),
n AS (SELECT d.doc_id, count(sh.sh) AS n FROM documents d LEFT JOIN sh ON sh.doc_id = d.doc_id GROUP BY d.doc_id),
hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM hits JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept
FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
