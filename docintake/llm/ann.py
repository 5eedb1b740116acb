"""Nearest neighbours by largest inner product with a hierarchical k-means tree.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product
with a query is the smallest Euclidean distance. ``Tree.fit`` splits a bounded sample (``SAMPLE_VALUES`` numbers)
by k-means, ``BRANCH`` ways at each node; every row is then put into a leaf. ``Tree.leaves`` walks the tree
best bin first: a priority queue holds the branches not taken, nearest centroid first. How many leaves a query
visits is calibrated: for ``CALIBRATE`` queries the exact neighbours are found by comparing them with all
rows, and visits widen until ``TARGET`` of those neighbours lie in the visited leaves; a query whose leaves hold
fewer than k other rows visits more.

Neighbouring leaves are put together to bins of about ``BIN_ROWS`` rows, the unit in which visits and vectors
meet: a visit row names the query, the bin, and which of the bin's leaves are visited. A bin with many rows or
many visits, such as one with a vector that fills a third of the table, is dealt into blocks of at most about
``BIN_ROWS`` vectors and ``QUERY_ROWS`` queries, so no bin meets in one task. The first bin of each query is
searched first; its k-th score is then the least that hits in the other bins must reach, which keeps what they
hand on in proportion to the queries.

Scores are inner products of the original vectors in double precision, computed row by row (equal vectors get
equal scores); ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, of a length other than the commonest, or that hold null or
non-finite components take no part, neither as queries nor as candidates; rows with a null id likewise;
repeated rows are candidates of their own, but never for a query with their id; of several vectors under one id the
largest asks, once; with fewer candidates than k
all are given; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docintake.llm.common import bounded_sample, stored, table

SAMPLE_VALUES = 1_500_000
BRANCH, ROUNDS, LEAF_ROWS, LEAF_SAMPLE = 8, 8, 256, 12
CALIBRATE, TARGET = 200, 0.97
BIN_ROWS, QUERY_ROWS = 8192, 2048
TOP = 20


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.filter(F.size("v") == (size[0]["size"] if size else 0))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of an array<double> column without nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


class Tree:
    """Nodes in arrays: ``centre``, ``children`` (empty for a leaf), ``leaf`` (its number, or -1)."""

    def __init__(self, norm: float):
        self.norm, self.centre, self.children, self.leaf, self.n_leaves = norm, [], [], [], 0

    def lift(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.hstack([x, more[:, None]]) / self.norm

    @classmethod
    def fit(cls, sample: np.ndarray, norm: float, rows: int, seed: int = 11) -> Tree:
        t, r = cls(norm or 1.0), np.random.default_rng(seed)
        x = t.lift(sample)
        most = max(LEAF_SAMPLE, LEAF_ROWS * len(x) / max(rows, 1))
        t._node(x, most, r)
        t.centre = np.array(t.centre)
        return t

    def _node(self, x: np.ndarray, most: float, r: np.random.Generator) -> int:
        me = len(self.centre)
        self.centre.append(x.mean(0))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x, r) if len(x) > most else []
        if len(parts) > 1:
            self.children[me] = [self._node(p, most, r) for p in parts]
        else:
            self.leaf[me], self.n_leaves = self.n_leaves, self.n_leaves + 1
        return me

    @staticmethod
    def _split(x: np.ndarray, r: np.random.Generator) -> list[np.ndarray]:
        unique = np.unique(x, axis=0)
        if len(unique) < 2:
            return []
        c = unique[r.choice(len(unique), min(BRANCH, len(unique)), replace=False)]
        for _ in range(ROUNDS):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        return [x[own == i] for i in range(len(c)) if (own == i).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        y, out, todo = self.lift(x), np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centre[kids]
                own = ((c * c).sum(1) - 2 * y[rows] @ c.T).argmin(1)
                todo += [(k, rows[own == i]) for i, k in enumerate(kids)]
        return out

    def leaves(self, queries: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaves of each query, best bin first (queries x visits)."""
        q = queries / np.maximum(np.linalg.norm(queries, axis=1), 1e-300)[:, None]
        far = (self.centre**2).sum(1) - 2 * np.hstack([q, np.zeros((len(q), 1))]) @ self.centre.T
        out = np.zeros((len(q), visits), np.int64)
        for i, d in enumerate(far):
            queue, n = [(0.0, 0)], 0
            while n < visits:
                node = heapq.heappop(queue)[1]
                while kids := self.children[node]:
                    order = sorted(kids, key=d.__getitem__)
                    node = order[0]
                    for k in order[1:]:
                        heapq.heappush(queue, (d[k], k))
                out[i, n], n = self.leaf[node], n + 1
        return out


def top_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of the k best rows of each query, of those with ``seen`` (queries x
    rows) that score ``least`` or more. BLAS picks who may be among them, with slack for its rounding; those are
    scored row by row."""
    got_q, got_r, got_s = [], [], []
    if len(rows) and len(queries):
        rough = queries @ rows.T
        rough[query_ids[:, None] == ids[None, :]] = -np.inf
        if seen is not None:
            rough[~seen] = -np.inf
        slack = 1e-9 * (np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max() + 1e-300)
        kth = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(queries), -np.inf)
        for i in range(len(queries)):
            floor = kth[i] if least is None else max(kth[i], least[i])
            may = np.flatnonzero((rough[i] >= floor - slack[i]) & (rough[i] > -np.inf))
            s = (rows[may] * queries[i]).sum(1)
            best = np.lexsort((ids[may], -s))[:k]
            best = best if least is None else best[s[best] >= least[i]]
            got_q.append(np.full(len(best), i))
            got_r.append(may[best])
            got_s.append(s[best])
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else z for x in (got_q, got_r, got_s))


def best(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def exact(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """query_id, rank, vec_id, score by comparing a bounded list of queries (id, v) with all rows."""
    ids, v = np.array([q["id"] for q in queries]), np.array([q["v"] for q in queries], float)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BIN_ROWS):
                part = b.slice(at, BIN_ROWS)
                got = part.column("id").to_numpy()
                q, r, s = top_of(v, ids, matrix(part.column("v")), got, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], part.column("id").type), pa.array(got[r], part.column("id").type), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return best(rows.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double"), k)


def search(vectors: DataFrame, is_query: Column, k: int = TOP, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row where ``is_query`` (an expression
    over ``id``) holds; with ``leaves_visited`` and ``share_read`` (of all rows), what the query's search took."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"), F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = size["dim"] or 1
    sample = bounded_sample(rows, "id", SAMPLE_VALUES // dim).collect()  # bounded by SAMPLE_VALUES numbers
    tree = Tree.fit(np.array([r["v"] for r in sample], float).reshape(-1, dim), size["norm"] or 1.0, size["n"]) if sample else None
    shared = spark.sparkContext.broadcast(tree)  # nodes are bounded by the sample

    def put(batches):
        for b in batches:
            x = matrix(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(shared.value.assign(x))], ["id", "x", "leaf"])

    placed = stored(rows.mapInArrow(put, f"id {kind}, x binary, leaf bigint"), "leaves")

    # Calibration: how many leaves hold TARGET of the exact neighbours.
    asking = stored(rows.filter(is_query).groupBy("id").agg(F.max("v").alias("v")), "queries")  # one for each id
    some = bounded_sample(asking, "id", CALIBRATE).collect()
    visits = 1
    if some:
        truth = exact(rows, some, k).join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()  # CALIBRATE * k rows
        order = tree.leaves(np.array([r["v"] for r in some], float), tree.n_leaves)
        at = {r["id"]: np.argsort(order[i]) for i, r in enumerate(some)}
        need = np.sort([at[r["query_id"]][r["leaf"]] for r in truth]) + 1
        visits = int(need[max(0, math.ceil(target * len(need)) - 1)]) if len(need) else 1

    # Bins of neighbouring leaves, in the tree's order; blocks for bins that are too large.
    held = dict(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each leaf, bounded by the sample
    rows_of = np.array([held.get(i, 0) for i in range(tree.n_leaves)]) if tree else np.zeros(0, np.int64)
    bin_of = (np.cumsum(rows_of) - rows_of) // BIN_ROWS if len(rows_of) else rows_of
    vector_blocks = {int(g): max(1, -(-int(rows_of[bin_of == g].sum()) // BIN_ROWS)) for g in np.unique(bin_of)}

    def chosen(x: np.ndarray) -> list[np.ndarray]:
        """The leaves that each query visits: the calibrated number, and more where they hold fewer than k others."""
        out, v = list(shared.value.leaves(x, visits)), visits
        while (short := [i for i, leaves in enumerate(out) if rows_of[leaves].sum() <= k]) and v < len(rows_of):
            v = min(2 * v, len(rows_of))
            for i, leaves in zip(short, shared.value.leaves(x[short], v), strict=True):
                out[i] = leaves
        return out

    def visit(batches):
        for b in batches:
            x = matrix(b.column("v"))
            for i in range(0, len(x), 512):
                out: list[tuple] = []
                for j, leaves in enumerate(chosen(x[i : i + 512])):
                    bins = bin_of[leaves]
                    effort = len(leaves), float(rows_of[leaves].sum()) / max(int(rows_of.sum()), 1)
                    out += [(i + j, int(g), leaves[bins == g].tolist(), bool(g == bins[0]), *effort) for g in np.unique(bins)]
                at, bins, leaves, first, visited, share = zip(*out, strict=True)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.float64())
                data = pa.array([x[k].tobytes() for k in at], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), data, *(pa.array(c, t) for c, t in zip((bins, leaves, first, visited, share), kinds, strict=True))], ["id", "x", "bin", "leaves", "first", "leaves_visited", "share_read"])

    asked = stored(asking.mapInArrow(visit, f"id {kind}, x binary, bin bigint, leaves array<bigint>, first boolean, leaves_visited int, share_read double"), "visits")
    effort = asked.filter("first").select(F.col("id").alias("query_id"), "leaves_visited", "share_read")
    asked = asked.drop("leaves_visited", "share_read")
    come = dict(asked.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each bin
    sizes = [(g, vector_blocks[g], max(1, -(-come.get(g, 0) // QUERY_ROWS))) for g in vector_blocks]
    blocks = F.broadcast(spark.createDataFrame(sizes, "bin bigint, vb int, qb int"))
    bins = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(bin_of)], "leaf bigint, bin bigint"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(blocks, "bin").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own + "b")).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "b") - 1)))
        return df.withColumn("cell", F.xxhash64("bin", "v", "q")).drop("bin", "vb", "qb", "v", "q")

    def meet(asking: pa.Table, there: pa.Table) -> pa.Table:
        unpack = lambda t: np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, dim)
        qid, vid, leaf, r = asking.column("id").to_numpy(), there.column("id").to_numpy(), there.column("leaf").to_numpy(), unpack(there)
        least, q, wanted = asking.column("least").to_numpy(), unpack(asking), asking.column("leaves").to_pylist()
        got = []
        for i in range(0, len(q) if len(r) else 0, 256):
            some = np.unique(np.concatenate([np.array(w, np.int64) for w in wanted[i : i + 256]]))
            on = np.flatnonzero(np.isin(leaf, some))
            allowed = np.zeros((len(q[i : i + 256]), tree_leaves), bool)
            for j, w in enumerate(wanted[i : i + 256]):
                allowed[j, w] = True
            a, b, s = top_of(q[i : i + 256], qid[i : i + 256], r[on], vid[on], k, allowed[:, leaf[on]], least[i : i + 256])
            got.append((qid[i + a], vid[on[b]], s))
        qs, vs, ss = (np.concatenate(c) if got else np.zeros(0) for c in (zip(*got, strict=True) if got else ((), (), ())))
        t = asking.column("id").type
        return pa.table({"query_id": pa.array(qs.astype(qid.dtype), t), "vec_id": pa.array(vs.astype(vid.dtype), t), "score": pa.array(ss.astype(float), pa.float64())})

    tree_leaves = tree.n_leaves if tree else 0
    found = f"query_id {kind}, vec_id {kind}, score double"
    vectors_dealt = dealt(placed.join(bins, "leaf"), "v", "q").groupBy("cell")
    near = dealt(asked.filter("first").drop("first").withColumn("least", F.lit(float("-inf"))), "q", "v")
    near = stored(best(near.groupBy("cell").cogroup(vectors_dealt).applyInArrow(meet, found), k), "near")
    floor = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = asked.filter("not first").drop("first").join(floor, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    far = dealt(rest, "q", "v").groupBy("cell").cogroup(vectors_dealt).applyInArrow(meet, found)
    got = best(near.select("query_id", "vec_id", "score").unionByName(far), k)
    return got.join(effort, "query_id").select("query_id", "rank", "vec_id", "score", "leaves_visited", "share_read")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


SQL = """
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) x
WHERE rank <= 20
"""
