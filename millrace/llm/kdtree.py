"""Exact top-k inner product search by KD-trees, one for each shard.

Rows are dealt to shards of about `shard` rows. A shard's tree splits the widest side of its box at the median until a leaf
has at most `leaf` rows; each node keeps the tight box of its rows. For a query the inner product with a box is at most
the sum over components of the larger of query * low and query * high. Nodes are visited best bound first from a heap; a
node is dropped when its bound is below the query's kth score so far. (A node whose bound equals it may hold a tie with a
smaller id and is visited.) Scores are whole numbers, exact below 2**63. Bounds are doubles: exact where all sums fit into 53
bits, else rounded up by more than the error of the sum.

A shard's rows come sorted before its queries, so a task builds each of its trees once and streams the queries past it. A
first round sends each query to its own shard; the kth scores found there are propagated to the second round over the other
shards, so most boxes are dropped at once. A query's results are merged from the `k` best of each shard.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do vectors of another
length than a query's; equal scores go to the smaller id; fewer than k candidates are all returned; repeated vectors are rows of
their own; repeated ids are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.storage import table, written

SHARD, LEAF = 16_384, 256


class Tree:
    """A KD-tree over integer vectors with ids in ascending order within each leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        # sums of products that a double holds exactly go through its faster product
        exact = not len(ids) or int(np.abs(vectors).max()) * (1 << 26) * vectors.shape[1] < 1 << 53
        self.vectors = vectors[order].astype(np.float64 if exact else np.int64)
        self.low, self.high, self.children, self.rows = [], [], [], []
        if len(ids):
            self._node(np.arange(len(ids)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = [None if r is None else self.vectors[r] for r in self.rows]

    def _node(self, rows: np.ndarray, leaf: int) -> int:
        v = self.vectors[rows]
        node, low, high = len(self.low), v.min(axis=0), v.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > leaf and (high > low).any():
            side = int(np.argmax(high - low))
            order = np.argsort(v[:, side], kind="stable")
            half = len(rows) // 2
            self.rows[node] = None
            self.children[node] = (self._node(np.sort(rows[order[:half]]), leaf), self._node(np.sort(rows[order[half:]]), leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """At least the most that each query (row) can score in each node's box (column)."""
        q, low, high = (x.astype(np.float64) for x in (queries, self.low, self.high))
        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        terms = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        # sums of whole numbers below 2**53 are exact; else each of the conversions, products and sums may be off by 2**-53
        return np.where(terms < 1 << 53, most, most + terms * (q.shape[1] + 8) * 2.0**-52)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows of at least `least`, without the row of id own. bound: this query's row of bounds()."""
        found: list[tuple[int, int]] = []
        bound = bound.tolist()  # Python compares a float with an int exactly
        ahead = [(-bound[0], 0)]
        while ahead:
            top, node = heapq.heappop(ahead)
            if -top < least:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if bound[c] >= least:
                        heapq.heappush(ahead, (-bound[c], c))
                continue
            rows = self.rows[node]
            score = (self.points[node] @ query).astype(np.int64)
            keep = np.flatnonzero(score >= least)
            keep = keep[self.ids[rows[keep]] != own]
            if not len(keep):
                continue
            found += zip((-score[keep]).tolist(), self.ids[rows[keep]].tolist(), strict=True)
            if len(found) >= k:
                found = heapq.nsmallest(k, found)
                least = max(least, -found[-1][0])
        return [(-s, i) for s, i in heapq.nsmallest(k, found)]


def _vectors(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), np.int64)


def _trees(ids: np.ndarray, width: np.ndarray, v: pa.Array) -> dict[int, Tree]:
    """A shard's tree, one for each length of vectors."""
    out = {}
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out[int(w)] = Tree(ids[rows], _vectors(v.take(pa.array(rows))))
    return out


def _search(k: int):
    """Rows by shard, each shard's own (side 0) before its queries (side 1, with the kth score so far)."""

    def run(batches):
        at, kept, trees = None, [], None
        for b in batches:
            shard, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(shard)]):
                if lo == hi:
                    continue
                if shard[lo] != at:
                    at, kept, trees = int(shard[lo]), [], None
                part = b.slice(lo, hi - lo)
                if side[lo] == 0:
                    kept.append(part)
                    continue
                if trees is None:
                    rows = pa.Table.from_batches(kept).combine_chunks().to_batches() if kept else []
                    trees = _trees(rows[0].column(2).to_numpy(), rows[0].column(3).to_numpy(), rows[0].column(4)) if rows else {}
                    kept = []
                yield _answers(part, trees, k)

    return run


def _answers(b: pa.RecordBatch, trees: dict[int, Tree], k: int) -> pa.RecordBatch:
    ids, width, least = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(5).to_numpy()
    out: tuple[list, list, list] = ([], [], [])
    for w in np.unique(width):
        if (tree := trees.get(int(w))) is None:
            continue
        rows = np.flatnonzero(width == w)
        q = _vectors(b.column(4).take(pa.array(rows)))
        bounds = tree.bounds(q)
        if tree.vectors.dtype == np.float64:
            if np.abs(q).max() < 1 << 26:
                q = q.astype(np.float64)
            else:
                tree.vectors = tree.vectors.astype(np.int64)
                tree.points = [p if p is None else p.astype(np.int64) for p in tree.points]
        for i, r in enumerate(rows.tolist()):
            for score, other in tree.search(q[i], int(ids[r]), bounds[i], k, int(least[r])):
                out[0].append(int(ids[r]))
                out[1].append(other)
                out[2].append(score)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """vectors, queries: id bigint, v array<bigint>. query_id, rank, vec_id, score: each query's k best rows but its own id."""
    from pyspark.sql import Window

    shards = -(-vectors.count() // shard) or 1

    def dealt(df: DataFrame) -> DataFrame:
        return df.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), "id", F.size("v").alias("width"), "v")

    rows, asked, lowest = dealt(vectors), dealt(queries), F.lit(-(1 << 62))
    tasks = max(shards, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def found(of: DataFrame) -> DataFrame:
        cols = ["shard", "side", "id", "width", "v", "least"]
        both = rows.withColumn("side", F.lit(0)).withColumn("least", lowest).select(cols).union(of.withColumn("side", F.lit(1)).select(cols))
        return both.repartition(tasks, "shard").sortWithinPartitions("shard", "side").mapInArrow(T.tidy(_search(k)), _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = found(asked.withColumn("least", lowest))
    if shards > 1:
        every = written(every, "own")
        kth = every.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        asked = asked.join(kth, "id", "left").withColumn("least", F.coalesce("kth", lowest)).withColumn("own", F.col("shard"))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> own")
        every = every.union(found(asked))
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v: floor(scale * component) of the vectors without null or non-finite components."""
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(F.col(id).isNotNull() & good).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("id % 20 = 0"))


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
           where embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
e as (select vec_id, generate_subscripts(v, 1) i, unnest(v) x from v),
s as (select q.vec_id query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) score from e q join e c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 20
"""
