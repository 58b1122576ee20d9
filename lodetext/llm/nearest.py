"""Exact nearest neighbours by a block matrix join with quantised distances.

Vectors are scaled to signed 8-bit integers by one scale for the whole table. Query and candidate blocks meet in tiles; the integer product of a tile gives squared
distances of the quantised vectors, exactly, and each true distance lies within the sum of both vectors' own quantisation errors of that. The k-th smallest upper
bound of a query prunes all candidates whose lower bound is larger; the surviving pairs are recomputed in double precision and merged by heaps of k. So the result
is exact: bounds only save work.

A stated set of queries meets all rows in blocks: candidate rows stay where they are read, and queries are broadcast in groups of at most QUERY_BYTES, a pass over the candidates a group.
Every task keeps k candidates a query, and these are merged query by query, in two rounds.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows with a null vec_id; repeated rows are candidates
each (a query's own rows, by vec_id, aren't); a vec_id that is queried by several rows with different vectors is answered once for the least of them; ties go to the smaller vec_id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm import shared

QUERY_BYTES = 32 << 20
TILE = 1024
_FOUND = "query_id long, vec_id long, score double"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part, all of one length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(~bad & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0].n if sizes else 0))


def quantise(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """8-bit integers, and the length of what was lost."""
    q = np.clip(np.rint(x / scale), -127, 127).astype(np.int8)
    return q, np.sqrt(((x - q * scale) ** 2).sum(1))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, n)


class _Best:
    """The k nearest of each query so far, as heaps whose first entry is the farthest."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(queries)]

    def worst(self) -> np.ndarray:
        return np.array([-h[0][0] if len(h) == self.k else np.inf for h in self.heaps])

    def add(self, q: int, score: float, vec_id: int) -> None:
        entry = (-score, -vec_id)
        if len(self.heaps[q]) < self.k:
            heapq.heappush(self.heaps[q], entry)
        elif entry > self.heaps[q][0]:
            heapq.heapreplace(self.heaps[q], entry)


def _tiles(shared_queries, k: int, scale: float):
    def run(batches):
        ids, x = shared_queries.value
        qx, q_err = quantise(x, scale)
        qi = qx.astype(np.float32)  # sums of 8-bit products stay exact in 24 bits for up to 1040 dimensions
        wide = np.float64 if x.shape[1] > 1040 else np.float32
        q_norm = (qx.astype(np.int64) ** 2).sum(1).astype(np.float64)
        best = _Best(len(ids), k)
        for b in batches:
            cand, c = b.column("vec_id").to_numpy(), _matrix(b.column("embedding"), x.shape[1])
            for s in range(0, len(cand), TILE):
                own, y = cand[s : s + TILE], c[s : s + TILE]
                qy, y_err = quantise(y, scale)
                y_norm = (qy.astype(np.int64) ** 2).sum(1).astype(np.float64)
                product = qi.astype(wide) @ qy.astype(wide).T
                dist = np.sqrt(np.maximum(q_norm[:, None] + y_norm[None] - 2.0 * product, 0)) * scale
                lost = (q_err[:, None] + y_err[None]) * (1 + 1e-9) + 1e-9 * scale
                upper = dist + lost
                upper[ids[:, None] == own[None]] = np.inf
                limit = best.worst()
                if upper.shape[1] > k:
                    limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
                near = (dist - lost <= limit[:, None]) & np.isfinite(upper)
                qs, cs = np.nonzero(near)
                exact = np.sqrt(((x[qs] - y[cs]) ** 2).sum(1))
                for i, e, v in zip(qs.tolist(), exact.tolist(), own[cs].tolist(), strict=True):
                    best.add(i, e, v)
        rows = [(int(ids[i]), -v, -e) for i, h in enumerate(best.heaps) for e, v in h]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(z), t) for z, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _merge(k: int):
    """k best of each query; rows of a query follow one another."""

    def run(batches):
        at, heap = None, []

        def out():
            rows = sorted((-e, -v) for e, v in heap)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.int64()), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array([v for _, v in rows], pa.int64()), pa.array([e for e, _ in rows], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for q, v, e in zip(*(b.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != at:
                    if heap:
                        yield out()
                    at, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (-e, -v))
                elif (-e, -v) > heap[0]:
                    heapq.heapreplace(heap, (-e, -v))
        if heap:
            yield out()

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest candidates of each query; both as clean() gives them."""
    spark = candidates.sparkSession
    asked = shared.save(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size.n:
        return empty
    top = candidates.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    if top is None:
        return empty
    scale = max(top, 1e-300) / 127
    groups = -(-size.n * size.d * 8 // QUERY_BYTES)
    found = None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow()
        if not len(part):
            continue
        x = _matrix(part.column("embedding").combine_chunks(), size.d)
        block = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), x))
        one = candidates.mapInArrow(_tiles(block, k, scale), _FOUND)
        found = one if found is None else found.unionByName(one)
    n = shared.partitions(spark)
    merge = lambda df, *keys: df.repartition(n, *keys).sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
    salted = found.withColumn("part", F.spark_partition_id() % 32)  # of many tasks' results, each round takes a bounded share
    return merge(merge(salted, "query_id", "part").drop("rank"), "query_id")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean(shared.table(spark, sf_dir, "embeddings"))
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)


_TAKES_PART = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {_TAKES_PART}),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
