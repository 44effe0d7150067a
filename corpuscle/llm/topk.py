"""Exact top-k search by inner product: tiled matrix products, a selection for each tile, merged lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import take

#: Queries that are sent to the executors at one time; with TILE and the vectors' width it bounds the memory of a task.
QUERY_BLOCK = 16_384
#: Vectors of a tile.
TILE = 1_024
#: Queries of a tile.
QUERY_TILE = 2_048
#: Doubles hold integers exactly below this.
EXACT = float(1 << 53)

LIST = "array<struct<score:long,vec_id:long>>"


def quantise(embedding: str = "embedding") -> F.Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256.0))


def usable(embedding: str = "embedding") -> F.Column:
    """Vectors that are null, empty or hold a null or a non-finite component take no part."""
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~bad


def _dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every partial sum fits, else in Python's integers."""
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < EXACT:
        return q @ v.T
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Best:
    """The k best so far of each query of a block; of equal scores the smaller id goes first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score, self.vec, self.used = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), bool)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(self.ids), QUERY_TILE):
            self._tile(slice(a, a + QUERY_TILE), ids, vectors)

    def _tile(self, part: slice, ids: np.ndarray, vectors: np.ndarray) -> None:
        k, s = self.k, _dot(self.vectors[part], vectors)
        if s.shape[1] > k + 1:  # with all that tie with the last; one more than k, as the query itself may be among them
            edge = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            r, c = np.nonzero(s >= edge[:, None])
        else:
            r, c = (x.ravel() for x in np.indices(s.shape))
        other = ids[c] != self.ids[part][r]
        r, c = r[other], c[other]
        have = np.nonzero(self.used[part])
        row = np.concatenate([have[0], r])
        score = np.concatenate([self.score[part][have], s[r, c].astype(np.int64)])
        vec = np.concatenate([self.vec[part][have], ids[c]])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        at = (row[top], place[top])
        self.used[part] = False
        for mine, new in ((self.score, score[top]), (self.vec, vec[top]), (self.used, True)):
            mine[part][at] = new

    def rows(self, cut: int = 4096) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), cut):
            used = self.used[a : a + cut]
            best = pa.StructArray.from_arrays([pa.array(self.score[a : a + cut][used]), pa.array(self.vec[a : a + cut][used])], ["score", "vec_id"])
            offsets = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
            batch = pa.RecordBatch.from_arrays([pa.array(self.ids[a : a + cut]), pa.ListArray.from_arrays(pa.array(offsets), best)], ["query_id", "best"])
            yield batch.filter(pa.array(used.any(1)))


def _search(it: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, _Best] = {}
    for dim, (ids, vectors) in queries.value.items():
        blocks[dim] = _Best(ids, vectors, k)
    for batch in it:
        lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
        flat, first = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
        first, dims = first - first[0], np.diff(lists.offsets.to_numpy())
        for dim in np.unique(dims):
            if dim in blocks:
                rows = np.nonzero(dims == dim)[0]
                for a in range(0, len(rows), TILE):
                    at = rows[a : a + TILE]
                    blocks[dim].add(ids[at], flat[first[at][:, None] + np.arange(dim)])
    for b in blocks.values():
        yield from b.rows()


def top_k(spark: SparkSession, queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` vectors with the highest inner product with each query, itself left out, ties to the smaller id.

    Both tables: vec_id (long), v (array of integral doubles). Returns query_id, rank (from 1), vec_id, score.

    Queries go to the executors in blocks of at most ``block`` (a fixed number, so that what is sent and held does not
    grow with the data); for each block every task multiplies its vectors tile by tile, keeps k for each query, and
    sends one list for each query. The lists are merged in two levels (within groups of tasks, then over groups), so
    that no task reads all lists of many queries at once. A query gets fewer than ``k`` if there are fewer vectors.
    Vectors of another width than the query's have no inner product with it and are left out. Scores beyond 64 bits
    are cut to the range of a long. A null vec_id takes no part. Empty tables give no rows.
    """
    out, schema = None, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("best", T._parse_datatype_string(LIST))])
    n = queries.count()
    blocks = -(-n // block)
    marked = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks * 2)))) if blocks > 1 else queries.withColumn("b", F.lit(0))
    for b in range(max(1, blocks * 2 if blocks > 1 else 1)):
        by: dict[int, list] = {}
        for q in marked.where(F.col("b") == b).select("vec_id", "v").collect():
            by.setdefault(len(q.v), []).append((q.vec_id, q.v))
        sent = spark.sparkContext.broadcast({d: (np.array([i for i, _ in r], np.int64), np.array([v for _, v in r], np.float64)) for d, r in by.items()})
        found = vectors.select("vec_id", "v").mapInArrow(lambda it, s=sent, kk=k: _search(it, s, kk), schema)
        out = found if out is None else out.union(found)
    order = lambda lists: F.slice(F.array_sort(F.flatten(lists), _better), 1, k)
    near = out.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("query_id", "g").agg(order(F.collect_list("best")).alias("best"))
    merged = near.groupBy("query_id").agg(order(F.collect_list("best")).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _better(a: F.Column, b: F.Column) -> F.Column:
    return F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.vec_id < b.vec_id, -1).when(a.vec_id > b.vec_id, 1).otherwise(0)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products for every vector whose vec_id is divisible by 50, against all rows."""
    rows = take(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id="vec_id", embedding="embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", F.transform(quantise(), lambda x: x.cast("double")).alias("v"))
    return top_k(spark, rows.where(F.pmod("vec_id", F.lit(50)) == 0), rows)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
