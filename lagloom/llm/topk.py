"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into BLOCKS groups; a vector's score for a query is the
sum of its scores in the groups, so each task holds, for its vectors, one local
score list for each group and query.

1. Every task sends the best K of each of its lists (with their whole scores,
   as the rows are whole where they lie). The K-th best whole score of a query
   is a safe cutoff: nothing below it can be in the answer.
2. The cutoffs of a block of queries, at most QUERIES numbers, are broadcast. A
   vector can reach the cutoff only if some group gives it cutoff / BLOCKS or
   more; those entries are sufficient, and the rest are not looked at again.
3. The whole score of each remaining entry is resolved exactly and set against
   the cutoff; a task's best K go to the final ranking.

Queries are taken in blocks of QUERIES, each against all rows, so what is
broadcast never grows with the data.

Defined results: vectors that are null, or hold null, NaN or infinite
components, take no part; components that a shorter vector lacks count as 0;
rows with equal vec_id are ranked as candidates one by one and queried one by
one, each against all rows but itself; ties go to the smaller vec_id; an empty table gives an empty result; other
columns are ignored. Scores that exceed 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

K, BLOCKS, QUERIES, ROWS = 10, 4, 8192, 512
_OUT = "query_row int, vec_id long, score long"
_NAMES = ["query_row", "vec_id", "score"]


def scaled_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * component) as long, usable vectors only."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
        .where(F.coalesce(finite, F.lit(False)))
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(whole, lambda x: F.floor(x * scale)).alias("v"))
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64, padded or cut to dim."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, : min(n, dim)] = flat[at : at + min(n, dim)]
        at += n
    return out


def _dot(q: np.ndarray, v: np.ndarray, top: int) -> np.ndarray:
    """Exact integer products: in floats while they are exact, else in Python
    integers."""
    most = top * int(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype("f8") @ v.astype("f8").T).astype("i8")
    exact = q.astype(object) @ v.astype(object).T
    if exact.size and max(abs(x) for x in exact.flat) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype("i8")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each row, ties to the smaller id: (rows, k)."""
    if score.shape[1] > 4 * k:
        # the k-th best of each row; everything above it or level with it
        cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        level = score >= cut[:, None]
        width = int(level.sum(axis=1).max(initial=0))
        if width < score.shape[1]:
            place = np.argsort(~level, axis=1, kind="stable")[:, :width]
            rest = np.take_along_axis(score, place, 1)
            order = np.lexsort((ids[place], -rest), axis=1)[:, :k]
            return np.take_along_axis(place, order, 1)
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)
    return order[:, :k]


def _chunks(batches, dim: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            ids, rows = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
            yield ids, rows, _matrix(part.column("v"), dim)


def _rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query.astype("i4")), pa.array(ids.astype("i8")), pa.array(score.astype("i8"))], _NAMES
    )


class _Kept:
    """The best k (vec_id, score) of each query so far in this task."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.queries = k, [], queries

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray):
        self.held.append(np.stack([row, ids, score]))
        if sum(h.shape[1] for h in self.held) > 4 * self.k * self.queries + 100_000:
            self.held = [self.best()]

    def best(self) -> np.ndarray:
        every = np.concatenate([np.empty((3, 0), "i8"), *self.held], axis=1)
        order = np.lexsort((every[1], -every[2], every[0]))
        every = every[:, order]
        first = np.searchsorted(every[0], every[0])
        return every[:, np.arange(every.shape[1]) - first < self.k]


def _phase_one(q: np.ndarray, own: np.ndarray, dim: int, k: int):
    groups = np.array_split(np.arange(dim), min(BLOCKS, dim))
    top = int(np.abs(q).max(initial=0))

    def lists(batches):
        kept = [_Kept(len(q), k) for _ in groups]
        whole = []
        for ids, rows, v in _chunks(batches, dim):
            parts = [_dot(q[:, g], v[:, g], top) for g in groups]
            # A score is the sum of its parts, where that fits 64 bits for sure.
            fits = top * int(np.abs(v).max(initial=0)) * dim < 1 << 62
            total = sum(parts) if fits else _dot(q, v, top)
            mine = own[:, None] == rows[None, :]
            for part, best in zip(parts, kept, strict=True):
                part[mine] = np.iinfo("i8").min // 2
                at = _best(part, ids, k)
                row = np.repeat(np.arange(len(q)), at.shape[1])
                at = at.ravel()
                usable = ~mine[row, at]
                row, at = row[usable], at[usable]
                best.add(row, ids[at], part[row, at])
                whole.append(np.stack([row, ids[at], total[row, at]]))
            if sum(w.shape[1] for w in whole) > 400_000:
                whole = [_still(whole, kept)]
        sent = _still(whole, kept)
        yield _rows(*sent)

    def _still(whole, kept):
        """Whole scores of what is still in a list; an entry of several lists once."""
        every = np.unique(np.concatenate([np.empty((3, 0), "i8"), *whole], axis=1), axis=1)
        listed = np.concatenate([b.best()[:2] for b in kept], axis=1)
        key = lambda a: a[0].astype("i8") * (1 << 40) + (a[1] & ((1 << 40) - 1))
        return every[:, np.isin(key(every), key(listed))]

    return lists


def _phases_two_three(q: np.ndarray, own: np.ndarray, cut: np.ndarray, dim: int, k: int):
    groups = np.array_split(np.arange(dim), min(BLOCKS, dim))
    top = int(np.abs(q).max(initial=0))

    def entries(batches):
        kept = _Kept(len(q), k)
        for ids, rows, v in _chunks(batches, dim):
            enough = np.zeros((len(q), len(ids)), bool)
            for g in groups:
                # part >= cutoff / groups, in whole numbers
                enough |= _dot(q[:, g], v[:, g], top) * len(groups) >= cut[:, None]
            enough &= own[:, None] != rows[None, :]
            row, at = np.nonzero(enough)
            for lo in range(0, len(row), 1 << 18):
                r, a = row[lo : lo + (1 << 18)], at[lo : lo + (1 << 18)]
                score = _resolve(q, v, r, a, top)
                in_it = score >= cut[r]
                kept.add(r[in_it], ids[a[in_it]], score[in_it])
        yield _rows(*kept.best())

    return entries


def _resolve(q, v, r, a, top):
    if top * int(np.abs(v).max(initial=0)) * q.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", q[r].astype("i8"), v[a].astype("i8"))
    return np.array([sum(int(x) * int(y) for x, y in zip(q[i], v[j], strict=True)) for i, j in zip(r, a, strict=True)], "i8")


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    spark = rows.sparkSession
    vectors = stored(scaled_vectors(rows, scale=scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    ask = vectors.where(is_query)
    count = ask.count()
    n = -(-count // QUERIES)
    if n > 1:  # blocks by rank in hashed order, each of at most QUERIES rows
        ask = stored(
            ask.repartitionByRange(n, F.xxhash64("vec_id")).withColumn("part", F.spark_partition_id()), "queries"
        )
        blocks = [(r["part"], r["count"]) for r in ask.groupBy("part").count().collect()]
    else:
        blocks = [(None, count)] if count else []
    # Each block's answer is appended to one table, so that the result's plan is
    # a scan however many blocks there are.
    path, schema = fresh_path(spark, "top-k"), "query_id long, rank int, vec_id long, score long"
    for part, size in sorted(blocks, key=str):
        for lo in range(0, size, QUERIES):
            few = ask if part is None else ask.where(F.col("part") == part)
            few = few.orderBy("vec_id", "row").offset(lo).limit(QUERIES).select("vec_id", "row", "v").toArrow()
            dim = max(map(len, few.column("v").to_pylist()))
            names, own = few.column("vec_id").to_numpy(), few.column("row").to_numpy()
            q = _matrix(few.column("v").combine_chunks(), dim)
            _answer(spark, vectors, q, own, names, dim, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def _answer(spark: SparkSession, vectors: DataFrame, q: np.ndarray, own: np.ndarray, names: np.ndarray, dim: int, k: int) -> DataFrame:
    seen = vectors.mapInArrow(_phase_one(q, own, dim, k), _OUT)
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = seen.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_row", "score")
    cut = np.full(len(q), np.iinfo("i8").min // 8)
    for r in kth.collect():  # one number for each query of the block
        cut[r["query_row"]] = max(r["score"], np.iinfo("i8").min // 8)
    entries = vectors.mapInArrow(_phases_two_three(q, own, cut, dim, k), _OUT)
    named = spark.createDataFrame(list(enumerate(names.tolist())), "query_row int, query_id long")
    return (
        entries.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .join(F.broadcast(named), "query_row")
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.own <> q.own
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
