"""Exact inner-product search, vectors, and contexts filled from its hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .chunking import fill

#: Query vectors and vectors of a block, and vectors that are multiplied at a time.
QUERY_BLOCK, VECTOR_BLOCK, STRIP = 4096, 65_536, 2048
#: Scores that a worker holds at a time, and blocks of queries and of vectors into which smaller blocks are gathered.
CELLS, ACROSS, DOWN = 1 << 20, 8, 64


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """An index: rows whose vector hasn't ``dim`` numbers raise when they are read."""
    right = F.size("embedding") == dim
    return vectors.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"vector of other than {dim} dimensions: "), F.size("embedding").cast("string")))))


def added(index: DataFrame, more: DataFrame, key: str = "index_id") -> DataFrame:
    """``more``, numbered from 0 in ``key``, appended behind the index's last number."""
    last = index.agg(F.coalesce(F.max(key) + 1, F.lit(0)).alias("_base"))
    return index.unionByName(more.join(F.broadcast(last)).withColumn(key, F.col(key) + F.col("_base")).drop("_base"))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """The nearest rows to one vector: rank, key, score. ``threshold`` drops lower scores after the cut at k."""
    array = F.array(*(F.lit(float(x)) for x in query))
    best = vectors.select(key, F.round(tx.dot("embedding", array), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    return ranked if threshold is None else ranked.where(F.col("score") >= threshold)


class _Best:
    """The best k rows so far for each of some queries."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.keys, self.scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(keys) or not len(self.ids):
            return
        step = max(64, CELLS // len(self.ids))
        for at in range(0, len(keys), step):
            self._add(keys[at : at + step], values[at : at + step])

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        score = np.hstack((self.scores, np.round(self.matrix @ values.T, 4)))
        every = np.hstack((self.keys, np.broadcast_to(keys, (len(self.ids), len(keys)))))
        order = np.lexsort((every, -score), axis=1)[:, : self.k]
        self.keys, self.scores = np.take_along_axis(every, order, 1), np.take_along_axis(score, order, 1)

    def columns(self) -> list[pa.Array]:
        return [pa.array(np.repeat(self.ids, self.keys.shape[1])), pa.array(self.keys.ravel()), pa.array(self.scores.ravel())]


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if not rows:
        return np.zeros((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(rows, -1).astype(np.float64)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", query_key: str = "query_id", block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """The nearest rows to each query: query, rank, key, score.

    Up to ``block`` queries go to the workers, which multiply each batch of vectors with them as it is read. More queries
    and the vectors are cut into blocks by their keys' hashes, and a task gets a block of each: a grid in one plan that reads
    both tables once, whatever the number of queries, and takes nothing to the driver. Blocks smaller than ``QUERY_BLOCK`` and
    ``VECTOR_BLOCK`` are as large as asked for while there are up to ``ACROSS`` and ``DOWN`` of them, and grow beyond, so each
    vector is sent to ``ACROSS`` tasks at most until blocks are full. A task sends on the best k for each of
    its queries, so what is ranked is k rows a query and block of vectors.
    """
    found = _by_broadcast(vectors, queries, k, key, query_key) if queries.count() <= block else _by_grid(vectors, queries, k, key, query_key, block, vector_block)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_broadcast(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str) -> DataFrame:
    few = queries.select(query_key, "embedding").toPandas()
    ids = few[query_key].to_numpy(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array(few["embedding"].tolist(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(*shared.value, k)
        for batch in batches:
            held.add(batch.column(0).to_numpy(), _matrix(batch.column(1), len(batch)))
        if held.keys.size:
            yield pa.RecordBatch.from_arrays(held.columns(), [query_key, key, "score"])

    return vectors.select(F.col(key).cast("long").alias(key), "embedding").mapInArrow(best, f"{query_key} long, {key} long, score double")


def blocks(rows: int, size: int, most: int, few: int) -> int:
    """The number of blocks of ``size`` rows; more than ``few`` of them grow to ``most`` rows each."""
    wanted = max(1, -(-rows // size))
    return max(min(wanted, few), min(wanted, -(-rows // most)))


def _by_grid(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, block: int, vector_block: int) -> DataFrame:
    across, down = blocks(queries.count(), block, QUERY_BLOCK, ACROSS), blocks(vectors.count(), vector_block, VECTOR_BLOCK, DOWN)
    of = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.select(F.col(key).cast("long").alias(key), "embedding", of(key, down).alias("_v")).withColumn("_q", every(across))
    right = queries.select(F.col(query_key).cast("long").alias(query_key), "embedding", of(query_key, across).alias("_q")).withColumn("_v", every(down))

    def best(vs: pa.Table, qs: pa.Table) -> pa.Table:
        held = _Best(qs.column(query_key).to_numpy(), _matrix(qs.column("embedding"), len(qs)), k)
        for at in range(0, len(vs) if len(qs) else 0, STRIP):
            strip = vs.slice(at, STRIP)
            held.add(strip.column(key).to_numpy(), _matrix(strip.column("embedding"), len(strip)))
        return pa.Table.from_arrays(held.columns(), [query_key, key, "score"])

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(best, f"{query_key} long, {key} long, score double")


def cited_context(hits: DataFrame, budget: int, order: list, tokenizer: tx.Tokenizer = tx.WHITE_SPACE) -> DataFrame:
    """Hits in rank order that fit, by the tokens of their bare texts, each with its citation."""
    kept = fill(hits, tokenizer.count("text"), budget, order, spread=False)  # hits are the best k
    return kept.withColumn("cited", F.concat(F.format_string("[Source: %s, Score: %.3f]\n", "source", "score"), "text"))


def stored_cost() -> Column:
    """Stored tokens of a hit, or a quarter of its characters where there are none."""
    return F.coalesce(F.when(F.col("token_count") != 0, F.col("token_count")), F.floor(F.length("text") / 4))


def hashed(text: str, dim: int) -> Column:
    """The offline embedder: token counts by buckets of token lengths and first characters, of unit length."""
    bucket = lambda t: F.pmod(F.ascii(t) + F.length(t) * 31, F.lit(dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(F.col(text), lambda t: bucket(t) == i)).cast("double"))
    return tx.normalised(counts)
