"""Whitened embeddings by a one-sided Jacobi singular value decomposition over blockwise QR.

Rows whose vector is null, empty, or holds null or non-finite entries go. Each entry c of the others becomes the integer
floor(1024 c) + 100000. Sums of each dimension are exact. Each task then compresses its centred rows, block by block, to a
triangular R (QR of the R so far on top of a block); R's of tasks are stacked and compressed sixteen at a time until one is
left. Its columns have the inner products of all rows' columns, without their being squared: plane rotations make them
orthogonal two by two, until no pair is further from it than rounding is. The lengths of the columns are then
the standard deviations (times the root of n), small ones as exact as large ones, and the rotations, multiplied up, the
components. Each component's largest entry is positive.

R has as many rows as a vector has dimensions (``MOST`` at most), whatever the number of rows, so it may pass through a
task and the driver. Components whose deviation is below ``LEAST`` of the largest are rounding noise, as of dimensions that
repeat others, and are left out; a table of equal vectors, or of a single one, has none and gives no rows. Of vectors of several
lengths those of the commonest length count (of several such the longest), others go, and so do finite entries too large
for a long. A deviation that doesn't fit a long is null. Null and repeated ids are rows like any other. Other columns
are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
MOST, LEAST, BLOCK, FAN = 4096, 1e-12, 4096, 16
#: Entries whose integer is beyond this aren't exact any more.
LARGEST = 2.0**52


@dataclass
class Fit:
    """What the fit list gives: rows, sums by dimension, components as columns, and standard deviations of all of them."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    variance: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / self.deviations


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): remaining rows of the commonest length."""
    exact = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    right = F.forall(exact, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & right)
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).head()
    d = size["d"] if size else 0
    if d > MOST:
        raise ValueError(f"vectors of over {MOST} dimensions")
    return rows.where(F.size("embedding") == d).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of a list column as matrices of at most ``BLOCK`` rows."""
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        yield part.flatten().to_numpy().reshape(len(part), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for x in _blocks(batch.column(0)):
                # blocks of 4096 entries below 2^52 may not fit a long: high and low parts do
                high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
                found = [(h << 26) + w for h, w in zip(high, low)]
                n, total = n + len(x), found if total is None else [a + b for a, b in zip(total, found)]
        if n:
            import decimal

            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(map(decimal.Decimal, total), pa.decimal128(38, 0))], ["k", "n", "s"])

    found = rows.select("x").mapInArrow(add, "k int, n long, s decimal(38,0)").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = sorted((r["k"], r["n"], int(r["s"])) for r in found.collect())  # a row for each dimension
    return (found[0][1] if found else 0), [s for _, _, s in found]


def triangle(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of all centred rows."""
    mean = np.array([s / n for s in total])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(mean)))
        for batch in batches:
            for x in _blocks(batch.column(0)):
                r = np.linalg.qr(np.vstack((r, x - mean)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def stack(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        r = np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, len(mean)) for b in table.column("r").to_pylist()]), mode="r")
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    # a row for each task; as a written table it isn't worked out again for each level
    parts = common.stored(rows.select("x").mapInArrow(compress, "part long, r binary"), "triangles")
    last = parts.agg(F.max("part")).head()[0]
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(stack, "part long, r binary")
        last //= FAN
    return np.frombuffer(parts.head()["r"]).reshape(-1, len(mean))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by plane rotations of pairs of columns.

    In each round all columns are paired off, so the rotations of a round don't meet; d - 1 rounds take each pair once.
    """
    d = r.shape[1]
    a = np.zeros((len(r), d + d % 2))
    a[:, :d] = r
    v = np.eye(d + d % 2)
    ring = list(range(a.shape[1]))
    half = len(ring) // 2
    tolerance = np.finfo(float).eps * max(1, len(r)) ** 0.5
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = np.array(ring[:half]), np.array(ring[half:][::-1])
            ap, aq = a[:, p], a[:, q]
            pp, qq, pq = (ap * ap).sum(axis=0), (aq * aq).sum(axis=0), (ap * aq).sum(axis=0)
            size = np.sqrt(pp) * np.sqrt(qq)
            away = np.divide(np.abs(pq), size, out=np.zeros(half), where=size > 0)
            worst = max(worst, float(away.max(initial=0.0)))
            turn = away > tolerance
            if turn.any():
                p, q, pp, qq, pq = p[turn], q[turn], pp[turn], qq[turn], pq[turn]
                z = (qq - pp) / (2 * pq)
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    mp, mq = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= tolerance:
            break
    values = np.sqrt((a * a).sum(axis=0))[:d] if d % 2 == 0 else np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-values, kind="stable")[:d]
    vectors = v[:d, order]
    return values[order], vectors / np.sqrt((vectors * vectors).sum(axis=0, keepdims=True)).clip(min=np.finfo(float).tiny)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """The first components of ``integers``' rows, at most ``most``; None without rows."""
    n, total = sums(rows)
    if not n:
        return None
    values, vectors = jacobi(triangle(rows, n, total))
    m = int((values[:most] > LEAST * values[0]).sum()) if len(values) and values[0] > 0 else 0
    vectors = vectors[:, :m] * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)[:m]
    return Fit(n, total, vectors, values[:m] / n**0.5, float((values**2).sum() / n))


def identity_error(rows: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    m = found.components.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((m + 1, m))
        for batch in batches:
            for x in _blocks(batch.column(0)):
                w = shared.value.whitened(x)
                products += np.vstack((w.T @ w, w.sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(products.size), pa.int32()), pa.array(products.ravel())], ["k", "s"])

    sent = rows.select("x").mapInArrow(multiply, "k int, s double").groupBy("k").agg(F.sum("s").alias("s"))
    products = np.zeros((m + 1) * m)
    for r in sent.collect():  # 72 rows at most
        products[r["k"]] = r["s"]
    products = products.reshape(m + 1, m) / found.n
    covariance = products[:m] - np.outer(products[m], products[m])
    return float(np.abs(covariance - np.eye(m)).max(initial=0.0))


def _deviation(x: np.ndarray, found: Fit) -> list[int | None]:
    """The exact sums over dimensions of (n x - S)^2; null where they don't fit a long."""
    reach = max(int(np.abs(x).max(initial=0)) * found.n + max(map(abs, found.sums)), 1)
    if reach * reach * x.shape[1] < 1 << 63:
        return ((x * found.n - np.array(found.sums, np.int64)) ** 2).sum(axis=1).tolist()
    away = x.astype(object) * found.n - np.array(found.sums, object)
    return [s if s < 1 << 63 else None for s in (away**2).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each remaining row and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors)
    found = fit(rows, most)
    if found is None or not found.components.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    m, error = found.components.shape[1], identity_error(rows, found)
    shares = found.deviations**2 / found.variance
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1)):
                ids = batch.column(0).slice(at, len(x))
                at += len(x)
                each = pa.array(np.repeat(np.arange(len(x)), m))
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, found.n)),
                    pa.array(_deviation(x, shared.value), pa.int64()).take(each), pa.array(shared.value.whitened(x).ravel()), pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(x) * m, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
