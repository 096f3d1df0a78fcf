"""Whitening of embeddings with components from spectral divide-and-conquer.

A component becomes the whole number floor(64 c) + 1,000,000, so all sums are exact. The fit
list has each distinct vector once. Its covariance V comes from one Spark pass over the list: tasks add up products
of differences from a whole number near the mean, in whole numbers, and return one small matrix each.

The eigenvectors are found without a library's eigensolver. The polar factor U of V - sI, by the
dynamically weighted Halley iteration (QDWH, on QR decompositions), is the matrix sign: (U + I) / 2
projects on the components with eigenvalues over s. A basis of its range and of the rest splits V into two
smaller problems, again and again, until a problem is one number or a multiple of the identity.
What is sent to the tasks is dimensions x 16 numbers.

Defined cases: null vectors, empty ones and those with null or non-finite components are dropped, then those of
another length than most rows have (of ties the greater length); components beyond +-2**40 count as
that; repeated vectors count once in the fit; directions without variance are no components, so a constant
table and a single vector give no rows; rows without vec_id are whitened like others; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.llm.text import slices
from legwise.session import settle

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 40)
EXACT = 1 << 53
BATCH_ROWS = 4096


def whole_numbers(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector is complete."""
    known = rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("c"))
    fine = F.forall("c", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    level = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * SCALE).cast("double")))
    bounded = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c))
    whole = F.transform("c", lambda c: level(bounded(c)).cast("bigint") + SHIFT)
    return known.where(F.col("c").isNotNull() & (F.size("c") > 0) & fine).select("vec_id", whole.alias("x"))


def _numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def sums(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every component."""
    spread = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (spread[0].n, [int(r.s) for r in spread]) if spread else (0, [0] * dimensions)


def products(fit: DataFrame, centre: list[int]) -> list[list[int]]:
    """Exact sums of products of differences from ``centre``, component by component."""
    d, middle = len(centre), np.array(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in slices(batches, BATCH_ROWS):
            y = _numbers(batch.column(0), d) - middle
            # doubles are whole-number arithmetic as long as no sum reaches 2**53
            if int(np.abs(y).max(initial=0)) ** 2 * len(y) < EXACT:
                total += (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
            else:
                total += y.T.astype(object) @ y.astype(object)
        where = np.indices((d, d)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where[0]), pa.array(where[1]), pa.array([Decimal(v) for v in total.ravel()], pa.decimal128(38, 0))],
            names=["i", "j", "v"])

    parts = fit.select("x").mapInArrow(add, "i int, j int, v decimal(38,0)")
    out = [[0] * d for _ in range(d)]
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i][r.j] = int(r.v)
    return out


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the QDWH iteration."""
    k = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the least singular value; far too small a bound costs a step or two
    low, eps = np.finfo(float).eps / math.sqrt(k), np.finfo(float).eps
    eye = np.eye(k)
    for _ in range(40):
        square = low * low
        step = (4 * (1 - square) / (square * square)) ** (1 / 3) if low < 1 else 0.0
        root = math.sqrt(1 + step)
        wa = root + 0.5 * math.sqrt(8 - 4 * step + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:k] @ q[k:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        low, x = min(1.0, low * (wa + wb * square) / (1 + wc * square)), new
        if moved < 10 * eps ** (1 / 3) * 1e-3 and abs(1 - low) < 10 * eps:
            break
    return x


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range, from two rounds of subspace iteration."""
    start = np.random.default_rng(rank).standard_normal((len(projector), rank))
    q, _ = np.linalg.qr(projector @ start)
    q, _ = np.linalg.qr(projector @ q)
    return q


def _split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces with eigenvalues over and under a shift, or None where no shift parts them."""
    k = len(a)
    centre, spread = np.trace(a) / k, np.linalg.norm(a - np.trace(a) / k * np.eye(k)) / math.sqrt(k)
    best = None
    for step in (0.0, 0.13, -0.13, 0.31, -0.31, 0.57, -0.57):
        sign = polar_factor(a - (centre + step * spread) * np.eye(k))
        projector = (sign + np.eye(k)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < k:
            continue
        above, below = _range(projector, rank), _range(np.eye(k) - projector, k - rank)
        whole, _ = np.linalg.qr(np.hstack([above, below]))
        above, below = whole[:, :rank], whole[:, rank:]
        left = np.linalg.norm(below.T @ a @ above)
        if best is None or left < best[0]:
            best = (left, above, below)
        if left <= 4 * k * np.finfo(float).eps * size:
            break
    return best and best[1:]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, by spectral divide-and-conquer."""
    size = np.linalg.norm(a)

    def divide(part: np.ndarray, basis: np.ndarray) -> np.ndarray:
        off = part - np.diag(np.diag(part))
        if len(part) == 1 or np.linalg.norm(off) <= np.finfo(float).eps * size:
            return basis
        halves = _split(part, size)
        if halves is None:
            return basis
        return np.hstack([divide((h.T @ part @ h + (h.T @ part @ h).T) / 2, basis @ h) for h in halves])

    vectors = divide(a, np.eye(len(a)))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitener:
    """Fitted sums, components and their scales."""

    def __init__(self, n: int, total: list[int], centre: list[int], gram: list[list[int]], most: int):
        self.n, self.centre = n, centre
        d = len(total)
        self.rest = [s - n * c for s, c in zip(total, centre)]
        # n * n * V in whole numbers, divided once
        v = np.array([[(n * gram[i][j] - self.rest[i] * self.rest[j]) / (n * n) for j in range(d)] for i in range(d)])
        values, vectors = eigenvectors(v)
        least = max(values[0], 0) * d * 1e-13
        kept = int((values > least).sum()) if values[0] > 0 else 0
        self.kept = min(most, kept)
        self.values, self.vectors = values[:self.kept], vectors[:, :self.kept]
        self.explained = self.values / np.trace(v) if self.kept else self.values
        self.identity_error = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of whole numbers."""
        y = x - np.array(self.centre)
        return (y - np.array([r / self.n for r in self.rest])) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S) squared."""
        y, n, rest = x - np.array(self.centre), self.n, self.rest
        most = (n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))) ** 2 * len(rest)
        if most < 1 << 62:
            z = n * y - np.array(rest)
            return (z * z).sum(axis=1).tolist()
        z = n * y.astype(object) - np.array(rest, object)
        return (z * z).sum(axis=1).tolist()


def fit(whole: DataFrame, dimensions: int, most: int = COMPONENTS) -> Whitener | None:
    """The whitener of the distinct vectors of ``whole``; None if there is no variance."""
    vectors = settle(whole.select("x").distinct())
    n, total = sums(vectors, dimensions)
    if n < 2:
        return None
    centre = [round(s / n) for s in total]
    found = Whitener(n, total, centre, products(vectors, centre), most)
    if not found.kept:
        return None
    k, known = found.kept, whole.sparkSession.sparkContext.broadcast(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in slices(batches, BATCH_ROWS):
            w = known.value.apply(_numbers(batch.column(0), dimensions))
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        where = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(where[0]), pa.array(where[1]), pa.array(total.ravel())], names=["i", "j", "v"])

    seen = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        seen[r.i, r.j] = r.v / n
    found.identity_error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    return found


def whiten(rows: DataFrame, most: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every complete row and component.

    ``deviation`` is decimal(38,0): its square sums outgrow a long beyond some ten million distinct vectors.
    """
    spark = rows.sparkSession
    whole = whole_numbers(rows, id_column, vector_column)
    common = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimensions = common.d if common else 0
    whole = settle(whole.where(F.size("x") == dimensions))
    found = fit(whole, dimensions, most) if common else None
    kind = whole.schema["vec_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), "
                                         "whitened double, explained double, identity_error double")
    known = spark.sparkContext.broadcast(found)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            x = _numbers(batch.column(1), dimensions)
            w = known.value.apply(x)
            far = pa.array([Decimal(v) for v in known.value.deviation(x)], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], names=["vec_id", "deviation", "w"])

    shown = whole.mapInArrow(apply, f"vec_id {kind}, deviation decimal(38,0), w array<double>")
    share = F.array(*[F.lit(float(v)) for v in found.explained])
    return shown.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(found.identity_error).alias("identity_error"))
