"""Statistics of tables with many columns, where a row is never unfolded by column.

Each task keeps one counter table for all columns and sends it once, after its last batch, so the
shuffle grows with tasks and columns, not with rows. NULL and NaN are missing values throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legwise.session import settle

ACCURACY = 10_000
MARGIN = 3 / ACCURACY
CELLS = 256
# two places of the last digit: a mean this close to all its values is the value itself
SAME = 4e-16


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The first ``width`` columns as one matrix; missing values are NaN."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1).astype(np.float64, copy=False)


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])


class Moments:
    """Counts, means, squared deviations and co-deviations of every pair of columns, over the rows that have both.

    Entry [a, b] of ``mean`` and ``square`` belongs to column a among the rows where b is known as well.
    """

    def __init__(self, width: int):
        self.n, self.mean, self.square, self.shared, self.infinite = (np.zeros((width, width)) for _ in range(5))

    def add(self, x: np.ndarray) -> None:
        endless = np.isinf(x)
        if endless.any():
            there = (~np.isnan(x)).astype(np.float64)
            met = endless.T.astype(np.float64) @ there
            self.infinite += met + met.T
        known = np.isfinite(x)
        counts = known.sum(axis=0)
        filled = np.where(known, x, 0.0)
        low, high = np.where(known, x, np.inf).min(axis=0), np.where(known, x, -np.inf).max(axis=0)
        centre = np.where(low == high, np.where(counts > 0, low, 0.0), filled.sum(axis=0) / np.maximum(counts, 1))
        z, m = np.where(known, x - centre, 0.0), known.astype(np.float64)
        n, sums, squares = m.T @ m, z.T @ m, (z * z).T @ m
        some = np.maximum(n, 1)
        square = squares - sums * sums / some
        square = np.where(square <= 1e-12 * squares, 0.0, square)
        self.merge(n, centre[:, None] + sums / some, square, z.T @ z - sums * sums.T / some)

    def merge(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, shared: np.ndarray) -> None:
        total = self.n + n
        step = np.where(n > 0, mean - self.mean, 0.0)
        weight = self.n * n / np.maximum(total, 1)
        self.square += np.where(n > 0, square, 0.0) + step * step * weight
        self.shared += np.where(n > 0, shared, 0.0) + step * step.T * weight
        self.mean += step * n / np.maximum(total, 1)
        self.n = total


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation (a, b, r) of every pair of columns, over the rows where both are known; one scan.

    A task holds five numbers per pair of columns, so a table may be some thousand columns wide.
    Without a row, or with a side that does not vary, ``r`` is NULL; with an infinite value it is NaN.
    """
    width = len(columns)
    pairs = list(combinations(range(width), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    left, right = (np.array(side) for side in zip(*pairs))
    names = ("n", "mean_a", "mean_b", "square_a", "square_b", "shared", "infinite")
    schema = pa.schema([("pair", pa.int32()), *[(name, pa.float64()) for name in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments(width)
        for batch in batches:
            if batch.num_rows:
                held.add(_matrix(batch, width))
        ahead, back = (left, right), (right, left)
        rows = (held.n[ahead], held.mean[ahead], held.mean[back], held.square[ahead], held.square[back],
                held.shared[ahead], held.infinite[ahead])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(left)), pa.int32()), *[pa.array(r) for r in rows]], schema=schema)

    parts = settle(_doubles(df, columns).mapInArrow(run, "pair int, " + ", ".join(f"{n} double" for n in names)))
    some = parts.where("n > 0")
    # the tasks' means are taken from one of them, so that a large common level costs no digits
    base = some.groupBy("pair").agg(F.min("mean_a").alias("base_a"), F.min("mean_b").alias("base_b"))
    a, b, n = F.col("mean_a") - F.col("base_a"), F.col("mean_b") - F.col("base_b"), F.col("n")
    sums = some.join(base, "pair").groupBy("pair").agg(
        F.sum("n").alias("n"), F.first("base_a").alias("base_a"), F.first("base_b").alias("base_b"),
        F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"),
        F.sum(F.col("square_a") + n * a * a).alias("aa"), F.sum(F.col("square_b") + n * b * b).alias("bb"),
        F.sum(F.col("shared") + n * a * b).alias("ab"))
    va, vb = F.col("aa") - F.col("sa") ** 2 / n, F.col("bb") - F.col("sb") ** 2 / n
    varies = (va / n > (SAME * F.col("base_a")) ** 2) & (vb / n > (SAME * F.col("base_b")) ** 2)
    r = F.when(varies, (F.col("ab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va) / F.sqrt(vb))
    infinite = parts.groupBy("pair").agg(F.sum("infinite").alias("infinite"))
    named = df.sparkSession.createDataFrame(
        [(i, columns[x], columns[y]) for i, (x, y) in enumerate(pairs)], "pair int, a string, b string")
    return named.join(infinite, "pair", "left").join(sums.select("pair", r.alias("r")), "pair", "left").select(
        "a", "b", F.when(F.col("infinite") > 0, float("nan")).otherwise(F.col("r")).alias("r"))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """Exact linearly interpolated quantiles of each column that has a value.

    A sketch brackets both neighbours of each wanted position. Each pass then cuts the brackets into
    ``CELLS`` cells, counts them inside the tasks and goes on with the cell that holds the position, between its
    least and greatest value, until they are the same. The driver sees two rows per column and probability.
    """
    rows = _doubles(df, columns)
    rows = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in rows.columns])
    ends = [min(1.0, max(0.0, p + side * MARGIN)) for p in probabilities for side in (-1, 1)]
    asked = F.array(*[F.lit(e) for e in ends])
    told = rows.agg(*[c for x in rows.columns for c in (
        F.count(x).alias(f"n{x}"), F.percentile_approx(x, asked, ACCURACY).alias(f"e{x}"))]).first()
    # one entry per target: column, wanted place from 0, bracket
    spots, targets = {}, []
    for c in range(len(columns)):
        n = told[f"n_x{c}"]
        for i, p in enumerate(probabilities if n else []):
            spot = (n - 1) * p
            spots[c, i] = (spot, len(targets))
            low, high = told[f"e_x{c}"][2 * i:2 * i + 2]
            targets += [[c, int(np.floor(spot)), low, high], [c, int(np.ceil(spot)), low, high]]
    open_ones = list(range(len(targets)))
    while open_ones:
        for t, least, most in _cell_of(rows, targets, open_ones):
            targets[t][2:] = [least, most]
        open_ones = [t for t in open_ones if targets[t][2] < targets[t][3]]
    return {columns[c]: [_between(*spots[c, i], targets) for i in range(len(probabilities))]
            for c in range(len(columns)) if (c, 0) in spots}


def _between(spot: float, first: int, targets: list) -> float:
    low, high = targets[first][2], targets[first + 1][2]
    return low + (high - low) * (spot - np.floor(spot)) if high != low else low


def _cell_of(rows: DataFrame, targets: list, open_ones: list[int]) -> list[tuple]:
    """(target, least, most): the ends of the values in the cell that holds the place of each open target.

    All values below the bracket, and all above it, are cells too, so a sketch that missed a place costs passes only.
    """
    width = len(rows.columns)
    by_column: dict[int, list[int]] = {}
    for t in open_ones:
        by_column.setdefault(targets[t][0], []).append(t)
    where = {t: i for i, t in enumerate(open_ones)}
    fixed = [tuple(t) for t in targets]
    # cell 0 lies below the bracket, cells 1 to CELLS inside, the last one above
    schema = pa.schema([("target", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(open_ones), CELLS + 2)
        n, least, most = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            for c, wanted in by_column.items():
                x = batch.column(c).to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)])
                if not len(x):
                    continue
                for t in wanted:
                    low, high, row = *fixed[t][2:], where[t]
                    start, stop = np.searchsorted(x, low, "left"), np.searchsorted(x, high, "right")
                    inside = x[start:stop]
                    wide = high * 0.5 - low * 0.5
                    if np.isfinite(wide) and wide > 0:
                        cell = np.minimum((inside * 0.5 - low * 0.5) / wide * CELLS, CELLS - 1).astype(np.int64)
                    else:
                        cell = np.where(inside == low, 0, np.where(inside == high, CELLS - 1, 1))
                    for place, part in ((0, x[:start]), (CELLS + 1, x[stop:])):
                        if len(part):
                            n[row, place] += len(part)
                            least[row, place], most[row, place] = min(least[row, place], part[0]), max(most[row, place], part[-1])
                    if len(inside):
                        n[row, 1:-1] += np.bincount(cell, minlength=CELLS)
                        np.minimum.at(least[row, 1:-1], cell, inside)
                        np.maximum.at(most[row, 1:-1], cell, inside)
        row, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.array(open_ones, np.int64)[row], pa.int32()), pa.array(cell, pa.int32()),
            pa.array(n[row, cell]), pa.array(least[row, cell]), pa.array(most[row, cell])], schema=schema)

    counted = rows.mapInArrow(run, "target int, cell int, n bigint, least double, most double").groupBy("target", "cell").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    place = rows.sparkSession.createDataFrame([(t, targets[t][1]) for t in open_ones], "target int, place bigint")
    upto = F.sum("n").over(Window.partitionBy("target").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    met = counted.join(F.broadcast(place), "target").withColumn("upto", upto)
    # at most CELLS + 2 rows per target, two targets per column and probability
    holds = met.where("upto > place AND upto - n <= place").collect()
    return [(r["target"], r["least"], r["most"]) for r in holds]


def label_histograms(df: DataFrame, columns: list[str], edges: dict[str, list[float]], label: str) -> DataFrame:
    """(feature, bin, y, n): rows per column, bin and 0/1 label, counted inside the tasks.

    The bin is the number of edges below the value, -1 for a missing value; ``y`` is NULL for a missing label.
    """
    cuts = [np.array(edges.get(c, []), np.float64) for c in columns]
    width, most = len(columns), max([len(c) for c in cuts], default=0) + 2
    schema = pa.schema([("place", pa.int32()), ("bin", pa.int32()), ("y", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((width, most, 3), np.int64)
        for batch in batches:
            y = batch.column(width).to_numpy(zero_copy_only=False).astype(np.float64)
            y = np.where(np.isnan(y), 2, y != 0).astype(np.int64)
            for i, cut in enumerate(cuts):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                spot = np.where(np.isnan(x), 0, np.searchsorted(cut, x, "left") + 1)
                n[i] += np.bincount(spot * 3 + y, minlength=most * 3).reshape(most, 3)
        i, spot, y = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(i, pa.int32()), pa.array(spot - 1, pa.int32()), pa.array(y, pa.int32()), pa.array(n[i, spot, y])], schema=schema)

    rows = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("_y"))
    cells = rows.mapInArrow(run, "place int, bin int, y int, n bigint").groupBy("place", "bin", "y").agg(F.sum("n").alias("n"))
    return cells.select(F.get(F.lit(columns), F.col("place")).alias("feature"), "bin",
                        F.when(F.col("y") < 2, F.col("y")).alias("y"), "n")
