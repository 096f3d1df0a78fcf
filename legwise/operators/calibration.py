"""Monotone calibration of a score, fitted along slots of the score order.

Rows with one score are counted together. The counted scores are range-partitioned along
the score; adjacent violators are pooled inside each slot, in any number of tasks, and then, once
more, over the slot borders. Pooling may go in any order, so the result is that of one pass over all scores.
What meets in the last task are the blocks left by the slots, rising means of 0/1 labels: of n rows there are at most
about 3 n^(2/3) different ones in a row, however many scores there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legwise.operators import evaluation as E
from legwise.session import settle

SLOT_SCORES = 100_000
ISOTONIC_GAIN = 0.9
BLOCK = "low DOUBLE, high DOUBLE, hits DOUBLE, weight DOUBLE"


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent blocks (low, high, hits, weight), in score order, until their means rise."""
    kept: list[list[float]] = []
    for low, high, hits, weight in blocks.itertuples(index=False):
        block = [low, high, hits, weight]
        # hits / weight compared without division, so equal means are equal
        while kept and kept[-1][2] * block[3] >= block[2] * kept[-1][3]:
            last = kept.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        kept.append(block)
    return pd.DataFrame(kept, columns=["low", "high", "hits", "weight"], dtype=float)


@dataclass
class Calibrator:
    """Scores at the block ends and their calibrated values; values between are interpolated."""

    scores: np.ndarray
    values: np.ndarray

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        known = df.sparkSession.sparkContext.broadcast((self.scores, self.values))

        @F.pandas_udf("double")
        def calibrated(p: pd.Series) -> pd.Series:
            return pd.Series(np.interp(p.to_numpy(float), *known.value)).where(p.notna().to_numpy())

        return df.withColumn(out, calibrated(F.col(score).cast("double")))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(zip(self.scores.tolist(), self.values.tolist())), "score DOUBLE, value DOUBLE").coalesce(
            1).write.parquet(path)

    @classmethod
    def none(cls) -> Calibrator:
        return cls(np.array([]), np.array([]))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibrator | None:
        rows = sorted(tuple(r) for r in spark.read.parquet(path).select("score", "value").collect())
        return cls(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if rows else None


def isotonic_blocks(df: DataFrame, score: str, label: str, slots: int | None = None) -> DataFrame:
    """(low, high, hits, weight) of the blocks of the monotone fit; NULL scores and labels stay out."""
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    counted = settle(df.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("low")).agg(
        F.sum(y).alias("hits"), F.count(F.lit(1)).cast("double").alias("weight")))
    slots = slots or 1 + counted.count() // SLOT_SCORES

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            left = pool(batch if left is None else pd.concat([left, batch]))
        if left is not None:
            yield left

    shaped = counted.select("low", F.col("low").alias("high"), "hits", "weight")
    dealt = shaped.repartitionByRange(slots, "low").sortWithinPartitions("low").mapInPandas(inside, BLOCK)
    # over the borders of the slots
    return settle(dealt).coalesce(1).sortWithinPartitions("low").mapInPandas(inside, BLOCK)


def fit_isotonic(df: DataFrame, score: str, label: str, slots: int | None = None) -> Calibrator | None:
    """The monotone fit, or None without labelled rows."""
    blocks = isotonic_blocks(df, score, label, slots).orderBy("low").collect()
    if not blocks:
        return None
    ends = [(x, r["hits"] / r["weight"]) for r in blocks for x in dict.fromkeys((r["low"], r["high"]))]
    return Calibrator(np.array([e[0] for e in ends]), np.array([e[1] for e in ends]))


@dataclass
class Choice:
    """Calibration errors on the judged half, and the calibrator of the whole window if it is adopted."""

    ece_raw: float
    ece_isotonic: float
    calibrator: Calibrator | None


def adopt(valid: DataFrame, score: str, label: str, key: str, half: str, gain: float = ISOTONIC_GAIN) -> Choice:
    """Fit on the first half of the window and judge on the second; where it wins, refit on the whole window."""
    fitted = fit_isotonic(valid.where(F.col(half) == 1), score, label)
    judged = valid.where(F.col(half) == 2)
    if fitted is None or judged.isEmpty():
        return Choice(float("nan"), float("nan"), None)
    judged = settle(fitted.apply(judged, score, "_calibrated"))
    raw, iso = judged.sparkSession.range(1).select(
        E.calibration_error(judged, label, score, key).scalar(), E.calibration_error(judged, label, "_calibrated", key).scalar()).first()
    return Choice(raw, iso, fit_isotonic(valid, score, label) if iso < raw * gain else None)


def calibrated(df: DataFrame, choice: Choice, score: str, out: str) -> DataFrame:
    """The score as adopted: calibrated, or as it was."""
    return choice.calibrator.apply(df, score, out) if choice.calibrator else df.withColumn(out, F.col(score).cast("double"))


def as_column(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
