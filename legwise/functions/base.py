"""Null-aware building blocks used by every other module.

Missing values are always NULL, never NaN. A comparison with a missing value
counts as "no" when it becomes a flag, and stays NULL when it becomes a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that raw feeds use for "not measured".
SENTINELS = (-999.0, -9999.0, 99999.0)


def flag(condition: Column) -> Column:
    """0/1, with an unknown condition counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("tinyint")


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound x and keep NULL as NULL (least/greatest would skip it)."""
    out = x
    if high is not None:
        out = F.when(x > high, F.lit(high).cast("double")).otherwise(out)
    if low is not None:
        out = F.when(x < low, F.lit(low).cast("double")).otherwise(out)
    return out


def positive_part(x: Column) -> Column:
    return clip(x, low=0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL instead of an error or infinity when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows on which the condition holds."""
    return F.avg(flag(condition).cast("double"))


def mean_where(condition: Column, x: Column) -> Column:
    """Aggregate: mean of x over the rows on which the condition holds."""
    return F.avg(F.when(condition, x))


def count_where(condition: Column) -> Column:
    """Aggregate: number of rows on which the condition holds."""
    return F.sum(flag(condition).cast("bigint"))


def band(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open interval (low, high] holding x; NULL outside all of them."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one more edge than labels is needed")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x > low) & (x <= high), F.lit(label)).otherwise(out)
    return out


def nullify(x: Column, markers: Sequence[float | str] = SENTINELS) -> Column:
    """NULL where x is one of the markers."""
    return F.when(x.isin(*markers), F.lit(None)).otherwise(x)


def keep_between(x: Column, low: float, high: float) -> Column:
    """NULL where x lies outside [low, high]."""
    return F.when(x.between(low, high), x)
