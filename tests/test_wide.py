"""Statistics of wide tables, held against Spark's own and against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from legwise.operators import wide
from legwise.operators.selection import mutual_information


def noisy(spark, width, rows=3000):
    """Columns of different levels and spreads; every tenth value of a column is missing, by another rule each."""
    made = spark.range(rows).repartition(5)
    gone = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(10)) == 0
    level = lambda i: F.lit(10.0 ** (i % 9))
    value = lambda i: level(i) + (F.pmod(F.xxhash64("id", F.lit(i // 2)), F.lit(1000)) / 7.0) + F.rand(i)
    return made.select("id", *[F.when(~gone(i), value(i)).alias(f"c{i}") for i in range(width)])


def test_correlations_of_135_columns(spark):
    df = noisy(spark, 135).cache()
    names = [f"c{i}" for i in range(135)]
    got = {(r["a"], r["b"]): r["r"] for r in wide.correlation_pairs(df, names).collect()}
    assert len(got) == 135 * 134 // 2
    some = [(f"c{i}", f"c{(i * 7 + 1) % 135}") for i in range(0, 134, 3)] + [("c0", "c1"), ("c8", "c9")]
    some = [(a, b) for a, b in (sorted(p, key=names.index) for p in some) if a != b]
    want = df.agg(*[F.corr(a, b) for a, b in some]).first()
    assert max(abs(got[p] - w) for p, w in zip(some, want)) < 1e-9


def test_correlation_of_odd_columns(spark):
    rows = [(1.0, 0.1, None, 1e15, float("inf"), 1.0, 2.0), (2.0, 0.1, None, 1e15 + 4, 2.0, None, float("nan")),
            (4.0, 0.1, None, 1e15 + 2, 3.0, 5.0, 1.0), (None, 0.1, None, 1e15, 4.0, None, None)]
    df = spark.createDataFrame(rows, "x double, same double, none double, high double, endless double, few double, odd double").repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in wide.correlation_pairs(df, df.columns).collect()}
    assert got["x", "same"] is None and got["x", "none"] is None and got["same", "none"] is None
    assert math.isnan(got["x", "endless"])
    assert got["x", "few"] == pytest.approx(1.0) and got["x", "odd"] == pytest.approx(-1.0)
    assert got["x", "high"] == pytest.approx(np.corrcoef([1, 2, 4], [0, 4, 2])[0, 1], abs=1e-6)
    assert {r["r"] for r in wide.correlation_pairs(df.limit(0), ["x", "few"]).collect()} == {None}
    assert wide.correlation_pairs(df, ["x"]).count() == 0


def test_quantiles_of_columns(spark):
    df = noisy(spark, 6).withColumns({
        "ties": F.col("id") % 3, "signs": F.when(F.col("id") % 2 == 0, -F.exp(F.col("id") % 300)).otherwise(F.col("id") * 1e-300),
        "none": F.lit(None).cast("double"), "one": F.when(F.col("id") == 7, 5.0)}).cache()
    names = [c for c in df.columns if c != "id"]
    asked = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = wide.column_quantiles(df, names, asked)
    frame = df.toPandas()
    assert "none" not in got and got["one"] == [5.0] * 6
    for c in got:
        assert got[c] == pytest.approx(list(frame[c].astype(float).dropna().quantile(asked)), rel=1e-12), c


def test_quantiles_where_the_sketch_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(wide, "ACCURACY", 3)
    monkeypatch.setattr(wide, "CELLS", 4)
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(100_000)) / 8).alias("v"))
    got = wide.column_quantiles(df, ["v"], [0.1, 0.5, 0.9])["v"]
    assert got == pytest.approx(list(df.toPandas()["v"].quantile([0.1, 0.5, 0.9])))


def test_mutual_information_of_many_columns(spark):
    df = noisy(spark, 135, 2000).withColumn("label", (F.col("c0") > 60).cast("int")).fillna({"label": 0})
    got = {r.feature: r.mutual_information for r in mutual_information(df, [f"c{i}" for i in range(135)], "label").collect()}
    assert len(got) == 135 and max(got, key=got.get) == "c0"
    frame = df.toPandas()
    for c in ("c0", "c1", "c77"):
        x, y = frame[c], frame["label"]
        edges = np.unique(x.dropna().quantile([i / 10 for i in range(1, 10)]))
        slot = np.where(x.isna(), -1, np.searchsorted(edges, x, "left"))
        want = sum(
            (p := ((slot == s) & (y == v)).mean()) and p * math.log(p / ((slot == s).mean() * (y == v).mean()))
            for s in set(slot) for v in (0, 1))
        assert got[c] == pytest.approx(max(want, 0), abs=1e-9)
