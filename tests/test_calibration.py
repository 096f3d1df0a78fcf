"""Monotone calibration in slots and joins as of a day, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from legwise.operators import calibration
from legwise.operators.joins import attach_as_of
from legwise.session import fresh_path


def slow_fit(data):
    """max over j <= i of min over k >= i of the mean of j..k, for distinct scores in order."""
    scores = sorted({s for s, _ in data if s is not None})
    hits = [sum(y for s, y in data if s == x) for x in scores]
    n = [sum(1 for s, _ in data if s == x) for x in scores]
    mean = lambda j, k: sum(hits[j:k + 1]) / sum(n[j:k + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i, x in enumerate(scores)}


@pytest.mark.parametrize("slots", [1, 7])
def test_isotonic_in_slots(spark, slots):
    rng = random.Random(3)
    data = [(round(rng.random() ** 2, 2), int(rng.random() < 0.3 + 0.3 * (i % 3 == 0))) for i in range(900)]
    data += [(None, 1)]
    df = spark.createDataFrame(data, "p DOUBLE, y INT")
    fitted = calibration.fit_isotonic(df, "p", "y", slots)
    want = slow_fit(data)
    assert (np.diff(fitted.values) >= 0).all()
    got = {r["p"]: r["c"] for r in fitted.apply(df, "p", "c").collect()}
    assert got.pop(None) is None
    assert got == pytest.approx(want, abs=1e-12)
    path = fresh_path(spark, "calibration")
    fitted.save(spark, path)
    assert calibration.Calibrator.load(spark, path).values.tolist() == fitted.values.tolist()


def test_calibration_is_adopted_only_where_it_wins(spark):
    base = spark.range(4000).select("id", F.rand(5).alias("p"), F.rand(6).alias("u"), (F.col("id") % 2 + 1).alias("half"))
    biased = base.withColumn("y", (F.col("u") < F.col("p") * F.col("p")).cast("int"))
    good = base.withColumn("y", (F.col("u") < F.col("p")).cast("int"))
    won, lost = [calibration.adopt(df, "p", "y", "id", "half") for df in (biased, good)]
    assert won.calibrator and won.ece_isotonic < 0.9 * won.ece_raw
    assert (lost.calibrator is None) == (lost.ece_isotonic >= 0.9 * lost.ece_raw)
    shown = calibration.calibrated(biased, won, "p", "c").select("p", "c").collect()
    assert sum(abs(r["c"] - r["p"] ** 2) for r in shown) / 4000 < 0.05
    none = calibration.adopt(biased.where("false"), "p", "y", "id", "half")
    assert none.calibrator is None


def test_join_as_of(spark):
    rng = random.Random(8)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    versions = {(k, day(rng.randrange(60))): rng.random() for k in "abc" for _ in range(9)}
    facts = [(i, rng.choice("abcd"), day(rng.randrange(70))) for i in range(300)] + [(300, None, day(3)), (301, "a", None)]
    v = spark.createDataFrame([(k, d, x) for (k, d), x in versions.items()], "who STRING, since DATE, x DOUBLE")
    f = spark.createDataFrame(facts, "id INT, k STRING, on DATE")
    got = {r["id"]: r["found"] for r in attach_as_of(f, v, ["k"], ["who"], "on", "since", {"x": "found"}).collect()}
    want = {i: max(((d, x) for (w, d), x in versions.items() if w == k and on and d <= on), default=(None, None))[1] for i, k, on in facts}
    assert got == want


def test_daily_distinct_sketches_unite(spark):
    from legwise.operators.aggregates import distinct_between, distinct_sketches

    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 20).cast("int")).alias("d"),
                                    F.pmod(F.xxhash64("id"), F.lit(9000)).alias("v"))
    kept = distinct_sketches(df, ["k"], "d", "v")
    assert kept.count() == 60
    for first, last in ((1, 20), (4, 9), (7, 7)):
        span = [F.lit(dt.date(2024, 1, n)) for n in (first, last)]
        got = {r["k"]: r["n_distinct"] for r in distinct_between(kept, ["k"], "d", *span).collect()}
        for r in df.where(F.col("d").between(*span)).groupBy("k").agg(F.count_distinct("v").alias("n")).collect():
            assert abs(got[r["k"]] - r["n"]) <= 0.04 * r["n"] + 1
