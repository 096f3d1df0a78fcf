"""Metrics of fitted candidates, recomputed by plain SQL over their written score tables."""

import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from legwise.operators import modelling as M
from legwise.session import fresh_path

METRICS = """
WITH s AS (SELECT label, p FROM '{path}/*.parquet'),
totals AS (SELECT SUM(label) AS pos, COUNT(*) - SUM(label) AS neg FROM s),
ranked AS (SELECT label, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2 AS place FROM s),
steps AS (SELECT p, SUM(label) AS hits, SUM(SUM(label)) OVER (ORDER BY p DESC) AS tp, SUM(COUNT(*)) OVER (ORDER BY p DESC) AS alerts FROM s GROUP BY p),
at_half AS (SELECT COUNT(*) FILTER (label = 1 AND p >= 0.5) AS tp, COUNT(*) FILTER (label = 0 AND p >= 0.5) AS fp,
  COUNT(*) FILTER (label = 1 AND p < 0.5) AS fn, COUNT(*) AS n FROM s)
SELECT (SELECT SUM(place) FILTER (label = 1) - pos * (pos + 1) / 2 FROM ranked, totals GROUP BY pos, neg) / (pos * neg) AS roc_auc,
  (SELECT SUM(hits / pos * tp / alerts) FROM steps) AS pr_auc, (SELECT AVG((p - label) ** 2) FROM s) AS brier,
  (SELECT -AVG(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) FROM s) AS log_loss, (SELECT AVG(label) FROM s) AS base_rate,
  (SELECT (n - fp - fn) / n FROM at_half) AS accuracy, (SELECT COALESCE(tp / NULLIF(tp + fp, 0), 0) FROM at_half) AS precision,
  (SELECT COALESCE(tp / NULLIF(tp + fn, 0), 0) FROM at_half) AS recall, (SELECT COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) FROM at_half) AS f1
FROM totals
"""


def lines(spark, rows, seed):
    """Numbers with ties, a category, and a label that follows them in degrees."""
    z = F.col("a") / 4 + F.col("b") * 2 - 2 + F.when(F.col("c") == "x", 1.0).otherwise(0.0)
    made = spark.range(rows).select(
        F.col("id").alias("key"), F.floor(F.rand(seed) * 8).cast("double").alias("a"), F.round(F.rand(seed + 1), 1).alias("b"),
        F.when(F.rand(seed + 2) < 0.4, "x").otherwise("y").alias("c"), F.rand(seed + 3).alias("u"))
    return made.select("key", "a", "b", "c", (F.col("u") < 1 / (1 + F.exp(-z))).cast("int").alias("label"))


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_metrics_are_those_of_plain_sql(spark, kind):
    train, valid = lines(spark, 2000, 1), lines(spark, 1500, 21)
    fitted = {
        "logistic": lambda: M.fit_logistic(train, ["a", "b"], ["c"], "label"),
        "forest": lambda: M.fit_forest(train, ["a", "b"], ["c"], "label", numTrees=5, maxDepth=4),
        "boosted": lambda: M.fit_boosted(train, valid, ["a", "b"], ["c"], "label", patience=3, maxDepth=3, maxIter=12),
    }[kind]()
    path = fresh_path(spark, "scores")
    fitted.predict(valid).select("key", "label", "p").write.parquet(path)
    scored = spark.read.parquet(path)
    got = M.quality_row(scored, "label", "key", fitted.name).first().asDict()
    con = duckdb.connect()
    found = con.execute(METRICS.format(path=path.removeprefix("file:")))
    names, values = [d[0] for d in found.description], found.fetchone()
    for name, want in zip(names, values):
        assert got[name] == pytest.approx(float(want), abs=1e-9), name
    # random scores have an area of a half
    assert got["roc_auc"] > 0.6
    best = con.execute(f"SELECT label FROM '{path.removeprefix('file:')}/*.parquet' ORDER BY p DESC, key LIMIT 150").fetchall()
    assert got["lift_top_decile"] == pytest.approx(sum(x for x, in best) / 150 / got["base_rate"], abs=1e-9)


def test_candidates_are_judged_side_by_side(spark, monkeypatch):
    met, plain = threading.Barrier(2, timeout=60), M.quality_row

    def judged(*args):
        met.wait()
        return plain(*args)

    monkeypatch.setattr(M, "quality_row", judged)
    valid = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    score = lambda divisor: lambda df: df.withColumn("p", (F.col("key") % divisor) / F.lit(divisor))
    made = [M.Fitted(name, score(divisor), None, [], 1.0, rounds) for name, divisor, rounds in (("blunt", 7, None), ("sharp", 3, 4))]
    got = M.compare(made, valid, "label", "key").collect()
    assert {r["model"]: r["rounds"] for r in got} == {"blunt": None, "sharp": 4}
    assert got[0]["pr_auc"] >= got[1]["pr_auc"]
