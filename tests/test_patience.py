"""Boosting ends where the validation loss is least."""

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from legwise.operators import modelling as M
from legwise.session import settle


def test_patient_round():
    assert M.patient_round([3, 2, 1, 2, 2, 2], 3) == (3, True)
    assert M.patient_round([3, 2, 2, 2, 1], 3) == (5, False)
    assert M.patient_round([3, 2, 2, 2, 2, 1], 3) == (2, True)
    assert M.patient_round([1], 50) == (1, False)


def graded(spark, rows, seed):
    """A label whose chance follows two numbers smoothly."""
    z = F.sin(F.col("a") * 6) * 2 + F.col("b") * 3 - 1.5
    return spark.range(rows).select(F.rand(seed).alias("a"), F.rand(seed + 1).alias("b"), F.rand(seed + 2).alias("u")).select(
        "a", "b", (F.col("u") < 1 / (1 + F.exp(-z))).cast("int").alias("y"))


def test_kept_rounds_are_the_minimum_of_the_validation_loss(spark):
    train, valid = graded(spark, 3000, 1), graded(spark, 3000, 11)
    prepare = M.tree_vector(train, ["a", "b"], [])
    rows, judged = [settle(prepare(df).select("features", "y")) for df in (train, valid)]
    options = {"maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 0.85}
    learner = GBTClassifier(labelCol="y", featuresCol="features", seed=M.SEED, maxIter=80, **options)
    model, losses = M.fit_patiently(learner, rows, judged, patience=12)
    # the loss of every round of one plain fit tells the same minimum
    plain = GBTClassifier(labelCol="y", featuresCol="features", seed=M.SEED, maxIter=len(losses), **options).fit(rows)
    want = plain.evaluateEachIteration(judged)
    assert len(model.trees) == want.index(min(want)) + 1 > 3
    assert len(losses) >= len(model.trees) + 12 and losses == want
    assert abs(model.evaluateEachIteration(judged)[-1] - min(want)) < 1e-12


def test_fitted_reports_its_rounds(spark):
    fitted = M.fit_boosted(graded(spark, 800, 1), graded(spark, 800, 5), ["a", "b"], [], "y", patience=3, maxDepth=2, maxIter=20)
    assert fitted.rounds == len(fitted.model.trees) <= len(fitted.losses)
    assert M.fit_boosted(graded(spark, 800, 1), None, ["a", "b"], [], "y", maxDepth=2, maxIter=2).rounds is None
