"""Forests grown on binned rows that stand once agree with Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from legwise.operators import forest as T
from legwise.operators import modelling as M
from legwise.session import settle


@pytest.fixture(scope="module")
def rows(spark):
    z = F.sin(F.col("a") * 6) * 2 + F.col("b") - 1.5
    made = spark.range(3000).select(F.rand(1).alias("a"), F.floor(F.rand(2) * 5).cast("double").alias("b"), F.rand(3).alias("u")).select(
        "a", "b", (F.col("u") < 1 / (1 + F.exp(-z))).cast("int").alias("y"))
    # every row twice, so that kinds of rows stand for several
    return settle(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(made.union(made)))


def scores(model, rows):
    found = model.transform(rows).orderBy("a", "b").select(vector_to_array("probability")[1])
    return np.array([r[0] for r in found.collect()])


@pytest.mark.parametrize("branch,dealt", [(1_000_000, 400_000_000), (300, 400_000_000), (300, 1000), (1, 1)])
def test_trees_of_spark(rows, monkeypatch, branch, dealt):
    monkeypatch.setattr(T, "BRANCH_KINDS", branch)
    monkeypatch.setattr(T, "DEALT_KINDS", dealt)
    options = {"labelCol": "y", "seed": 42, "numTrees": 2, "maxDepth": 5, "minInstancesPerNode": 30, "bootstrap": False,
               "featureSubsetStrategy": "all"}
    want, got = RandomForestClassifier(**options).fit(rows), T.BinnedForestClassifier(**options).fit(rows)
    told = [m.toDebugString.split("\n", 1)[1] for m in (want, got)]
    assert told[0] == told[1] and got.totalNumNodes > 10
    assert np.allclose(scores(want, rows), scores(got, rows), atol=1e-12)
    assert np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray(), atol=1e-9)


def test_bags_are_those_of_single_rows_and_repeat(rows):
    options = {"labelCol": "y", "seed": 42, "numTrees": 40, "maxDepth": 5, "minInstancesPerNode": 20}
    first, again, spark_ml = [kind(**options).fit(rows) for kind in (T.BinnedForestClassifier, T.BinnedForestClassifier, RandomForestClassifier)]
    assert np.array_equal(scores(first, rows), scores(again, rows))
    assert np.abs(scores(first, rows) - scores(spark_ml, rows)).mean() < 0.03
    # a bag holds as many rows as the table, give or take, whatever a kind stands for
    kept = [t.trees[0]._call_java("rootNode").impurityStats().count() for t in (first, spark_ml)]
    assert all(abs(n - 6000) < 400 for n in kept)
    told = first.transform(rows).withColumn("q", first.chance(vector_to_array("features")))
    assert told.agg(F.max(F.abs(F.col("q") - vector_to_array("probability")[1]))).first()[0] < 1e-12


def test_a_large_table_is_fitted_on_its_kinds(rows, monkeypatch):
    monkeypatch.setattr(M, "ONE_TASK_ROWS", 5000)
    fitted = M.fit_forest(rows.select("a", "b", "y"), ["a", "b"], [], "y", numTrees=3, maxDepth=4)
    assert hasattr(fitted.model, "chance")
    scored = fitted.predict(rows.select("a", "b", "y"))
    assert scored.columns == ["a", "b", "y", "p"] and scored.where("p BETWEEN 0 AND 1").count() == 6000


def test_wrong_labels_are_refused(rows):
    with pytest.raises(Exception, match="labels must"):
        T.BinnedForestClassifier(labelCol="w", numTrees=1).fit(settle(rows.withColumn("w", F.lit(2.0))))
