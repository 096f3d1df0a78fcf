"""Fits read every row of their window, however many there are."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from legwise.operators import modelling as M
from legwise.plans import risk_model as R

ROWS = 5_200_000


class Met(Exception):
    """Ends a fit at its learner, with the rows it was given."""


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(0, ROWS, 1, 8).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").alias("upstream_delay_min"))


@pytest.mark.parametrize("fit", [
    lambda df: M.fit_logistic(df, ["a"], [], "y"), lambda df: M.fit_forest(df, ["a"], [], "y"),
    lambda df: M.fit_boosted(df, None, ["a"], [], "y"), lambda df: M.fit_boosted(df, df, ["a"], [], "y", preset="boosted_ordered"),
    lambda df: R.fit(df, "y", ["upstream_delay_min"])])
def test_no_row_is_left_out(many, monkeypatch, fit):
    def met(self, rows):
        raise Met(rows.count())

    for kind in (M.RandomForestClassifier, M.BinnedForestClassifier, M.GBTClassifier, M.BinnedGBTClassifier, Pipeline):
        monkeypatch.setattr(kind, "_fit", met)
    with pytest.raises(Met) as found:
        fit(many)
    assert found.value.args == (ROWS,)
