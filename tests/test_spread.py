"""Fits deal their rows to tasks even where the input is one row group."""

import pytest
from pyspark.sql import functions as F

from legwise import session
from legwise.operators import modelling as M


@pytest.fixture
def one_task(spark):
    return session.settle(spark.range(2500).coalesce(1).select(
        F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y")))


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_large_input_is_dealt_evenly_and_small_input_stays(one_task, monkeypatch):
    assert rows_by_task(session.spread(one_task)) == [2500]
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    found = session.spread(one_task)
    assert len(rows_by_task(found)) == 3 and max(rows_by_task(found)) < 1000
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, one_task.collect()))


def test_no_task_of_a_fit_has_all_rows(one_task, monkeypatch):
    seen = []
    for kind in (M.RandomForestClassifier, M.GBTClassifier):
        monkeypatch.setattr(kind, "_fit", lambda self, rows, go=kind._fit: (seen.append(rows_by_task(rows)), go(self, rows))[1])
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    M.fit_forest(one_task, ["a"], [], "y", numTrees=2, maxDepth=2)
    M.fit_boosted(one_task, None, ["a"], [], "y", maxIter=2, maxDepth=2)
    assert len(seen) == 2 and all(sum(n) == 2500 and max(n) < 2500 for n in seen)
