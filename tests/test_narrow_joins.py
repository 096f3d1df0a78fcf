"""The flight plan does costly steps once and joins its side tables while rows are narrow."""

import re

from pyspark.sql import functions as F

from legwise.catalog import serving
from legwise.catalog.frames import Tables
from legwise.catalog.serving import clean_tables, raw_tables
from legwise.operators import quality
from legwise.operators.projections import select_apart
from legwise.operators.quantiles import exact_medians
from legwise.plans import flights as P
from legwise.session import settle


def made(spark, folder):
    spark.range(5).select(F.col("id").alias("r_regionkey"), F.concat(F.lit("R"), "id").alias("r_name"), F.lit("").alias("r_comment")).write.parquet(f"{folder}/region.parquet")
    spark.range(25).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), (F.col("id") % 5).alias("n_regionkey"), F.lit("").alias("n_comment")).write.parquet(f"{folder}/nation.parquet")
    i = F.col("id")
    spark.range(400).select(
        i.alias("event_id"), F.timestamp_seconds(1704067200 + i * 1800).alias("ts"), (i % 20).alias("user_id"), F.lit("click").alias("event_type"),
        (i % 37 + 0.5).alias("value"), F.concat(F.lit('{"k": '), i % 70, F.lit("}")).alias("props")).write.parquet(f"{folder}/events.parquet")
    return Tables(spark, folder)


def test_no_join_of_a_side_has_more_columns_than_code_is_generated_for(spark, tmp_path):
    integrated = settle(P.integrate(clean_tables(made(spark, str(tmp_path)))))
    plan = P.derive_features(integrated)._jdf.queryExecution().optimizedPlan()
    most, stack, joins = int(spark.conf.get("spark.sql.codegen.maxFields")), [plan], 0
    while stack:
        node = stack.pop()
        stack += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and "flight_id" not in node.condition().toString():
            joins += 1
            assert node.output().size() <= most, node.condition().toString()
    assert joins >= 7


def test_flights_are_judged_once(spark, tmp_path, monkeypatch):
    t = made(spark, str(tmp_path))
    raw = raw_tables(t)
    read = []
    monkeypatch.setattr(quality, "settle", lambda df, go=settle: (read.append(df.columns), go(df))[1])
    flights = P.clean(raw, "seq")[0]["flights"]
    assert any("_verdict" in columns for columns in read)
    assert not re.search(r"events\.parquet", flights._jdf.queryExecution().executedPlan().toString())
    assert flights.count() > 0


def test_a_select_apart_is_no_part_of_the_generated_method(spark):
    df = spark.range(3).select("id", F.array("id").alias("a"), F.lit(None).cast("string").alias("n"))
    got = select_apart(df, {"n": F.col("n"), "twice": F.col("id") * 2, "a": F.col("a")})
    assert got.columns == ["n", "twice", "a"] and [f.dataType for f in got.schema] == [df.schema[c].dataType for c in ("n", "id", "a")]
    assert sorted(map(tuple, got.collect())) == [(None, 2 * i, [i]) for i in range(3)]
    assert "lambdafunction" in got._jdf.queryExecution().optimizedPlan().toString()


def test_served_requests_are_judged_once_and_features_selected_apart(spark, tmp_path, monkeypatch):
    t = made(spark, str(tmp_path))
    written = []
    monkeypatch.setattr(serving, "settle", lambda df, go=settle: (written.append(df), go(df))[1])
    rows = serving.served(t)
    good, features = written[-2:]
    assert "origin_weather" in good.columns and "dep_time_decimal" not in good.columns
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "array_compact" not in plan and "lambdafunction" in plan
    assert rows.count() == good.count() > 0


def test_values_in_brackets_are_filtered_by_generated_code(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    medians = exact_medians(df, ["k"], ["v"])
    assert "lambdafunction" not in medians._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.v for r in medians.collect()} == {0: 99.0, 1: 100.0, 2: 99.5}
