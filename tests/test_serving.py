"""Model table, serving, parity and streaming on the smallest tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from legwise.catalog import serving as C
from legwise.catalog.frames import Tables
from legwise.operators import modelling as M
from legwise.operators.splits import chronological_split
from legwise.plans import serving as S
from legwise.plans.features import ALL_FEATURES, BANNED, CATEGORICAL, FEATURE_GROUPS
from legwise.session import fresh_path
from legwise.sources import readers, schemas
from legwise.streaming import scoring

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def test_feature_inventory():
    assert len(ALL_FEATURES) == 135 and not set(ALL_FEATURES) & BANNED
    assert set(CATEGORICAL) <= set(ALL_FEATURES) and len(FEATURE_GROUPS) == 6


def test_model_table_is_complete(tables):
    features = C.all_features(tables)
    assert set(ALL_FEATURES) <= set(features.columns)
    clean = C.clean_tables(tables)["flights"]
    assert features.count() == clean.count() == features.select("flight_id").distinct().count()


def test_split_is_chronological(spark):
    df = spark.createDataFrame([(dt.date(2023, m, 28),) for m in range(1, 13)], "day DATE")
    got = {r["split"]: r for r in chronological_split(df, "day", "2023-06-30", "2023-09-30").groupBy("split").agg(
        F.min("day").alias("lo"), F.max("day").alias("hi")).collect()}
    assert got["train"]["hi"] < got["valid"]["lo"] and got["valid"]["hi"] < got["test"]["lo"]


def test_served_features_equal_batch_features(tables):
    counts = C.parity_counts(*C.parity_rows(tables)).collect()
    assert len(counts) == len(C.SHARED) and not [r for r in counts if r["n_mismatched"]]
    # only weather has a fallback that the batch does not have
    assert all("wx" in r["feature"] or r["feature"] == "dep_gust_factor" for r in counts if r["n_filled"])


def test_a_missing_served_value_is_a_mismatch(spark):
    joined = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, None), (None, None), (4.0, 5.0)], "a DOUBLE, batch_a DOUBLE")
    row = C.parity_counts(joined, ["a"]).first()
    assert (row["n"], row["n_mismatched"], row["n_filled"]) == (5, 2, 1)


def request(**changes):
    base = {f: None for f in ("request_id", "carrier_code", "origin", "destination", "scheduled_departure_local",
                              "scheduled_arrival_local", "flight_number", "tail_number", "aircraft_model",
                              "aircraft_age_years", "seats", "scheduled_turnaround_min", "scheduled_ground_time_min",
                              "prev_leg_arr_delay_min", "prev_leg_dep_delay_min", "aircraft_cum_delay_today",
                              "origin_weather", "dest_weather")}
    return base | {"request_id": "r", "carrier_code": "AA", "origin": "AAA", "destination": "BAA",
                   "scheduled_departure_local": "2024-01-20T18:00:00"} | changes


WEATHER = dict.fromkeys(("temperature_c", "dewpoint_c", "wind_speed_kt", "wind_gust_kt", "precip_mm", "snow_mm",
                         "visibility_km", "cloud_ceiling_ft", "condition"))


def answer(spark, tables, *requests):
    df = spark.createDataFrame(list(requests), schemas.REQUEST)
    store, _ = C.frozen_store(tables)
    good, bad = S.validate_requests(df, store["airports"])
    served = S.featurize(good, store, C.clean_tables(tables)["holiday_calendar"], C.STORED)
    return S.assess(C.probability(served), "p", C.THRESHOLD, C.RISK_WEIGHTS), bad


def test_storm_and_late_inbound_raise_the_risk(spark, tables):
    clear = WEATHER | {"precip_mm": 0.0, "wind_gust_kt": 5.0, "visibility_km": 16.0}
    storm = WEATHER | {"precip_mm": 14.0, "wind_gust_kt": 45.0, "visibility_km": 1.0, "cloud_ceiling_ft": 400.0,
                       "condition": "Thunderstorm"}
    out, bad = answer(
        spark, tables, request(request_id="clear", origin_weather=clear), request(request_id="storm", origin_weather=storm),
        request(request_id="ontime", scheduled_ground_time_min=45.0, prev_leg_arr_delay_min=0.0),
        request(request_id="late", scheduled_ground_time_min=45.0, prev_leg_arr_delay_min=120.0))
    p = {r["request_id"]: r for r in out.collect()}
    assert bad.count() == 0 and all(0 <= r["delay_probability"] <= 1 for r in p.values())
    assert p["storm"]["delay_probability"] > p["clear"]["delay_probability"]
    assert p["late"]["delay_probability"] > p["ontime"]["delay_probability"] + 0.1
    assert "inbound aircraft late" in p["late"]["explanation"]


def test_bad_requests_are_rejected_with_reasons(spark, tables):
    out, bad = answer(spark, tables, request(request_id="x", origin="XXX"), request(request_id="same", destination="aaa"),
                      request(request_id="when", scheduled_departure_local="soon"), request(request_id="seats", seats=1000),
                      request(request_id="fine"))
    reasons = {r["request_id"]: r["reasons"] for r in bad.collect()}
    assert reasons == {"x": ["unknown origin"], "same": ["origin and destination must differ"],
                       "when": ["unreadable departure"], "seats": ["seats out of range"]}
    assert [r["request_id"] for r in out.collect()] == ["fine"]


def test_watch_list_is_sorted(spark, tables):
    out, _ = answer(spark, tables, request(request_id="a"), request(request_id="b", prev_leg_arr_delay_min=95.0,
                                                                    scheduled_ground_time_min=40.0))
    p = [r["delay_probability"] for r in S.watch_list(out, "request_id").collect()]
    assert p == sorted(p, reverse=True)


def test_streamed_requests_equal_batch(spark, tables):
    source = fresh_path(spark, "requests")
    C.requests_of(tables).repartition(3).write.json(source)
    store, _ = C.frozen_store(tables)

    def score(df):
        good, _ = S.validate_requests(df, store["airports"])
        served = S.featurize(good, store, C.clean_tables(tables)["holiday_calendar"], C.STORED)
        return C.probability(served).select("request_id", F.round("p", 9).alias("p"))

    out = fresh_path(spark, "answers")
    stream = scoring.request_stream(spark, source, schemas.REQUEST, files_per_trigger=1)
    scoring.score_batches(stream, score, out, fresh_path(spark, "state"))
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("request_id", "p").collect())
    batch = sorted(tuple(r) for r in score(readers.read_json(spark, source, schemas.REQUEST)).collect())
    assert streamed == batch and streamed


def test_csv_source_keeps_bad_rows_apart(spark):
    path = fresh_path(spark, "csv")
    spark.createDataFrame([("h,n,m",), ("2024-01-01,N/A,1",), ("2024-01-02,None,x",)], "value STRING").coalesce(1).write.text(path)
    got = readers.read_csv(spark, path, "holiday_date DATE, holiday_name STRING, is_major_travel INT").orderBy("holiday_date").collect()
    assert [r["holiday_name"] for r in got] == [None, None] and [r["_corrupt"] is None for r in got] == [True, False]


def test_trees_learn_and_explain(spark):
    rows = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("a"), F.rand(3).alias("b"),
                                   F.when(F.col("id") % 10 > 6, 1).otherwise(0).alias("y"))
    fitted = M.fit_boosted(rows, None, ["a", "b"], [], "y", maxIter=3, maxDepth=2)
    path = fresh_path(spark, "model")
    fitted.model.save(path)
    from legwise.operators.explanation import tree_contributions, tree_nodes

    parts = tree_contributions(rows, tree_nodes(spark, path), "id", ["a", "b"])
    mean = parts.agg(F.avg(F.abs("c_a")).alias("a"), F.avg(F.abs("c_b")).alias("b")).first()
    assert mean["a"] > 0.1 > mean["b"]


def test_logistic_matches_label_direction(spark):
    rows = spark.range(800).select("id", F.col("id").cast("double").alias("x"),
                                   F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"),
                                   (F.col("id") > 400).cast("int").alias("y"))
    fitted = M.fit_logistic(rows, ["x"], ["c"], "y")
    p = {r["id"]: r["p"] for r in fitted.predict(rows).collect()}
    assert p[799] > 0.9 and p[0] < 0.1
    assert M.linear_weights(fitted.model, ["x"])["x"][0] > 0
