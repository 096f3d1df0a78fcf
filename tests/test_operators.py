"""Operators against brute force, quirks of missing values, leakage and skew."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from legwise.operators import economics, evaluation, ordering, quality, quantiles, selection, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---------------------------------------------------------------- order and quantiles
@pytest.mark.parametrize("slots", [1, 3, 50])
def test_running_totals_with_a_hot_tie(spark, slots):
    rng = random.Random(1)
    data = [(i, 0.5 if i % 3 == 0 else rng.random(), rng.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(data, "id INT, s DOUBLE, v INT")
    got = ordering.running_totals(df, ["s", "id"], {"run": F.col("v")}, slots=slots, grand={"run": "total"})
    want = pd.DataFrame(data, columns=["id", "s", "v"]).sort_values(["s", "id"])
    want["run"] = want["v"].cumsum()
    assert {r["id"]: r["run"] for r in got.collect()} == dict(zip(want["id"], want["run"]))
    assert got.first()["total"] == want["v"].sum()


def test_hot_ties_are_split_over_slots(spark):
    df = spark.range(3000).select(F.lit(0.5).alias("s"), "id")
    slots = ordering.in_slots(df, ["s", "id"], 8).groupBy(F.col("_slot").alias("slot")).count().collect()
    assert len(slots) == 8 and max(r["count"] for r in slots) < 3000 / 3


def test_equal_frequency_bins_match_qcut(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(997), 2)
    df = spark.createDataFrame(pd.DataFrame({"id": range(997), "p": p}))
    got = {r["id"]: r["bin"] for r in ordering.equal_frequency_bins(df, "p", "id", 10).collect()}
    want = pd.qcut(pd.Series(p).rank(method="first"), 10, labels=range(1, 11)).astype(int)
    assert [got[i] for i in range(997)] == want.tolist()


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k STRING, v DOUBLE")
    assert rows(ordering.average_ranks(df, "v", "r").select("k", "r"), "k") == [
        ("a", 1.0), ("b", 2.5), ("c", 2.5), ("d", None)]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = [("x", float(v)) for v in rng.normal(0, 100, 501)] + [("y", 7.0)] * 400 + [("y", -3.5)] + [("z", 2.0)]
    df = spark.createDataFrame(data + [("x", None), (None, 1.0)], "k STRING, v DOUBLE")
    got = quantiles.exact_quantiles(df, ["k"], F.col("v"), {"q1": 0.25, "q9": 0.9, "q0": 0.0, "q10": 1.0})
    found = {r["k"]: r for r in got.collect()}
    assert set(found) == {"x", "y", "z"}
    for key in found:
        values = [v for k, v in data if k == key]
        for name, p in (("q1", 0.25), ("q9", 0.9), ("q0", 0.0), ("q10", 1.0)):
            assert found[key][name] == pytest.approx(np.quantile(values, p))


def test_smallest_mode(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",)], "c STRING")
    assert spark.range(1).select(quantiles.smallest_mode(df, "c")).first()[0] == "a"


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(500)
    a = rows(ordering.hashed_sample(df.repartition(1), 50, "id"), "id")
    assert a == rows(ordering.hashed_sample(df.repartition(13), 50, "id"), "id") and len(a) == 50


# ---------------------------------------------------------------- windows
def series(spark, values):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("k", start + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "k STRING, ts TIMESTAMP, v DOUBLE")


@pytest.mark.parametrize("given,wanted", [
    ([1.0] + [None] * 8 + [10.0], [1, 2, 3, 4, None, None, 7, 8, 9, 10]),
    ([None] * 5 + [3.0, 4.0] + [None] * 5, [None, None, 3, 3, 3, 3, 4, 4, 4, 4, None, None]),
])
def test_interpolation_limits(spark, given, wanted):
    got = windows.interpolate_columns(series(spark, given), "k", "ts", ["v"]).orderBy("ts")
    assert [r["v"] for r in got.collect()] == [None if w is None else pytest.approx(w) for w in wanted]


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(9)
    values = [None if m else float(v) for m, v in zip(rng.random(300) < 0.55, rng.normal(size=300))]
    got = [r["v"] for r in windows.interpolate_columns(series(spark, values), "k", "ts", ["v"]).orderBy("ts").collect()]
    want = pd.Series(values, dtype=float).interpolate(limit=3, limit_direction="both")
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)


def test_prior_window_leaves_out_today(spark):
    days = [("a", dt.date(2024, 1, d), d, 1) for d in range(1, 13)]
    daily = spark.createDataFrame(days, "k STRING, day DATE, n_delayed INT, n_flights INT")
    got = windows.prior_rate(daily, ["k"], "day", 7, "rate", "volume").orderBy("day").collect()
    sums = [None if r["rate"] is None else round(r["rate"] * r["volume"]) for r in got]
    assert sums == [None, 1, 3, 6, 10, 15, 21, 28, 35, 42, 49, 56]


def test_future_days_do_not_change_earlier_rates(spark):
    def run(last):
        data = [("a", dt.date(2024, 1, d), d % 3, 3) for d in range(1, 10)] + [("a", dt.date(2024, 1, 10), last, 9)]
        daily = spark.createDataFrame(data, "k STRING, day DATE, n_delayed INT, n_flights INT")
        return rows(windows.prior_rate(daily, ["k"], "day", 7, "r", "v"), "day")

    assert run(0) == run(9)


@pytest.mark.parametrize("slot", ["minute", "hour", "day", None])
def test_delay_so_far_restarts_after_a_missing_delay(spark, slot):
    at = dt.datetime(2024, 1, 1, 6)
    data = [("n", at.date(), at + dt.timedelta(hours=i), i, d) for i, d in enumerate([5.0, None, 7.0, 2.0])]
    data.append((None, at.date(), at, 9, 4.0))
    df = spark.createDataFrame(data, "tail STRING, day DATE, ts TIMESTAMP, id INT, d DOUBLE")
    got = rows(windows.earlier_delay_today(df, "tail", "day", "ts", "id", "d", "run", slot).select("id", "run"), "id")
    assert got == [(0, 0.0), (1, 5.0), (2, 0.0), (3, 12.0), (9, 0.0)]


def legs(spark, second_departs, second_origin):
    day = "2024-01-01 "
    data = [(1, "N1", day + "08:00:00", day + "09:30:00", "ORD", "ATL", 45.0, 60.0, 0),
            (2, "N1", day + second_departs, day + "14:00:00", second_origin, "MIA", 20.0, 25.0, 0)]
    df = spark.createDataFrame(data, "id INT, tail STRING, dep STRING, arr STRING, o STRING, d STRING, dd DOUBLE, ad DOUBLE, x INT")
    return df.withColumns({"dep": F.col("dep").cast("timestamp"), "arr": F.col("arr").cast("timestamp")})


@pytest.mark.parametrize("departs,origin,arrival,known,upstream", [
    ("10:00:00", "ATL", None, 0, 45.0), ("12:00:00", "ATL", 60.0, 1, 60.0), ("12:00:00", "DEN", None, 0, 0.0)])
def test_propagation_uses_only_what_was_known(spark, departs, origin, arrival, known, upstream):
    got = windows.add_propagation(legs(spark, departs, origin), "tail", "dep", "arr", "id", "o", "d", "dd", "ad", "x")
    second = got.where("id = 2").first()
    assert second["prev_leg_arr_delay_min"] == arrival and second["prev_leg_known"] == known
    assert second["upstream_delay_min"] == upstream


@pytest.mark.parametrize("slot", ["hour", "day", "year"])
def test_previous_row_does_not_depend_on_the_slot(spark, slot):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = [(i, None if i % 10 == 0 else ("hot" if i % 2 else f"t{i % 7}"),
             start + dt.timedelta(minutes=rng.randint(0, 8000)), float(i)) for i in range(400)]
    df = spark.createDataFrame(data, "id INT, tail STRING, ts TIMESTAMP, v DOUBLE")
    got = windows.previous_in_order(df, "tail", "ts", "id", {"v": "prev"}, slot)
    p = pd.DataFrame(data, columns=["id", "tail", "ts", "v"]).sort_values(["ts", "id"])
    p["prev"] = p.groupby("tail")["v"].shift(1)
    want = {i: (None if pd.isna(x) else x) for i, x in zip(p["id"], p["prev"])}
    assert {r["id"]: r["prev"] for r in got.collect()} == want


# ---------------------------------------------------------------- cleaning
def fixture_tables(spark):
    airports = spark.createDataFrame([("ORD", "America/Chicago"), ("ATL", "America/New_York")], "airport_code STRING, timezone STRING")
    aircraft = spark.createDataFrame([("N123AB",)], "tail_number STRING")
    dep = "2024-01-05 08:00:00"
    data = [
        (0, "F1", " ord ", "2024-01-05 10:45:00", 975.0, 12.0, 8.0), (1, "F1", " ord ", "2024-01-05 10:45:00", 975.0, 12.0, 8.0),
        (2, "F2", "ORD", "2024-01-05 07:00:00", 975.0, 5.0, 2.0), (3, "F3", "ZZZ", "2024-01-05 10:45:00", 975.0, 5.0, 2.0),
        (4, "F4", "ORD", "2024-01-05 10:45:00", -999.0, 99999.0, 3.0)]
    flights = spark.createDataFrame(
        [(s, f, "AA", "N123AB", o, "ATL", dep, a, km, dd, ad, 0, 0) for s, f, o, a, km, dd, ad in data],
        "seq INT, flight_id STRING, carrier_code STRING, tail_number STRING, origin STRING, destination STRING, "
        "scheduled_departure_local STRING, scheduled_arrival_local STRING, distance_km DOUBLE, departure_delay_min DOUBLE, "
        "arrival_delay_min DOUBLE, cancelled INT, diverted INT")
    return flights, airports, aircraft


def test_cleaning_fixture(spark):
    clean, audit = quality.clean_flights(*fixture_tables(spark), "seq")
    kept = clean.collect()
    assert [r["flight_id"] for r in kept] == ["F1"] and kept[0]["origin"] == "ORD"
    assert kept[0]["scheduled_departure_utc"] == dt.datetime(2024, 1, 5, 14)
    assert kept[0]["tail_known"] == 1
    counts = {r["step"]: r["rows_affected"] for r in audit.collect()}
    assert counts["duplicate flight ids"] == 1 and counts["invalid station codes"] == 1
    assert counts["arrival not after departure"] == 1 and counts["missing target"] == 1
    assert counts["rows in"] == 5 and counts["rows out"] == 1


def test_malformed_station_code_stops_the_job(spark):
    bad = spark.createDataFrame([("OR", 1)], "airport_code STRING, seq INT")
    with pytest.raises(Exception, match="invalid station code"):
        quality.clean_airports(bad, "seq")[0].collect()


# ---------------------------------------------------------------- evaluation and economics
def scores(spark, n=400, seed=8):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 2)
    y = (rng.random(n) < p).astype(int)
    d = np.where(y == 1, rng.uniform(15, 200, n), rng.uniform(-20, 14, n))
    pdf = pd.DataFrame({"id": range(n), "p": p, "y": y, "d": d})
    return spark.createDataFrame(pdf), pdf


def test_ranking_quality_brute_force(spark):
    df, pdf = scores(spark)
    got = evaluation.ranking_quality(evaluation.score_curve(df, "y", "p")).first()
    pos, neg = pdf[pdf.y == 1].p.to_numpy(), pdf[pdf.y == 0].p.to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for s in sorted(pdf.p.unique(), reverse=True):
        hit = pdf[pdf.p >= s]
        ap += (hit.y.sum() / len(pos) - before) * hit.y.mean()
        before = hit.y.sum() / len(pos)
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_threshold_counts_brute_force(spark):
    df, pdf = scores(spark)
    got = economics.threshold_counts(df, "y", "p").orderBy("threshold").collect()
    assert len(got) == 94
    for i, row in enumerate(got):
        alert = pdf.p >= 0.02 + 0.01 * i
        assert (row["alerts"], row["tp"]) == (alert.sum(), (alert & (pdf.y == 1)).sum())


def test_deciles_cover_everything_and_rank_risk(spark):
    df, pdf = scores(spark)
    got = {r["decile"]: r for r in economics.risk_deciles(df, "y", "p", "d", "id").collect()}
    assert len(got) == 10 and sum(r["flights"] for r in got.values()) == len(pdf)
    assert got["D1"]["cumulative_share"] == pytest.approx(1.0)
    assert got["D10"]["delay_rate"] > got["D1"]["delay_rate"]


def test_correlation_pruning_keeps_the_stronger_feature(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + 1).alias("b"),
                                 F.rand(1).alias("c"))
    kept, decided = selection.correlation_prune(df, ["a", "b", "c"], {"a": 0.1, "b": 0.9, "c": 0.2})
    assert kept == ["b", "c"] and decided[0][:2] == ("b", "a")
    assert selection.correlation_prune(df, ["a", "b", "c"], {})[0] == ["b", "c"]


def test_recursive_elimination_order():
    weight = {c: i for i, c in enumerate("abcdefgh")}
    ranks = selection.recursive_elimination(lambda columns: weight, list("abcdefgh"), keep=4, step=0.25)
    assert [ranks[c] for c in "abcdefgh"] == [3, 3, 2, 2, 1, 1, 1, 1]


# ---------------------------------------------------------------- kernels
def test_slots_split_hot_values(spark):
    """A score that half of the rows share is cut along the next key; positions stay exact."""
    rng = random.Random(9)
    data = [(i, 0.5 if i % 2 else rng.random()) for i in range(4000)]
    df = spark.createDataFrame(data, "id BIGINT, score DOUBLE")
    sizes = [r["count"] for r in ordering.in_slots(df, ["score", "id"], 16).groupBy("_slot").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 800
    got = ordering.running_totals(df, ["score", "id"], {"place": F.lit(1)}, slots=16).collect()
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(data, key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["place"] for r in got} == want


def test_the_plan_does_not_grow_with_the_slots(spark):
    df = spark.range(20_000).repartition(40).withColumn("score", F.rand(1))
    plans = [ordering.running_totals(df, ["score", "id"], {"place": F.lit(1)}, slots=n)._jdf.queryExecution().toString() for n in (4, 400)]
    assert abs(len(plans[0]) - len(plans[1])) < 200


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (31_536_000.0, 1.7e9)])
def test_brackets_are_narrow(spark, scale, shift):
    """Values in [0, 1) and a year of seconds with fractions: few of them have to be ordered."""
    df = spark.range(200_000).select(((F.rand(3) * scale) + shift).alias("_x0"), F.lit(0).alias("_all"))
    wanted = [("q", "_x0", 0.5)]
    bracket = quantiles._bracketed(df, ["_all"], ["_x0"], wanted).first()
    inside = df.where((F.col("_x0") >= bracket["_lo0"]) & (F.col("_x0") <= bracket["_hi0"])).count()
    assert inside <= 4000
    got = quantiles.exact_quantiles(df, [], F.col("_x0"), {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    values = [r[0] for r in df.select("_x0").collect()]
    assert list(got) == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.9, 1.0]).tolist(), rel=1e-12)


def test_brackets_are_narrowed_to_a_bound(spark):
    """Ten million distinct values in skewed groups with ties, and a bound of 500 values to order."""
    df = spark.range(10_000_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.when(
        F.col("id") % 5 == 0, F.lit(0.25)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 50)) / float(1 << 50)).alias("v"))
    rows = df.select("g", F.col("v").alias("_x0"))
    wanted = [("a", "_x0", 0.001), ("b", "_x0", 0.5), ("c", "_x0", 0.9999)]
    brackets = quantiles._narrowed(rows, ["g"], quantiles._bracketed(rows, ["g"], ["_x0"], wanted), wanted, 500)
    held = rows.join(brackets, "g").groupBy("g").agg(*[F.approx_count_distinct(
        F.when(F.col("_x0").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.col("_x0"))).alias(f"d{i}") for i in range(3)]).collect()
    assert all(0 < n <= 550 for r in held for n in tuple(r)[1:])
    got = {r["g"]: tuple(r)[1:] for r in quantiles.exact_quantiles(df, ["g"], F.col("v"), {"a": 0.001, "b": 0.5, "c": 0.9999}, 500).collect()}
    pdf = df.toPandas()
    for g in (0, 1):
        assert got[g] == pytest.approx(np.quantile(pdf[pdf.g == g].v.to_numpy(), [0.001, 0.5, 0.9999]).tolist(), rel=1e-12)


def test_quantiles_of_small_and_tied_groups(spark):
    rng = random.Random(2)
    data = [(g, float(rng.choice([1, 1, 1, 2, 5, 7])) if rng.random() > 0.1 else None) for g in range(12) for _ in range(g)]
    df = spark.createDataFrame(data, "g INT, v DOUBLE")
    got = {r["g"]: tuple(r)[1:] for r in quantiles.exact_quantiles(df, ["g"], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.75}).collect()}
    held = {g: [v for h, v in data if h == g and v is not None] for g in range(12)}
    assert got == {g: pytest.approx(np.quantile(v, [0.1, 0.5, 0.75]).tolist()) for g, v in held.items() if v}


def test_average_ranks_with_a_hot_value(spark):
    data = [(i, None if i % 50 == 0 else float(i % 3 == 0) if i % 2 else i / 7) for i in range(3000)]
    df = spark.createDataFrame(data, "id BIGINT, v DOUBLE")
    got = {r["id"]: r["r"] for r in ordering.average_ranks(df, "v", "r").collect()}
    want = pd.Series(dict(data), dtype=float).rank()
    assert got == {i: None if pd.isna(x) else x for i, x in want.items()}


def test_hashed_sample_is_the_smallest_hashes(spark):
    import hashlib

    df = spark.range(5000)
    got = {r["id"] for r in ordering.hashed_sample(df, 100, "id").collect()}
    assert got == set(sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:100])


def test_nearest_mark(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 29)]
    marks = [dt.date(2024, 1, 5), dt.date(2024, 1, 11), dt.date(2024, 2, 1)]
    from legwise.operators.joins import nearest_date_gap

    got = {r["day"]: r["days_from_major_holiday"] for r in nearest_date_gap(
        spark.createDataFrame([(d,) for d in days], "day DATE"), "day",
        spark.createDataFrame([(m,) for m in marks], "m DATE"), "m").collect()}
    assert got == {d: float(min(((d - m).days for m in marks), key=lambda g: (abs(g), -g))) for d in days}
