"""V: features from raw flights, the store, serving and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import FLIGHTS, SCORED
from legwise.catalog.quality import RAW, fleet, raw_flights, raw_weather, station_codes
from legwise.catalog.registry import query
from legwise.functions.text import narrative
from legwise.operators.explanation import example_picks, strongest
from legwise.operators.joins import attach
from legwise.plans import flights as P
from legwise.plans import risk_model as R
from legwise.plans import serving as S
from legwise.plans import store as V
from legwise.session import fresh_path, settle
from legwise.sources import schemas
from legwise.streaming import scoring

# A linear risk score on served features (coefficient, mean) and its threshold.
RISK_WEIGHTS = {
    "upstream_delay_min": (0.02, 10.0), "slack_vs_upstream_min": (-0.004, 300.0),
    "dep_wx_severity": (0.5, 1.0), "carrier_delay_rate_7d": (1.5, 0.4),
    "origin_delay_rate_7d": (1.0, 0.4), "dep_time_decimal": (0.03, 12.0),
}
BASE_LOG_ODDS = -1.3  # of a base rate near 21 percent
THRESHOLD = 0.53
STORED = ["scheduled_turnaround_min", "aircraft_model", "seats", "aircraft_age_years",
          "carrier_share_at_origin", "carrier_delay_rate_7d", "carrier_volume_7d",
          "origin_delay_rate_7d", "origin_mean_delay_min_7d", "route_delay_rate_30d",
          "route_popularity_30d", "carrier_origin_delay_rate_14d", "carrier_origin_volume_14d",
          "origin_hour_departures", "dest_hour_arrivals"]


def raw_tables(t):
    """The six raw tables, all derived from the bundled ones."""
    station = t.stations.groupBy("region").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.max("num_runways").alias("num_runways"), F.max("elevation_ft").alias("elevation_ft"),
        F.max("is_hub").alias("is_hub"), F.sum("capacity").cast("int").alias("hourly_capacity"))
    airports = (
        station_codes(t).join(t.region, F.concat(F.char(F.col("r_regionkey") + 65), F.lit("AA")) == F.col("airport_code"))
        .join(station, F.col("r_regionkey") == F.col("region"))
        .select("airport_code", F.col("r_name").alias("airport_name"), F.col("r_name").alias("city"),
                F.lit("XX").alias("state"), F.col("r_name").alias("region"), "latitude", "longitude", "timezone",
                "num_runways", "elevation_ft", "is_hub", "hourly_capacity", F.lit("temperate").alias("climate_zone"),
                F.col("r_regionkey").alias("seq")))
    airlines = t.events.select(F.upper("event_type").alias("carrier_code")).distinct().withColumns({
        "carrier_name": F.initcap("carrier_code"),
        "carrier_type": F.when(F.length("carrier_code") > 4, "legacy").otherwise("regional")})
    aircraft = fleet(t).withColumn("_n", F.substring("tail_number", 2, 9).cast("int")).select(
        "tail_number", F.lit(None).cast("string").alias("carrier_code"),
        F.concat(F.lit("M"), F.col("_n") % 4).alias("aircraft_model"), F.lit("maker").alias("manufacturer"),
        (F.col("_n") % 150 + 50).alias("seats"), F.when(F.col("_n") % 3 == 0, "regional_jet").otherwise("narrow").alias("category"),
        (F.col("_n") % 50).cast("double").alias("age_years_2024"), F.col("_n").alias("seq"))
    flights = raw_flights(t).withColumns({
        "flight_number": (F.col("seq") % 900).cast("int"),
        "scheduled_turnaround_min": (F.col("seq") % 60 + 25).cast("double"),
        "leg_number": (F.col("seq") % 6).cast("int")})
    day = F.to_date(F.col("ts").cast("timestamp"))
    holidays = t.events.groupBy(day.alias("holiday_date")).agg(F.count(F.lit(1)).alias("n")).where(
        F.dayofmonth("holiday_date") % 14 == 1).select(
        "holiday_date", F.lit("Holiday").alias("holiday_name"), (F.dayofmonth("holiday_date") < 20).cast("int").alias("is_major_travel"))
    return {"airports": airports, "airlines": airlines, "aircraft": aircraft, "flights": flights,
            "weather_hourly": raw_weather(t), "holiday_calendar": holidays}


def once(build):
    """Run a stage once per call of a query: its written result stays with the call's tables."""
    def run(t):
        done = t.__dict__.setdefault("stages", {})
        if build.__name__ not in done:
            done[build.__name__] = build(t)
        return done[build.__name__]
    return run


@once
def clean_tables(t):
    return {name: settle(df) for name, df in P.clean(raw_tables(t), "seq")[0].items()}


@once
def all_features(t):
    return settle(P.derive_features(settle(P.integrate(clean_tables(t)))))


@query("V0_features_from_raw", f"""
WITH {RAW}, f AS (SELECT *, date_trunc('hour', dep_utc) AS dep_hour, date_trunc('hour', arr_utc) AS arr_hour, dep_local::DATE AS day, (dep_ok >= 15)::INT AS late FROM timely WHERE verdict IS NULL),
o AS (SELECT carrier_code, day, SUM(late) AS d, COUNT(*) AS n FROM f WHERE cancelled = 0 GROUP BY 1, 2),
c AS (SELECT carrier_code, day, SUM(d) OVER w AS d, SUM(n) OVER w AS n FROM o WINDOW w AS (PARTITION BY carrier_code ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
h AS (SELECT origin, dep_hour, COUNT(*) AS n FROM f GROUP BY 1, 2), b AS (SELECT *, SUM(n) OVER (PARTITION BY origin ORDER BY dep_hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS bank FROM h),
p AS (SELECT *, LAG(dep_ok) OVER w AS pd, LAG(arr_ok) OVER w AS pa, LAG(arr_utc) OVER w AS ps, LAG(destination) OVER w AS pdest, LAG(cancelled) OVER w AS pc FROM f WINDOW w AS (PARTITION BY tail_number ORDER BY dep_utc, flight_id)),
q AS (SELECT *, COALESCE(tail_number IS NOT NULL AND pdest = origin AND pc = 0, FALSE) AS chained, COALESCE(pa IS NOT NULL AND epoch_us(ps) + (pa * 60000000)::BIGINT <= epoch_us(dep_utc), FALSE) AS landed FROM p)
SELECT flight_id, COALESCE(late, 0)::INT AS is_delayed, hour(dep_local)::INT AS dep_hour, ROUND(c.d / c.n, 6) AS carrier_delay_rate_7d, b.n AS origin_hour_departures, b.bank::BIGINT AS bank_pressure_3h,
 ROUND(COUNT(*) OVER (PARTITION BY q.origin, q.carrier_code) / COUNT(*) OVER (PARTITION BY q.origin), 6) AS carrier_share_at_origin,
 COUNT(*) OVER (PARTITION BY q.destination, q.arr_hour) AS dest_hour_arrivals, COUNT(*) OVER (PARTITION BY q.origin, q.day) AS origin_daily_departures,
 ROUND(GREATEST(COALESCE(CASE WHEN landed AND chained THEN pa END, CASE WHEN chained THEN pd END, 0), 0), 6) AS upstream_delay_min
FROM q LEFT JOIN c USING (carrier_code, day) LEFT JOIN b USING (origin, dep_hour)
""")
def v0(t):
    return all_features(t).select(
        "flight_id", *[F.col(c).cast("int").alias(c) for c in ("is_delayed", "dep_hour")],
        F.round("carrier_delay_rate_7d", 6).alias("carrier_delay_rate_7d"), "origin_hour_departures", "bank_pressure_3h",
        F.round("carrier_share_at_origin", 6).alias("carrier_share_at_origin"), "dest_hour_arrivals",
        "origin_daily_departures", F.round("upstream_delay_min", 6).alias("upstream_delay_min"))


@once
def frozen_store(t):
    clean, features = clean_tables(t), P.model_rows(all_features(t))
    store = V.build_store(features, clean["airports"], clean["airlines"], clean["aircraft"], STORED)
    path = fresh_path(t.spark, "store")
    V.save_store(store, path)
    return V.load_store(t.spark, path), features


@query("V1_feature_store", f"""
WITH {RAW}, f AS (SELECT * FROM timely WHERE verdict IS NULL AND cancelled = 0)
SELECT 'carrier' AS section, COUNT(DISTINCT carrier_code) AS n, MAX(dep_local::DATE)::VARCHAR AS as_of FROM f
UNION ALL SELECT 'origin', COUNT(DISTINCT origin), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'route', COUNT(DISTINCT origin || destination), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'carrier_origin', COUNT(DISTINCT origin || carrier_code), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'demand', COUNT(DISTINCT (origin, isodow(dep_local), hour(dep_local))), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'dest_arrivals', COUNT(DISTINCT (destination, isodow(dep_local))), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'weather_normals', COUNT(DISTINCT (origin, month(dep_local))), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'defaults', 1, MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'airports', (SELECT COUNT(*) FROM region), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'airlines', (SELECT COUNT(DISTINCT event_type) FROM events), MAX(dep_local::DATE)::VARCHAR FROM f
UNION ALL SELECT 'aircraft', (SELECT COUNT(DISTINCT user_id) FROM events WHERE user_id % 4 <> 0), MAX(dep_local::DATE)::VARCHAR FROM f
""")
def v1(t):
    store, _ = frozen_store(t)
    out = None
    for name, section in store.items():
        row = section.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n"), F.max("as_of").cast("string").alias("as_of"))
        out = row if out is None else out.unionByName(row)
    return out


def requests_of(t):
    """Scoring requests from the event rows: some fields missing, some flights malformed."""
    i, k = F.col("event_id"), F.from_json("props", "k INT")["k"]
    weather = lambda on: F.when(on, F.struct(
        *[F.lit(None).cast("double").alias(m) for m in ("temperature_c", "dewpoint_c", "wind_speed_kt")],
        (k * 2.5).alias("wind_gust_kt"), (F.col("value") / 10).alias("precip_mm"), F.lit(None).cast("double").alias("snow_mm"),
        (k / 5.0).alias("visibility_km"), (k * 100.0).alias("cloud_ceiling_ft"), F.lit(None).cast("string").alias("condition")))
    none = lambda kind: F.lit(None).cast(kind)
    return t.events.select(
        i.cast("string").alias("request_id"), F.when(i % 10 == 0, "ZZ").otherwise(F.substring("event_type", 1, 3)).alias("carrier_code"),
        F.concat(F.char(i % 6 + 97), F.lit("aa")).alias("origin"), F.concat(F.char(F.floor("value") % 5 + 65), F.lit("AA")).alias("destination"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("scheduled_departure_local"),
        none("string").alias("scheduled_arrival_local"), (i % 900).cast("int").alias("flight_number"),
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("tail_number"), none("string").alias("aircraft_model"),
        none("double").alias("aircraft_age_years"), none("int").alias("seats"), none("double").alias("scheduled_turnaround_min"),
        F.when(i % 3 == 0, 45.0).alias("scheduled_ground_time_min"), F.when(i % 4 == 0, F.col("value")).alias("prev_leg_arr_delay_min"),
        F.when(i % 5 == 0, F.col("value") / 2).alias("prev_leg_dep_delay_min"), none("double").alias("aircraft_cum_delay_today"),
        weather(i % 2 == 0).alias("origin_weather"), weather(i % 7 == 0).alias("dest_weather"))


@query("V2_served_features", f"""
SELECT flight_id::VARCHAR AS request_id, ROUND(hour(dep_ts) + minute(dep_ts) / 60.0::DOUBLE, 6) AS dep_time_decimal, (isodow(dep_ts) - 1)::INT AS day_of_week,
 ROUND(GREATEST(COALESCE(CASE WHEN flight_id % 4 = 0 THEN value END, CASE WHEN flight_id % 5 = 0 THEN value / 2 END, 0), 0), 6) AS upstream_delay_min, (flight_id % 4 = 0)::INT AS prev_leg_known
FROM (SELECT event_id AS flight_id, ts AS dep_ts, value, (props::JSON->>'k')::INT AS k FROM events)
WHERE flight_id % 6 <> 5 AND flight_id % 6 <> FLOOR(value)::BIGINT % 5 AND NOT (k > 80 AND (flight_id % 2 = 0 OR flight_id % 7 = 0))
""")
def v2(t):
    return served(t).select("request_id", F.round("dep_time_decimal", 6).alias("dep_time_decimal"), F.col("day_of_week").cast("int").alias("day_of_week"),
                            F.round("upstream_delay_min", 6).alias("upstream_delay_min"), F.col("prev_leg_known").cast("int").alias("prev_leg_known"))


@once
def served(t):
    store, _ = frozen_store(t)
    # judged once: the days asked for and the features go on from the written requests
    good = settle(S.validate_requests(requests_of(t), store["airports"])[0])
    return settle(S.featurize(good, store, clean_tables(t)["holiday_calendar"], STORED))


# Served features that come from the request alone; the others also depend on the day the store was frozen.
SHARED = ["dep_time_decimal", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "holiday_proximity", "lat_delta", "bearing_sin",
          "bearing_cos", "upstream_delay_min", "prev_leg_known", "dep_wx_severity", "dep_gust_factor", "dep_minute", "day_of_week",
          "dep_wx_temperature_c", "dep_wx_wind_speed_kt", "dep_wx_visibility_km", "dep_wx_cloud_ceiling_ft"]


def flight_requests(rows):
    """The flights of a feature table as requests."""
    none = lambda kind: F.lit(None).cast(kind)
    at_origin = F.struct(*[F.col(f"dep_wx_{m}").alias(m) if f"dep_wx_{m}" in rows.columns else none("double").alias(m) for m in (
        "temperature_c", "dewpoint_c", "wind_speed_kt", "wind_gust_kt", "precip_mm", "snow_mm", "visibility_km", "cloud_ceiling_ft")],
        F.col("dep_wx_condition").alias("condition"))
    return rows.select(
        F.col("flight_id").alias("request_id"), "carrier_code", "origin", "destination", "scheduled_departure_local",
        none("string").alias("scheduled_arrival_local"), "flight_number", "tail_number", none("string").alias("aircraft_model"),
        none("double").alias("aircraft_age_years"), none("int").alias("seats"), "scheduled_turnaround_min", "scheduled_ground_time_min",
        "prev_leg_arr_delay_min", "prev_leg_dep_delay_min", "aircraft_cum_delay_today", at_origin.alias("origin_weather"),
        none(dict(rows.select(at_origin.alias("w")).dtypes)["w"]).alias("dest_weather"))


def parity_rows(t):
    """Served and batch values of the shared features, for the flights of all days."""
    store, rows = frozen_store(t)
    online = S.featurize(flight_requests(rows), store, clean_tables(t)["holiday_calendar"], STORED)
    batch = rows.select(F.col("flight_id").alias("request_id"), *[F.col(c).cast("double").alias(f"batch_{c}") for c in SHARED])
    return online.join(batch, "request_id"), SHARED


def parity_counts(joined, shared):
    """Per feature: rows; rows whose served value is missing or differs; rows where only the service has a value.

    Where a flight has no weather observation the service falls back to the station's normals and
    the batch keeps NULL; that is the one known difference, and it is counted apart.
    """
    def both(c):
        return F.col(c).cast("double"), F.col(f"batch_{c}")

    def differs(c):
        served, batch = both(c)
        return batch.isNotNull() & F.coalesce(F.abs(served - batch) > 1e-9, F.lit(True))

    def filled(c):
        served, batch = both(c)
        return batch.isNull() & served.isNotNull()

    counted = joined.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(rule(c)).alias(f"{name}_{c}") for c in shared for name, rule in (("m", differs), ("f", filled))])
    return counted.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col("n"), F.col(f"m_{c}").alias("n_mismatched"), F.col(f"f_{c}").alias("n_filled"))
        for c in shared])))


@query("V3_offline_online_parity", f"""
WITH {RAW}, f AS (SELECT * FROM timely WHERE verdict IS NULL AND cancelled = 0)
SELECT unnest({SHARED}) AS feature, COUNT(*) AS n, 0::BIGINT AS n_mismatched FROM f
""")
def v3(t):
    return parity_counts(*parity_rows(t)).drop("n_filled")


@query("V3_filled_by_normals")
def v3b(t):
    return parity_counts(*parity_rows(t)).select("feature", "n_filled")


def probability(df):
    z = F.lit(BASE_LOG_ODDS)
    for name, (w, m) in RISK_WEIGHTS.items():
        z = z + F.lit(w) * (F.coalesce(F.col(name).cast("double"), F.lit(m)) - F.lit(m))
    return df.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


@query("V4_scored_flights")
def v4(t):
    answered = S.assess(probability(served(t)), "p", THRESHOLD, RISK_WEIGHTS)
    return answered.select("request_id", "flight", "route", "delay_probability", "risk_band", "recommend_intervention",
                           "expected_delay_minutes", F.size("top_factors").alias("n_factors"), "explanation")


@query("V4_answer_from_score", f"""
WITH {SCORED} SELECT id, carrier_code || CASE WHEN id % 900 <> 0 THEN (id % 900)::VARCHAR ELSE '' END AS flight, round_even(score, 4) AS delay_probability, CASE WHEN score < 0.15 THEN 'low' WHEN score < 0.3 THEN 'moderate' WHEN score < 0.5 THEN 'elevated' ELSE 'high' END AS risk_band,
 score >= 0.53 AS recommend_intervention, round_even(score * 44, 1) AS expected_delay_minutes FROM scored
""")
def v4b(t):
    rows = t.scored.withColumns({"flight_number": F.col("id") % 900, "origin": F.lit("AAA"), "destination": F.lit("BAA")})
    return S.assess(rows, "score", THRESHOLD).select(
        "id", "flight", "delay_probability", "risk_band", "recommend_intervention", "expected_delay_minutes")


@query("V5_watch_summary", f"""
WITH {SCORED} SELECT COUNT(*) AS n_flights, 0.53::DOUBLE AS threshold, COUNT(*) FILTER (score >= 0.53) AS n_flagged, ROUND(AVG(score), 4) AS mean_risk, ROUND(SUM(score), 1) AS expected_delayed_flights FROM scored
""")
def v5(t):
    return S.watch_summary(t.scored, "score", THRESHOLD)


@query("V6_streamed_scores", f"""
WITH {FLIGHTS} SELECT flight_id, ROUND(1 / (1 + exp(-(0.01::DOUBLE * k - 0.5::DOUBLE + 0.1::DOUBLE * length(n.n_name)))), 6) AS p FROM flights JOIN nation n ON n.n_nationkey = origin
""")
def v6(t):
    """events.parquet read as a file stream, joined to a static table and scored."""
    stream = scoring.request_stream(t.spark, t.folder, t.events.schema, "parquet", "events.parquet")
    names = t.nation.select(F.col("n_nationkey").cast("bigint").alias("key"), "n_name")

    def score(df):
        k = F.from_json("props", "k INT")["k"]
        rows = df.select(F.col("event_id").alias("flight_id"), (F.col("event_id") % 5).alias("origin"), k.alias("k"))
        placed = attach(rows, names, ["origin"], ["key"], {"n_name": "name"}, "inner")
        z = F.lit(0.01) * F.col("k") - 0.5 + F.lit(0.1) * F.length("name")
        return placed.select("flight_id", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6).alias("p"))

    out = fresh_path(t.spark, "stream-out")
    scoring.score_available(stream, score, out, fresh_path(t.spark, "stream-state"))
    return t.spark.read.schema("flight_id BIGINT, p DOUBLE").parquet(out)


# ---------------------------------------------------------------- the fitted model, saved and served
_SERVED = {}


def shared(build):
    """Queries around the saved model share its artefacts, and the tables it is served with, within a session and folder."""
    def run(t):
        key = (t.spark.sparkContext.applicationId, t.folder)
        return build(_SERVED.setdefault(key, t))
    return run


@once
def fitted_model(t):
    """Learned on the earlier days, calibration judged on the next ones: (model in memory, model loaded, rows, choice)."""
    rows = P.model_rows(all_features(t)).withColumn("is_delayed", F.col("is_delayed").cast("int"))
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    until = F.date_add(F.lit(first), int((last - first).days * 0.7))
    model, choice = R.calibrate(R.fit(rows.where(F.col("date") <= until), "is_delayed"),
                                rows.where(F.col("date") > until), "is_delayed", "scheduled_departure_utc", "flight_id")
    path = fresh_path(t.spark, "risk-model")
    model.save(t.spark, path)
    return model, R.RiskModel.load(t.spark, path), rows, choice


def loaded_model(t):
    return fitted_model(t)[1]


MODEL_SQL = f"WITH {RAW}, f AS (SELECT * FROM timely WHERE verdict IS NULL AND cancelled = 0)"


@query("D2_saved_model_scores", f"{MODEL_SQL} SELECT COUNT(*) AS n, COUNT(*) AS n_scored, 0::BIGINT AS n_reload_differs, 0::BIGINT AS n_not_explained FROM f")
@shared
def d2(t):
    """The loaded model scores like the fitted one, and its contributions add up to its log-odds, on every flight."""
    model, loaded, rows, _ = fitted_model(t)
    both = loaded.raw_score(model.score(rows, "p_fitted"), "p_raw")
    both = loaded.score(both.withColumn("parts", loaded.contributions()))
    total = F.aggregate("parts", F.lit(loaded.base), lambda a, e: a + e["contribution"])
    return both.withColumn("z", total).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").between(0, 1)).alias("n_scored"),
        F.count_if(~(F.abs(F.col("p") - F.col("p_fitted")) < 1e-12)).alias("n_reload_differs"),
        F.count_if(~(F.abs(1 / (1 + F.exp(-F.col("z"))) - F.col("p_raw")) < 1e-9)).alias("n_not_explained"))


@query("D2_input_contract")
@shared
def d2b(t):
    """What the saved model takes: its features with the levels, fills and weights of the training window."""
    return t.spark.createDataFrame([tuple(r.values()) for r in loaded_model(t).contract], R.CONTRACT)


def model_answers(t):
    store, _ = frozen_store(t)
    return S.answer_requests(requests_of(t), store, clean_tables(t)["holiday_calendar"], loaded_model(t), STORED, THRESHOLD)


@query("V4_model_answers")
@shared
def v4c(t):
    """Every valid request answered by the saved model."""
    return model_answers(t)[0].select(
        "request_id", "flight", "route", "delay_probability", "risk_band", "recommend_intervention", "expected_delay_minutes",
        F.transform("top_factors", lambda e: e["feature"]).alias("factors"), "explanation")


@query("X1_model_importance")
@shared
def x1b(t):
    model = loaded_model(t)
    rows = fitted_model(t)[2].select(F.inline(model.contributions()))
    return rows.groupBy("feature", "label").agg(F.avg(F.abs("contribution")).alias("importance"))


@query("X5_model_examples", f"{MODEL_SQL} SELECT unnest(['highest_risk', 'lowest_risk', 'typical']) AS tag, 1::BIGINT AS n, TRUE AS has_reasons")
@shared
def x5b(t):
    """The highest, the middle and the lowest flight by the model's score, with their reasons in words."""
    model, rows = loaded_model(t), fitted_model(t)[2]
    scored = settle(model.score(rows).withColumn("top", strongest(model.contributions(), 6)).select("flight_id", "p", "top"))
    picked = scored.join(example_picks(scored, "p", "flight_id").drop("p"), "flight_id")
    told = picked.withColumn("sentence", narrative(F.col("top"), F.col("p")))
    return told.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.bool_and(
        F.col("sentence").contains("Driven up by") | F.col("sentence").contains("Offset by")).alias("has_reasons"))


@query("M9_adopted_calibration")
@shared
def m9c(t):
    """Calibration errors on the judged half, and whether the saved model carries the calibration."""
    _, loaded, _, choice = fitted_model(t)
    return t.spark.createDataFrame([(float(choice.ece_raw), float(choice.ece_isotonic), loaded.calibrator is not None)],
                                   "ece_raw DOUBLE, ece_isotonic DOUBLE, adopted BOOLEAN")


# ---------------------------------------------------------------- a version per day
RATED = ["carrier_delay_rate_7d", "carrier_volume_7d", "origin_delay_rate_7d", "origin_mean_delay_min_7d", "route_delay_rate_30d",
         "route_popularity_30d", "carrier_origin_delay_rate_14d", "carrier_origin_volume_14d", "carrier_share_at_origin"]


@once
def daily_store(t):
    clean, features = clean_tables(t), P.model_rows(all_features(t))
    path = fresh_path(t.spark, "daily-store")
    V.save_store(V.build_store(features, clean["airports"], clean["airlines"], clean["aircraft"], STORED, daily=True), path)
    return V.load_store(t.spark, path), features


@query("V3_stored_features_as_of", f"{MODEL_SQL} SELECT unnest({RATED}) AS feature, COUNT(*) AS n, 0::BIGINT AS n_mismatched FROM f")
@shared
def v3c(t):
    """Rates, volumes and shares served as of each flight's day, against the batch, on all days."""
    store, rows = daily_store(t)
    batch = rows.select(F.col("flight_id").alias("request_id"), *[F.col(c).cast("double").alias(f"batch_{c}") for c in RATED])
    online = S.featurize(flight_requests(rows), store, clean_tables(t)["holiday_calendar"], STORED)
    return parity_counts(online.join(batch, "request_id"), RATED).drop("n_filled")


@query("V1_carrier_versions", f"""{MODEL_SQL}, d AS (SELECT carrier_code, dep_local::DATE AS day, SUM((dep_ok >= 15)::INT) AS d, COUNT(*) AS n FROM f GROUP BY 1, 2),
w AS (SELECT carrier_code, day, SUM(d) OVER w AS d, SUM(n) OVER w AS n FROM d WINDOW w AS (PARTITION BY carrier_code ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT carrier_code, day::VARCHAR AS day, ROUND(d / n, 6) AS carrier_delay_rate_7d, n::DOUBLE AS carrier_volume_7d FROM w""")
@shared
def v1b(t):
    return daily_store(t)[0]["carrier"].select(
        "carrier_code", F.col("date").cast("string").alias("day"), F.round("carrier_delay_rate_7d", 6).alias("carrier_delay_rate_7d"),
        F.col("carrier_volume_7d").cast("double").alias("carrier_volume_7d"))


@query("V1_latest_carrier_values", f"""{MODEL_SQL}, d AS (SELECT carrier_code, dep_local::DATE AS day, SUM((dep_ok >= 15)::INT) AS d, COUNT(*) AS n FROM f GROUP BY 1, 2),
w AS (SELECT carrier_code, day, SUM(d) OVER w AS d, SUM(n) OVER w AS n FROM d WINDOW w AS (PARTITION BY carrier_code ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT carrier_code, ROUND(max_by(d / n, day), 6) AS carrier_delay_rate_7d, max_by(n, day)::DOUBLE AS carrier_volume_7d FROM w GROUP BY 1""")
def v1c(t):
    return frozen_store(t)[0]["carrier"].select("carrier_code", F.round("carrier_delay_rate_7d", 6).alias("carrier_delay_rate_7d"),
                                                F.col("carrier_volume_7d").cast("double").alias("carrier_volume_7d"))


# ---------------------------------------------------------------- nested requests as a stream
BATCH_SIZE = 50


def request_files(t):
    """The requests as nested JSON batches, one per line; every thirteenth line is cut short."""
    number = F.floor(F.col("request_id").cast("bigint") / BATCH_SIZE)
    flights = requests_of(t).withColumn("number", number)
    inside = F.struct(*[F.col(c) for c in flights.columns if c != "number"])
    line = F.to_json(F.struct(
        F.col("number").cast("string").alias("batch_id"), F.col("flights"), (F.col("number") % 4 + 1).cast("int").alias("top_n_reasons"),
        F.when(F.col("number") % 2 == 0, 0.4).alias("threshold")))
    whole = flights.groupBy("number").agg(F.array_sort(F.collect_list(inside)).alias("flights"))
    path = fresh_path(t.spark, "request-files")
    whole.select(F.when(F.col("number") % 13 == 12, F.substr(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).repartition(
        3, "value").write.text(path)
    return path


def answer_batch(t, batch):
    """Answers of a micro-batch, and its rejects: unreadable batches and refused requests."""
    store, _ = frozen_store(t)
    opened, bad = S.open_batches(batch, THRESHOLD)
    opened, bad = settle(opened), settle(bad)
    good, refused = S.answer_requests(opened, store, clean_tables(t)["holiday_calendar"], loaded_model(t), STORED, F.col("limit"), F.col("n_reasons"))
    answers = good.select("batch_id", "request_id", "p", "delay_probability", "recommend_intervention", "threshold",
                          F.size("top_factors").alias("n_factors"))
    rejects = bad.select(F.lit("batch").alias("what"), F.col("batch_id").alias("id"), "reasons").unionByName(
        refused.select(F.lit("request").alias("what"), F.col("request_id").alias("id"), "reasons"))
    return answers, rejects


def streamed_answers(t, source, out, rejected, state):
    stream = scoring.request_stream(t.spark, source, schema_of_batches(t), files_per_trigger=1)
    scoring.answer_batches(stream, lambda batch: answer_batch(t, batch), out, rejected, state)


def schema_of_batches(t):
    return t.spark.createDataFrame([], schemas.REQUEST_BATCH).schema


@query("V6_streamed_requests", """
WITH x AS (SELECT event_id AS i, event_id // 50 AS number, value, (props::JSON->>'k')::INT AS k FROM events),
v AS (SELECT *, i % 6 <> 5 AND i % 6 <> FLOOR(value)::BIGINT % 5 AND NOT (k > 80 AND (i % 2 = 0 OR i % 7 = 0)) AS valid FROM x)
SELECT COUNT(*) FILTER (valid AND number % 13 <> 12) AS n_answered, COUNT(*) FILTER (NOT valid AND number % 13 <> 12) AS n_refused,
 COUNT(DISTINCT number) FILTER (number % 13 = 12) AS n_unreadable, 0::BIGINT AS n_differ, 0::BIGINT AS n_twice,
 (SUM(number % 4 + 1) FILTER (valid AND number % 13 <> 12))::BIGINT AS n_factors FROM v
""")
@shared
def v6b(t):
    """JSON batches as a file stream through validation, features, the saved model and answers; compared with V4 row by row.

    The stream is run twice on one checkpoint: the restart finds nothing to do.
    """
    source, out, rejected, state = request_files(t), *[fresh_path(t.spark, n) for n in ("answers", "rejects", "answer-state")]
    for _ in range(2):
        streamed_answers(t, source, out, rejected, state)
    answers, rejects = t.spark.read.parquet(out), t.spark.read.parquet(rejected)
    direct = model_answers(t)[0].select("request_id", F.col("p").alias("p_direct"))
    met = answers.join(direct, "request_id", "left").agg(
        F.count(F.lit(1)).alias("n_answered"), F.count_if(~F.coalesce(F.abs(F.col("p") - F.col("p_direct")) < 1e-12, F.lit(False))).alias("n_differ"),
        (F.count(F.lit(1)) - F.count_distinct("request_id")).alias("n_twice"), F.sum("n_factors").cast("bigint").alias("n_factors"))
    refused = rejects.agg(F.count_if(F.col("what") == "request").alias("n_refused"), F.count_if(F.col("what") == "batch").alias("n_unreadable"))
    return met.select("n_answered", refused.select("n_refused").scalar().alias("n_refused"),
                      refused.select("n_unreadable").scalar().alias("n_unreadable"), "n_differ", "n_twice", "n_factors")
