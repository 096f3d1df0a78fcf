"""Features and risk of requested flights: the serving twin of the batch features.

Requests meet the store tables in joins, and the same Column functions as in
training give the same values. What a request leaves out comes from the store,
then from the defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legwise.functions import clock, schedule, space, weather
from legwise.functions.base import clip, count_where, flag
from legwise.functions.text import code, expected_minutes, flight_label, narrative, risk_band
from legwise.operators.calibration import as_column
from legwise.operators.explanation import linear_contributions, strongest
from legwise.operators.joins import attach, attach_as_of, nearest_date_gap
from legwise.operators.projections import select_apart
from legwise.operators.quality import split_valid

# Last-resort weather, block-time range, demand, and request limits.
FALLBACK_WEATHER = {
    "temperature_c": 15.0, "wind_speed_kt": 8.0, "wind_gust_kt": 10.0, "precip_mm": 0.0,
    "visibility_km": 16.0, "cloud_ceiling_ft": 12000.0,
}
DEWPOINT_DROP_C = 4.0
BLOCK_LIMITS = (25.0, 600.0)
FALLBACK_DEMAND = 4.0
REQUEST_LIMITS = {
    "aircraft_age_years": (0, 50), "seats": (1, 900), "scheduled_turnaround_min": (0, 1440),
    "scheduled_ground_time_min": (0, 1440),
}
WEATHER_LIMITS = {
    "wind_speed_kt": (0, 150), "wind_gust_kt": (0, 200), "precip_mm": (0, 200), "snow_mm": (0, 500),
    "visibility_km": (0, 20), "cloud_ceiling_ft": (0, 50000),
}
CODES = ("carrier_code", "origin", "destination")
DEFAULT_REASONS = 4


def validate_requests(requests: DataFrame, airports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests with normalised codes, and rejected ones with reasons."""
    r = requests.withColumns({c: code(F.col(c)) for c in CODES})
    known = airports.select("airport_code", F.lit(1).alias("_known"))
    r = attach(r, known, ["origin"], ["airport_code"], {"_known": "_o"})
    r = attach(r, known, ["destination"], ["airport_code"], {"_known": "_d"})
    when = clock.parse_timestamp(F.col("scheduled_departure_local"))

    def outside(c: Column, low: float, high: float) -> Column:
        return F.coalesce(~c.between(low, high), F.lit(False))

    rules = {
        "carrier_code length": ~F.length("carrier_code").between(2, 3),
        "origin length": F.length("origin") != 3,
        "destination length": F.length("destination") != 3,
        "unknown origin": F.col("_o").isNull(),
        "unknown destination": F.col("_d").isNull(),
        "origin and destination must differ": F.col("origin") == F.col("destination"),
        "unreadable departure": when.isNull(),
    }
    rules |= {f"{c} out of range": outside(F.col(c), *limits) for c, limits in REQUEST_LIMITS.items()}
    rules |= {f"{side}.{c} out of range": outside(F.col(side)[c], *limits)
              for side in ("origin_weather", "dest_weather") for c, limits in WEATHER_LIMITS.items()}
    good, bad = split_valid(r, rules)
    return good.drop("_o", "_d"), bad.drop("_o", "_d")


# Limits of a batch of requests.
BATCH_FLIGHTS, REASON_LIMITS, THRESHOLD_LIMITS = (1, 500), (1, 10), (0, 1)


def open_batches(batches: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The requests of well-formed batches, one per row with their batch's settings, and the batches that are not.

    A batch names its threshold and number of reasons or takes the defaults.
    """
    rules = {
        "unreadable": F.col("_corrupt").isNotNull(),
        "number of flights out of range": ~F.coalesce(F.size("flights"), F.lit(0)).between(*BATCH_FLIGHTS),
        "top_n_reasons out of range": ~F.coalesce("top_n_reasons", F.lit(DEFAULT_REASONS)).between(*REASON_LIMITS),
        "threshold out of range": ~F.coalesce("threshold", F.lit(float(threshold))).between(*THRESHOLD_LIMITS)}
    good, bad = split_valid(batches, rules)
    return good.select("batch_id", F.coalesce("threshold", F.lit(float(threshold))).alias("limit"),
                       F.coalesce("top_n_reasons", F.lit(DEFAULT_REASONS)).alias("n_reasons"), F.inline("flights")), bad


def answer_requests(requests: DataFrame, store: dict[str, DataFrame], holidays: DataFrame, model, columns: list[str],
                    threshold: float | Column, reasons: int | Column = DEFAULT_REASONS) -> tuple[DataFrame, DataFrame]:
    """Requests from validation to answers with a loaded model, and the rejected ones."""
    good, bad = validate_requests(requests, store["airports"])
    scored = model.score(featurize(good, store, holidays, columns))
    return assess(scored, "p", threshold, model.contributions(), reasons), bad


def _weather_at(side: str, normal: str) -> dict[str, Column]:
    """Measures of one end: request, then month normal, then a mild day."""
    def pick(measure: str) -> Column:
        return F.coalesce(F.col(side)[measure], F.col(f"{normal}_dep_wx_{measure}"),
                          F.lit(FALLBACK_WEATHER[measure]))

    w = {m: pick(m) for m in FALLBACK_WEATHER}
    w["snow_mm"] = F.coalesce(F.col(side)["snow_mm"], F.lit(0.0))
    w["dewpoint_c"] = F.coalesce(F.col(side)["dewpoint_c"], w["temperature_c"] - DEWPOINT_DROP_C)
    condition = F.coalesce(F.col(side)["condition"], F.lit("Clear"))
    storm = weather.is_storm(condition, w["wind_gust_kt"], w["precip_mm"])
    w["severity"] = weather.severity(w["precip_mm"], w["wind_gust_kt"], w["visibility_km"],
                                     w["snow_mm"], storm, w["cloud_ceiling_ft"])
    return w


def featurize(requests: DataFrame, store: dict[str, DataFrame], holidays: DataFrame,
              columns: list[str]) -> DataFrame:
    """The request columns plus one column per model feature."""
    r = requests.withColumns({
        "_at": clock.parse_timestamp(F.col("scheduled_departure_local")),
        "_until": clock.parse_timestamp(F.col("scheduled_arrival_local")),
        "tail_number": code(F.col("tail_number")),
    }).withColumns({"_day": F.to_date("_at"), "_month": F.month("_at").cast("tinyint"),
                    "_weekday": F.weekday("_at").cast("tinyint"), "_hour": F.hour("_at").cast("tinyint")})
    spots = ["latitude", "longitude", "timezone", "hourly_capacity"]
    for key, prefix in (("origin", "_o_"), ("destination", "_d_")):
        r = attach(r, store["airports"], [key], ["airport_code"], {c: prefix + c for c in spots})
        r = attach(r, store["weather_normals"], [key, "_month"], ["origin", "month"], {
            f"dep_wx_{m}": f"{prefix}n_dep_wx_{m}" for m in FALLBACK_WEATHER})
    stored = {
        "route": (["origin", "destination"], ["origin", "destination"],
                  ["route_delay_rate_30d", "route_popularity_30d", "scheduled_block_min"]),
        "aircraft": (["tail_number"], ["tail_number"], ["aircraft_model", "seats", "aircraft_age_years"]),
        "demand": (["origin", "_weekday", "_hour"], ["origin", "day_of_week", "dep_hour"],
                   ["origin_hour_departures"]),
        "carrier_origin": (["carrier_code", "origin"], ["carrier_code", "origin"],
                           ["carrier_origin_delay_rate_14d", "carrier_origin_volume_14d",
                            "carrier_share_at_origin"]),
        "carrier": (["carrier_code"], ["carrier_code"], ["carrier_delay_rate_7d", "carrier_volume_7d"]),
        "origin": (["origin"], ["origin"], ["origin_delay_rate_7d", "origin_mean_delay_min_7d"]),
    }
    for section, (keys, there, names) in stored.items():
        named = {n: f"_s_{n}" for n in names}
        if "date" in store[section].columns:  # a version per day
            r = attach_as_of(r, store[section], keys, there, "_day", "date", named)
        else:
            r = attach(r, store[section], keys, there, named)
    gaps = nearest_date_gap(r, "_day", holidays.where(F.col("is_major_travel") == 1), "holiday_date")
    r = attach(r, gaps, ["_day"], ["_day"], {"days_from_major_holiday": "_gap"})
    default_names = [c for c in columns if c in store["defaults"].columns]
    row = store["defaults"].select(F.struct(*default_names)).scalar()
    r = r.withColumn("_default", row)

    def default(name: str) -> Column:
        return F.col("_default")[name] if name in default_names else F.lit(None)

    def kept(name: str) -> Column:
        return F.coalesce(F.col(f"_s_{name}"), default(name))

    km = space.great_circle_km(F.col("_o_latitude"), F.col("_o_longitude"),
                               F.col("_d_latitude"), F.col("_d_longitude"))
    heading = space.bearing_degrees(F.col("_o_latitude"), F.col("_o_longitude"),
                                    F.col("_d_latitude"), F.col("_d_longitude"))
    implied = schedule.implied_block_min(km)
    planned = clock.zoned_minutes(F.col("_at"), F.col("_o_timezone"), F.col("_until"), F.col("_d_timezone"))
    block = clip(F.coalesce(planned, F.col("_s_scheduled_block_min"), implied), *BLOCK_LIMITS)
    w_o, w_d = _weather_at("origin_weather", "_o_n"), _weather_at("dest_weather", "_d_n")
    arrived, left = F.col("prev_leg_arr_delay_min"), F.col("prev_leg_dep_delay_min")
    upstream = clip(F.coalesce(arrived, left, F.lit(0.0)), low=0.0)
    turnaround = F.coalesce(F.nullif(F.col("scheduled_turnaround_min"), F.lit(0.0)),
                            default("scheduled_turnaround_min").cast("double"))
    ground = F.coalesce(F.col("scheduled_ground_time_min"),
                        F.when(arrived.isNotNull() | left.isNotNull(), turnaround).otherwise(999.0))
    demand = F.coalesce(F.col("_s_origin_hour_departures"), default("origin_hour_departures").cast("double"),
                        F.lit(FALLBACK_DEMAND))
    features = {
        "dep_time_decimal": clock.decimal_hour(F.col("_at")),
        "dep_minute": F.minute("_at"), "day_of_week": F.col("_weekday"),
        **clock.cycles(F.col("_at")),
        "time_block": clock.hour_bands(F.col("_at"))["time_block"],
        "holiday_proximity": F.coalesce(clock.holiday_proximity(F.abs("_gap")), F.lit(0.0)),
        "lat_delta": F.col("_d_latitude") - F.col("_o_latitude"),
        "bearing_sin": F.sin(F.radians(heading)), "bearing_cos": F.cos(F.radians(heading)),
        "scheduled_block_min": block, "schedule_padding_min": block - implied,
        "padding_ratio": (block - implied) / clip(block, low=1.0),
        "scheduled_turnaround_min": turnaround,
        "aircraft_model": F.coalesce(F.nullif(F.trim("aircraft_model"), F.lit("")), kept("aircraft_model")),
        "seats": F.coalesce(F.nullif("seats", F.lit(0)).cast("double"), kept("seats").cast("double")),
        "aircraft_age_years": F.coalesce("aircraft_age_years", kept("aircraft_age_years")),
        "dep_wx_temperature_c": w_o["temperature_c"], "dep_wx_wind_speed_kt": w_o["wind_speed_kt"],
        "dep_wx_visibility_km": w_o["visibility_km"], "dep_wx_cloud_ceiling_ft": w_o["cloud_ceiling_ft"],
        "dep_dewpoint_spread": w_o["temperature_c"] - w_o["dewpoint_c"],
        "dep_gust_factor": w_o["wind_gust_kt"] / clip(w_o["wind_speed_kt"], low=1.0),
        "dep_temp_anomaly": w_o["temperature_c"] - F.coalesce(
            F.col("_o_n_dep_wx_temperature_c"), w_o["temperature_c"]),
        "dep_wx_severity": w_o["severity"],
        "route_wx_severity": weather.route_severity(w_o["severity"], w_d["severity"]),
        "origin_congestion_ratio": schedule.congestion_ratio(
            demand, clip(F.col("_o_hourly_capacity").cast("double"), low=1.0)),
        **{n: kept(n).cast("double") for n in (
            "carrier_share_at_origin", "carrier_delay_rate_7d", "carrier_volume_7d",
            "origin_delay_rate_7d", "origin_mean_delay_min_7d", "route_delay_rate_30d",
            "route_popularity_30d", "carrier_origin_delay_rate_14d", "carrier_origin_volume_14d")},
        "prev_leg_known": flag(arrived.isNotNull()), "upstream_delay_min": upstream,
        "slack_vs_upstream_min": ground - 30.0 - upstream,
        "aircraft_cum_delay_today": F.coalesce("aircraft_cum_delay_today", F.lit(0.0)),
    }
    features |= {c: default(c) for c in columns if c not in features and c not in CODES}
    keep = [c for c in requests.columns if c not in features]
    return select_apart(r, {c: F.col(c) for c in keep} | features)


def assess(scored: DataFrame, probability: str, threshold: float | Column,
           weights: dict[str, tuple[float, float]] | Column | None = None, reasons: int | Column = DEFAULT_REASONS) -> DataFrame:
    """Answer per flight: probability, band, advice, expected minutes, reasons, sentence.

    The reasons come from the weights of a linear score or from a model's contributions; threshold and
    number of reasons are the same for all flights or columns.
    """
    p, limit = F.col(probability), as_column(threshold)
    out = {
        "flight": flight_label(F.col("carrier_code"), F.col("flight_number")),
        "route": schedule.route_key(F.col("origin"), F.col("destination")),
        "delay_probability": F.bround(p, 4), "risk_band": risk_band(p), "threshold": limit,
        "recommend_intervention": p >= limit,
        "expected_delay_minutes": F.bround(expected_minutes(p), 1),
    }
    answered = scored.withColumns(out)
    if weights is not None:
        parts = linear_contributions(weights) if isinstance(weights, dict) else weights
        answered = answered.withColumn("top_factors", strongest(parts, as_column(reasons)))
        answered = answered.withColumn("explanation", narrative(F.col("top_factors"), p))
    return answered


def watch_list(assessed: DataFrame, key: str) -> DataFrame:
    """Highest risk first."""
    return assessed.orderBy(F.desc("delay_probability"), key)


def watch_summary(assessed: DataFrame, probability: str, threshold: float) -> DataFrame:
    p = F.col(probability)
    return assessed.agg(
        F.count(F.lit(1)).alias("n_flights"), F.lit(threshold).alias("threshold"),
        count_where(p >= threshold).alias("n_flagged"), F.bround(F.avg(p), 4).alias("mean_risk"),
        F.bround(F.sum(p), 1).alias("expected_delayed_flights"))
