"""From raw tables to the model table: clean, integrate, derive features.

The flight table is large and everything derived per station, carrier, route or
day is small next to it. So the small tables are aggregated first, one per
grain, and the flight table then meets each grain once. One daily base serves
all prior-rate features, the station volume and the carrier shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.functions import clock, schedule, space, weather
from legwise.functions.base import flag
from legwise.operators import windows as W
from legwise.operators.joins import attach, attach_holidays, attach_roles
from legwise.operators.projections import keep_columns, missing_columns
from legwise.operators.quality import clean_aircraft, clean_airports, clean_flights, clean_weather
from legwise.plans.features import ALL_FEATURES, ID_COLUMNS
from legwise.session import settle
from legwise.sources.readers import INGEST_ORDER

# Windows of the prior rates, and the station columns taken in both roles.
CARRIER_DAYS, ROUTE_DAYS, ORIGIN_DAYS, CARRIER_ORIGIN_DAYS = 7, 30, 7, 14
STATION_COLUMNS = ["latitude", "longitude", "timezone", "num_runways", "elevation_ft", "is_hub",
                   "hourly_capacity", "region", "city", "state", "climate_zone"]
WEATHER_COLUMNS = [*weather.MEASURES, "condition", "weather_imputed"]


def clean(raw: dict[str, DataFrame], order: str = INGEST_ORDER) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cleaned tables and one audit over all of them."""
    airports, audit_a = clean_airports(raw["airports"], order)
    aircraft, audit_b = clean_aircraft(raw["aircraft"], order)
    observations, audit_c = clean_weather(raw["weather_hourly"], airports, order)
    flights, audit_d = clean_flights(raw["flights"], airports, aircraft, order)
    audit = None
    for table, part in (("airports", audit_a), ("aircraft", audit_b),
                        ("weather", audit_c), ("flights", audit_d)):
        named = part.withColumn("table_name", F.lit(table))
        audit = named if audit is None else audit.unionByName(named)
    return {"airports": airports, "aircraft": aircraft, "weather_hourly": observations,
            "flights": flights, "airlines": raw["airlines"],
            "holiday_calendar": raw["holiday_calendar"]}, audit


def integrate(t: dict[str, DataFrame]) -> DataFrame:
    """One row per flight with station, carrier, aircraft, weather and holiday columns."""
    f = t["flights"].withColumns({
        "local_departure_date": F.to_date(clock.parse_timestamp(
            F.col("scheduled_departure_local").cast("string"))),
        "dep_hour_utc": clock.hour_floor(F.col("scheduled_departure_utc")),
        "arr_hour_utc": clock.hour_floor(F.col("scheduled_arrival_utc")),
    })
    f = attach_roles(f, t["airports"], "airport_code",
                     {"origin": "origin_", "destination": "dest_"}, STATION_COLUMNS)
    f = attach(f, t["airlines"], ["carrier_code"], ["carrier_code"],
               {"carrier_name": "carrier_name", "carrier_type": "carrier_type"})
    f = attach(f, t["aircraft"], ["tail_number"], ["tail_number"], {
        "aircraft_model": "aircraft_model", "manufacturer": "manufacturer", "seats": "seats",
        "category": "category", "age_years_2024": "aircraft_age_years"})
    for place, hour, prefix in (("origin", "dep_hour_utc", "dep_wx_"),
                                ("destination", "arr_hour_utc", "arr_wx_")):
        f = attach(f, t["weather_hourly"], [place, hour], ["airport_code", "obs_time_utc"],
                   {c: prefix + c for c in WEATHER_COLUMNS})
    return attach_holidays(f, "local_departure_date", t["holiday_calendar"])


def _day_tables(f: DataFrame, until: str | None, ready) -> dict[str, tuple[DataFrame, list[str]]]:
    """Side tables at day grain and the carrier shares, all from one daily base."""
    flown = F.col("cancelled") == 0
    base = ready(f.groupBy("carrier_code", "origin", "destination", "route", "date").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(flown).alias("n_flights"),
        F.sum(F.when(flown, F.col("is_delayed").cast("bigint")).otherwise(0)).alias("n_delayed"),
        F.sum(F.when(flown, F.col("departure_delay_min"))).alias("minutes"),
        F.count(F.when(flown, F.col("departure_delay_min"))).alias("n_minutes")))

    def daily(keys: list[str]) -> DataFrame:
        return base.where(F.col("n_flights") > 0).dropna(subset=keys).groupBy(*keys, "date").agg(
            F.sum("n_delayed").alias("n_delayed"), F.sum("n_flights").alias("n_flights"),
            F.try_divide(F.sum("minutes"), F.sum("n_minutes")).alias("mean_minutes"))

    def rate(keys: list[str], days: int, stem: str) -> DataFrame:
        return W.prior_rate(daily(keys), keys, "date", days,
                            f"{stem}_delay_rate_{days}d", f"{stem}_volume_{days}d")

    past = base.where(F.col("date") <= F.lit(until).cast("date")) if until else base
    carriers = rate(["carrier_code"], CARRIER_DAYS, "carrier")
    per_carrier_day = past.groupBy("carrier_code", "date").agg(F.sum("n_all").alias("n_all"))
    weighted = attach(per_carrier_day, carriers, ["carrier_code", "date"], ["carrier_code", "date"],
                      {"carrier_delay_rate_7d": "r"}).where(F.col("r").isNotNull())
    system = weighted.agg(F.try_divide(F.sum(F.col("r") * F.col("n_all")), F.sum("n_all"))).scalar()

    origin_days = base.groupBy("origin", "date").agg(F.sum("n_all").alias("origin_daily_departures"))
    for side, names in (
        (rate(["origin"], ORIGIN_DAYS, "origin"), ("origin_delay_rate_7d", "origin_volume_7d")),
        (W.prior_mean_of_means(daily(["origin"]), ["origin"], "date", ORIGIN_DAYS,
                               "origin_mean_delay_min_7d"), ("origin_mean_delay_min_7d",)),
    ):
        origin_days = attach(origin_days, side, ["origin", "date"], ["origin", "date"],
                             {n: n for n in names})

    pairs = past.dropna(subset=["origin", "carrier_code"]).groupBy("origin", "carrier_code").agg(
        F.sum("n_all").alias("n"))
    wholes = past.dropna(subset=["origin"]).groupBy("origin").agg(F.sum("n_all").alias("n"))
    shares = attach(pairs, wholes, ["origin"], ["origin"], {"n": "whole"}).select(
        "origin", "carrier_code", (F.col("n") / F.col("whole")).alias("carrier_share_at_origin"))
    return {
        "carrier_day": (carriers.withColumn(
            "carrier_vs_system_delay", F.col("carrier_delay_rate_7d") - system), ["carrier_code", "date"]),
        "route_day": (rate(["route"], ROUTE_DAYS, "route"), ["route", "date"]),
        "origin_day": (origin_days, ["origin", "date"]),
        "carrier_origin_day": (rate(["carrier_code", "origin"], CARRIER_ORIGIN_DAYS, "carrier_origin"),
                               ["carrier_code", "origin", "date"]),
        "carrier_share": (shares, ["origin", "carrier_code"]),
    }


def _hour_tables(f: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Movements per station and hour, with the pressure of the neighbouring hours."""
    departures = f.groupBy("origin", "dep_hour_utc").agg(
        F.count(F.lit(1)).alias("origin_hour_departures"))
    arrivals = f.groupBy("destination", "arr_hour_utc").agg(
        F.count(F.lit(1)).alias("dest_hour_arrivals"))
    return {
        "departure_hour": (W.centred_sum(departures, "origin", "dep_hour_utc",
                                         "origin_hour_departures", "bank_pressure_3h"),
                           ["origin", "dep_hour_utc"]),
        "arrival_hour": (arrivals, ["destination", "arr_hour_utc"]),
    }


def _rotation(f: DataFrame, ready, slot: str | None) -> DataFrame:
    """Previous-leg features per flight, from the few columns they need.

    Only this narrow table is arranged by airframe; its result joins the wide
    table on the flight id, which spreads evenly.
    """
    narrow = f.select("flight_id", "tail_number", "scheduled_departure_utc", "scheduled_arrival_utc",
                      "origin", "destination", "departure_delay_min", "arrival_delay_min", "cancelled", "date")
    linked = ready(W.add_propagation(
        narrow, "tail_number", "scheduled_departure_utc", "scheduled_arrival_utc", "flight_id", "origin",
        "destination", "departure_delay_min", "arrival_delay_min", "cancelled", slot))
    summed = W.earlier_delay_today(linked, "tail_number", "date", "scheduled_departure_utc", "flight_id",
                                   "departure_delay_min", "aircraft_cum_delay_today", slot)
    return summed.select("flight_id", *[
        c for c in summed.columns if c not in narrow.columns and not c.startswith("prev_") or
        c.startswith("prev_leg_")])


def derive_features(integrated: DataFrame, until: str | None = None, settled: bool = True,
                    slot: str = W.SLOT) -> DataFrame:
    """All features next to the identifier columns, cancelled flights included.

    ``until`` keeps later days out of the station normals, carrier shares and the
    system rate; by default they use all days. With ``settled`` the small tables
    are written to the shared folder once; Spark knows their size then and broadcasts them if small.
    """
    ready = settle if settled else (lambda df: df)
    local = clock.parse_timestamp(F.col("scheduled_departure_local").cast("string"))
    f = integrated.withColumns({
        "date": F.col("local_departure_date"),
        "is_delayed": flag(F.col("departure_delay_min") >= W.DELAY_THRESHOLD_MIN),
        "route": schedule.route_key(F.col("origin"), F.col("destination")),
        "_local": local,
    })
    seen = f.where(F.col("date") <= F.lit(until).cast("date")) if until else f
    normals = seen.withColumn("month", F.month("_local").cast("tinyint")).groupBy("origin", "month").agg(
        F.avg("dep_wx_temperature_c").alias("_normal_c"))
    sides = _hour_tables(f) | _day_tables(f, until, ready) | {"month_normal": (normals, ["origin", "month"])}
    # the sides are joined while the rows are narrow: each join copies a row, and beyond 100 columns Spark generates no code for it
    wide = f.withColumn("month", F.month("_local").cast("tinyint"))
    for side, keys in sides.values():
        wide = attach(wide, ready(side), keys, keys, {c: c for c in side.columns if c not in keys})
    wide = wide.withColumns(clock.calendar_fields(F.col("_local")) | clock.hour_bands(F.col("_local"))
                         | clock.cycles(F.col("_local")) | clock.season_fields(F.col("_local"))
                         | clock.holiday_fields(F.col("days_from_major_holiday")))
    wide = wide.withColumns(weather.weather_fields("dep_wx_", "dep") | weather.weather_fields("arr_wx_", "arr"))
    wide = wide.withColumns({
        "route_wx_severity": weather.route_severity(F.col("dep_wx_severity"), F.col("arr_wx_severity")),
        "both_ends_bad_wx": flag((F.col("dep_ifr") == 1) & (F.col("arr_ifr") == 1)),
    })
    wide = wide.withColumns(
        schedule.schedule_fields(F.col("distance_km"), F.col("scheduled_block_min"),
                                 F.col("scheduled_turnaround_min"), F.col("leg_number"))
        | schedule.airframe_fields(F.col("aircraft_age_years"), F.col("category"))
        | space.geo_fields())
    wide = wide.withColumns({
        "dep_temp_anomaly": F.col("dep_wx_temperature_c") - F.col("_normal_c"),
        "route_popularity_30d": F.coalesce(F.col("route_volume_30d"), F.lit(0.0)),
    } | schedule.congestion_fields(
        F.col("origin_hour_departures"), F.col("dest_hour_arrivals"), F.col("origin_hourly_capacity"),
        F.col("dest_hourly_capacity"), F.col("origin_num_runways"), F.col("origin")))

    done = wide.join(_rotation(f, ready, slot), "flight_id", "left")
    absent = missing_columns(done, ALL_FEATURES)
    if absent:
        raise ValueError(f"declared but not built: {absent}")
    return keep_columns(done, [*ID_COLUMNS, *ALL_FEATURES])


def model_rows(features: DataFrame) -> DataFrame:
    """Flights that operated: a cancelled one has no delay to learn from."""
    return features.where(F.col("cancelled") == 0)
