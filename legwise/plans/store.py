"""Latest state of every aggregate, frozen as keyed tables for serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legwise.operators.aggregates import typical_demand
from legwise.operators.quantiles import exact_medians, smallest_mode
from legwise.operators.windows import latest_rows
from legwise.plans.features import CATEGORICAL

# The aggregates each section keeps.
LATEST = {
    "carrier": (["carrier_code"], ["carrier_delay_rate_7d", "carrier_volume_7d"]),
    "origin": (["origin"], ["origin_delay_rate_7d", "origin_volume_7d", "origin_mean_delay_min_7d"]),
    "route": (["origin", "destination"],
              ["route_delay_rate_30d", "route_popularity_30d", "distance_km", "scheduled_block_min"]),
    "carrier_origin": (["carrier_code", "origin"],
                       ["carrier_origin_delay_rate_14d", "carrier_origin_volume_14d",
                        "carrier_share_at_origin"]),
}
NORMALS = ["dep_wx_temperature_c", "dep_wx_wind_speed_kt", "dep_wx_wind_gust_kt",
           "dep_wx_precip_mm", "dep_wx_visibility_km", "dep_wx_cloud_ceiling_ft"]
NEWEST = ["date", "scheduled_departure_utc", "flight_id"]


def defaults(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median of each number, most frequent text of each category."""
    numeric = [c for c in columns if c not in CATEGORICAL]
    row = exact_medians(features, [], numeric)
    return row.withColumns({c: smallest_mode(features, c) for c in columns if c in CATEGORICAL})


def build_store(features: DataFrame, airports: DataFrame, airlines: DataFrame, aircraft: DataFrame,
                columns: list[str], daily: bool = False) -> dict[str, DataFrame]:
    """All sections; each carries the day it is valid for.

    With ``daily`` the latest-state sections keep a version per key and ``date``, so that a request of any day
    can be answered as of that day.
    """
    day = ["date"] if daily else []
    sections = {name: latest_rows(features, [*keys, *day], NEWEST, keep) for name, (keys, keep) in LATEST.items()}
    sections["demand"] = typical_demand(
        features, ["origin", "day_of_week", "dep_hour"], "date",
        ["bank_pressure_3h", "origin_daily_departures"],
    ).withColumnRenamed("per_day", "origin_hour_departures").withColumns({
        c: F.bround(c, 3) for c in ("origin_hour_departures", "bank_pressure_3h", "origin_daily_departures")})
    sections["dest_arrivals"] = features.groupBy("destination", "day_of_week").agg(
        F.bround(F.avg("dest_hour_arrivals"), 2).alias("dest_hour_arrivals"))
    sections["weather_normals"] = exact_medians(features, ["origin", "month"], NORMALS).withColumns(
        {c: F.bround(c, 2) for c in NORMALS})
    sections["defaults"] = defaults(features, columns)
    sections["airports"] = airports
    sections["airlines"] = airlines.select("carrier_code", "carrier_type")
    sections["aircraft"] = aircraft.select(
        "tail_number", "aircraft_model", "seats", "category",
        F.col("age_years_2024").alias("aircraft_age_years"), "carrier_code")
    as_of = features.agg(F.max("date")).scalar()
    return {name: df.withColumn("as_of", as_of) for name, df in sections.items()}


def save_store(store: dict[str, DataFrame], folder: str) -> None:
    for name, section in store.items():
        section.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = [*LATEST, "demand", "dest_arrivals", "weather_normals", "defaults", "airports",
             "airlines", "aircraft"]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
