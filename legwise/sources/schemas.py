"""Explicit schemas (DDL) of the raw tables and of scoring requests. Nothing is inferred."""

from __future__ import annotations

from legwise.functions.weather import MEASURES

FLIGHTS = """
    flight_id STRING, carrier_code STRING, flight_number INT, tail_number STRING,
    origin STRING, destination STRING,
    scheduled_departure_local STRING, scheduled_arrival_local STRING,
    scheduled_elapsed_min DOUBLE, distance_km DOUBLE, scheduled_turnaround_min DOUBLE,
    leg_number INT, departure_delay_min DOUBLE, arrival_delay_min DOUBLE,
    cancelled INT, diverted INT
"""
AIRPORTS = """
    airport_code STRING, airport_name STRING, city STRING, state STRING, region STRING,
    latitude DOUBLE, longitude DOUBLE, timezone STRING, num_runways INT, elevation_ft INT,
    is_hub INT, hourly_capacity INT, climate_zone STRING
"""
AIRLINES = """
    carrier_code STRING, carrier_name STRING, carrier_type STRING, fleet_share DOUBLE,
    ops_quality_index DOUBLE, hubs STRING
"""
AIRCRAFT = """
    tail_number STRING, carrier_code STRING, aircraft_model STRING, manufacture_year INT,
    age_years_2024 DOUBLE, manufacturer STRING, seats INT, range_km INT, category STRING,
    reliability_index DOUBLE
"""
WEATHER = (
    "airport_code STRING, obs_time_utc STRING, "
    + ", ".join(f"{m} DOUBLE" for m in MEASURES) + ", condition STRING")
HOLIDAYS = "holiday_date DATE, holiday_name STRING, is_major_travel INT"

OBSERVATION = "STRUCT<" + ", ".join(f"{m}: DOUBLE" for m in MEASURES) + ", condition: STRING>"
REQUEST = f"""
    request_id STRING, carrier_code STRING, origin STRING, destination STRING,
    scheduled_departure_local STRING, scheduled_arrival_local STRING, flight_number INT,
    tail_number STRING, aircraft_model STRING, aircraft_age_years DOUBLE, seats INT,
    scheduled_turnaround_min DOUBLE, scheduled_ground_time_min DOUBLE,
    prev_leg_arr_delay_min DOUBLE, prev_leg_dep_delay_min DOUBLE, aircraft_cum_delay_today DOUBLE,
    origin_weather {OBSERVATION}, dest_weather {OBSERVATION}
"""

REQUEST_BATCH = f"batch_id STRING, flights ARRAY<STRUCT<{REQUEST}>>, top_n_reasons INT, threshold DOUBLE, _corrupt STRING"

RAW_TABLES = {
    "flights": FLIGHTS, "airports": AIRPORTS, "airlines": AIRLINES, "aircraft": AIRCRAFT,
    "weather_hourly": WEATHER, "holiday_calendar": HOLIDAYS,
}
