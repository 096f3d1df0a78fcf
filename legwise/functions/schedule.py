"""Schedule padding, turnarounds, congestion and airframe flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legwise.functions.base import band, clip, flag, ratio

# Taxi allowance, cruise speed, thresholds and station lists.
TAXI_MIN = 30.0
CRUISE_KM_PER_MIN = 12.5
TIGHT_TURNAROUND_MIN = 45
OLD_AIRFRAME_YEARS = 18
REGIONAL_JET = "regional_jet"
DEMAND_SCALE = 6.0
SLOT_CONSTRAINED = ("JFK", "LGA", "DCA", "EWR")
DISTANCE_EDGES = (0.0, 500.0, 1200.0, 2500.0, 9000.0)
DISTANCE_LABELS = ("short", "medium", "long", "transcon")
CONGESTION_EDGES = (0.0, 0.5, 0.75, 1.0, 1.25, 1.5, 10.0)
CONGESTION_LABELS = ("<50%", "50-75%", "75-100%", "100-125%", "125-150%", ">150%")
UPSTREAM_EDGES = (-0.01, 0.1, 15.0, 30.0, 60.0, 120.0, 10000.0)
UPSTREAM_LABELS = ("0", "1-15", "15-30", "30-60", "60-120", ">120")


def implied_block_min(distance_km: Column) -> Column:
    """Block time the distance alone would need."""
    return F.lit(TAXI_MIN) + distance_km / F.lit(CRUISE_KM_PER_MIN)


def schedule_fields(distance_km: Column, block_min: Column, turnaround_min: Column,
                    leg: Column) -> dict[str, Column]:
    padding = block_min - implied_block_min(distance_km)
    return {
        "distance_band": band(distance_km, DISTANCE_EDGES, DISTANCE_LABELS),
        "schedule_padding_min": padding,
        "padding_ratio": padding / clip(block_min, low=1.0),
        "speed_kmh_implied": distance_km / clip(block_min / 60.0, low=0.1),
        "turnaround_buffer_min": turnaround_min - 30.0,
        "tight_turnaround": flag(turnaround_min < TIGHT_TURNAROUND_MIN),
        "leg_depth": leg.cast("tinyint"),
        "is_first_leg_of_day": flag(leg == 0),
    }


def airframe_fields(age_years: Column, category: Column) -> dict[str, Column]:
    return {
        "is_old_aircraft": flag(age_years > OLD_AIRFRAME_YEARS),
        "is_regional_jet": flag(category == REGIONAL_JET),
    }


def congestion_ratio(movements: Column, hourly_capacity: Column) -> Column:
    """Scaled demand over declared capacity."""
    return ratio(movements * F.lit(DEMAND_SCALE), hourly_capacity)


def congestion_fields(departures: Column, arrivals: Column, origin_capacity: Column,
                      dest_capacity: Column, runways: Column, origin: Column,
                      constrained: tuple = SLOT_CONSTRAINED) -> dict[str, Column]:
    load = congestion_ratio(departures, origin_capacity)
    return {
        "origin_congestion_ratio": load,
        "dest_congestion_ratio": congestion_ratio(arrivals, dest_capacity),
        "origin_over_capacity": flag(load > 1),
        "runways_per_departure": runways / clip(departures.cast("double"), low=1.0),
        "origin_is_slot_constrained": flag(origin.isin(*constrained)),
    }


def route_key(origin: Column, destination: Column) -> Column:
    """NULL if either end is missing (concat_ws would hide that)."""
    return F.concat(origin.cast("string"), F.lit("-"), destination.cast("string"))
