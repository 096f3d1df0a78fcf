"""Weather flags, bands and the composite severity score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legwise.functions.base import band, clip, flag, positive_part

# Measures, plausible bounds, neutral fills, band edges and score weights.
MEASURES = (
    "temperature_c", "dewpoint_c", "wind_speed_kt", "wind_gust_kt",
    "precip_mm", "snow_mm", "visibility_km", "cloud_ceiling_ft",
)
PHYSICAL_BOUNDS = {
    "temperature_c": (-60.0, 60.0),
    "wind_speed_kt": (0.0, 120.0),
    "wind_gust_kt": (0.0, 160.0),
    "precip_mm": (0.0, 120.0),
    "snow_mm": (0.0, 400.0),
    "visibility_km": (0.0, 20.0),
    "cloud_ceiling_ft": (0.0, 45000.0),
}
CLEAR_VISIBILITY_KM = 16.0
CLEAR_CEILING_FT = 20000.0
RAIN_EDGES, RAIN_LABELS = (-0.01, 0.1, 2.5, 7.6, 1000.0), ("none", "light", "moderate", "heavy")
WIND_EDGES, WIND_LABELS = (-0.01, 12.0, 22.0, 34.0, 1000.0), ("calm", "breezy", "strong", "gale")
VISIBILITY_EDGES = (-0.01, 1.6, 5.0, 10.0, 100.0)
VISIBILITY_LABELS = ("very_poor", "poor", "moderate", "good")
SEVERITY_EDGES = (-0.01, 0.05, 0.3, 0.7, 1.2, 2.0, 10.0)
SEVERITY_LABELS = ("none", "trace", "low", "moderate", "high", "severe")
STORM_CONDITION = "Thunderstorm"
STORM_GUST_KT, STORM_PRECIP_MM = 35.0, 3.0
ADVERSE_SEVERITY = 0.3


def is_storm(condition: Column, gust: Column, precip: Column) -> Column:
    windy_rain = (gust > STORM_GUST_KT) & (precip > STORM_PRECIP_MM)
    return flag(F.coalesce(condition == STORM_CONDITION, F.lit(False))
                | F.coalesce(windy_rain, F.lit(False)))


def _ramp(x: Column, span: float, cap: float) -> Column:
    return clip(x / F.lit(span), 0.0, cap)


def severity(precip: Column, gust: Column, visibility: Column, snow: Column,
             storm: Column, ceiling: Column) -> Column:
    """Weighted sum of six capped terms; 0 in clear weather."""
    weighted = [
        (0.85, _ramp(precip, 6.0, 1.7)),
        (1.25, _ramp(gust - 24.0, 26.0, 1.6)),
        (1.05, _ramp(F.lit(5.0) - visibility, 5.0, 1.0)),
        (1.55, _ramp(snow, 18.0, 1.7)),
        (1.15, storm.cast("double")),
        (0.35, flag(ceiling < 800).cast("double")),
    ]
    total = F.lit(0.0)
    for weight, term in weighted:
        total = total + F.lit(weight) * term
    return total


def weather_fields(prefix: str, out: str) -> dict[str, Column]:
    """Features of the observation columns ``<prefix><measure>``, named ``<out>_...``."""
    raw = {m: F.col(prefix + m) for m in MEASURES}
    precip = F.coalesce(raw["precip_mm"], F.lit(0.0))
    snow = F.coalesce(raw["snow_mm"], F.lit(0.0))
    gust = F.coalesce(raw["wind_gust_kt"], raw["wind_speed_kt"])
    wind = F.coalesce(raw["wind_speed_kt"], F.lit(0.0))
    visibility = F.coalesce(raw["visibility_km"], F.lit(CLEAR_VISIBILITY_KM))
    ceiling = F.coalesce(raw["cloud_ceiling_ft"], F.lit(CLEAR_CEILING_FT))
    spread = raw["temperature_c"] - raw["dewpoint_c"]
    storm = is_storm(F.col(prefix + "condition"), gust, precip)
    return {
        f"{out}_rain_intensity": band(precip, RAIN_EDGES, RAIN_LABELS),
        f"{out}_wind_category": band(gust, WIND_EDGES, WIND_LABELS),
        f"{out}_visibility_level": band(visibility, VISIBILITY_EDGES, VISIBILITY_LABELS),
        f"{out}_is_storm": storm,
        f"{out}_is_snow": flag(snow > 0.5),
        f"{out}_is_freezing": flag(raw["temperature_c"] < 0),
        f"{out}_ifr": flag((ceiling < 3000) | (visibility < 8)),
        f"{out}_lifr": flag((ceiling < 500) | (visibility < 1.6)),
        f"{out}_dewpoint_spread": spread,
        f"{out}_fog_risk": flag((spread < 2) & (visibility < 5)),
        f"{out}_gust_factor": gust / clip(wind, low=1.0),
        f"{out}_heat_stress": positive_part(raw["temperature_c"] - 32.0),
        f"{out}_wx_severity": severity(precip, gust, visibility, snow, storm, ceiling),
    }


def route_severity(departure: Column, arrival: Column) -> Column:
    """The arrival end counts half."""
    return departure + F.lit(0.5) * arrival
