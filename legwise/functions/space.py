"""Great-circle distance, bearing and the geography of a route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legwise.functions.base import flag

# Fixed values.
EARTH_RADIUS_KM = 6371.0
HIGH_ALTITUDE_FT = 4000


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = (
        F.pow(F.sin(half_lat), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial heading in [0, 360), clockwise from north; 0 from a place to itself."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    heading = F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(heading)


def hub_pair(origin_hub: Column, dest_hub: Column) -> Column:
    def kind(hub: Column) -> Column:
        return F.when(hub == 1, "hub").otherwise("spoke")

    return F.concat(kind(origin_hub), F.lit("_"), kind(dest_hub))


def geo_fields(o: str = "origin_", d: str = "dest_") -> dict[str, Column]:
    """Route geography from the prefixed station columns of both ends."""
    lat1, lon1 = F.col(o + "latitude"), F.col(o + "longitude")
    lat2, lon2 = F.col(d + "latitude"), F.col(d + "longitude")
    heading = bearing_degrees(lat1, lon1, lat2, lon2)
    return {
        "route_bearing_deg": heading,
        "bearing_sin": F.sin(F.radians(heading)),
        "bearing_cos": F.cos(F.radians(heading)),
        "is_eastbound": flag((heading > 45) & (heading < 135)),
        "is_westbound": flag((heading > 225) & (heading < 315)),
        "lat_delta": lat2 - lat1,
        "lon_delta": lon2 - lon1,
        "same_region": flag(F.col(o + "region") == F.col(d + "region")),
        "hub_to_hub": (F.col(o + "is_hub") * F.col(d + "is_hub")).cast("tinyint"),
        "hub_pair_type": hub_pair(F.col(o + "is_hub"), F.col(d + "is_hub")),
        "elevation_gain_ft": F.col(d + "elevation_ft") - F.col(o + "elevation_ft"),
        "high_altitude_origin": flag(F.col(o + "elevation_ft") > HIGH_ALTITUDE_FT),
    }
