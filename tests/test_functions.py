"""Column functions on the fixture rows."""

import math

import pytest
from pyspark.sql import functions as F

from legwise.functions import base, clock, space, text, weather


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_known_distance(spark):
    km = one(spark, d=space.great_circle_km(*lit(40.6413, -73.7781, 33.9416, -118.4085)))["d"]
    assert 3900 < km < 4050


def test_distance_is_symmetric_and_zero_on_itself(spark):
    a, b = (33.6, -84.4), (41.9, -87.9)
    row = one(spark, there=space.great_circle_km(*lit(*a, *b)), back=space.great_circle_km(*lit(*b, *a)),
              same=space.great_circle_km(*lit(*a, *a)))
    assert row["there"] == pytest.approx(row["back"]) and row["same"] == pytest.approx(0)


def test_northbound_bearing(spark):
    row = one(spark, b=space.bearing_degrees(*lit(41.97, -87.9, 47.45, -87.9)))["b"]
    assert row < 1 or row > 359


@pytest.mark.parametrize("low,high", [((0, 5, 16, 0, 0, 20000), 0.0)])
def test_severity_is_zero_in_clear_weather(spark, low, high):
    assert one(spark, s=weather.severity(*lit(*[float(v) for v in low])))["s"] == high


def test_severity_grows_with_rain_and_storms(spark):
    score = lambda *v: one(spark, s=weather.severity(*lit(*[float(x) for x in v])))["s"]
    assert score(8, 5, 16, 0, 0, 20000) > score(1, 5, 16, 0, 0, 20000)
    assert score(12, 45, 1.2, 0, 1, 400) > score(0, 5, 16, 0, 0, 20000) + 3


@pytest.mark.parametrize("local,zone,utc", [
    ("2024-01-05 08:00:00", "America/Chicago", "2024-01-05 14:00:00"),
    ("2024-03-10 02:30:00", "America/Chicago", "2024-03-10 08:00:00"),
    ("2024-11-03 01:30:00", "America/Chicago", "2024-11-03 06:30:00"),
    ("2024-07-01 12:00:00", "America/Phoenix", "2024-07-01 19:00:00"),
])
def test_local_to_utc(spark, local, zone, utc):
    got = one(spark, u=clock.local_to_utc(F.lit(local).cast("timestamp"), F.lit(zone)).cast("string"))["u"]
    assert got == utc


def test_bands_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (6,), (24,), (25,)], "x INT")
    got = [r[0] for r in df.select(base.band(F.col("x"), (-1, 5, 9, 24), ("1", "2", "3"))).collect()]
    assert got == [None, "1", "1", "2", "3", None]


def test_cycle_wraps_at_midnight(spark):
    at = lambda t: one(spark, **clock.cycles(F.lit(t).cast("timestamp")))
    a, b = at("2024-01-01 23:00:00"), at("2024-01-02 00:00:00")
    assert math.hypot(a["hour_sin"] - b["hour_sin"], a["hour_cos"] - b["hour_cos"]) < 0.3


def test_flags_count_unknown_as_no_and_clip_keeps_null(spark):
    row = one(spark, f=base.flag(F.lit(None).cast("double") > 1), c=base.clip(F.lit(None).cast("double"), 0, 1))
    assert row["f"] == 0 and row["c"] is None


def test_display_values(spark):
    show = lambda v, u: one(spark, s=text.display_value(F.lit(v), F.lit(u)))["s"]
    assert show(0.214, "%") == "21%" and show(1234.4, "min") == "1,234 min"
    assert show(17.75, "h") == "17:45" and show(3.14159, "x") == "3.1 x" and show(2.0, "") == "2.0"


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.15,), (0.3,), (0.5,), (0.9,)], "p DOUBLE")
    assert [r[0] for r in df.select(text.risk_band(F.col("p"))).collect()] == [
        "low", "moderate", "elevated", "high", "high"]
