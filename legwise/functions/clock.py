"""Calendar fields, cyclical encodings, holiday distances and time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legwise.functions.base import band, clip, flag, positive_part

# Hour bands, bank hours, seasons and holiday-window sizes.
TIME_BLOCK_EDGES = (-1, 5, 9, 12, 16, 20, 24)
TIME_BLOCK_LABELS = (
    "night", "early_morning", "late_morning", "afternoon", "evening", "late_evening",
)
PEAK_HOURS = (7, 8, 17, 18, 19)
SUMMER_MONTHS = (6, 7, 8)
WINTER_MONTHS = (12, 1, 2)
SPRING_MONTHS = (3, 4, 5)
DAYS_PER_YEAR = 365.25
HOLIDAY_WINDOW_DAYS = 3
HOLIDAY_FADE_DAYS = 4.0


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a text, NULL when it cannot be read."""
    return F.try_to_timestamp(text)


def decimal_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def calendar_fields(ts: Column) -> dict[str, Column]:
    """Parts of a local departure time; Monday is weekday 0, weeks are ISO weeks."""
    weekday = F.weekday(ts)
    return {
        "dep_hour": F.hour(ts).cast("tinyint"),
        "dep_minute": F.minute(ts).cast("tinyint"),
        "dep_time_decimal": decimal_hour(ts),
        "day_of_week": weekday.cast("tinyint"),
        "day_of_month": F.dayofmonth(ts).cast("tinyint"),
        "month": F.month(ts).cast("tinyint"),
        "quarter": F.quarter(ts).cast("tinyint"),
        "day_of_year": F.dayofyear(ts).cast("smallint"),
        "week_of_year": F.weekofyear(ts).cast("smallint"),
        "is_weekend": flag(weekday >= 5),
        "is_monday": flag(weekday == 0),
        "is_friday": flag(weekday == 4),
    }


def hour_bands(ts: Column) -> dict[str, Column]:
    """Operational parts of the day."""
    hour = F.hour(ts)
    return {
        "is_red_eye": flag((hour >= 22) | (hour <= 4)),
        "is_morning_bank": flag(hour.between(6, 9)),
        "is_evening_bank": flag(hour.between(16, 20)),
        "is_peak_hour": flag(hour.isin(*PEAK_HOURS)),
        "time_block": band(hour, TIME_BLOCK_EDGES, TIME_BLOCK_LABELS),
    }


def turn(x: Column, period: float) -> Column:
    """Angle in radians of x on a circle of the given period."""
    return x * F.lit(2.0) * F.pi() / F.lit(period)


def cycles(ts: Column) -> dict[str, Column]:
    """Positions on the daily and yearly circles."""
    daily = turn(decimal_hour(ts), 24.0)
    yearly = turn(F.dayofyear(ts), DAYS_PER_YEAR)
    return {
        "hour_sin": F.sin(daily),
        "hour_cos": F.cos(daily),
        "doy_sin": F.sin(yearly),
        "doy_cos": F.cos(yearly),
    }


def season(month: Column) -> Column:
    return (
        F.when(month.isin(*WINTER_MONTHS), "winter")
        .when(month.isin(*SPRING_MONTHS), "spring")
        .when(month.isin(*SUMMER_MONTHS), "summer")
        .when(month.isNotNull(), "fall")
    )


def season_fields(ts: Column) -> dict[str, Column]:
    month = F.month(ts)
    return {
        "season": season(month),
        "is_summer_peak": flag(month.isin(*SUMMER_MONTHS)),
        "is_winter_ops": flag(month.isin(*WINTER_MONTHS)),
    }


def holiday_fields(gap: Column) -> dict[str, Column]:
    """Features of the signed distance in days to the nearest major holiday."""
    distance = F.abs(gap)
    return {
        "days_to_holiday": F.coalesce(positive_part(-gap), F.lit(0.0)),
        "days_after_holiday": positive_part(gap),
        "in_holiday_window": flag(distance <= HOLIDAY_WINDOW_DAYS),
        "holiday_proximity": holiday_proximity(distance),
    }


def holiday_proximity(distance: Column) -> Column:
    return clip(F.lit(1.0) - distance / F.lit(HOLIDAY_FADE_DAYS), 0.0, 1.0)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def local_to_utc(local: Column, zone: Column) -> Column:
    """UTC instant of a wall-clock time.

    A repeated hour takes its first reading. A skipped time moves to the end of
    the gap: the round trip shows it, and all zones used have one-hour gaps that
    end on a full UTC hour.
    """
    instant = F.to_utc_timestamp(local, zone)
    skipped = F.from_utc_timestamp(instant, zone) != local
    return F.when(skipped, F.date_trunc("hour", instant)).otherwise(instant)


def zoned_minutes(start: Column, start_zone: Column, end: Column, end_zone: Column) -> Column:
    """Elapsed minutes between two wall-clock times in their own zones."""
    return minutes_between(local_to_utc(start, start_zone), local_to_utc(end, end_zone))
