"""Codes, display values, labels and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk bands, minutes expected at probability 1, and display units.
RISK_EDGES = ((0.15, "low"), (0.30, "moderate"), (0.50, "elevated"))
RISK_TOP = "high"
EXPECTED_DELAY_MIN = 44.0
COUNT_UNITS = ("min", "ft", "flights", "flights/30d", "seats")


def code(text: Column) -> Column:
    return F.upper(F.trim(text))


def is_station_code(text: Column) -> Column:
    return text.rlike("^[A-Z]{3}$")


def split_codes(text: Column) -> Column:
    """Array held in a bar-joined text."""
    return F.split(text, r"\|")


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains one of the words."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def risk_band(p: Column) -> Column:
    out = F.lit(RISK_TOP)
    for edge, name in reversed(RISK_EDGES):
        out = F.when(p < edge, name).otherwise(out)
    return F.when(p.isNotNull(), out)


def expected_minutes(p: Column) -> Column:
    return p * F.lit(EXPECTED_DELAY_MIN)


def flight_label(carrier: Column, number: Column) -> Column:
    """Carrier and flight number; the carrier alone without a number or with number 0."""
    return F.concat(carrier, F.coalesce(F.nullif(number, F.lit(0)).cast("string"), F.lit("")))


def default_label(feature: Column) -> Column:
    """Readable name of a feature without a registered label."""
    words = F.lower(F.replace(feature, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))


def display_value(value: Column, unit: Column) -> Column:
    """Text of a value in its unit: percent, whole count, hh:mm, else one decimal."""
    minutes = F.bround((value - F.floor(value)) * 60, 0).cast("int")
    clock = F.format_string("%02d:%02d", F.floor(value).cast("int"), minutes)
    counted = F.concat(F.format_number(F.bround(value, 0), 0), F.lit(" "), unit)
    plain = F.trim(F.concat(F.format_number(F.bround(value, 1), 1), F.lit(" "),
                            F.coalesce(unit, F.lit(""))))
    return (
        F.when(value.isNull(), "None")
        .when(unit == "%", F.concat(F.format_number(F.bround(value * 100, 0), 0), F.lit("%")))
        .when(unit.isin(*COUNT_UNITS), counted)
        .when(unit == "h", clock)
        .otherwise(plain)
    )


def narrative(reasons: Column, p: Column, up: int = 3, down: int = 2) -> Column:
    """Sentence from an ordered array of (label, display_value, contribution) structs."""
    def phrases(kept: Column) -> Column:
        return F.array_join(
            F.transform(kept, lambda r: F.concat(F.lower(r["label"]), F.lit(" ("),
                                                 r["display_value"], F.lit(")"))), "; ")

    raises = F.slice(F.filter(reasons, lambda r: r["contribution"] > 0), 1, up)
    lowers = F.slice(F.filter(reasons, lambda r: r["contribution"] < 0), 1, down)
    opening = F.concat(F.lit("Predicted departure-delay risk "),
                       F.format_number(F.bround(p * 100, 0), 0), F.lit("%."))
    return F.concat(
        opening,
        F.when(F.size(raises) > 0, F.concat(F.lit(" Driven up by: "), phrases(raises), F.lit(".")))
        .otherwise(""),
        F.when(F.size(lowers) > 0, F.concat(F.lit(" Offset by: "), phrases(lowers), F.lit(".")))
        .otherwise(""),
    )


def drop_null_entries(entries: Column) -> Column:
    """Map without its NULL values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def json_safe(x: Column) -> Column:
    """NaN as NULL, so that JSON never carries it."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
