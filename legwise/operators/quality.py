"""Cleaning rules with an audit of how many rows or cells each one touched.

Rules apply in order: a row rejected by one rule is not counted by a later one.
Every cleaner returns the cleaned table and a (step, rows_affected) table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legwise.functions import weather as wx
from legwise.functions.base import SENTINELS, clip, count_where, flag, keep_between, nullify
from legwise.functions.clock import local_to_utc, minutes_between, parse_timestamp
from legwise.functions.text import code, is_station_code
from legwise.operators.joins import attach, fill_from_group_median, keep_known, mark_known
from legwise.operators.quantiles import exact_medians
from legwise.operators.windows import (
    UNKNOWN_CONDITION, first_rows, forward_fill, hourly_grid, interpolate_columns,
)
from legwise.session import settle

# Plausible delay, block time and distance ranges.
DELAY_RANGE_MIN = (-120.0, 1440.0)
BLOCK_RANGE_MIN = (20.0, 540.0)
MAX_DISTANCE_KM = 8000.0
MAX_AGE_YEARS = 45.0


def audit_table(totals: DataFrame, steps: list[str]) -> DataFrame:
    """Turn a one-row table of counters into (step_no, step, rows_affected)."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"),
                 F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias("rows_affected"))
        for i, s in enumerate(steps, 1)])
    return totals.select(F.inline(rows))


def first_failed(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule a row breaks, NULL for a good row.

    Each condition says when a row is bad; an unknown answer counts as good, so
    rules that must reject missing values say so themselves.
    """
    return F.coalesce(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])


def audit_verdicts(marked: DataFrame, verdict: str, rules: list[str]) -> DataFrame:
    """Rejected rows per rule, from one pass over the marked rows."""
    return audit_table(
        marked.agg(*[count_where(F.col(verdict) == r).alias(r) for r in rules]), rules)


def count_cells(columns: dict[str, Column]) -> Column:
    """Aggregate: number of cells, over all columns, on which the condition holds."""
    return reduce(lambda a, b: a + b, [count_where(c) for c in columns.values()])


def bad_code_examples(rejected: DataFrame, column: str, k: int = 4) -> DataFrame:
    """The first k distinct rejected codes in alphabetical order, as one text."""
    few = rejected.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(k)
    return few.agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ", ")
                   .alias("examples"))


# ---------------------------------------------------------------- dimensions
def clean_airports(airports: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Normalised, unique, well-formed codes; a malformed code stops the job."""
    coded = airports.withColumn("airport_code", code(F.col("airport_code")))
    unique = first_rows(coded, ["airport_code"], [order])
    checked = unique.withColumn("airport_code", F.when(
        is_station_code(F.col("airport_code")), F.col("airport_code")).otherwise(
        F.raise_error(F.concat(F.lit("invalid station code: "),
                               F.coalesce("airport_code", F.lit("NULL"))))))
    counts = coded.agg((F.count(F.lit(1)) - F.count_distinct("airport_code")).alias("duplicate codes"))
    return checked, audit_table(counts, ["duplicate codes"])


def clean_aircraft(aircraft: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """One row per tail, age within bounds."""
    unique = first_rows(aircraft, ["tail_number"], [order]).withColumn(
        "age_years_2024", clip(F.col("age_years_2024"), 0.0, MAX_AGE_YEARS))
    counts = aircraft.agg((F.count(F.lit(1)) - F.count_distinct("tail_number")).alias("duplicate tails"))
    return unique, audit_table(counts, ["duplicate tails"])


# ---------------------------------------------------------------- weather
def null_sentinels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: nullify(F.col(c)) for c in columns})


def null_implausible(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: keep_between(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})


def complete_hours(df: DataFrame, key: str, ts: str, measures: list[str],
                   imputed: str = "weather_imputed") -> DataFrame:
    """Full hourly grid per key; hours without any measure are marked."""
    empty = reduce(lambda a, b: a & b, [F.col(m).isNull() for m in measures])
    return hourly_grid(df, key, ts).join(df, [key, ts], "left").withColumn(imputed, flag(empty))


def fill_short_gaps(df: DataFrame, key: str, ts: str, measures: list[str],
                    condition: str | None = None) -> DataFrame:
    """Bounded interpolation of measures and bounded carry-forward of the condition."""
    filled = df
    if condition:
        filled = df.withColumn(
            condition, F.coalesce(forward_fill(key, ts, condition), F.lit(UNKNOWN_CONDITION)))
    return interpolate_columns(filled, key, ts, measures)


def fill_key_medians(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Remaining gaps take the median of the key."""
    medians = exact_medians(df, [key], measures)
    joined = attach(df, medians, [key], [key], {m: f"_m_{m}" for m in measures})
    return joined.withColumns({m: F.coalesce(F.col(m), F.col(f"_m_{m}")) for m in measures}).drop(
        *[f"_m_{m}" for m in measures])


def clean_weather(weather: DataFrame, airports: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Unique, bounded observations on a complete hourly grid without gaps."""
    measures = list(wx.MEASURES)
    typed = weather.withColumns({
        "airport_code": code(F.col("airport_code")),
        "obs_time_utc": parse_timestamp(F.col("obs_time_utc").cast("string")),
    })
    # the audit, the grid and the medians go on from the written observations: at most one per station and hour
    unique = settle(first_rows(typed, ["airport_code", "obs_time_utc"], [order]))
    known = keep_known(unique, "airport_code", airports, "airport_code")
    without_marks = null_sentinels(known, measures)
    bounded = null_implausible(without_marks, wx.PHYSICAL_BOUNDS)
    grid = complete_hours(bounded.drop(order), "airport_code", "obs_time_utc", measures)
    filled = fill_short_gaps(grid, "airport_code", "obs_time_utc", measures, "condition")
    done = fill_key_medians(filled, "airport_code", measures)

    n_typed = typed.agg(F.count(F.lit(1))).scalar()
    n_unique = unique.agg(F.count(F.lit(1))).scalar()
    counts = known.agg(
        F.count(F.lit(1)).alias("_known"),
        count_cells({c: F.col(c).isin(*SENTINELS) for c in measures}).alias("sentinel cells"),
        count_cells({c: ~nullify(F.col(c)).between(lo, hi)
                     for c, (lo, hi) in wx.PHYSICAL_BOUNDS.items()}).alias("out-of-range cells"),
    ).select(
        (n_typed - n_unique).alias("duplicate observations"),
        (n_unique - F.col("_known")).alias("unknown stations"),
        "sentinel cells", "out-of-range cells",
        grid.agg(F.sum(F.col("weather_imputed").cast("bigint"))).scalar().alias("reconstructed hours"),
        filled.agg(count_cells({m: F.col(m).isNull() for m in measures})).scalar()
        .alias("median-filled cells"),
    )
    return done, audit_table(counts, [
        "duplicate observations", "unknown stations", "sentinel cells", "out-of-range cells",
        "reconstructed hours", "median-filled cells"])


# ---------------------------------------------------------------- flights
FLIGHT_CODES = ("origin", "destination", "carrier_code", "tail_number")
FLIGHT_REJECTS = ("invalid station codes", "origin equals destination",
                  "arrival not after departure", "implausible block time", "missing target")
DELAYS = ("departure_delay_min", "arrival_delay_min")


def judge_flights(flights: DataFrame, airports: DataFrame, order: str) -> DataFrame:
    """Unique flights with codes, UTC times, block time and a ``_verdict`` per row."""
    unique = first_rows(flights, ["flight_id"], [order]).drop(order)
    coded = unique.withColumns({c: code(F.col(c)) for c in FLIGHT_CODES})
    placed = attach(coded, airports, ["origin"], ["airport_code"], {"timezone": "_origin_zone"})
    placed = attach(placed, airports, ["destination"], ["airport_code"], {"timezone": "_dest_zone"})
    timed = placed.withColumns({
        "_dep_local": parse_timestamp(F.col("scheduled_departure_local").cast("string")),
        "_arr_local": parse_timestamp(F.col("scheduled_arrival_local").cast("string")),
    }).withColumns({
        "scheduled_departure_utc": local_to_utc(F.col("_dep_local"), F.col("_origin_zone")),
        "scheduled_arrival_utc": local_to_utc(F.col("_arr_local"), F.col("_dest_zone")),
    }).withColumn("scheduled_block_min", minutes_between(
        F.col("scheduled_departure_utc"), F.col("scheduled_arrival_utc")))
    target = keep_between(F.col("departure_delay_min"), *DELAY_RANGE_MIN)
    rules = dict(zip(FLIGHT_REJECTS, (
        F.col("_origin_zone").isNull() | F.col("_dest_zone").isNull(),
        F.col("origin") == F.col("destination"),
        ~F.coalesce(F.col("scheduled_arrival_utc") > F.col("scheduled_departure_utc"), F.lit(False)),
        ~F.col("scheduled_block_min").between(*BLOCK_RANGE_MIN),
        target.isNull() & (F.col("cancelled") == 0),
    )))
    return timed.withColumn("_verdict", first_failed(list(rules.items())))


def clean_flights(flights: DataFrame, airports: DataFrame, aircraft: DataFrame,
                  order: str) -> tuple[DataFrame, DataFrame]:
    """Accepted flights with repaired values, and the audit of every rule."""
    judged = judge_flights(flights, airports, order)
    # judged once: the medians, the cleaned table and the audit go on from the written rows
    tagged = settle(mark_known(judged, "tail_number", aircraft, "tail_number", "tail_known"))
    bad_distance = (F.col("distance_km") <= 0) | (F.col("distance_km") > MAX_DISTANCE_KM)
    # distances are repaired from every flight that passed the time rules
    timely = tagged.where(F.col("_verdict").isNull() | (F.col("_verdict") == "missing target"))
    repaired = fill_from_group_median(
        timely.withColumn("distance_km", F.when(~bad_distance, F.col("distance_km"))),
        ["origin", "destination"], "distance_km")
    clean = (
        repaired.where(F.col("_verdict").isNull())
        .withColumns({d: keep_between(F.col(d), *DELAY_RANGE_MIN) for d in DELAYS})
        .withColumns({c: F.col(c).cast("tinyint") for c in ("cancelled", "diverted")})
        .drop("_verdict", "_origin_zone", "_dest_zone", "_dep_local", "_arr_local")
    )

    verdict = F.col("_verdict")
    placed = ~verdict.isin(*FLIGHT_REJECTS[:2]) | verdict.isNull()
    passed_time = ~verdict.isin(*FLIGHT_REJECTS[:4]) | verdict.isNull()
    n_in = flights.agg(F.count(F.lit(1))).scalar()
    counts = tagged.agg(
        (n_in - F.count(F.lit(1))).alias("duplicate flight ids"),
        *[count_where(verdict == r).alias(r) for r in FLIGHT_REJECTS],
        (count_where(placed & F.col("_dep_local").isNull())
         + count_where(placed & F.col("_arr_local").isNull())).alias("unparseable timestamps"),
        count_where(placed).alias("aligned to UTC"),
        count_where(passed_time & bad_distance).alias("invalid distance"),
        *[count_where(passed_time & ~F.col(d).between(*DELAY_RANGE_MIN)).alias(f"absurd {d}")
          for d in DELAYS],
        count_where(passed_time & (F.col("tail_known") == 0)).alias("unknown tail"),
        count_where(passed_time & (F.col("cancelled") == 1)).alias("cancelled"),
        n_in.alias("rows in"),
        count_where(verdict.isNull()).alias("rows out"),
    )
    steps = ["duplicate flight ids", "invalid station codes", "origin equals destination",
             "unparseable timestamps", "aligned to UTC", "arrival not after departure",
             "implausible block time", "invalid distance", "absurd departure_delay_min",
             "absurd arrival_delay_min", "unknown tail", "cancelled", "missing target",
             "rows in", "rows out"]
    return clean, audit_table(counts, steps)


# ---------------------------------------------------------------- requests
def reject_reasons(rules: dict[str, Column]) -> Column:
    """Array of the names of all broken rules; empty for a valid row."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their reasons."""
    judged = df.withColumn("reasons", reject_reasons(rules))
    return (judged.where(F.size("reasons") == 0).drop("reasons"),
            judged.where(F.size("reasons") > 0))
