"""Dimension joins, nearest-date matching, aggregates joined back, fallback chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """Same columns with a role prefix."""
    return df.select(*[F.col(c).alias(prefix + c) for c in (keep or df.columns)])


def attach(fact: DataFrame, dim: DataFrame, fact_keys: list[str], dim_keys: list[str],
           columns: dict[str, str], how: str = "left") -> DataFrame:
    """Equi-join that adds the chosen dimension columns under new names.

    No hint is given: Spark broadcasts a side whose size it knows to be small and
    shuffles otherwise, with skewed partitions split at run time.
    """
    side = dim.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(dim_keys)],
        *[F.col(c).alias(n) for c, n in columns.items()])
    match = reduce(lambda a, b: a & b, [
        F.col(k) == F.col(f"_k{i}") for i, k in enumerate(fact_keys)])
    return fact.join(side, match, how).drop(*[f"_k{i}" for i in range(len(dim_keys))])


def attach_as_of(fact: DataFrame, versions: DataFrame, fact_keys: list[str], version_keys: list[str],
                 day: str, version_day: str, columns: dict[str, str]) -> DataFrame:
    """Join that adds the latest version of a key at or before each row's day.

    The days asked for and the days with a version stand in one table with a row per key and day, where the last version is
    a running value. A key has no more rows there than the calendar has days, however many facts share it;
    the facts then meet the result in an equi-join on key and day.
    """
    names = [f"_k{i}" for i in range(len(fact_keys))]
    asked = fact.select(*[F.col(k).alias(n) for k, n in zip(fact_keys, names)], F.col(day).alias("_t")).dropna().distinct()
    known = versions.select(*[F.col(k).alias(n) for k, n in zip(version_keys, names)], F.col(version_day).alias("_t"),
                            F.struct(*columns).alias("_v")).dropna(subset=[*names, "_t"])
    both = asked.withColumn("_asked", F.lit(1)).unionByName(known, allowMissingColumns=True).groupBy(*names, "_t").agg(
        F.max("_asked").alias("_asked"), F.max("_v").alias("_v"))
    upto = Window.partitionBy(*names).orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(upto)).where("_asked = 1")
    side = found.select(*names, "_t", *[F.col("_v")[c].alias(out) for c, out in columns.items()])
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(n) for k, n in zip([*fact_keys, day], [*names, "_t"])])
    return fact.join(side, match, "left").drop(*names, "_t")


def attach_roles(fact: DataFrame, dim: DataFrame, dim_key: str,
                 roles: dict[str, str], columns: list[str]) -> DataFrame:
    """Join one dimension once per role: ``roles`` maps fact key to prefix."""
    out = fact
    for key, prefix in roles.items():
        out = attach(out, dim, [key], [dim_key], {c: prefix + c for c in columns})
    return out


def attach_group(fact: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregate per key and join the result back.

    Counts are combined before the shuffle, which a window over the raw rows
    cannot do, so a hot key costs no more than any other.
    """
    grouped = fact.dropna(subset=keys).groupBy(*keys).agg(
        *[c.alias(n) for n, c in aggregates.items()])
    return attach(fact, grouped, keys, keys, {n: n for n in aggregates})


def nearest_date_gap(dates: DataFrame, day: str, marks: DataFrame, mark: str) -> DataFrame:
    """Signed days from each distinct day to its nearest mark; ties go to the earlier.

    Days and marks stand in one calendar with a row per date; the last mark before and the
    next one after a day are running values along it.
    """
    days = dates.select(F.col(day).alias("_d"), F.lit(1).alias("_asked"), F.lit(0).alias("_mark")).where("_d IS NOT NULL")
    marked = marks.select(F.col(mark).alias("_d"), F.lit(0), F.lit(1)).where("_d IS NOT NULL")
    calendar = days.distinct().union(marked.distinct()).groupBy("_d").agg(
        F.max("_asked").alias("_asked"), F.max("_mark").alias("_mark"))
    own = F.when(F.col("_mark") == 1, F.col("_d"))
    along = Window.orderBy("_d")  # one row per calendar date
    gaps = calendar.select(
        "_d", "_asked",
        F.date_diff("_d", F.max(own).over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_since"),
        F.date_diff(F.min(own).over(along.rowsBetween(0, Window.unboundedFollowing)), "_d").alias("_until"))
    nearer = F.when(F.col("_until").isNull() | (F.col("_since") <= F.col("_until")), F.col("_since")).otherwise(-F.col("_until"))
    return gaps.where("_asked = 1").select(
        F.col("_d").alias(day), nearer.cast("double").alias("days_from_major_holiday"))


def attach_holidays(fact: DataFrame, day: str, holidays: DataFrame) -> DataFrame:
    """Holiday membership and distance to the nearest major travel holiday.

    ``holidays`` has holiday_date, holiday_name and is_major_travel.
    """
    named = attach(fact, holidays, [day], ["holiday_date"],
                   {"holiday_name": "_name", "is_major_travel": "_major"})
    gaps = nearest_date_gap(
        fact, day, holidays.where(F.col("is_major_travel") == 1), "holiday_date")
    return (
        named.withColumn("is_holiday", F.col("_major").isNotNull().cast("tinyint"))
        .withColumn("is_major_travel_holiday", F.coalesce(F.col("_major") == 1, F.lit(False)).cast("tinyint"))
        .withColumn("holiday_name", F.coalesce(F.col("_name"), F.lit("None")))
        .drop("_name", "_major")
        .join(gaps, day, "left")
    )


def keep_known(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose key exists in the dimension."""
    return fact.join(dim.select(F.col(dim_key).alias("_known")).distinct(),
                     F.col(key) == F.col("_known"), "left_semi")


def keep_unknown(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose key is missing or not in the dimension."""
    return fact.join(dim.select(F.col(dim_key).alias("_known")).distinct(),
                     F.col(key) == F.col("_known"), "left_anti")


def mark_known(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, out: str) -> DataFrame:
    """Add 1 where the key exists in the dimension, else 0."""
    known = dim.select(F.col(dim_key).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    return (
        fact.join(known, F.col(key) == F.col("_known"), "left")
        .withColumn(out, F.col("_known").isNotNull().cast("tinyint")).drop("_known")
    )


def fill_from_group_median(fact: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Missing values become the exact median of their group."""
    from legwise.operators.quantiles import exact_quantiles

    medians = exact_quantiles(fact, keys, F.col(value), {"_median": 0.5})
    filled = attach(fact, medians, keys, keys, {"_median": "_median"})
    return filled.withColumn(value, F.coalesce(F.col(value), F.col("_median"))).drop("_median")


def first_available(*candidates: Column) -> Column:
    """Fallback chain: request value, stored value, default."""
    return F.coalesce(*candidates)


def observed_pair_distances(pairs: DataFrame, left: str, right: str, stations: DataFrame,
                            code: str) -> DataFrame:
    """Great-circle distance of every pair of stations that occurs in the table."""
    from legwise.functions.space import great_circle_km

    distinct = pairs.select(left, right).distinct()
    placed = attach_roles(distinct, stations, code, {left: "a_", right: "b_"},
                          ["latitude", "longitude"])
    return placed.select(left, right, great_circle_km(
        F.col("a_latitude"), F.col("a_longitude"),
        F.col("b_latitude"), F.col("b_longitude")).alias("distance_km"))
