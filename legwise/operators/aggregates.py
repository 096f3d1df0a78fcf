"""Delay-rate summaries: by key, band, period, and for the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.functions.base import clip, mean_where, positive_part, ratio, share
from legwise.operators.joins import attach
from legwise.operators.quantiles import exact_quantiles

# Severity cut points in minutes, whisker length.
SEVERITY_CUTS = (15, 60, 120)
WHISKER = 1.5

# A sketch of 2**14 registers errs by 1.6 percent at two standard deviations.
SKETCH_BITS = 14


def rate_by(df: DataFrame, keys: list, late: str, min_rows: int = 0) -> DataFrame:
    """Late rate and row count per key, small groups left out on request."""
    out = df.groupBy(*keys).agg(
        F.avg(F.col(late).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") > min_rows) if min_rows else out


def performance_by(df: DataFrame, keys: list[str], late: str, minutes: str,
                   quantile: float = 0.9) -> DataFrame:
    """Rate, count, mean minutes and an exact upper quantile per key."""
    means = df.groupBy(*keys).agg(
        F.avg(F.col(late).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"),
        F.avg(minutes).alias("mean_min"))
    tails = exact_quantiles(df, keys, F.col(minutes), {"p90": quantile})
    return attach(means, tails, keys, keys, {"p90": "p90"})


def delay_shares(df: DataFrame, key: str, late: str, minutes: str) -> DataFrame:
    """Rate, count, late minutes and share of all late minutes per key."""
    total = df.agg(F.sum(positive_part(F.col(minutes)))).scalar()
    return df.groupBy(key).agg(
        F.avg(F.col(late).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"),
        F.sum(positive_part(F.col(minutes))).alias("total_min"),
    ).withColumn("share_of_delay_minutes", ratio(F.col("total_min"), total))


def severity_mix(df: DataFrame, minutes: str) -> DataFrame:
    """Shares of on-time, minor, major and severe delays."""
    low, mid, high = SEVERITY_CUTS
    d = F.col(minutes)
    return df.agg(
        share(d < low).alias("on_time"), share((d >= low) & (d < mid)).alias("minor"),
        share((d >= mid) & (d < high)).alias("major"), share(d >= high).alias("severe"))


def grid_of_rates(df: DataFrame, row: str, column: str, values: Sequence, late: str) -> DataFrame:
    """Two-way table of late rates with a fixed set of columns."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(F.col(late).cast("double")))


def contrast(df: DataFrame, condition: Column, late: str) -> DataFrame:
    """Late rate with and without a condition, their multiplier and uplift."""
    y = F.col(late).cast("double")
    hit = F.coalesce(condition, F.lit(False))
    return df.agg(mean_where(hit, y).alias("rate_with"), mean_where(~hit, y).alias("rate_without")
                  ).withColumns({
        "multiplier": ratio(F.col("rate_with"), F.col("rate_without")),
        "uplift_pct": (ratio(F.col("rate_with"), F.col("rate_without")) - 1) * 100})


def excess_share(df: DataFrame, condition: Column, late: str) -> DataFrame:
    """Share of all late flights that the condition adds over the rest."""
    y = F.col(late).cast("double")
    hit = F.coalesce(condition, F.lit(False))
    return df.agg(
        mean_where(hit, y).alias("rate_bad"), mean_where(~hit, y).alias("rate_ok"),
        share(hit).alias("share_bad"), F.avg(y).alias("rate_all"),
    ).withColumn("excess_share", ratio(
        (F.col("rate_bad") - F.col("rate_ok")) * F.col("share_bad"), F.col("rate_all")))


def extremes_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with the largest and smallest value; ties go to the smallest key."""
    return df.agg(
        F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("argmax"),
        F.max(value).alias("max_value"),
        F.min_by(key, F.struct(F.col(value), F.col(key))).alias("argmin"),
        F.min(value).alias("min_value"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Row counts in equal-width bins of the clipped value; the last bin is closed."""
    x = clip(F.col(value), low, high)
    slot = F.least(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and whiskers per key: the extreme values within 1.5 box lengths."""
    quartiles = exact_quantiles(df, [key], F.col(value), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    joined = attach(df.select(key, value), quartiles, [key], [key],
                    {"q1": "q1", "median": "median", "q3": "q3"}, "inner")
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(key).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing values per column, one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rate")) for c in columns])))


def typical_demand(df: DataFrame, keys: list[str], day: str, means: list[str]) -> DataFrame:
    """Rows per distinct day and mean levels per key."""
    return df.groupBy(*keys).agg(
        (F.count(F.lit(1)) / F.greatest(F.count_distinct(day), F.lit(1))).alias("per_day"),
        *[F.avg(m).alias(m) for m in means])


def propagation_share(df: DataFrame, late: str, delay: str, upstream: str, first_leg: str) -> DataFrame:
    """How much of the late minutes came with the inbound aircraft."""
    is_late = F.col(late) == 1
    inherited = F.least(F.coalesce(F.col(upstream), F.lit(0.0)), F.col(delay))
    return df.agg(
        ratio(F.sum(F.when(is_late, inherited)), F.sum(F.when(is_late, positive_part(F.col(delay)))))
        .alias("share_inherited"),
        mean_where(is_late, F.coalesce(F.col(upstream) > 15, F.lit(False)).cast("double"))
        .alias("late_with_late_inbound"),
        mean_where(F.col(first_leg) == 1, F.col(late).cast("double")).alias("first_leg_rate"))


def key_figures(df: DataFrame, late: str, delay: str) -> DataFrame:
    """Headline row: flights, rate, mean when late, total late hours."""
    return df.agg(
        F.count(F.lit(1)).alias("flights"), F.avg(F.col(late).cast("double")).alias("rate"),
        mean_where(F.col(late) == 1, F.col(delay)).alias("mean_when_late"),
        (F.sum(positive_part(F.col(delay))) / 60.0).alias("late_hours"))


def top_share(shares: DataFrame, share_column: str, k: int) -> DataFrame:
    """Sum of the k largest shares."""
    return shares.orderBy(F.desc(share_column)).limit(k).agg(F.sum(share_column).alias("top_share"))


def family_shares(df: DataFrame, family: str, value: str) -> DataFrame:
    """Group sums as fractions of the total; one row per family."""
    sums = df.groupBy(family).agg(F.sum(value).alias("total"))
    return sums.withColumn("share", F.col("total") / sums.agg(F.sum("total")).scalar())


def system_summary(df: DataFrame, day: str, late: str, distinct: list[str]) -> DataFrame:
    """One row of facts about the whole table."""
    return df.agg(
        F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in distinct],
        F.avg(F.col(late).cast("double")).alias("rate"))




def distinct_sketches(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One mergeable distinct-count sketch of ``value`` per key and day; NULL values do not count."""
    return df.groupBy(*keys, day).agg(F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch"))


def distinct_between(sketches: DataFrame, keys: list[str], day: str, first: Column, last: Column) -> DataFrame:
    """Estimated distinct values per key over any days, united from their sketches without reading a row again."""
    inside = sketches.where(F.col(day).between(first, last))
    return inside.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
