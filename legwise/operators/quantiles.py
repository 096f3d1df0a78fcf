"""Exact interpolated quantiles in narrow passes, whole groups and hot groups alike.

The built-in exact percentile keeps every distinct value of a group in one task. Here a
mergeable sketch first brackets each wanted position; the error of the sketch is bounded,
so a bracket holds a small share of the group's values. While a bracket still holds more distinct values than
``MOST_VALUES``, another pass counts the rows below it and sketches those inside it, which narrows it by the
same factor; a bracket of one value is narrow however many rows share it. The last pass counts, with
partial sums before the shuffle, what lies below each bracket, and only the distinct values
inside it are ordered. Rows are neither shuffled as they are nor unfolded by column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.session import settle

ACCURACY = 10_000
MARGIN = 3 / ACCURACY
MOST_VALUES = 100_000
ALL = "_all"


def _bracketed(rows: DataFrame, keys: list[str], values: list[str], wanted: list[tuple[str, str, float]]) -> DataFrame:
    """One row per key: the count of each value column and the bracket of each wanted quantile."""
    ends = []
    for i, (_, value, p) in enumerate(wanted):
        pair = F.percentile_approx(value, F.array(F.lit(max(0.0, p - MARGIN)), F.lit(min(1.0, p + MARGIN))), ACCURACY)
        ends += [pair[0].alias(f"_lo{i}"), pair[1].alias(f"_hi{i}")]
    return rows.groupBy(*keys).agg(*[F.count(v).alias(f"_n_{v}") for v in values], *ends)


def _narrowed(rows: DataFrame, keys: list[str], brackets: DataFrame, wanted: list[tuple[str, str, float]], most: int) -> DataFrame:
    """The brackets, narrowed around their positions until none holds more than about ``most`` distinct values."""
    while True:
        placed = rows.join(brackets, keys)
        spots = [(i, F.col(x), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, (_, x, _) in enumerate(wanted)]
        inside = [F.when((x >= lo) & (x <= hi), x) for _, x, lo, hi in spots]
        facts = settle(placed.groupBy(*keys).agg(*[c for (i, x, lo, _), v in zip(spots, inside) for c in (
            F.approx_count_distinct(v).alias(f"_d{i}"), F.count_if(x < lo).alias(f"_b{i}"), F.count(v).alias(f"_c{i}"))]))
        widest = facts.agg(F.max(F.greatest(*[F.col(f"_d{i}") for i in range(len(wanted))], F.lit(0)))).first()[0] or 0
        if widest <= most:
            return brackets
        # places of the wanted positions among the values inside, as steps of a fixed grid of quantiles
        grid = F.array(*[F.lit(j / ACCURACY) for j in range(0, ACCURACY + 1, 50)])
        points = placed.groupBy(*keys).agg(*[F.percentile_approx(v, grid, ACCURACY).alias(f"_g{i}") for i, v in enumerate(inside)])
        cells = ACCURACY // 50
        met = brackets.join(facts, keys).join(points, keys)
        ends = []
        for i, (_, x, p) in enumerate(wanted):
            spot = (F.col(f"_n_{x}") - 1) * F.lit(float(p)) - F.col(f"_b{i}")
            place = spot / F.greatest(F.col(f"_c{i}"), F.lit(1)) * cells
            at = lambda c, i=i: F.get(F.col(f"_g{i}"), F.greatest(F.lit(0), F.least(F.lit(cells), c)).cast("int"))
            wide = F.col(f"_d{i}") > most
            ends += [F.when(wide, F.coalesce(at(F.floor(place) - 1), F.col(f"_lo{i}"))).otherwise(F.col(f"_lo{i}")).alias(f"_lo{i}"),
                     F.when(wide, F.coalesce(at(F.ceil(place) + 1), F.col(f"_hi{i}"))).otherwise(F.col(f"_hi{i}")).alias(f"_hi{i}")]
        counts = [c for c in brackets.columns if c.startswith("_n_")]
        brackets = settle(met.select(*keys, *counts, *ends))


def _quantiles(df: DataFrame, keys: list[str], values: dict[str, Column],
               wanted: list[tuple[str, str, float]], most: int = MOST_VALUES) -> DataFrame:
    """Exact quantiles (name, value, probability) of every group that has a value."""
    group = keys or [ALL]
    named = {v: f"_x{i}" for i, v in enumerate(values)}
    wanted = [(name, named[v], p) for name, v, p in wanted]
    columns = list(named.values())
    present = reduce(lambda a, b: a | b, [F.col(x).isNotNull() for x in columns])
    rows = df if keys else df.withColumn(ALL, F.lit(0))
    rows = rows.select(*group, *[values[v].cast("double").alias(x) for v, x in named.items()])
    rows = settle(reduce(lambda a, k: a.where(F.col(k).isNotNull()), group, rows.where(present)))
    brackets = settle(_bracketed(rows, group, columns, wanted))
    # a bracket holds at most a few thousandths of the rows, so small tables need no further look
    if rows.count() * 2 * MARGIN > most:
        brackets = _narrowed(rows, group, brackets, wanted, most)
    placed = rows.join(brackets, group)
    spots = [(F.col(x), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, (_, x, _) in enumerate(wanted)]
    around = placed.groupBy(*group).agg(*[c for i, (x, lo, hi) in enumerate(spots) for c in (
        F.count_if(x < lo).alias(f"_below{i}"), F.max(F.when(x < lo, x)).alias(f"_prev{i}"),
        F.min(F.when(x > hi, x)).alias(f"_next{i}"))])
    inside = F.array(*[F.struct(F.lit(i).alias("_i"), F.when((x >= lo) & (x <= hi), x).alias("_v"))
                       for i, (x, lo, hi) in enumerate(spots)])
    # a plain filter on the unfolded values is compiled, one inside the array is not
    counted = placed.select(*group, F.inline(inside)).where("_v IS NOT NULL").groupBy(*group, "_i", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    facts = settle(brackets.join(around, group))
    # the wanted positions as rows beside the bracket's values: a handful per group
    places = [F.struct(
        F.lit(i).alias("_i"), F.col(f"_below{i}").alias("_below"), F.col(f"_prev{i}").alias("_prev"),
        F.col(f"_next{i}").alias("_next"), ((F.col(f"_n_{x}") - 1) * F.lit(float(p))).alias("_spot"))
        for i, (_, x, p) in enumerate(wanted)]
    sought = facts.select(*group, F.inline(F.array(*places)))
    upto = F.sum("_c").over(Window.partitionBy(*group, "_i").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    met = counted.withColumn("_upto", upto).join(sought, [*group, "_i"])

    def at(position: Column, out: str) -> Column:
        return F.min(F.when(F.col("_upto") + F.col("_below") > position, F.col("_v"))).alias(out)

    found = met.groupBy(*group, "_i").agg(
        at(F.floor("_spot"), "_low"), at(F.ceil("_spot"), "_high"), F.first("_below").alias("_below"),
        F.first("_prev").alias("_prev"), F.first("_next").alias("_next"), F.first("_spot").alias("_spot"))
    low = F.when(F.floor("_spot") < F.col("_below"), F.col("_prev")).otherwise(F.coalesce("_low", "_next"))
    high = F.when(F.ceil("_spot") < F.col("_below"), F.col("_prev")).otherwise(F.coalesce("_high", "_next"))
    exact = low + (high - low) * (F.col("_spot") - F.floor("_spot"))
    answered = found.groupBy(*group).agg(*[
        F.max(F.when(F.col("_i") == i, exact)).alias(name) for i, (name, _, _) in enumerate(wanted)])
    return answered if keys else answered.drop(ALL)


def exact_quantiles(df: DataFrame, keys: list[str], value: Column,
                    probabilities: dict[str, float], most: int = MOST_VALUES) -> DataFrame:
    """One row per key with the linearly interpolated quantiles of ``value``.

    NULL keys and NULL values are left out. Without keys the result has one row, or none if
    there is no value.
    """
    return _quantiles(df, keys, {"value": value}, [(name, "value", p) for name, p in probabilities.items()], most)


def exact_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the median of each column."""
    return _quantiles(df, keys, {c: F.col(c) for c in columns}, [(c, c, 0.5) for c in columns])


def median_of(df: DataFrame, value: Column) -> Column:
    """Global median as a scalar subquery."""
    return exact_quantiles(df, [], value, {"_median": 0.5}).scalar()


def smallest_mode(df: DataFrame, column: str) -> Column:
    """Most frequent non-null value as a scalar subquery; ties go to the smallest."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column)))).scalar()
