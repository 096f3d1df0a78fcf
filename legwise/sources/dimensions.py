"""Literal dimensions, the holiday calendar and the feature manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legwise.functions.text import mentions_any

# Holidays with heavy travel, extra heavy days of every year, trailing days.
MAJOR_HOLIDAYS = ("Thanksgiving", "Christmas Day", "New Year's Day", "Independence Day",
                  "Memorial Day", "Labor Day")
EXTRA_DAYS = ((12, 24, "Christmas Eve"), (12, 26, "Day after Christmas"), (12, 31, "New Year's Eve"))
TRAILING_DAYS = 7


def literal_dimension(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A reference table given as literals, with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def holiday_calendar(official: DataFrame, day: str, name: str, start: str, end: str) -> DataFrame:
    """Holidays of a period, with heavy ones marked; an official name wins over an extra one."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    named = official.select(
        F.col(day).alias("holiday_date"), F.col(name).alias("holiday_name"),
        mentions_any(F.col(name), MAJOR_HOLIDAYS).cast("int").alias("is_major_travel"),
        F.lit(0).alias("_source"),
    ).where(F.col("holiday_date").between(first, F.date_add(last, TRAILING_DAYS)))
    years = F.explode(F.sequence(F.year(first), F.year(last)))
    per_year = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("n")) for m, d, n in EXTRA_DAYS])
    extra = (
        official.sparkSession.range(1).select(years.alias("y")).select("y", F.inline(per_year))
        .select(F.make_date("y", "m", "d").alias("holiday_date"), F.col("n").alias("holiday_name"),
                F.lit(1).alias("is_major_travel"), F.lit(1).alias("_source"))
        .where(F.col("holiday_date").between(first, last))
    )
    both = named.unionByName(extra)
    pick = F.min_by(F.struct("holiday_name", "is_major_travel"), F.struct("_source", "holiday_name"))
    return both.groupBy("holiday_date").agg(pick.alias("_row")).select("holiday_date", "_row.*")


def feature_manifest(df: DataFrame, target: str, groups: dict[str, list[str]]) -> DataFrame:
    """Row count, positive rate, group sizes and declared-but-missing columns."""
    declared = sorted({c for cols in groups.values() for c in cols})
    missing = [c for c in declared if c not in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(target).cast("double")).alias("positive_rate"),
    ).select(
        "n_rows", "positive_rate", F.lit(len(declared)).alias("n_features"),
        F.lit(",".join(missing)).alias("missing"),
        *[F.lit(len(cols)).alias(f"size_{g}") for g, cols in groups.items()])
