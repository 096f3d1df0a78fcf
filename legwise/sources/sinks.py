"""Parquet, CSV and JSON sinks, and the fact rows they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.session import settle


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  sort_by: list[str] | None = None) -> None:
    """Partitioned Parquet; with ``sort_by``, files are ranges of a total order.

    Rows of one partition value may come from many tasks, so no value has to
    pass through a single one.
    """
    out = df
    if sort_by:
        out = out.repartitionByRange(*[*(partition_by or []), *sort_by]).sortWithinPartitions(
            *[*(partition_by or []), *sort_by])
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """Small report table as one CSV file with a header.

    The table is computed and written in parallel first; only the finished rows meet in one task.
    """
    settle(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_facts_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; NULL fields are left out."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, *keep: str, out: str = "facts") -> DataFrame:
    """Rows as JSON texts next to the kept key columns."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*rest)).alias(out))
