"""Work along one global order without sending the table to one task.

A window without PARTITION BY puts every row in a single task. Here Spark's range partitioner
arranges the rows in slots of the order, each row carries the number of its slot, slot totals (one row per
slot) give each slot its starting offset, and the exact running value is computed per slot.

The input is written once, arranged and written again with the slot numbers, so that every later step
sees the same slots. Their number follows the row count; no cut point is in any plan. A value that many
rows share is cut along the next key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.session import settle

SLOT_ROWS = 200_000
HOT_SHARE = 1000


def in_slots(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The rows with ``_slot``: all keys of a slot come before those of the next one."""
    if slots <= 1:
        return df.withColumn("_slot", F.lit(0))
    return settle(df.repartitionByRange(slots, *keys).withColumn("_slot", F.spark_partition_id()))


def running_totals(df: DataFrame, keys: list[str], totals: dict[str, Column],
                   slots: int | None = None, grand: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums of ``totals`` along the ascending order of ``keys``.

    The keys must be non-null and unique together. ``grand`` names columns for the
    sums over the whole table, which the slot totals already hold.
    """
    grand = grand or {}
    valued = settle(df.withColumns({f"_v_{name}": expr for name, expr in totals.items()}))
    slots = slots or -(-valued.count() // SLOT_ROWS)
    marked = in_slots(valued, keys, slots)
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("_slot")
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
        .select("_slot", *[
            F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals
        ], *[F.sum(f"_s_{n}").over(Window.partitionBy()).alias(out) for n, out in grand.items()])
    )
    inside = (
        Window.partitionBy("_slot").orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # one row per slot, that is per SLOT_ROWS rows: settled, so Spark broadcasts it while it is small
    joined = marked.join(settle(offsets), "_slot", "left")
    return joined.select(
        *df.columns, *grand.values(),
        *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in totals],
    )


def positions(df: DataFrame, keys: list[str], out: str = "position") -> DataFrame:
    """Add the 1-based global row number along ``keys``."""
    return running_totals(df, keys, {out: F.lit(1).cast("bigint")})


def equal_frequency_bins(df: DataFrame, score: str, tie_break: str, bins: int,
                         out: str = "bin") -> DataFrame:
    """Bins 1..bins with (nearly) equal row counts along (score, tie_break).

    Bin edges are the interpolated quantiles of the ranks 1..n, intervals closed
    on the right. NULL scores stay out.
    """
    ranked = running_totals(
        df.where(F.col(score).isNotNull()), [score, tie_break],
        {"_position": F.lit(1).cast("bigint")}, grand={"_position": "_rows"})
    bin_no = F.ceil((F.col("_position") - 1) * F.lit(bins) / F.greatest(F.col("_rows") - 1, F.lit(1)))
    return ranked.withColumn(
        out, F.greatest(F.lit(1), bin_no).cast("int")).drop("_position", "_rows")


def average_ranks(df: DataFrame, value: str, out: str, ascending: bool = True) -> DataFrame:
    """Rank of each row's value, ties sharing the mean of their positions, NULL unranked.

    Values are counted first, so tied rows never travel together. The ranks of values
    that hold more than one in ``HOT_SHARE`` rows, fewer than ``HOT_SHARE`` of them, are
    broadcast; other values meet their rank in a join without hot keys.
    """
    rows = settle(df)
    known = rows.where(F.col(value).isNotNull())
    counted = (
        known.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_ties"))
        .withColumn("_key", F.col("_value") if ascending else -F.col("_value"))
    )
    total = known.count()
    ranked = settle(running_totals(counted, ["_key"], {"_upto": F.col("_ties")}).select(
        "_value", "_ties", (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)).alias(out)))
    hot = F.broadcast(ranked.where(F.col("_ties") * HOT_SHARE > total).drop("_ties"))
    same = F.col(value) == F.col("_value")
    cold = ranked.where(F.col("_ties") * HOT_SHARE <= total).drop("_ties")
    plain = known.join(hot, same, "left_anti").join(cold, same, "left")
    unranked = rows.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    kept = [*df.columns, out]
    return known.join(hot, same).select(*kept).unionByName(plain.select(*kept)).unionByName(unranked.select(*kept))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a report; Spark keeps k rows per task."""
    return df.orderBy(*order).limit(k)


def hashed_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same rows on any partitioning.

    Only rows whose hash can be among the n smallest are ordered, about n of them.
    """
    total = df.count()
    hashed = df.withColumn("_digest", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    share = (n + 10 * n ** 0.5 + 10) / max(total, 1)
    if share < 1:
        near = hashed.where(F.col("_digest") < f"{int(share * (1 << 32)):08x}")
        if near.limit(n).count() == n:
            hashed = near
    return hashed.orderBy("_digest", key).limit(n).drop("_digest")
