"""Time-ordered operators: prior-window rates, previous-leg links, grid filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.functions.base import clip, flag
from legwise.functions.clock import minutes_between

# Turnaround allowance, slack of an unknown link, delay threshold, fill limit.
MIN_GROUND_MIN = 30.0
OPEN_SLACK_MIN = 999.0
DELAY_THRESHOLD_MIN = 15
FILL_LIMIT = 3
UNKNOWN_CONDITION = "Unknown"


# ---------------------------------------------------------------- prior windows
def daily_counts(df: DataFrame, keys: list[str], day: str, late: Column,
                 minutes: Column | None = None) -> DataFrame:
    """One row per (keys, day): late flights, flights and, if asked, mean minutes.

    Rows shrink to keys x days before any window runs.
    """
    aggregates = [F.sum(late.cast("bigint")).alias("n_delayed"), F.count(F.lit(1)).alias("n_flights")]
    if minutes is not None:
        aggregates.append(F.avg(minutes).alias("mean_minutes"))
    present = df.dropna(subset=[*keys, day])
    return present.groupBy(*keys, day).agg(*aggregates)


def prior_days(keys: list[str], day: str, days: int):
    """Frame over [t - days, t): earlier days only, by the calendar."""
    return (
        Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day)))
        .rangeBetween(-days, -1)
    )


def prior_rate(daily: DataFrame, keys: list[str], day: str, days: int,
               rate: str, volume: str) -> DataFrame:
    """Rate and volume of the days strictly before; NULL when there were none."""
    frame = prior_days(keys, day, days)
    late, flights = F.sum("n_delayed").over(frame), F.sum("n_flights").over(frame)
    return daily.select(
        *keys, day,
        F.try_divide(late.cast("double"), flights.cast("double")).alias(rate),
        flights.cast("double").alias(volume),
    )


def prior_mean_of_means(daily: DataFrame, keys: list[str], day: str, days: int,
                        out: str) -> DataFrame:
    """Unweighted mean of the daily means of the days strictly before."""
    return daily.select(*keys, day, F.avg("mean_minutes").over(prior_days(keys, day, days)).alias(out))


def centred_sum(counts: DataFrame, key: str, order: str, value: str, out: str,
                clock: bool = False) -> DataFrame:
    """Sum over the previous, own and next observed hour (or clock hour)."""
    if clock:
        frame = Window.partitionBy(key).orderBy(F.unix_seconds(order)).rangeBetween(-3600, 3600)
    else:
        frame = Window.partitionBy(key).orderBy(order).rowsBetween(-1, 1)
    return counts.withColumn(out, F.sum(value).over(frame))


def centred_mean(daily: DataFrame, day: str, value: str, out: str, rows: int = 14) -> DataFrame:
    """Mean over ``rows`` days around each day, NULL near the ends.

    The input has one row per calendar day, so the global frame stays tiny.
    """
    frame = Window.orderBy(day).rowsBetween(-(rows // 2), (rows + 1) // 2 - 1)
    full = F.count(F.lit(1)).over(frame) == rows
    return daily.withColumn(out, F.when(full, F.avg(value).over(frame)))


# ---------------------------------------------------------------- previous leg
SLOT = "hour"


def previous_in_order(df: DataFrame, entity: str, ts: str, tie_break: str,
                      carried: dict[str, str], slot: str = SLOT) -> DataFrame:
    """Add columns of the entity's previous row in (ts, tie_break) order.

    Each entity's history is cut into hours, so one busy entity spreads over as many
    tasks as it has hours. The last row of each earlier slot is carried
    over through a small (entity, slot) table. Rows without an entity get NULLs
    and never meet in one task.
    """
    named = df.where(F.col(entity).isNotNull()).withColumn("_slot", F.date_trunc(slot, F.col(ts)))
    anonymous = df.where(F.col(entity).isNull())
    record = F.struct(*[F.col(c).alias(c) for c in carried])
    last = named.groupBy(entity, "_slot").agg(
        F.max_by(record, F.struct(F.col(ts), F.col(tie_break))).alias("_last"))
    carry = last.select(
        entity, "_slot",
        F.lag("_last").over(Window.partitionBy(entity).orderBy("_slot")).alias("_carry"))
    inside = Window.partitionBy(entity, "_slot").orderBy(ts, tie_break)
    linked = (
        named.join(carry, [entity, "_slot"], "left")
        .withColumn("_prev", F.coalesce(F.lag(record).over(inside), F.col("_carry")))
        .select(*df.columns, *[F.col("_prev")[c].alias(n) for c, n in carried.items()])
    )
    types = {f.name: f.dataType for f in linked.schema.fields}
    blank = anonymous.select(
        *df.columns, *[F.lit(None).cast(types[n]).alias(n) for n in carried.values()])
    return linked.unionByName(blank)


def earlier_delay_today(df: DataFrame, entity: str, day: str, ts: str, tie_break: str,
                        delay: str, out: str, slot: str = SLOT) -> DataFrame:
    """Running delay of the entity's earlier rows of the same local day.

    The row right after a missing delay gets 0; the sum resumes after it. A busy
    day is cut into slots as in ``previous_in_order``, with the sum carried over.
    """
    named = df.where(F.col(entity).isNotNull()).withColumn("_slot", F.date_trunc(slot, F.col(ts)))
    anonymous = df.where(F.col(entity).isNull())
    record = F.struct(F.col(delay).alias("d"))
    ended = named.groupBy(entity, day, "_slot").agg(
        F.sum(delay).alias("_sum"), F.max_by(record, F.struct(F.col(ts), F.col(tie_break))).alias("_last"))
    over_day = Window.partitionBy(entity, day).orderBy("_slot")
    carry = ended.select(
        entity, day, "_slot", F.lag("_last").over(over_day).alias("_carry"),
        F.sum("_sum").over(over_day.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    order = Window.partitionBy(entity, day, "_slot").orderBy(ts, tie_break)
    before = F.sum(delay).over(order.rowsBetween(Window.unboundedPreceding, -1))
    previous = F.coalesce(F.lag(record).over(order), F.col("_carry"))
    total = F.coalesce(before, F.lit(0.0)) + F.coalesce("_earlier", F.lit(0.0))
    summed = named.join(carry, [entity, day, "_slot"], "left").select(
        *df.columns, F.when(previous["d"].isNull(), F.lit(0.0)).otherwise(total).alias(out))
    return summed.unionByName(anonymous.withColumn(out, F.lit(0.0)))


def propagation_fields(departure: Column, origin: Column) -> dict[str, Column]:
    """Upstream-delay features from the ``prev_*`` columns of the previous leg.

    The arrival delay counts only if the earlier leg had landed by now, and the
    link only if that leg ended here and was flown.
    """
    landed_at = F.timestamp_micros((
        F.unix_micros("prev_sched_arr")
        + F.coalesce(F.col("prev_arr_delay"), F.lit(0.0)) * 60_000_000).cast("bigint"))
    landed = F.coalesce(
        (landed_at <= departure) & F.col("prev_arr_delay").isNotNull(), F.lit(False))
    chained = F.coalesce(
        (F.col("prev_dest") == origin) & (F.col("prev_cancelled") == 0), F.lit(False))
    arrival = F.when(landed & chained, F.col("prev_arr_delay"))
    leaving = F.when(chained, F.col("prev_dep_delay"))
    upstream = clip(F.coalesce(arrival, leaving, F.lit(0.0)), low=0.0)
    ground = F.when(chained, minutes_between(F.col("prev_sched_arr"), departure))
    slack = F.coalesce(ground, F.lit(OPEN_SLACK_MIN)) - MIN_GROUND_MIN - upstream
    return {
        "prev_leg_arr_delay_min": arrival,
        "prev_leg_dep_delay_min": leaving,
        "prev_leg_known": flag(landed & chained),
        "upstream_delay_min": upstream,
        "upstream_delayed_15": flag(upstream >= DELAY_THRESHOLD_MIN),
        "scheduled_ground_time_min": ground,
        "slack_vs_upstream_min": slack,
        "at_risk_of_propagation": flag((slack < 0) & landed & chained),
    }


def add_propagation(df: DataFrame, entity: str, ts: str, arr: str, tie_break: str, origin: str,
                    destination: str, dep_delay: str, arr_delay: str, cancelled: str,
                    slot: str = SLOT) -> DataFrame:
    """Previous-leg link plus the upstream-delay features."""
    linked = previous_in_order(df, entity, ts, tie_break, {
        dep_delay: "prev_dep_delay", arr_delay: "prev_arr_delay", arr: "prev_sched_arr",
        destination: "prev_dest", cancelled: "prev_cancelled"}, slot)
    return linked.withColumns(propagation_fields(F.col(ts), F.col(origin)))


# ---------------------------------------------------------------- latest state
def latest_rows(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row per key in the given order, combined before the shuffle."""
    state = F.max_by(F.struct(*keep), F.struct(*order))
    return (
        df.dropna(subset=keys).groupBy(*keys).agg(state.alias("_state"))
        .select(*keys, "_state.*")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order (duplicates removed, first kept)."""
    rest = [c for c in df.columns if c not in keys]
    state = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(state.alias("_state")).select(*keys, "_state.*").select(*df.columns)


# ---------------------------------------------------------------- hourly grid
def hourly_grid(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Every (key, hour) from the first to the last observed instant."""
    first, last = df.agg(F.min(ts)).scalar(), df.agg(F.max(ts)).scalar()
    hours = F.sequence(first, last, F.expr("interval 1 hour"))
    return df.select(key).where(F.col(key).isNotNull()).distinct().select(
        key, F.explode(hours).alias(ts))


def forward_fill(key: str, ts: str, column: str, limit: int = FILL_LIMIT) -> Column:
    """Last seen value at most ``limit`` rows back."""
    frame = Window.partitionBy(key).orderBy(ts).rowsBetween(-limit, 0)
    return F.last(column, ignorenulls=True).over(frame)


def interpolate_columns(df: DataFrame, key: str, ts: str, columns: list[str],
                        limit: int = FILL_LIMIT) -> DataFrame:
    """Linear interpolation on a regular hourly grid, at most ``limit`` cells from a
    known value on either side; the ends extend flat.

    Both neighbours come from running frames, one per direction: a frame that ends
    at the last row would be evaluated anew for every cell.
    """
    back = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    celled = df.withColumn("_cell", F.unix_seconds(ts) / 3600)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_cell").alias("at"), F.col(c).alias("v")))
             for c in columns}
    sided = celled.withColumns({f"_l_{c}": F.last(k, ignorenulls=True).over(back) for c, k in known.items()})
    sided = sided.withColumns({f"_r_{c}": F.last(k, ignorenulls=True).over(ahead) for c, k in known.items()})

    def fill(c: str) -> Column:
        left, right, cell = F.col(f"_l_{c}"), F.col(f"_r_{c}"), F.col("_cell")
        slope = F.try_divide(right["v"] - left["v"], right["at"] - left["at"])
        line = left["v"] + slope * (cell - left["at"])
        near = F.coalesce(cell - left["at"] <= limit, F.lit(False)) | F.coalesce(
            right["at"] - cell <= limit, F.lit(False))
        return F.coalesce(F.col(c), F.when(near, F.coalesce(line, left["v"], right["v"])))

    return sided.withColumns({c: fill(c) for c in columns}).drop(
        "_cell", *[f"_{side}_{c}" for side in "lr" for c in columns])
