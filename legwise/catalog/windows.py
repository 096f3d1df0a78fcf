"""W: window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from legwise.catalog.frames import FLIGHTS, HOURLY, OPERATED, SCORED
from legwise.catalog.registry import query
from legwise.operators import windows as W
from legwise.operators.joins import attach, attach_group
from legwise.operators.ordering import average_ranks, equal_frequency_bins

LINKED = FLIGHTS + """,
linked AS (
  SELECT *, LAG(dep_delay) OVER w AS prev_dep_delay, LAG(arr_delay) OVER w AS prev_arr_delay,
         LAG(arr_ts) OVER w AS prev_sched_arr, LAG(destination) OVER w AS prev_dest,
         LAG(cancelled) OVER w AS prev_cancelled
  FROM flights WHERE tail_number IS NOT NULL
  WINDOW w AS (PARTITION BY tail_number ORDER BY dep_ts, flight_id)
  UNION ALL
  SELECT *, NULL, NULL, NULL, NULL, NULL FROM flights WHERE tail_number IS NULL),
gated AS (
  SELECT *,
    COALESCE(prev_arr_delay IS NOT NULL AND
      epoch_us(prev_sched_arr) + (prev_arr_delay * 60000000)::BIGINT <= epoch_us(dep_ts), FALSE) AS landed,
    COALESCE(prev_dest = origin AND prev_cancelled = 0, FALSE) AS chained
  FROM linked),
chain AS (
  SELECT *, CASE WHEN landed AND chained THEN prev_arr_delay END AS inbound_arr,
            CASE WHEN chained THEN prev_dep_delay END AS inbound_dep FROM gated),
upstream AS (
  SELECT *, GREATEST(COALESCE(inbound_arr, inbound_dep, 0), 0) AS up,
            CASE WHEN chained THEN (epoch_us(dep_ts) - epoch_us(prev_sched_arr)) / 60000000.0::DOUBLE END AS ground
  FROM chain)
"""


def linked(t):
    return W.add_propagation(
        t.flights, "tail_number", "dep_ts", "arr_ts", "flight_id", "origin", "destination",
        "dep_delay", "arr_delay", "cancelled")


@query("W1_previous_leg", f"""
WITH {LINKED}
SELECT flight_id, prev_dep_delay, prev_arr_delay, epoch_us(prev_sched_arr) AS prev_arr_us,
       prev_dest, prev_cancelled FROM linked
""")
def previous_leg(t):
    rows = W.previous_in_order(t.flights, "tail_number", "dep_ts", "flight_id", {
        "dep_delay": "prev_dep_delay", "arr_delay": "prev_arr_delay", "arr_ts": "prev_sched_arr",
        "destination": "prev_dest", "cancelled": "prev_cancelled"})
    return rows.select("flight_id", "prev_dep_delay", "prev_arr_delay",
                       F.unix_micros("prev_sched_arr").alias("prev_arr_us"),
                       "prev_dest", "prev_cancelled")


@query("W2_observable_inbound", f"""
WITH {LINKED} SELECT flight_id, (landed AND chained)::INT AS prev_leg_known FROM gated
""")
def observable(t):
    return linked(t).select("flight_id", F.col("prev_leg_known").cast("int").alias("prev_leg_known"))


@query("W3_rotation_chain", f"""
WITH {LINKED} SELECT origin, SUM(chained::INT)::BIGINT AS chained, COUNT(*) AS n FROM gated GROUP BY 1
""")
def rotation_chain(t):
    return linked(t).groupBy("origin").agg(
        F.count("scheduled_ground_time_min").alias("chained"), F.count(F.lit(1)).alias("n"))


@query("W4_upstream_delay", f"""
WITH {LINKED}
SELECT flight_id, ROUND(inbound_arr, 6) AS prev_leg_arr_delay_min, ROUND(inbound_dep, 6) AS prev_leg_dep_delay_min,
       ROUND(up, 6) AS upstream_delay_min, (up >= 15)::INT AS upstream_delayed_15 FROM upstream
""")
def upstream_delay(t):
    return linked(t).select(
        "flight_id", *[F.round(c, 6).alias(c) for c in (
            "prev_leg_arr_delay_min", "prev_leg_dep_delay_min", "upstream_delay_min")],
        F.col("upstream_delayed_15").cast("int").alias("upstream_delayed_15"))


@query("W5_ground_time_slack", f"""
WITH {LINKED}
SELECT flight_id, ROUND(ground, 4) AS scheduled_ground_time_min,
       ROUND(COALESCE(ground, 999) - 30 - up, 4) AS slack_vs_upstream_min,
       (COALESCE(ground, 999) - 30 - up < 0 AND landed AND chained)::INT AS at_risk_of_propagation
FROM upstream
""")
def ground_slack(t):
    return linked(t).select(
        "flight_id", F.round("scheduled_ground_time_min", 4).alias("scheduled_ground_time_min"),
        F.round("slack_vs_upstream_min", 4).alias("slack_vs_upstream_min"),
        F.col("at_risk_of_propagation").cast("int").alias("at_risk_of_propagation"))


@query("W6_delay_so_far_today", f"""
WITH {FLIGHTS}
SELECT flight_id, ROUND(CASE WHEN tail_number IS NULL OR LAG(dep_delay) OVER w IS NULL THEN 0
  ELSE SUM(dep_delay) OVER (PARTITION BY tail_number, day ORDER BY dep_ts, flight_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END::DOUBLE, 6) AS delay_so_far
FROM flights WINDOW w AS (PARTITION BY tail_number, day ORDER BY dep_ts, flight_id)
""")
def delay_so_far(t):
    rows = W.earlier_delay_today(
        t.flights, "tail_number", "day", "dep_ts", "flight_id", "dep_delay", "delay_so_far")
    return rows.select("flight_id", F.round("delay_so_far", 6).alias("delay_so_far"))


@query("W7_rolling_rate_prior", f"""
WITH {OPERATED},
daily AS (SELECT carrier_code, day, SUM(late) AS d, COUNT(*) AS n FROM operated GROUP BY 1, 2),
roll AS (SELECT carrier_code, day, SUM(d) OVER w AS d, SUM(n) OVER w AS n FROM daily
  WINDOW w AS (PARTITION BY carrier_code ORDER BY day
               RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT carrier_code, day::VARCHAR AS day, ROUND(d / n, 6) AS rate, n::DOUBLE AS volume FROM roll
""")
def rolling_rate(t):
    daily = W.daily_counts(t.operated, ["carrier_code"], "day", F.col("late"))
    rolled = W.prior_rate(daily, ["carrier_code"], "day", 7, "rate", "volume")
    return rolled.select("carrier_code", F.col("day").cast("string").alias("day"),
                         F.round("rate", 6).alias("rate"), "volume")


# Keys and window lengths of the four prior rates.
PRIOR_RATES = {
    "carrier": (["carrier_code"], 7),
    "route": (["origin", "destination"], 30),
    "origin": (["origin"], 7),
    "carrier_origin": (["carrier_code", "origin"], 14),
}


def _prior_sql(name, keys, days):
    cols = ", ".join(keys)
    return f"""
{name}_r AS (SELECT {cols}, day, SUM(d) OVER w / SUM(n) OVER w AS {name}_rate, SUM(n) OVER w::DOUBLE AS {name}_volume
  FROM (SELECT {cols}, day, SUM(late) AS d, COUNT(*) AS n FROM operated GROUP BY ALL)
  WINDOW w AS (PARTITION BY {cols} ORDER BY day RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))"""


def prior_features(t):
    """All flights with the four prior rates, from one shared daily base."""
    base = W.daily_counts(t.operated, ["carrier_code", "origin", "destination"], "day", F.col("late"))
    out = t.flights
    for name, (keys, days) in PRIOR_RATES.items():
        daily = base.groupBy(*keys, "day").agg(
            F.sum("n_delayed").alias("n_delayed"), F.sum("n_flights").alias("n_flights"))
        rolled = W.prior_rate(daily, keys, "day", days, f"{name}_rate", f"{name}_volume")
        out = attach(out, rolled, [*keys, "day"], [*keys, "day"],
                     {f"{name}_rate": f"{name}_rate", f"{name}_volume": f"{name}_volume"})
    return out


@query("W8_four_prior_rates", f"""
WITH {OPERATED}, {",".join(_prior_sql(n, k, d) for n, (k, d) in PRIOR_RATES.items())}
SELECT flight_id, {", ".join(f"ROUND({n}_rate, 6) AS {n}_rate, {n}_volume" for n in PRIOR_RATES)}
FROM flights LEFT JOIN carrier_r USING (carrier_code, day)
  LEFT JOIN route_r USING (origin, destination, day) LEFT JOIN origin_r USING (origin, day)
  LEFT JOIN carrier_origin_r USING (carrier_code, origin, day)
""")
def four_prior_rates(t):
    return prior_features(t).select("flight_id", *[
        c for n in PRIOR_RATES for c in (F.round(f"{n}_rate", 6).alias(f"{n}_rate"), f"{n}_volume")])


@query("W9_prior_mean_of_daily_means", f"""
WITH {OPERATED}, daily AS (SELECT origin, day, AVG(dep_delay) AS m FROM operated GROUP BY 1, 2)
SELECT origin, day::VARCHAR AS day, ROUND(AVG(m) OVER (PARTITION BY origin ORDER BY day
  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS mean_min FROM daily
""")
def mean_of_means(t):
    daily = W.daily_counts(t.operated, ["origin"], "day", F.col("late"), F.col("dep_delay"))
    rolled = W.prior_mean_of_means(daily, ["origin"], "day", 7, "mean_min")
    return rolled.select("origin", F.col("day").cast("string").alias("day"),
                         F.round("mean_min", 6).alias("mean_min"))


@query("W10_three_row_bank", f"""
WITH {FLIGHTS}, h AS (SELECT origin, date_trunc('hour', dep_ts) AS hour, COUNT(*) AS n FROM flights GROUP BY 1, 2)
SELECT origin, epoch(hour)::BIGINT AS hour_epoch, n,
  SUM(n) OVER (PARTITION BY origin ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS bank
FROM h
""")
def three_row_bank(t):
    counts = t.flights.groupBy("origin", F.date_trunc("hour", "dep_ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))
    return W.centred_sum(counts, "origin", "hour", "n", "bank").select(
        "origin", F.unix_seconds("hour").alias("hour_epoch"), "n", "bank")


@query("W11_centred_mean_14", f"""
WITH {OPERATED}, daily AS (SELECT day, AVG(late) AS rate FROM operated GROUP BY 1)
SELECT day::VARCHAR AS day, ROUND(CASE WHEN COUNT(*) OVER w = 14 THEN AVG(rate) OVER w END, 6) AS mean_14
FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)
""")
def centred_mean(t):
    daily = t.operated.groupBy("day").agg(F.avg(F.col("late").cast("double")).alias("rate"))
    return W.centred_mean(daily, "day", "rate", "mean_14").select(
        F.col("day").cast("string").alias("day"), F.round("mean_14", 6).alias("mean_14"))


@query("W12_latest_per_key", f"""
WITH {FLIGHTS}
SELECT carrier_code, origin, flight_id, dep_delay FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY carrier_code, origin ORDER BY day DESC, dep_ts DESC, flight_id DESC) AS r
  FROM flights) WHERE r = 1
""")
def latest(t):
    return W.latest_rows(t.flights, ["carrier_code", "origin"], ["day", "dep_ts", "flight_id"],
                         ["flight_id", "dep_delay"])


@query("W13_deviation_from_group_mean", f"""
WITH {FLIGHTS}
SELECT flight_id, ROUND(k - AVG(k) OVER (PARTITION BY origin, month(day)), 6) AS anomaly FROM flights
""")
def group_deviation(t):
    keyed = t.flights.withColumn("month", F.month("day"))
    return attach_group(keyed, ["origin", "month"], mean_k=F.avg("k")).select(
        "flight_id", F.round(F.col("k") - F.col("mean_k"), 6).alias("anomaly"))


@query("W14_deviation_from_system_mean", f"""
WITH {FLIGHTS} SELECT flight_id, ROUND(k - (SELECT AVG(k) FROM flights), 6) AS deviation FROM flights
""")
def system_deviation(t):
    mean = t.flights.agg(F.avg("k")).scalar()
    return t.flights.select("flight_id", F.round(F.col("k") - mean, 6).alias("deviation"))


GRID = HOURLY + """,
grid AS (
  SELECT s.station, h.hour FROM (SELECT DISTINCT station FROM hourly) s,
    (SELECT UNNEST(generate_series((SELECT MIN(hour) FROM hourly), (SELECT MAX(hour) FROM hourly), INTERVAL 1 HOUR)) AS hour) h),
cells AS (
  SELECT g.station, g.hour, epoch(g.hour)::BIGINT // 3600 AS cell, h.temperature_c, h.wind_speed_kt, h.condition
  FROM grid g LEFT JOIN hourly h ON g.station = h.station AND g.hour = h.hour)
"""


def hourly_cells(t):
    grid = W.hourly_grid(t.hourly, "station", "hour")
    return grid.join(t.hourly, ["station", "hour"], "left")


@query("W15_bounded_forward_fill", f"""
WITH {GRID}
SELECT station, cell, COALESCE(LAST_VALUE(condition IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour
  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 'Unknown') AS condition FROM cells
""")
def forward_fill(t):
    filled = F.coalesce(W.forward_fill("station", "hour", "condition"), F.lit("Unknown"))
    return hourly_cells(t).withColumn("condition", filled).select(
        "station", F.expr("unix_seconds(hour) div 3600").alias("cell"), "condition")


@query("W16_bounded_interpolation", f"""
WITH {GRID},
near AS (SELECT *,
  LAST_VALUE(CASE WHEN temperature_c IS NOT NULL THEN cell END IGNORE NULLS) OVER b AS i0,
  LAST_VALUE(temperature_c IGNORE NULLS) OVER b AS v0,
  FIRST_VALUE(CASE WHEN temperature_c IS NOT NULL THEN cell END IGNORE NULLS) OVER a AS i1,
  FIRST_VALUE(temperature_c IGNORE NULLS) OVER a AS v1
  FROM cells
  WINDOW b AS (PARTITION BY station ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY station ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, cell, ROUND(CASE WHEN temperature_c IS NOT NULL THEN temperature_c
  WHEN COALESCE(cell - i0 <= 3, FALSE) OR COALESCE(i1 - cell <= 3, FALSE)
  THEN COALESCE(v0 + (v1 - v0) * (cell - i0) / NULLIF(i1 - i0, 0), v0, v1) END, 6) AS temperature_c
FROM near
""")
def interpolation(t):
    return W.interpolate_columns(hourly_cells(t), "station", "hour", ["temperature_c"]).select(
        "station", F.expr("unix_seconds(hour) div 3600").alias("cell"),
        F.round("temperature_c", 6).alias("temperature_c"))


@query("W17_equal_frequency_bins", f"""
WITH {SCORED}
SELECT id, GREATEST(1, CEIL((ROW_NUMBER() OVER (ORDER BY score, id) - 1) * 10 / (COUNT(*) OVER () - 1)::DOUBLE))::INT AS bin
FROM scored
""")
def equal_frequency(t):
    return equal_frequency_bins(t.scored, "score", "id", 10).select("id", "bin")


@query("W18_cumulative_share", f"""
WITH {SCORED},
binned AS (SELECT GREATEST(delay, 0) AS m, GREATEST(1, CEIL((ROW_NUMBER() OVER (ORDER BY score, id) - 1) * 10 / (COUNT(*) OVER () - 1)::DOUBLE))::INT AS bin FROM scored),
g AS (SELECT bin, SUM(m) AS m FROM binned GROUP BY 1)
SELECT bin, ROUND(SUM(m / (SELECT SUM(m) FROM g)) OVER (ORDER BY bin DESC), 6) AS cumulative_share FROM g
""")
def cumulative_share(t):
    groups = equal_frequency_bins(t.scored, "score", "id", 10).groupBy("bin").agg(
        F.sum(F.greatest("delay", F.lit(0.0))).alias("m"))
    shared = groups.withColumn("part", F.col("m") / F.sum("m").over(Window.partitionBy()))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return shared.select("bin", F.round(F.sum("part").over(down), 6).alias("cumulative_share"))


@query("W19_average_rank", f"""
WITH {SCORED}
SELECT id, RANK() OVER (ORDER BY score DESC) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rank
FROM scored
""")
def average_rank(t):
    return average_ranks(t.scored, "score", "rank", ascending=False).select("id", "rank")


@query("W20_running_best", f"""
WITH {OPERATED}, daily AS (SELECT day, AVG(late) AS rate FROM operated GROUP BY 1)
SELECT day::VARCHAR AS day, ROUND(MAX(rate) OVER (ORDER BY day), 6) AS best_so_far FROM daily
""")
def running_best(t):
    daily = t.operated.groupBy("day").agg(F.avg(F.col("late").cast("double")).alias("rate"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(F.col("day").cast("string").alias("day"),
                        F.round(F.max("rate").over(upto), 6).alias("best_so_far"))
