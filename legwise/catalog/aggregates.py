"""A: aggregations, O: sorts and top-k, U: set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from legwise.catalog.frames import FILLED, FLIGHTS, HOURLY, OBSERVED, OPERATED, PLACED, SCORED
from legwise.catalog.registry import query
from legwise.catalog.windows import LINKED, linked
from legwise.functions import clock, schedule
from legwise.functions import weather as wx
from legwise.functions.base import band, clip, flag, mean_where, positive_part, share
from legwise.operators import aggregates as A
from legwise.operators import windows as W
from legwise.operators.joins import attach, attach_roles
from legwise.operators.explanation import example_picks
from legwise.operators.ordering import positions, top_k
from legwise.operators.quantiles import exact_medians, exact_quantiles, median_of, smallest_mode
from legwise.operators.wide import correlation_pairs


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("A1_rate_by_key", f"""
WITH {OPERATED} SELECT carrier_code, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM operated GROUP BY 1
""")
def a1(t):
    return A.rate_by(t.operated, ["carrier_code"], "late").select("carrier_code", *r6("rate"), "n")


@query("A2_performance_with_p90", f"""
WITH {OPERATED} SELECT carrier_code, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n,
  ROUND(AVG(dep_delay), 6) AS mean_min, ROUND(quantile_cont(dep_delay, 0.9), 6) AS p90
FROM operated GROUP BY 1
""")
def a2(t):
    return A.performance_by(t.operated, ["carrier_code"], "late", "dep_delay").select(
        "carrier_code", *r6("rate"), "n", *r6("mean_min", "p90"))


@query("A3_share_of_late_minutes", f"""
WITH {OPERATED}, g AS (SELECT origin, AVG(late) AS rate, COUNT(*) AS n, SUM(GREATEST(dep_delay, 0)) AS m FROM operated GROUP BY 1)
SELECT origin, ROUND(rate, 6) AS rate, n, ROUND(m, 4) AS total_min, ROUND(m / SUM(m) OVER (), 6) AS share_of_delay_minutes FROM g
""")
def a3(t):
    return A.delay_shares(t.operated, "origin", "late", "dep_delay").select(
        "origin", *r6("rate"), "n", F.round("total_min", 4).alias("total_min"), *r6("share_of_delay_minutes"))


@query("A4_severity_mix", f"""
WITH {OPERATED} SELECT ROUND(AVG((dep_delay < 15)::INT), 6) AS on_time, ROUND(AVG((dep_delay >= 15 AND dep_delay < 60)::INT), 6) AS minor,
 ROUND(AVG((dep_delay >= 60 AND dep_delay < 120)::INT), 6) AS major, ROUND(AVG((dep_delay >= 120)::INT), 6) AS severe FROM operated
""")
def a4(t):
    return A.severity_mix(t.operated, "dep_delay").select(*r6("on_time", "minor", "major", "severe"))


@query("A5_mean_and_median_when_late", f"""
WITH {OPERATED} SELECT ROUND(AVG(dep_delay), 6) AS mean_late, ROUND(quantile_cont(dep_delay, 0.5), 6) AS median_late FROM operated WHERE late = 1
""")
def a5(t):
    late = t.operated.where(F.col("late") == 1)
    return late.agg(F.avg("dep_delay").alias("mean_late")).select(
        *r6("mean_late"), F.round(median_of(late, F.col("dep_delay")), 6).alias("median_late"))


@query("A6_rate_by_month", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, ROUND(AVG((o_orderstatus = 'F')::INT), 6) AS rate, COUNT(*) AS n
FROM orders GROUP BY 1
""")
def a6(t):
    rows = t.orders.withColumn("late", flag(F.col("o_orderstatus") == "F"))
    month = F.date_format(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")), "yyyy-MM")
    return A.rate_by(rows, [month.alias("month")], "late").select("month", *r6("rate"), "n")


@query("A7_weekday_hour_leg_profiles", f"""
WITH {OPERATED}, p AS (
  SELECT 'weekday' AS profile, (isodow(dep_ts) - 1)::INT AS slot, late FROM operated UNION ALL
  SELECT 'hour', hour(dep_ts)::INT, late FROM operated UNION ALL SELECT 'leg', leg::INT, late FROM operated)
SELECT profile, slot, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM p GROUP BY 1, 2
""")
def a7(t):
    slots = F.array(*[
        F.struct(F.lit(p).alias("profile"), c.cast("int").alias("slot")) for p, c in (
            ("weekday", F.weekday("dep_ts")), ("hour", F.hour("dep_ts")), ("leg", F.col("leg")))])
    rows = t.operated.select("late", F.inline(slots))
    return A.rate_by(rows, ["profile", "slot"], "late").select("profile", "slot", *r6("rate"), "n")


def pivot_sql(row: str, column: str, values: range) -> str:
    cells = ", ".join(f'ROUND(AVG(late) FILTER ({column} = {v}), 6) AS "{v}"' for v in values)
    return f"WITH {OPERATED} SELECT {row}, {cells} FROM operated GROUP BY 1"


@query("A8_weekday_by_hour_pivot", pivot_sql("(isodow(dep_ts) - 1)::INT AS weekday", "hour(dep_ts)", range(24)))
def a8(t):
    cells = t.operated.select(F.weekday("dep_ts").alias("weekday"), F.hour("dep_ts").alias("hour"), "late")
    return A.grid_of_rates(cells, "weekday", "hour", list(range(24)), "late").select(
        "weekday", *r6(*map(str, range(24))))


@query("A8_station_by_month_pivot", pivot_sql("origin", "month(dep_ts)", range(1, 13)))
def a8b(t):
    cells = t.operated.select("origin", F.month("dep_ts").alias("month"), "late")
    return A.grid_of_rates(cells, "origin", "month", list(range(1, 13)), "late").select(
        "origin", *r6(*map(str, range(1, 13))))


BAND_SQL = """CASE WHEN {x} > -0.01 AND {x} <= 0.1 THEN '0' WHEN {x} > 0.1 AND {x} <= 15 THEN '1-15'
 WHEN {x} > 15 AND {x} <= 30 THEN '15-30' WHEN {x} > 30 AND {x} <= 60 THEN '30-60'
 WHEN {x} > 60 AND {x} <= 120 THEN '60-120' WHEN {x} > 120 AND {x} <= 10000 THEN '>120' END"""


@query("A9_rate_by_upstream_band", f"""
WITH {LINKED} SELECT {BAND_SQL.format(x="up")} AS band, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n
FROM upstream WHERE cancelled = 0 GROUP BY 1
""")
def a9(t):
    flown = linked(t).where(F.col("cancelled") == 0)
    label = band(F.col("upstream_delay_min"), schedule.UPSTREAM_EDGES, schedule.UPSTREAM_LABELS)
    return A.rate_by(flown, [label.alias("band")], "late").select("band", *r6("rate"), "n")


@query("A10_contrast_multiplier_uplift", f"""
WITH {OBSERVED}, g AS (SELECT AVG(late) FILTER (condition = 'Thunderstorm') AS w, AVG(late) FILTER (condition <> 'Thunderstorm') AS o FROM observed)
SELECT ROUND(w, 6) AS rate_with, ROUND(o, 6) AS rate_without, ROUND(w / o, 6) AS multiplier, ROUND((w / o - 1) * 100, 6) AS uplift_pct FROM g
""")
def a10(t):
    return A.contrast(t.observed, F.col("dep_wx_condition") == "Thunderstorm", "late").select(
        *r6("rate_with", "rate_without", "multiplier", "uplift_pct"))


@query("A10_storm_and_freeze_contrasts", f"""
WITH {OBSERVED}, x AS (SELECT late, unnest(['storm', 'freezing']) AS contrast, unnest([condition = 'Thunderstorm', temp < 0]) AS held FROM observed),
g AS (SELECT contrast, AVG(late) FILTER (held) AS w, AVG(late) FILTER (NOT held) AS o FROM x GROUP BY 1)
SELECT contrast, ROUND(w, 6) AS rate_with, ROUND(o, 6) AS rate_without, ROUND(w / o, 6) AS multiplier, ROUND((w / o - 1) * 100, 6) AS uplift_pct FROM g
""")
def a10b(t):
    out = None
    for name, held in (("storm", F.col("dep_wx_condition") == "Thunderstorm"), ("freezing", F.col("dep_wx_temperature_c") < 0)):
        row = A.contrast(t.observed, held, "late").withColumn("contrast", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("contrast", *r6("rate_with", "rate_without", "multiplier", "uplift_pct"))


@query("A11_excess_attributable_share", f"""
WITH {OBSERVED}, g AS (SELECT AVG(late) FILTER (temp > 20) AS b, AVG(late) FILTER (temp <= 20) AS o, AVG((temp > 20)::INT) AS s, AVG(late) AS a FROM observed)
SELECT ROUND((b - o) * s / a, 6) AS excess_share FROM g
""")
def a11(t):
    return A.excess_share(t.observed, F.col("dep_wx_temperature_c") > 20, "late").select(*r6("excess_share"))


@query("A12_distinct_counts", f"""
WITH {FLIGHTS} SELECT COUNT(DISTINCT origin) AS origins, COUNT(DISTINCT carrier_code) AS carriers, COUNT(DISTINCT tail_number) AS tails,
 COUNT(DISTINCT origin || '-' || destination) AS routes FROM flights
""")
def a12(t):
    return t.flights.agg(
        F.count_distinct("origin").alias("origins"), F.count_distinct("carrier_code").alias("carriers"),
        F.count_distinct("tail_number").alias("tails"),
        F.count_distinct(schedule.route_key(F.col("origin"), F.col("destination"))).alias("routes"))


@query("A13_demand_per_day", f"""
WITH {OPERATED} SELECT origin, (isodow(dep_ts) - 1)::INT AS weekday, hour(dep_ts)::INT AS hour,
  ROUND(COUNT(*) / GREATEST(COUNT(DISTINCT day), 1)::DOUBLE, 6) AS per_day, ROUND(AVG(k), 6) AS k FROM operated GROUP BY ALL
""")
def a13(t):
    keyed = t.operated.withColumns({"weekday": F.weekday("dep_ts"), "hour": F.hour("dep_ts")})
    return A.typical_demand(keyed, ["origin", "weekday", "hour"], "day", ["k"]).select(
        "origin", "weekday", "hour", *r6("per_day", "k"))


@query("A14_mean_arrivals_by_weekday", f"""
WITH {FLIGHTS}, h AS (SELECT *, COUNT(*) OVER (PARTITION BY destination, date_trunc('hour', arr_ts)) AS arrivals FROM flights)
SELECT destination, (isodow(dep_ts) - 1)::INT AS weekday, ROUND(AVG(arrivals), 6) AS arrivals FROM h GROUP BY 1, 2
""")
def a14(t):
    per_hour = t.flights.groupBy("destination", F.date_trunc("hour", "arr_ts").alias("arr_hour")).agg(
        F.count(F.lit(1)).alias("arrivals"))
    rows = attach(t.flights.withColumn("_h", F.date_trunc("hour", "arr_ts")), per_hour,
                  ["destination", "_h"], ["destination", "arr_hour"], {"arrivals": "arrivals"})
    return rows.groupBy("destination", F.weekday("dep_ts").alias("weekday")).agg(
        F.round(F.avg("arrivals"), 6).alias("arrivals"))


@query("A15_monthly_medians", f"""
WITH {HOURLY} SELECT station, month(hour)::INT AS month, ROUND(quantile_cont(temperature_c, 0.5), 6) AS temperature_c,
 ROUND(quantile_cont(wind_speed_kt, 0.5), 6) AS wind_speed_kt FROM hourly GROUP BY 1, 2
""")
def a15(t):
    keyed = t.hourly.withColumn("month", F.month("hour"))
    return exact_medians(keyed, ["station", "month"], ["temperature_c", "wind_speed_kt"]).select(
        "station", "month", *r6("temperature_c", "wind_speed_kt"))


@query("A16_global_defaults", f"""
WITH {FLIGHTS}, m AS (SELECT carrier_code, COUNT(*) AS n FROM flights GROUP BY 1)
SELECT (SELECT carrier_code FROM m ORDER BY n DESC, carrier_code LIMIT 1) AS carrier_code,
       ROUND((SELECT quantile_cont(dep_delay, 0.5) FROM flights), 6) AS dep_delay,
       (SELECT quantile_cont(k, 0.5) FROM flights)::DOUBLE AS k
""")
def a16(t):
    return t.spark.range(1).select(
        smallest_mode(t.flights, "carrier_code").alias("carrier_code"),
        F.round(median_of(t.flights, F.col("dep_delay")), 6).alias("dep_delay"),
        median_of(t.flights, F.col("k")).alias("k"))


@query("A17_carrier_share_at_station", f"""
WITH {FLIGHTS}, g AS (SELECT origin, carrier_code, COUNT(*) AS n FROM flights GROUP BY 1, 2)
SELECT origin, carrier_code, ROUND(n / SUM(n) OVER (PARTITION BY origin), 6) AS carrier_share FROM g
""")
def a17(t):
    counts = t.flights.groupBy("origin", "carrier_code").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("origin"))
    return counts.select("origin", "carrier_code", F.round(F.col("n") / whole, 6).alias("carrier_share"))


@query("A18_missing_rates", f"""
WITH {FLIGHTS} SELECT 'tail_number' AS column_name, ROUND(AVG((tail_number IS NULL)::INT), 6) AS missing_rate FROM flights
UNION ALL SELECT 'dep_delay', ROUND(AVG((dep_delay IS NULL)::INT), 6) FROM flights
UNION ALL SELECT 'k', ROUND(AVG((k IS NULL)::INT), 6) FROM flights
""")
def a18(t):
    return A.missing_rates(t.flights, ["tail_number", "dep_delay", "k"]).select(
        "column_name", *r6("missing_rate"))


HISTOGRAM_SQL = """SELECT LEAST(FLOOR((LEAST(GREATEST(dep_delay, {lo}), {hi}) - {lo}) * {n} / ({hi} - {lo}))::INT + 1, {n})::INT AS bin, COUNT(*) AS n
FROM operated {where} GROUP BY 1"""


@query("A19_histogram", f"""
WITH {OPERATED}, a AS ({HISTOGRAM_SQL.format(lo=-30, hi=180, n=70, where="")}),
b AS ({HISTOGRAM_SQL.format(lo=0, hi=400, n=60, where="WHERE dep_delay > 0")})
SELECT 'all' AS part, * FROM a UNION ALL SELECT 'tail', * FROM b
""")
def a19(t):
    whole = A.histogram(t.operated, "dep_delay", -30, 180, 70)
    tail = A.histogram(t.operated.where(F.col("dep_delay") > 0), "dep_delay", 0, 400, 60)
    return whole.withColumn("part", F.lit("all")).unionByName(tail.withColumn("part", F.lit("tail")))


@query("A20_box_stats", f"""
WITH {OPERATED}, x AS (SELECT carrier_code, LEAST(GREATEST(dep_delay, -20), 150) AS d FROM operated),
q AS (SELECT carrier_code, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS q3 FROM x GROUP BY 1)
SELECT carrier_code, ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(median), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3,
  ROUND(MIN(d) FILTER (d >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, ROUND(MAX(d) FILTER (d <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM x JOIN q USING (carrier_code) GROUP BY 1
""")
def a20(t):
    clipped = t.operated.withColumn("d", clip(F.col("dep_delay"), -20, 150))
    return A.box_stats(clipped, "carrier_code", "d").select(
        "carrier_code", *r6("q1", "median", "q3", "whisker_low", "whisker_high"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@query("A21_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def a21(t):
    return correlation_pairs(t.lineitem, NUMERIC).select("a", "b", *r6("r"))


@query("A22_strongest_correlate", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS feature, corr(l_extendedprice, {b}) AS r FROM lineitem"
    for b in NUMERIC if b != "l_extendedprice")
    + ") SELECT feature, ROUND(r, 6) AS r FROM c ORDER BY ABS(r) DESC LIMIT 1")
def a22(t):
    pairs = correlation_pairs(t.lineitem, NUMERIC)
    target = F.lit("l_extendedprice")
    about = pairs.where((F.col("a") == target) | (F.col("b") == target)).select(
        F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("feature"), "r")
    best = F.max_by(F.struct("feature", "r"), F.abs("r"))
    return about.agg(best.alias("m")).select("m.feature", F.round("m.r", 6).alias("r"))


@query("A23_propagation_share", f"""
WITH {LINKED}, o AS (SELECT * FROM upstream WHERE cancelled = 0)
SELECT ROUND(SUM(LEAST(up, dep_delay)) FILTER (late = 1) / SUM(GREATEST(dep_delay, 0)) FILTER (late = 1), 6) AS share_inherited,
 ROUND(AVG((up > 15)::INT) FILTER (late = 1), 6) AS late_with_late_inbound, ROUND(AVG(late) FILTER (leg = 0), 6) AS first_leg_rate FROM o
""")
def a23(t):
    flown = linked(t).where(F.col("cancelled") == 0).withColumn("first_leg", flag(F.col("leg") == 0))
    return A.propagation_share(flown, "late", "dep_delay", "upstream_delay_min", "first_leg").select(
        *r6("share_inherited", "late_with_late_inbound", "first_leg_rate"))


@query("A24_argmax_argmin_key", f"""
WITH {OPERATED}, g AS (SELECT hour(dep_ts)::INT AS hour, AVG(late) AS rate FROM operated GROUP BY 1)
SELECT (SELECT hour FROM g ORDER BY rate DESC, hour LIMIT 1) AS argmax, ROUND((SELECT MAX(rate) FROM g), 6) AS max_value,
 (SELECT hour FROM g ORDER BY rate, hour LIMIT 1) AS argmin, ROUND((SELECT MIN(rate) FROM g), 6) AS min_value
""")
def a24(t):
    rates = A.rate_by(t.operated, [F.hour("dep_ts").alias("hour")], "late")
    return A.extremes_of(rates, "hour", "rate").select("argmax", *r6("max_value"), "argmin", *r6("min_value"))


@query("A25_key_figures", f"""
WITH {OPERATED}, h AS (SELECT hour(dep_ts)::INT AS hour, AVG(late) AS rate FROM operated GROUP BY 1)
SELECT COUNT(*) AS flights, ROUND(AVG(late), 6) AS rate, ROUND(AVG(dep_delay) FILTER (late = 1), 6) AS mean_when_late,
  ROUND(SUM(GREATEST(dep_delay, 0)) / 60, 4) AS late_hours, (SELECT hour FROM h ORDER BY rate DESC, hour LIMIT 1) AS worst_hour FROM operated
""")
def a25(t):
    rates = A.rate_by(t.operated, [F.hour("dep_ts").alias("hour")], "late")
    worst = A.extremes_of(rates, "hour", "rate").select("argmax").scalar()
    return A.key_figures(t.operated, "late", "dep_delay").select(
        "flights", *r6("rate", "mean_when_late"), F.round("late_hours", 4).alias("late_hours"),
        worst.alias("worst_hour"))


@query("A26_top_three_concentration", f"""
WITH {OPERATED}, g AS (SELECT origin, SUM(GREATEST(dep_delay, 0)) AS m FROM operated GROUP BY 1), s AS (SELECT m / SUM(m) OVER () AS share FROM g)
SELECT ROUND(SUM(share), 6) AS top_share FROM (SELECT share FROM s ORDER BY share DESC LIMIT 3)
""")
def a26(t):
    shares = A.delay_shares(t.operated, "origin", "late", "dep_delay")
    return A.top_share(shares, "share_of_delay_minutes", 3).select(*r6("top_share"))


@query("A27_family_share", """
WITH g AS (SELECT p_type AS family, SUM(l_extendedprice) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT family, ROUND(total / SUM(total) OVER (), 6) AS share FROM g
""")
def a27(t):
    rows = attach(t.lineitem, t.part, ["l_partkey"], ["p_partkey"], {"p_type": "family"}, "inner")
    return A.family_shares(rows, "family", "l_extendedprice").select("family", *r6("share"))


@query("A28_summary_facts", f"""
WITH {OPERATED} SELECT MIN(day)::VARCHAR AS first_day, MAX(day)::VARCHAR AS last_day, COUNT(*) AS n_rows, COUNT(DISTINCT origin) AS n_origin,
 COUNT(DISTINCT carrier_code) AS n_carrier_code, COUNT(DISTINCT origin || '-' || destination) AS n_route, ROUND(AVG(late), 6) AS rate FROM operated
""")
def a28(t):
    rows = t.operated.withColumn("route", schedule.route_key(F.col("origin"), F.col("destination")))
    return A.system_summary(rows, "day", "late", ["origin", "carrier_code", "route"]).select(
        "first_day", "last_day", "n_rows", "n_origin", "n_carrier_code", "n_route", *r6("rate"))


@query("A29_station_and_route_geography", f"""
WITH {PLACED}, x AS (SELECT *, (l_discount >= 0.06)::INT AS late FROM placed)
SELECT 'station' AS level, origin, NULL::INT AS destination, ROUND(lat1, 4) AS latitude, ROUND(lon1, 4) AS longitude, ROUND(AVG(late) + 1e-9, 6) AS rate, COUNT(*) AS n FROM x GROUP BY ALL
UNION ALL SELECT 'route', origin, destination, NULL, NULL, ROUND(AVG(late) + 1e-9, 6), COUNT(*) FROM x GROUP BY ALL
""")
def a29(t):
    x = t.placed_legs.withColumn("late", flag(F.col("l_discount") >= 0.06))
    stations = A.rate_by(x, ["origin", "origin_latitude", "origin_longitude"], "late").select(
        F.lit("station").alias("level"), "origin", F.lit(None).cast("int").alias("destination"),
        F.round("origin_latitude", 4).alias("latitude"), F.round("origin_longitude", 4).alias("longitude"),
        F.round(F.col("rate") + 1e-9, 6).alias("rate"), "n")
    routes = A.rate_by(x, ["origin", "destination"], "late").select(
        F.lit("route").alias("level"), "origin", "destination", F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.round(F.col("rate") + 1e-9, 6).alias("rate"), "n")
    return stations.unionByName(routes)


@query("A30_weather_view", f"""
WITH {OBSERVED}, b AS (SELECT *, CASE WHEN v > -0.01 AND v <= 1.6 THEN 'very_poor' WHEN v > 1.6 AND v <= 5 THEN 'poor'
  WHEN v > 5 AND v <= 10 THEN 'moderate' WHEN v > 10 AND v <= 100 THEN 'good' END AS level,
  CASE WHEN p > -0.01 AND p <= 0.1 THEN 'none' WHEN p > 0.1 AND p <= 2.5 THEN 'light' WHEN p > 2.5 AND p <= 7.6 THEN 'moderate' WHEN p > 7.6 AND p <= 1000 THEN 'heavy' END AS rain,
  CASE WHEN g > -0.01 AND g <= 12 THEN 'calm' WHEN g > 12 AND g <= 22 THEN 'breezy' WHEN g > 22 AND g <= 34 THEN 'strong' WHEN g > 34 AND g <= 1000 THEN 'gale' END AS gusts
  FROM (SELECT *, COALESCE(vis, 16) AS v, COALESCE(precip, 0) AS p, COALESCE(gust, wind) AS g FROM observed)),
base AS (SELECT AVG(late) AS r FROM observed)
SELECT 'condition' AS view, condition AS bucket, ROUND(AVG(late), 6) AS rate, ROUND(AVG(late) / (SELECT r FROM base), 6) AS vs_base FROM b GROUP BY 2
UNION ALL SELECT 'visibility', level, ROUND(AVG(late), 6), ROUND(AVG(late) / (SELECT r FROM base), 6) FROM b GROUP BY 2
UNION ALL SELECT 'rain', rain, ROUND(AVG(late), 6), ROUND(AVG(late) / (SELECT r FROM base), 6) FROM b GROUP BY 2
UNION ALL SELECT 'wind', gusts, ROUND(AVG(late), 6), ROUND(AVG(late) / (SELECT r FROM base), 6) FROM b GROUP BY 2
""")
def a30(t):
    fields = wx.weather_fields("dep_wx_", "dep")
    views = F.array(
        F.struct(F.lit("condition").alias("view"), F.col("dep_wx_condition").alias("bucket")),
        F.struct(F.lit("visibility").alias("view"), fields["dep_visibility_level"].alias("bucket")),
        F.struct(F.lit("rain").alias("view"), fields["dep_rain_intensity"].alias("bucket")),
        F.struct(F.lit("wind").alias("view"), fields["dep_wind_category"].alias("bucket")))
    base = t.observed.agg(F.avg("late")).scalar()
    return A.rate_by(t.observed.select("late", F.inline(views)), ["view", "bucket"], "late").select(
        "view", "bucket", *r6("rate"), F.round(F.col("rate") / base, 6).alias("vs_base"))


@query("A30_storm_and_adverse", f"""
WITH {FILLED} SELECT ROUND(AVG(late) FILTER (storm = 1) / AVG(late) FILTER (storm = 0), 6) AS storm_multiplier,
  ROUND(COUNT(*) FILTER (sev >= 0.3::DOUBLE)::DOUBLE / COUNT(*), 6) AS adverse_share FROM severe
""")
def a30b(t):
    fields = wx.weather_fields("dep_wx_", "dep")
    rows = t.observed.select("late", fields["dep_is_storm"].alias("storm"), fields["dep_wx_severity"].alias("severity"))
    adverse = rows.agg((F.count_if(F.col("severity") >= wx.ADVERSE_SEVERITY) / F.count(F.lit(1))).alias("adverse_share"))
    return A.contrast(rows, F.col("storm") == 1, "late").select(
        F.round("multiplier", 6).alias("storm_multiplier"), F.round(adverse.scalar(), 6).alias("adverse_share"))


@query("A9_rate_by_severity_band", f"""
WITH {FILLED} SELECT CASE WHEN sev > -0.01 AND sev <= 0.05 THEN 'none' WHEN sev > 0.05 AND sev <= 0.3 THEN 'trace' WHEN sev > 0.3 AND sev <= 0.7 THEN 'low'
  WHEN sev > 0.7 AND sev <= 1.2 THEN 'moderate' WHEN sev > 1.2 AND sev <= 2 THEN 'high' WHEN sev > 2 AND sev <= 10 THEN 'severe' END AS band,
  ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM severe GROUP BY 1
""")
def a9b(t):
    level = band(wx.weather_fields("dep_wx_", "dep")["dep_wx_severity"], wx.SEVERITY_EDGES, wx.SEVERITY_LABELS)
    return A.rate_by(t.observed, [level.alias("band")], "late").select("band", *r6("rate"), "n")


@query("A9_rate_by_condition", f"WITH {OBSERVED} SELECT condition AS band, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM observed GROUP BY 1")
def a9c(t):
    return A.rate_by(t.observed, [F.col("dep_wx_condition").alias("band")], "late").select("band", *r6("rate"), "n")


# ---------------------------------------------------------------- O
@query("O1_total_order", f"WITH {FLIGHTS} SELECT flight_id, ROW_NUMBER() OVER (ORDER BY dep_ts, flight_id) AS place FROM flights")
def o1(t):
    rows = t.flights.select("flight_id", F.unix_micros("dep_ts").alias("at"))
    return positions(rows, ["at", "flight_id"], "place").select("flight_id", "place")


@query("O2_top_routes", f"""
WITH {FLIGHTS} SELECT origin || '-' || destination AS route, COUNT(*) AS n FROM flights GROUP BY 1 ORDER BY n DESC, route LIMIT 15
""")
def o2(t):
    routes = t.flights.groupBy(schedule.route_key(F.col("origin"), F.col("destination")).alias("route")).agg(
        F.count(F.lit(1)).alias("n"))
    return top_k(routes, 15, F.desc("n"), F.col("route"))


@query("O3_best_and_worst", f"""
WITH {OPERATED}, g AS (SELECT carrier_code, AVG(late) AS rate FROM operated GROUP BY 1)
SELECT (SELECT carrier_code FROM g ORDER BY rate, carrier_code LIMIT 1) AS best, (SELECT carrier_code FROM g ORDER BY rate DESC, carrier_code LIMIT 1) AS worst,
  ROUND(((SELECT MAX(rate) FROM g) - (SELECT MIN(rate) FROM g)) * 100, 6) AS spread_pp
""")
def o3(t):
    ends = A.extremes_of(A.rate_by(t.operated, ["carrier_code"], "late"), "carrier_code", "rate")
    return ends.select(F.col("argmin").alias("best"), F.col("argmax").alias("worst"),
                       F.round((F.col("max_value") - F.col("min_value")) * 100, 6).alias("spread_pp"))


@query("O5_watch_list", f"""
WITH {SCORED} SELECT id, score, (score >= 0.53)::INT AS flagged, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS place FROM scored
""")
def o5(t):
    rows = t.scored.select("id", "score", flag(F.col("score") >= 0.53).cast("int").alias("flagged"),
                           (-F.col("score")).alias("_down"))
    return positions(rows, ["_down", "id"], "place").drop("_down")


@query("O6_highest_middle_lowest", f"""
WITH {SCORED}, r AS (SELECT id, score, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS place, COUNT(*) OVER () AS n FROM scored)
SELECT CASE place WHEN 1 THEN 'highest_risk' WHEN n THEN 'lowest_risk' ELSE 'typical' END AS tag, id, score FROM r WHERE place IN (1, n // 2 + 1, n)
""")
def o6(t):
    return example_picks(t.scored, "score", "id")


@query("O7_first_distinct_bad_values", """
SELECT string_agg(c, ', ' ORDER BY c) AS examples FROM (SELECT DISTINCT o_orderpriority AS c FROM orders WHERE o_orderpriority <> '1-URGENT' ORDER BY 1 LIMIT 4)
""")
def o7(t):
    from legwise.operators.quality import bad_code_examples

    return bad_code_examples(t.orders.where(F.col("o_orderpriority") != "1-URGENT"), "o_orderpriority")


@query("O8_argmax_row", f"""
WITH {SCORED}, g AS (SELECT hour, SUM(delay) AS net, COUNT(*) AS n FROM scored GROUP BY 1)
SELECT hour, ROUND(net, 4) AS net, n FROM g ORDER BY g.net DESC, hour LIMIT 1
""")
def o8(t):
    g = t.scored.groupBy("hour").agg(F.sum("delay").alias("net"), F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("hour", "net", "n"), F.struct(F.col("net"), -F.col("hour")))
    return g.agg(best.alias("b")).select(F.col("b.hour").cast("bigint").alias("hour"),
                                         F.round("b.net", 4).alias("net"), "b.n")


# ---------------------------------------------------------------- U
@query("U1_concatenate_sources", """
SELECT s_suppkey AS key, s_nationkey AS nation, 'supplier' AS role FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 'customer' FROM customer
""")
def u1(t):
    a = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("role"))
    b = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"), F.lit("customer").alias("role"))
    return a.unionByName(b)


@query("U2_distinct_on_key_keep_first", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1
""")
def u2(t):
    return W.first_rows(t.events.select("user_id", "event_type", "event_id", "value"),
                        ["user_id", "event_type"], ["event_id"])


@query("U3_distinct_values", "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders")
def u3(t):
    return t.orders.select(F.to_date(F.col("o_orderdate").cast("timestamp")).cast("string").alias("day")).distinct()


@query("U4_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.09")
def u4(t):
    a = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("k"))
    b = t.lineitem.where((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.09)).select(F.col("l_partkey").alias("k"))
    return a.intersect(b)


@query("U5_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u5(t):
    a = t.customer.select(F.col("c_custkey").alias("k"))
    return a.subtract(t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k")))


@query("A12_distinct_over_days", f"""
WITH {FLIGHTS}, e AS (SELECT MAX(day) AS last FROM flights)
SELECT carrier_code, COUNT(DISTINCT tail_number) AS n_exact, TRUE AS within_bound FROM flights, e WHERE day BETWEEN last - 13 AND last GROUP BY 1
""")
def a12c(t):
    """Distinct airframes of the last fourteen days from daily sketches, held against the exact count."""
    last = t.flights.agg(F.max("day")).scalar()
    told = A.distinct_between(A.distinct_sketches(t.flights.where("tail_number IS NOT NULL"), ["carrier_code"], "day", "tail_number"),
                              ["carrier_code"], "day", F.date_sub(last, 13), last)
    exact = t.flights.where(F.col("day") >= F.date_sub(last, 13)).groupBy("carrier_code").agg(F.count_distinct("tail_number").alias("n_exact"))
    return exact.join(told, "carrier_code").select("carrier_code", "n_exact", (
        F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.04 * F.col("n_exact") + 1).alias("within_bound"))
