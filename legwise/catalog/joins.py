"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import FLIGHTS, HOURLY, LEGS, OPERATED, STATIONS
from legwise.catalog.registry import query
from legwise.catalog.tables import CALENDAR, order_calendar
from legwise.functions.base import flag
from legwise.operators import joins as J
from legwise.operators import windows as W
from legwise.operators.quantiles import median_of


@query("J1_station_roles", f"""
WITH {LEGS}, {STATIONS} SELECT l_orderkey, l_linenumber, l_partkey, o.region AS origin_region, ROUND(o.latitude, 4) AS origin_latitude,
 d.region AS dest_region, ROUND(d.latitude, 4) AS dest_latitude FROM legs LEFT JOIN stations o ON origin = o.station LEFT JOIN stations d ON destination = d.station
""")
def j1(t):
    rows = J.attach_roles(t.legs, t.stations, "station", {"origin": "origin_", "destination": "dest_"}, ["region", "latitude"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "origin_region", F.round("origin_latitude", 4).alias("origin_latitude"),
                       "dest_region", F.round("dest_latitude", 4).alias("dest_latitude"))


@query("J2_carrier_dimension", "SELECT o_orderkey, c_name AS carrier_name, c_mktsegment AS carrier_type FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j2(t):
    return J.attach(t.orders, t.customer, ["o_custkey"], ["c_custkey"],
                    {"c_name": "carrier_name", "c_mktsegment": "carrier_type"}).select("o_orderkey", "carrier_name", "carrier_type")


@query("J3_fleet_registry", "SELECT l_orderkey, l_linenumber, l_partkey, p_type AS aircraft_model, p_size AS seats FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey")
def j3(t):
    return J.attach(t.lineitem, t.part.where(F.col("p_size") > 5), ["l_partkey"], ["p_partkey"],
                    {"p_type": "aircraft_model", "p_size": "seats"}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "aircraft_model", "seats")


@query("J4_weather_at_both_ends", f"""
WITH {HOURLY} SELECT flight_id, d.temperature_c AS dep_wx_temperature_c, d.condition AS dep_wx_condition, a.temperature_c AS arr_wx_temperature_c, a.condition AS arr_wx_condition
FROM flights LEFT JOIN hourly d ON d.station = origin AND d.hour = date_trunc('hour', dep_ts) LEFT JOIN hourly a ON a.station = destination AND a.hour = date_trunc('hour', arr_ts)
""")
def j4(t):
    rows = t.flights.withColumns({"_dh": F.date_trunc("hour", "dep_ts"), "_ah": F.date_trunc("hour", "arr_ts")})
    for keys, prefix in ((["origin", "_dh"], "dep_wx_"), (["destination", "_ah"], "arr_wx_")):
        rows = J.attach(rows, t.hourly, keys, ["station", "hour"],
                        {c: prefix + c for c in ("temperature_c", "condition")})
    return rows.select("flight_id", *[p + c for p in ("dep_wx_", "arr_wx_") for c in ("temperature_c", "condition")])


HOLIDAY_JOIN = CALENDAR + """,
days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
gaps AS (SELECT day, FIRST(day - holiday_date ORDER BY ABS(day - holiday_date), holiday_date)::DOUBLE AS gap
  FROM days, calendar WHERE is_major_travel = 1 GROUP BY 1)
"""


def with_holidays(t):
    rows = t.orders.select("o_orderkey", F.to_date(F.col("o_orderdate").cast("timestamp")).alias("day"))
    return J.attach_holidays(rows, "day", order_calendar(t))


@query("J5_holiday_membership", f"""
WITH {HOLIDAY_JOIN} SELECT o_orderkey, (holiday_date IS NOT NULL)::INT AS is_holiday, COALESCE(is_major_travel, 0)::INT AS is_major_travel_holiday,
 COALESCE(holiday_name, 'None') AS holiday_name FROM orders LEFT JOIN calendar ON o_orderdate::DATE = holiday_date
""")
def j5(t):
    return with_holidays(t).select("o_orderkey", F.col("is_holiday").cast("int").alias("is_holiday"),
                                   F.col("is_major_travel_holiday").cast("int").alias("is_major_travel_holiday"), "holiday_name")


@query("J6_nearest_major_holiday", f"WITH {HOLIDAY_JOIN} SELECT o_orderkey, gap AS days_from_major_holiday FROM orders LEFT JOIN gaps ON day = o_orderdate::DATE")
def j6(t):
    return with_holidays(t).select("o_orderkey", "days_from_major_holiday")


@query("J7_group_size_joined_back", f"""
WITH {FLIGHTS} SELECT flight_id, COUNT(*) OVER (PARTITION BY origin, date_trunc('hour', dep_ts)) AS hour_departures,
 COUNT(*) OVER (PARTITION BY origin, day) AS day_departures FROM flights
""")
def j7(t):
    rows = t.flights.withColumn("hour", F.date_trunc("hour", "dep_ts"))
    rows = J.attach_group(rows, ["origin", "hour"], hour_departures=F.count(F.lit(1)))
    return J.attach_group(rows, ["origin", "day"], day_departures=F.count(F.lit(1))).select(
        "flight_id", "hour_departures", "day_departures")


@query("J8_rolling_joined_back", f"""
WITH {OPERATED}, daily AS (SELECT origin, day, AVG(dep_delay) AS m FROM operated GROUP BY 1, 2),
roll AS (SELECT origin, day, AVG(m) OVER (PARTITION BY origin ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS m7 FROM daily)
SELECT flight_id, ROUND(m7, 6) AS mean_min_7d FROM flights LEFT JOIN roll USING (origin, day)
""")
def j8(t):
    daily = W.daily_counts(t.operated, ["origin"], "day", F.col("late"), F.col("dep_delay"))
    rolled = W.prior_mean_of_means(daily, ["origin"], "day", 7, "mean_min_7d")
    return J.attach(t.flights, rolled, ["origin", "day"], ["origin", "day"], {"mean_min_7d": "mean_min_7d"}).select(
        "flight_id", F.round("mean_min_7d", 6).alias("mean_min_7d"))


@query("J9_type_attributes", """
WITH types AS (SELECT p_type, COUNT(*) AS models, ROUND(AVG(p_size), 6) AS mean_size FROM part GROUP BY 1)
SELECT p_partkey, models, mean_size FROM part LEFT JOIN types USING (p_type)
""")
def j9(t):
    types = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("models"), F.round(F.avg("p_size"), 6).alias("mean_size"))
    return J.attach(t.part, types, ["p_type"], ["p_type"], {"models": "models", "mean_size": "mean_size"}).select(
        "p_partkey", "models", "mean_size")


@query("J10_route_median_fill", f"""
WITH {LEGS}, x AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS distance FROM legs),
m AS (SELECT origin, destination, quantile_cont(distance, 0.5) AS med FROM x GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(COALESCE(distance, med), 4) AS distance FROM x LEFT JOIN m USING (origin, destination)
""")
def j10(t):
    rows = t.legs.withColumn("distance", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")))
    return J.fill_from_group_median(rows, ["origin", "destination"], "distance").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("distance", 4).alias("distance"))


@query("J11_busiest_keys", f"""
WITH {OPERATED} SELECT tail_number, month(day)::INT AS month, ROUND(AVG(late), 6) AS rate FROM operated
WHERE tail_number IN (SELECT tail_number FROM operated WHERE tail_number IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, tail_number LIMIT 18) GROUP BY 1, 2
""")
def j11(t):
    busiest = t.operated.where(F.col("tail_number").isNotNull()).groupBy("tail_number").count().orderBy(
        F.desc("count"), "tail_number").limit(18)
    kept = J.keep_known(t.operated, "tail_number", busiest, "tail_number")
    return kept.groupBy("tail_number", F.month("day").alias("month")).agg(
        F.round(F.avg(F.col("late").cast("double")), 6).alias("rate"))


@query("J12_route_endpoints", f"""
WITH {LEGS}, {STATIONS}, r AS (SELECT origin, destination, COUNT(*) AS n FROM legs GROUP BY 1, 2 ORDER BY n DESC, origin, destination LIMIT 70)
SELECT origin, destination, n, ROUND(o.latitude, 4) AS lat1, ROUND(o.longitude, 4) AS lon1, ROUND(d.latitude, 4) AS lat2, ROUND(d.longitude, 4) AS lon2
FROM r JOIN stations o ON origin = o.station JOIN stations d ON destination = d.station
""")
def j12(t):
    routes = t.legs.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "origin", "destination").limit(70)
    placed = J.attach(routes, t.stations, ["origin"], ["station"], {"latitude": "lat1", "longitude": "lon1"}, "inner")
    placed = J.attach(placed, t.stations, ["destination"], ["station"], {"latitude": "lat2", "longitude": "lon2"}, "inner")
    return placed.select("origin", "destination", "n", *[F.round(c, 4).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])


@query("J13_fallback_chain", f"""
WITH {FLIGHTS}, s AS (SELECT tail_number, AVG(dep_delay) AS typical FROM flights WHERE tail_number IS NOT NULL AND tail_number % 3 = 0 GROUP BY 1),
c AS (SELECT carrier_code, AVG(dep_delay) AS typical FROM flights WHERE carrier_code <> 'view' GROUP BY 1)
SELECT flight_id, ROUND(COALESCE(CASE WHEN k > 80 THEN dep_delay END, s.typical, c.typical, (SELECT quantile_cont(dep_delay, 0.5) FROM flights)), 6) AS value
FROM flights LEFT JOIN s USING (tail_number) LEFT JOIN c USING (carrier_code)
""")
def j13(t):
    by_tail = t.flights.where(F.col("tail_number") % 3 == 0).groupBy("tail_number").agg(F.avg("dep_delay").alias("typical"))
    by_carrier = t.flights.where(F.col("carrier_code") != "view").groupBy("carrier_code").agg(F.avg("dep_delay").alias("typical"))
    rows = J.attach(t.flights, by_tail, ["tail_number"], ["tail_number"], {"typical": "_tail"})
    rows = J.attach(rows, by_carrier, ["carrier_code"], ["carrier_code"], {"typical": "_carrier"})
    default = median_of(t.flights, F.col("dep_delay"))
    return rows.select("flight_id", F.round(J.first_available(
        F.when(F.col("k") > 80, F.col("dep_delay")), F.col("_tail"), F.col("_carrier"), default), 6).alias("value"))


@query("J14_known_flag", "SELECT o_orderkey, (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))::INT AS tail_known FROM orders")
def j14(t):
    return J.mark_known(t.orders, "o_custkey", t.customer.where(F.col("c_acctbal") > 0), "c_custkey", "tail_known").select(
        "o_orderkey", F.col("tail_known").cast("int").alias("tail_known"))
