"""C: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import FILLED, FLIGHTS, LEGS, OBSERVED, PLACED, SCORED, STATIONS
from legwise.catalog.joins import HOLIDAY_JOIN, with_holidays
from legwise.catalog.registry import query
from legwise.catalog.tables import order_calendar
from legwise.functions import base as B
from legwise.functions import clock as T
from legwise.functions import schedule as S
from legwise.functions import space as G
from legwise.functions import text as X
from legwise.functions import weather as WX
from legwise.operators import joins as J


def ints(fields, names):
    return [fields[n].cast("int").alias(n) for n in names]


def r6(fields, names):
    return [F.round(fields[n], 6).alias(n) for n in names]


@query("C1_trim_upper", "SELECT c_custkey, upper(trim('  ' || lower(c_mktsegment) || ' ')) AS code FROM customer")
def c1(t):
    dirty = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return t.customer.select("c_custkey", X.code(dirty).alias("code"))


@query("C2_station_code_pattern", "SELECT c_custkey, regexp_full_match(substr(c_mktsegment, 1, (3 + c_custkey % 2)::INT), '[A-Z]{3}')::INT AS good FROM customer")
def c2(t):
    cut = F.substr(F.col("c_mktsegment"), F.lit(1), (3 + F.col("c_custkey") % 2).cast("int"))
    return t.customer.select("c_custkey", X.is_station_code(cut).cast("int").alias("good"))


@query("C3_split_and_explode", "SELECT p_partkey, UNNEST(string_split(replace(p_name, ' ', '|'), '|')) AS word FROM part")
def c3(t):
    return t.part.select("p_partkey", F.explode(X.split_codes(F.replace("p_name", F.lit(" "), F.lit("|")))).alias("word"))


@query("C4_mentions_any", "SELECT p_partkey, (contains(p_name, 'red') OR contains(p_name, 'bolt'))::INT AS hit FROM part")
def c4(t):
    return t.part.select("p_partkey", X.mentions_any(F.col("p_name"), ("red", "bolt")).cast("int").alias("hit"))


@query("C5_parse_timestamp", "SELECT event_id, epoch_us(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)) AS us FROM events")
def c5(t):
    text = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", F.unix_micros(T.parse_timestamp(text)).alias("us"))


@query("C6_calendar_parts", "SELECT event_id, hour(ts)::INT AS dep_hour, minute(ts)::INT AS dep_minute, day(ts)::INT AS day_of_month, month(ts)::INT AS month, quarter(ts)::INT AS quarter, dayofyear(ts)::INT AS day_of_year FROM events")
def c6(t):
    return t.events.select("event_id", *ints(T.calendar_fields(F.col("ts")), (
        "dep_hour", "dep_minute", "day_of_month", "month", "quarter", "day_of_year")))


@query("C7_weekday_monday_zero", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS day_of_week FROM orders")
def c7(t):
    return t.orders.select("o_orderkey", *ints(T.calendar_fields(F.col("o_orderdate")), ("day_of_week",)))


@query("C8_iso_week", "SELECT o_orderkey, weekofyear(o_orderdate)::INT AS week_of_year FROM orders")
def c8(t):
    return t.orders.select("o_orderkey", *ints(T.calendar_fields(F.col("o_orderdate")), ("week_of_year",)))


@query("C9_decimal_hour", "SELECT event_id, ROUND(hour(ts) + minute(ts) / 60.0::DOUBLE, 6) AS dep_time_decimal FROM events")
def c9(t):
    return t.events.select("event_id", *r6(T.calendar_fields(F.col("ts")), ("dep_time_decimal",)))


@query("C10_day_and_hour_flags", """
WITH x AS (SELECT event_id, (isodow(ts) - 1)::INT AS d, hour(ts)::INT AS h FROM events)
SELECT event_id, (d >= 5)::INT AS is_weekend, (d = 0)::INT AS is_monday, (d = 4)::INT AS is_friday, (h >= 22 OR h <= 4)::INT AS is_red_eye,
 (h BETWEEN 6 AND 9)::INT AS is_morning_bank, (h BETWEEN 16 AND 20)::INT AS is_evening_bank, (h IN (7, 8, 17, 18, 19))::INT AS is_peak_hour FROM x
""")
def c10(t):
    fields = T.calendar_fields(F.col("ts")) | T.hour_bands(F.col("ts"))
    return t.events.select("event_id", *ints(fields, (
        "is_weekend", "is_monday", "is_friday", "is_red_eye", "is_morning_bank", "is_evening_bank", "is_peak_hour")))


@query("C11_cyclical_encodings", """
WITH x AS (SELECT event_id, (hour(ts) + minute(ts) / 60.0::DOUBLE) * 2 * pi() / 24 AS a, dayofyear(ts) * 2 * pi() / 365.25::DOUBLE AS b FROM events)
SELECT event_id, ROUND(sin(a), 6) AS hour_sin, ROUND(cos(a), 6) AS hour_cos, ROUND(sin(b), 6) AS doy_sin, ROUND(cos(b), 6) AS doy_cos FROM x
""")
def c11(t):
    return t.events.select("event_id", *r6(T.cycles(F.col("ts")), ("hour_sin", "hour_cos", "doy_sin", "doy_cos")))


@query("C12_season", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'fall' END AS season,
 (month(o_orderdate) IN (6, 7, 8))::INT AS is_summer_peak, (month(o_orderdate) IN (12, 1, 2))::INT AS is_winter_ops FROM orders
""")
def c12(t):
    fields = T.season_fields(F.col("o_orderdate"))
    return t.orders.select("o_orderkey", fields["season"].alias("season"), *ints(fields, ("is_summer_peak", "is_winter_ops")))


@query("C13_holiday_distances", f"""
WITH {HOLIDAY_JOIN} SELECT o_orderkey, GREATEST(-gap, 0)::DOUBLE AS days_to_holiday, GREATEST(gap, 0)::DOUBLE AS days_after_holiday, (ABS(gap) <= 3)::INT AS in_holiday_window,
 ROUND(LEAST(GREATEST(1 - ABS(gap) / 4, 0), 1), 6) AS holiday_proximity FROM orders LEFT JOIN gaps ON day = o_orderdate::DATE
""")
def c13(t):
    fields = T.holiday_fields(F.col("days_from_major_holiday"))
    return with_holidays(t).select("o_orderkey", F.abs(fields["days_to_holiday"]).alias("days_to_holiday"),
                                   F.abs(fields["days_after_holiday"]).alias("days_after_holiday"),
                                   *ints(fields, ("in_holiday_window",)), *r6(fields, ("holiday_proximity",)))


@query("C14_hour_floor", "SELECT event_id, epoch_us(date_trunc('hour', ts)) AS us FROM events")
def c14(t):
    return t.events.select("event_id", F.unix_micros(T.hour_floor(F.col("ts").cast("timestamp"))).alias("us"))


@query("C15_minutes_between", "SELECT l_orderkey, l_linenumber, l_partkey, ROUND((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0::DOUBLE, 4) AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def c15(t):
    return t.legs.select("l_orderkey", "l_linenumber", "l_partkey",
                         F.round(T.minutes_between(F.col("ordered"), F.col("shipped")), 4).alias("minutes"))


@query("C16_signed_days", "SELECT o_orderkey, (o_orderdate::DATE - DATE '1998-07-04')::INT AS days FROM orders")
def c16(t):
    day = F.to_date(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", F.date_diff(day, F.lit("1998-07-04").cast("date")).alias("days"))


ZONED = f"""
WITH {STATIONS}, x AS (SELECT o_orderkey, o_orderdate + INTERVAL 150 MINUTE AS local, o.timezone AS zone, d.timezone AS zone2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN stations o ON o.station = c_nationkey JOIN stations d ON d.station = o_orderkey % 25),
y AS (SELECT *, timezone('UTC', timezone(zone, local)) AS u, timezone('UTC', timezone(zone2, local + INTERVAL 5 HOUR)) AS u2 FROM x),
z AS (SELECT *, CASE WHEN timezone(zone, timezone('UTC', u)) <> local THEN date_trunc('hour', u) ELSE u END AS utc FROM y)
"""


def zoned_orders(t):
    local = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 150 * 60000000)
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 25).alias("to"), local.alias("local"))
    rows = J.attach(rows, t.customer, ["o_custkey"], ["c_custkey"], {"c_nationkey": "at"}, "inner")
    rows = J.attach(rows, t.stations, ["at"], ["station"], {"timezone": "zone"}, "inner")
    return J.attach(rows, t.stations, ["to"], ["station"], {"timezone": "zone2"}, "inner")


@query("C17_zone_aware_block", ZONED + "SELECT o_orderkey, ROUND((epoch_us(u2) - epoch_us(utc)) / 60000000.0::DOUBLE, 4) AS block_min FROM z")
def c17(t):
    arrival = F.timestamp_micros(F.unix_micros("local") + 300 * 60000000)
    block = T.zoned_minutes(F.col("local"), F.col("zone"), arrival, F.col("zone2"))
    return zoned_orders(t).select("o_orderkey", F.round(block, 4).alias("block_min"))


@query("C18_clip", "SELECT l_orderkey, l_linenumber, l_partkey, LEAST(GREATEST(l_quantity, 10), 40)::DOUBLE AS quantity FROM lineitem")
def c18(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", B.clip(F.col("l_quantity"), 10, 40).alias("quantity"))


@query("C19_null_fill", f"WITH {OBSERVED} SELECT id, COALESCE(gust, wind) AS gust, COALESCE(precip, 0) AS precip FROM observed")
def c19(t):
    return t.observed.select("id", F.coalesce("dep_wx_wind_gust_kt", "dep_wx_wind_speed_kt").alias("gust"),
                             F.coalesce("dep_wx_precip_mm", F.lit(0.0)).alias("precip"))


def band_sql(x, edges, labels):
    cases = " ".join(f"WHEN {x} > {a} AND {x} <= {b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], labels))
    return f"CASE {cases} END"


@query("C20_half_open_bands", f"""
WITH {OBSERVED}, x AS (SELECT o.id, hour(ts)::INT AS h, COALESCE(precip, 0) AS p, COALESCE(gust, wind) AS g, COALESCE(vis, 16) AS v, value * 20 AS dist, value / 40 AS sev, value / 100 AS cong, value AS up
  FROM observed o JOIN events ON event_id = o.id)
SELECT id, {band_sql("h", T.TIME_BLOCK_EDGES, T.TIME_BLOCK_LABELS)} AS time_block, {band_sql("p", WX.RAIN_EDGES, WX.RAIN_LABELS)} AS rain,
 {band_sql("g", WX.WIND_EDGES, WX.WIND_LABELS)} AS wind, {band_sql("v", WX.VISIBILITY_EDGES, WX.VISIBILITY_LABELS)} AS visibility,
 {band_sql("dist", S.DISTANCE_EDGES, S.DISTANCE_LABELS)} AS distance, {band_sql("sev", WX.SEVERITY_EDGES, WX.SEVERITY_LABELS)} AS severity,
 {band_sql("cong", S.CONGESTION_EDGES, S.CONGESTION_LABELS)} AS congestion, {band_sql("up", S.UPSTREAM_EDGES, S.UPSTREAM_LABELS)} AS upstream FROM x
""")
def c20(t):
    rows = t.observed.join(t.events.select("event_id", "ts", "value"), F.col("id") == F.col("event_id"))
    v = F.col("value")
    w = WX.weather_fields("dep_wx_", "dep")
    return rows.select(
        "id", T.hour_bands(F.col("ts"))["time_block"].alias("time_block"), w["dep_rain_intensity"].alias("rain"),
        w["dep_wind_category"].alias("wind"), w["dep_visibility_level"].alias("visibility"),
        B.band(v * 20, S.DISTANCE_EDGES, S.DISTANCE_LABELS).alias("distance"),
        B.band(v / 40, WX.SEVERITY_EDGES, WX.SEVERITY_LABELS).alias("severity"),
        B.band(v / 100, S.CONGESTION_EDGES, S.CONGESTION_LABELS).alias("congestion"),
        B.band(v, S.UPSTREAM_EDGES, S.UPSTREAM_LABELS).alias("upstream"))


@query("C21_weather_flags", f"""
WITH {FILLED} SELECT id, storm AS dep_is_storm, (snow > 0.5)::INT AS dep_is_snow, (temp < 0)::INT AS dep_is_freezing, (ceiling < 3000 OR v < 8)::INT AS dep_ifr,
 (ceiling < 500 OR v < 1.6)::INT AS dep_lifr, (temp - dew < 2 AND v < 5)::INT AS dep_fog_risk FROM stormy
""")
def c21(t):
    return t.observed.select("id", *ints(WX.weather_fields("dep_wx_", "dep"), (
        "dep_is_storm", "dep_is_snow", "dep_is_freezing", "dep_ifr", "dep_lifr", "dep_fog_risk")))


@query("C22_spread_gust_heat", f"WITH {FILLED} SELECT id, ROUND(temp - dew, 6) AS dep_dewpoint_spread, ROUND(g / GREATEST(w, 1), 6) AS dep_gust_factor, ROUND(GREATEST(temp - 32, 0), 6) AS dep_heat_stress FROM filled")
def c22(t):
    return t.observed.select("id", *r6(WX.weather_fields("dep_wx_", "dep"), (
        "dep_dewpoint_spread", "dep_gust_factor", "dep_heat_stress")))


@query("C23_weather_severity", f"WITH {FILLED} SELECT id, ROUND(sev + 1e-9, 6) AS dep_wx_severity FROM severe")
def c23(t):
    score = WX.weather_fields("dep_wx_", "dep")["dep_wx_severity"]
    return t.observed.select("id", F.round(score + 1e-9, 6).alias("dep_wx_severity"))


@query("C24_route_severity", f"""
WITH {FILLED} SELECT a.id, ROUND(a.sev + 0.5::DOUBLE * b.sev, 6) AS route_wx_severity, COALESCE((a.ceiling < 3000 OR a.v < 8) AND (b.ceiling < 3000 OR b.v < 8), FALSE)::INT AS both_ends_bad_wx
FROM severe a LEFT JOIN severe b ON b.id = a.id + 1
""")
def c24(t):
    fields = WX.weather_fields("dep_wx_", "dep")
    dep = t.observed.select("id", fields["dep_wx_severity"].alias("s1"), fields["dep_ifr"].alias("i1"))
    arr = t.observed.select((F.col("id") - 1).alias("id"), fields["dep_wx_severity"].alias("s2"), fields["dep_ifr"].alias("i2"))
    return dep.join(arr, "id", "left").select(
        "id", F.round(WX.route_severity(F.col("s1"), F.col("s2")), 6).alias("route_wx_severity"),
        B.flag((F.col("i1") == 1) & (F.col("i2") == 1)).cast("int").alias("both_ends_bad_wx"))


@query("C25_congestion", f"""
WITH {FLIGHTS}, {STATIONS}, x AS (SELECT flight_id, origin, COUNT(*) OVER (PARTITION BY origin, date_trunc('hour', dep_ts)) AS d, COUNT(*) OVER (PARTITION BY destination, date_trunc('hour', arr_ts)) AS a, destination FROM flights)
SELECT flight_id, ROUND(d * 6.0::DOUBLE / o.capacity, 6) AS origin_congestion_ratio, ROUND(a * 6.0::DOUBLE / s.capacity, 6) AS dest_congestion_ratio, (d * 6.0::DOUBLE / o.capacity > 1)::INT AS origin_over_capacity,
 ROUND(o.num_runways / GREATEST(d, 1)::DOUBLE, 6) AS runways_per_departure, (origin IN (1, 3))::INT AS origin_is_slot_constrained
FROM x JOIN stations o ON origin = o.station JOIN stations s ON destination = s.station
""")
def c25(t):
    rows = t.flights.withColumns({"dh": F.date_trunc("hour", "dep_ts"), "ah": F.date_trunc("hour", "arr_ts")})
    rows = J.attach_group(rows, ["origin", "dh"], d=F.count(F.lit(1)))
    rows = J.attach_group(rows, ["destination", "ah"], a=F.count(F.lit(1)))
    rows = J.attach(rows, t.stations, ["origin"], ["station"], {"capacity": "c1", "num_runways": "runways"}, "inner")
    rows = J.attach(rows, t.stations, ["destination"], ["station"], {"capacity": "c2"}, "inner")
    fields = S.congestion_fields(F.col("d"), F.col("a"), F.col("c1"), F.col("c2"), F.col("runways"), F.col("origin"), (1, 3))
    return rows.select("flight_id", *r6(fields, ("origin_congestion_ratio", "dest_congestion_ratio", "runways_per_departure")),
                       *ints(fields, ("origin_over_capacity", "origin_is_slot_constrained")))


@query("C26_schedule_padding", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 20 AS km, l_quantity * 10 AS block, l_quantity + 20 AS turn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(block - (30 + km / 12.5::DOUBLE), 6) AS schedule_padding_min, ROUND((block - (30 + km / 12.5::DOUBLE)) / GREATEST(block, 1) + 1e-9, 6) AS padding_ratio,
 ROUND(km / GREATEST(block / 60, 0.1::DOUBLE) + 1e-9, 6) AS speed_kmh_implied, turn - 30 AS turnaround_buffer_min, (turn < 45)::INT AS tight_turnaround FROM x
""")
def c26(t):
    fields = S.schedule_fields(F.col("l_extendedprice") / 20, F.col("l_quantity") * 10, F.col("l_quantity") + 20, F.col("l_linenumber"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(fields["schedule_padding_min"], 6).alias("schedule_padding_min"),
        *[F.round(fields[n] + 1e-9, 6).alias(n) for n in ("padding_ratio", "speed_kmh_implied")],
        fields["turnaround_buffer_min"].alias("turnaround_buffer_min"), *ints(fields, ("tight_turnaround",)))


@query("C27_airframe_flags", "SELECT event_id, (event_id % 6 = 0)::INT AS is_first_leg_of_day, (value / 4 > 18)::INT AS is_old_aircraft, (event_type = 'click')::INT AS is_regional_jet FROM events")
def c27(t):
    category = F.when(F.col("event_type") == "click", "regional_jet").otherwise(F.col("event_type"))
    fields = S.airframe_fields(F.col("value") / 4, category) | S.schedule_fields(F.col("value"), F.col("value"), F.col("value"), F.col("event_id") % 6)
    return t.events.select("event_id", *ints(fields, ("is_first_leg_of_day", "is_old_aircraft", "is_regional_jet")))


BEARING_SQL = """CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN 0 ELSE fmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360) END"""
KM_SQL = """2 * 6371 * asin(sqrt(LEAST(1, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"""


@query("C28_initial_bearing", f"WITH {PLACED} SELECT l_orderkey, l_linenumber, l_partkey, ROUND({BEARING_SQL}, 4) AS route_bearing_deg, ROUND(sin(radians({BEARING_SQL})), 6) AS bearing_sin, ROUND(cos(radians({BEARING_SQL})), 6) AS bearing_cos FROM placed")
def c28(t):
    fields = G.geo_fields()
    return t.placed_legs.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(fields["route_bearing_deg"], 4).alias("route_bearing_deg"),
        *r6(fields, ("bearing_sin", "bearing_cos")))


@query("C29_great_circle_distance", f"WITH {PLACED} SELECT l_orderkey, l_linenumber, l_partkey, ROUND({KM_SQL}, 4) AS km FROM placed")
def c29(t):
    km = G.great_circle_km(F.col("origin_latitude"), F.col("origin_longitude"), F.col("dest_latitude"), F.col("dest_longitude"))
    return t.placed_legs.select("l_orderkey", "l_linenumber", "l_partkey", F.round(km, 4).alias("km"))


@query("C30_distances_of_pairs", f"WITH {PLACED} SELECT origin, destination, ROUND(ANY_VALUE({KM_SQL}), 4) AS distance_km FROM placed GROUP BY 1, 2")
def c30(t):
    return J.observed_pair_distances(t.legs, "origin", "destination", t.stations, "station").withColumn(
        "distance_km", F.round("distance_km", 4))


@query("C31_route_geography", f"""
WITH {PLACED}, b AS (SELECT *, {BEARING_SQL} AS brg FROM placed)
SELECT l_orderkey, l_linenumber, l_partkey, (brg > 45 AND brg < 135)::INT AS is_eastbound, (brg > 225 AND brg < 315)::INT AS is_westbound, ROUND(lat2 - lat1, 4) AS lat_delta, ROUND(lon2 - lon1, 4) AS lon_delta,
 (region1 = region2)::INT AS same_region, (hub1 * hub2)::INT AS hub_to_hub, CASE WHEN hub1 = 1 THEN 'hub' ELSE 'spoke' END || '_' || CASE WHEN hub2 = 1 THEN 'hub' ELSE 'spoke' END AS hub_pair_type,
 (elev2 - elev1)::INT AS elevation_gain_ft, (elev1 > 4000)::INT AS high_altitude_origin FROM b
""")
def c31(t):
    fields = G.geo_fields()
    return t.placed_legs.select(
        "l_orderkey", "l_linenumber", "l_partkey", *ints(fields, (
            "is_eastbound", "is_westbound", "same_region", "hub_to_hub", "elevation_gain_ft", "high_altitude_origin")),
        F.round(fields["lat_delta"], 4).alias("lat_delta"), F.round(fields["lon_delta"], 4).alias("lon_delta"),
        fields["hub_pair_type"].alias("hub_pair_type"))


@query("C32_risk_band", f"WITH {SCORED} SELECT id, CASE WHEN score < 0.15 THEN 'low' WHEN score < 0.3 THEN 'moderate' WHEN score < 0.5 THEN 'elevated' ELSE 'high' END AS risk_band FROM scored")
def c32(t):
    return t.scored.select("id", X.risk_band(F.col("score")).alias("risk_band"))


@query("C33_half_even_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS halves FROM lineitem")
def c33(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 2, 0).alias("halves"))


@query("C34_display_value", """
WITH x AS (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN '%' WHEN 1 THEN 'min' WHEN 2 THEN 'h' ELSE 'kt' END AS unit FROM events)
SELECT event_id, CASE unit WHEN '%' THEN format('{:,.0f}', round_even(value / 500 * 100, 0)) || '%' WHEN 'min' THEN format('{:,.0f}', round_even(value * 30, 0)) || ' min'
 WHEN 'h' THEN printf('%02d:%02d', FLOOR(value / 21)::INT, round_even((value / 21 - FLOOR(value / 21)) * 60, 0)::INT) ELSE format('{:,.1f}', round_even(value * 30, 1)) || ' kt' END AS shown FROM x
""")
def c34(t):
    u = F.element_at(F.array(*[F.lit(x) for x in ("%", "min", "h", "kt")]), (F.col("event_id") % 4 + 1).cast("int"))
    scaled = F.when(u == "%", F.col("value") / 500).when(u == "h", F.col("value") / 21).otherwise(F.col("value") * 30)
    return t.events.select("event_id", X.display_value(scaled, u).alias("shown"))


@query("C35_label_lookup", """
WITH labels_(k, label) AS (VALUES ('red widget', 'Inbound aircraft late'), ('blue bolt', 'Ground-time slack'))
SELECT p_partkey, COALESCE(label, upper(substr(p_name, 1, 1)) || lower(replace(substr(p_name, 2), '_', ' '))) AS label FROM part LEFT JOIN labels_ ON p_name = k
""")
def c35(t):
    known = t.spark.createDataFrame([("red widget", "Inbound aircraft late"), ("blue bolt", "Ground-time slack")], "k STRING, label STRING")
    rows = J.attach(t.part, known, ["p_name"], ["k"], {"label": "_label"})
    return rows.select("p_partkey", F.coalesce("_label", X.default_label(F.col("p_name"))).alias("label"))


@query("C37_expected_minutes", f"WITH {SCORED} SELECT id, ROUND(score * 44, 4) AS expected_min FROM scored")
def c37(t):
    return t.scored.select("id", F.round(X.expected_minutes(F.col("score")), 4).alias("expected_min"))


@query("C38_drop_null_entries", f"WITH {OBSERVED} SELECT id, (CASE WHEN wind IS NULL THEN 0 ELSE 1 END + CASE WHEN gust IS NULL THEN 0 ELSE 1 END + CASE WHEN vis IS NULL THEN 0 ELSE 1 END)::INT AS kept FROM observed")
def c38(t):
    entries = F.create_map(F.lit("wind"), F.col("dep_wx_wind_speed_kt"), F.lit("gust"), F.col("dep_wx_wind_gust_kt"),
                           F.lit("vis"), F.col("dep_wx_visibility_km"))
    return t.observed.select("id", F.size(X.drop_null_entries(entries)).alias("kept"))


@query("C39_nan_as_null", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events")
def c39(t):
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select("event_id", X.json_safe(odd).alias("value"))


@query("C40_local_date", "SELECT event_id, ts::DATE::VARCHAR AS day FROM events")
def c40(t):
    return t.events.select("event_id", F.to_date("ts").cast("string").alias("day"))


@query("C41_flight_label", "SELECT event_id, event_type || COALESCE(NULLIF(CASE WHEN event_id % 3 <> 0 THEN user_id END, 0)::VARCHAR, '') AS flight FROM events")
def c41(t):
    number = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return t.events.select("event_id", X.flight_label(F.col("event_type"), number).alias("flight"))


@query("C42_late_target", f"WITH {FLIGHTS} SELECT flight_id, COALESCE(dep_delay >= 15, FALSE)::INT AS is_delayed FROM flights")
def c42(t):
    return t.flights.select("flight_id", B.flag(F.col("dep_delay") >= 15).cast("int").alias("is_delayed"))
