"""Q: data-quality cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import HOURLY, ZONES
from legwise.catalog.registry import query
from legwise.catalog.windows import GRID
from legwise.operators import quality as Q
from legwise.operators import windows as W


def station_codes(t):
    """Codes AAA..EAA of the five regions, with their zones."""
    zones = F.array(*[F.lit(z) for z in ZONES])
    return t.region.select(F.concat(F.char(F.col("r_regionkey") + 65), F.lit("AA")).alias("airport_code"),
                           F.get(zones, F.col("r_regionkey")).alias("timezone"))


def raw_flights(t):
    """events as an unclean flight feed: repeated ids, dirty codes, bad times and sentinels."""
    e = t.events.withColumns({"k": F.from_json("props", "k INT")["k"], "at": F.col("ts").cast("timestamp")})
    i = F.col("event_id")
    arrival = F.timestamp_micros(F.unix_micros("at") + (F.col("k") * 6 - 20).cast("bigint") * 60000000)
    return e.select(
        i.alias("seq"), F.concat(F.lit("F"), i - (i % 50 == 49).cast("int")).alias("flight_id"),
        F.col("event_type").alias("carrier_code"),
        F.when(i % 31 != 0, F.concat(F.lit(" n"), F.col("user_id").cast("string"))).alias("tail_number"),
        F.concat(F.lit(" "), F.char(i % 6 + 97), F.lit("aa ")).alias("origin"),
        F.concat(F.char(F.floor("value") % 5 + 65), F.lit("AA")).alias("destination"),
        F.when(i % 97 == 0, "garbage").otherwise(F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
        .alias("scheduled_departure_local"),
        F.date_format(arrival, "yyyy-MM-dd HH:mm:ss").alias("scheduled_arrival_local"),
        F.when(i % 23 == 0, -999.0).otherwise(F.col("value") * 20).alias("distance_km"),
        F.when(i % 41 == 0, 99999.0).when(i % 17 != 0, F.col("value") - 30).alias("departure_delay_min"),
        F.when(i % 43 == 0, -500.0).when(i % 17 != 0, F.col("value") - 35).alias("arrival_delay_min"),
        (i % 17 == 0).cast("int").alias("cancelled"), F.lit(0).alias("diverted"))


def fleet(t):
    return t.events.select(F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("tail_number")).where(
        F.col("user_id") % 4 != 0).distinct()


RAW = f"""
zones AS (SELECT chr(r_regionkey + 65) || 'AA' AS code, CASE r_regionkey {" ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES))} END AS zone FROM region),
e AS (SELECT *, (props::JSON->>'k')::INT AS k FROM events),
raw AS (SELECT event_id AS seq, 'F' || (event_id - (event_id % 50 = 49)::INT) AS flight_id, upper(event_type) AS carrier_code,
  CASE WHEN event_id % 31 <> 0 THEN 'N' || user_id END AS tail_number, chr((event_id % 6 + 65)::INT) || 'AA' AS origin, chr((FLOOR(value)::INT % 5 + 65)::INT) || 'AA' AS destination,
  CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', ts) END AS dep_local, date_trunc('second', ts + to_minutes(k * 6 - 20)) AS arr_local,
  CASE WHEN event_id % 23 = 0 THEN -999 ELSE value * 20 END AS distance_km,
  CASE WHEN event_id % 41 = 0 THEN 99999 WHEN event_id % 17 <> 0 THEN value - 30 END AS dep_delay,
  CASE WHEN event_id % 43 = 0 THEN -500 WHEN event_id % 17 <> 0 THEN value - 35 END AS arr_delay, (event_id % 17 = 0)::INT AS cancelled FROM e),
uniq AS (SELECT * FROM raw QUALIFY ROW_NUMBER() OVER (PARTITION BY flight_id ORDER BY seq) = 1),
timed AS (SELECT u.*, o.zone AS oz, d.zone AS dz, timezone('UTC', timezone(o.zone, dep_local)) AS dep_utc, timezone('UTC', timezone(d.zone, arr_local)) AS arr_utc
  FROM uniq u LEFT JOIN zones o ON o.code = origin LEFT JOIN zones d ON d.code = destination),
judged AS (SELECT *, (epoch_us(arr_utc) - epoch_us(dep_utc)) / 60000000.0::DOUBLE AS block,
  CASE WHEN dep_delay BETWEEN -120 AND 1440 THEN dep_delay END AS dep_ok, CASE WHEN arr_delay BETWEEN -120 AND 1440 THEN arr_delay END AS arr_ok,
  CASE WHEN distance_km > 0 AND distance_km <= 8000 THEN distance_km END AS dist_ok,
  (tail_number IN (SELECT 'N' || user_id FROM events WHERE user_id % 4 <> 0) AND tail_number IS NOT NULL)::INT AS tail_known FROM timed),
verdicts AS (SELECT *, CASE WHEN oz IS NULL OR dz IS NULL THEN 'invalid station codes' WHEN origin = destination THEN 'origin equals destination'
  WHEN NOT COALESCE(arr_utc > dep_utc, FALSE) THEN 'arrival not after departure' WHEN NOT block BETWEEN 20 AND 540 THEN 'implausible block time'
  WHEN dep_ok IS NULL AND cancelled = 0 THEN 'missing target' END AS verdict FROM judged),
placed AS (SELECT * FROM verdicts WHERE verdict IS NULL OR verdict NOT IN ('invalid station codes', 'origin equals destination')),
timely AS (SELECT * FROM placed WHERE verdict IS NULL OR verdict = 'missing target')
"""


def cleaned(t):
    return Q.clean_flights(raw_flights(t), station_codes(t), fleet(t), "seq")


@query("Q1_audit_log", f"""
WITH {RAW}, a AS (SELECT 1 AS step_no, 'duplicate flight ids' AS step, (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM uniq) AS rows_affected
UNION ALL SELECT 2, 'invalid station codes', COUNT(*) FROM verdicts WHERE verdict = 'invalid station codes'
UNION ALL SELECT 3, 'origin equals destination', COUNT(*) FROM verdicts WHERE verdict = 'origin equals destination'
UNION ALL SELECT 4, 'unparseable timestamps', (SELECT COUNT(*) FROM placed WHERE dep_local IS NULL) + (SELECT COUNT(*) FROM placed WHERE arr_local IS NULL)
UNION ALL SELECT 5, 'aligned to UTC', COUNT(*) FROM placed
UNION ALL SELECT 6, 'arrival not after departure', COUNT(*) FROM verdicts WHERE verdict = 'arrival not after departure'
UNION ALL SELECT 7, 'implausible block time', COUNT(*) FROM verdicts WHERE verdict = 'implausible block time'
UNION ALL SELECT 8, 'invalid distance', COUNT(*) FROM timely WHERE dist_ok IS NULL
UNION ALL SELECT 9, 'absurd departure_delay_min', COUNT(*) FROM timely WHERE dep_ok IS NULL AND dep_delay IS NOT NULL
UNION ALL SELECT 10, 'absurd arrival_delay_min', COUNT(*) FROM timely WHERE arr_ok IS NULL AND arr_delay IS NOT NULL
UNION ALL SELECT 11, 'unknown tail', COUNT(*) FROM timely WHERE tail_known = 0
UNION ALL SELECT 12, 'cancelled', COUNT(*) FROM timely WHERE cancelled = 1
UNION ALL SELECT 13, 'missing target', COUNT(*) FROM verdicts WHERE verdict = 'missing target'
UNION ALL SELECT 14, 'rows in', COUNT(*) FROM raw UNION ALL SELECT 15, 'rows out', COUNT(*) FROM verdicts WHERE verdict IS NULL)
SELECT step_no, step, rows_affected FROM a
""")
def q1(t):
    return cleaned(t)[1]


@query("Q2_clean_stations", """
SELECT chr(65 + n_nationkey % 20) || 'AA' AS airport_code, FIRST(n_name ORDER BY n_nationkey) AS name FROM nation GROUP BY 1
""")
def q2(t):
    dirty = t.nation.select(
        F.concat(F.lit(" "), F.lower(F.char(F.col("n_nationkey") % 20 + 65)), F.lit("aa ")).alias("airport_code"),
        F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq"))
    return Q.clean_airports(dirty, "seq")[0].select("airport_code", "name")


@query("Q3_clean_aircraft", "SELECT p_name AS tail_number, LEAST(FIRST(p_size ORDER BY p_partkey) + 10, 45)::DOUBLE AS age_years_2024 FROM part GROUP BY 1")
def q3(t):
    dirty = t.part.select(F.col("p_name").alias("tail_number"), (F.col("p_size") + 10).cast("double").alias("age_years_2024"),
                          F.col("p_partkey").alias("seq"))
    return Q.clean_aircraft(dirty, "seq")[0].select("tail_number", "age_years_2024")


def raw_weather(t):
    """events as hourly weather with repeated rows, unknown stations and sentinels."""
    e = t.events.withColumn("k", F.from_json("props", "k INT")["k"].cast("double"))
    i, k, v = F.col("event_id"), F.col("k"), F.col("value")
    return e.select(
        i.alias("seq"), F.concat(F.lit(" "), F.char(i % 6 + 97), F.lit("aa")).alias("airport_code"),
        F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("obs_time_utc"),
        F.when(i % 10 == 3, -999.0).otherwise(k / 2 - 12).alias("temperature_c"), (k / 4 - 8).alias("dewpoint_c"),
        F.when(i % 14 == 5, -9999.0).otherwise(k * 2).alias("wind_speed_kt"), (k * 2).alias("wind_gust_kt"),
        (v / 4).alias("precip_mm"), (v / 2).alias("snow_mm"),
        F.when(i % 9 == 1, 99999.0).otherwise(k / 4).alias("visibility_km"), (v * 100).alias("cloud_ceiling_ft"),
        F.col("event_type").alias("condition"))


RAW_WEATHER = """
w0 AS (SELECT event_id AS seq, chr((event_id % 6 + 65)::INT) || 'AA' AS code, date_trunc('hour', ts) AS hour, (props::JSON->>'k')::DOUBLE AS k, value AS v, event_type AS condition FROM events),
w1 AS (SELECT * FROM w0 QUALIFY ROW_NUMBER() OVER (PARTITION BY code, hour ORDER BY seq) = 1),
w2 AS (SELECT * FROM w1 WHERE code <> 'FAA'),
w3 AS (SELECT code, hour, condition, CASE WHEN seq % 10 <> 3 THEN k / 2 - 12 END AS temperature_c, k / 4 - 8 AS dewpoint_c, CASE WHEN seq % 14 <> 5 THEN k * 2 END AS wind_speed_kt, k * 2 AS wind_gust_kt,
  v / 4 AS precip_mm, v / 2 AS snow_mm, CASE WHEN seq % 9 <> 1 THEN k / 4 END AS visibility_km, v * 100 AS cloud_ceiling_ft FROM w2),
w4 AS (SELECT code, hour, condition, temperature_c, dewpoint_c, CASE WHEN wind_speed_kt <= 120 THEN wind_speed_kt END AS wind_speed_kt, CASE WHEN wind_gust_kt <= 160 THEN wind_gust_kt END AS wind_gust_kt,
  CASE WHEN precip_mm <= 120 THEN precip_mm END AS precip_mm, CASE WHEN snow_mm <= 400 THEN snow_mm END AS snow_mm, CASE WHEN visibility_km <= 20 THEN visibility_km END AS visibility_km,
  CASE WHEN cloud_ceiling_ft <= 45000 THEN cloud_ceiling_ft END AS cloud_ceiling_ft FROM w3)
"""
WX_NAMES = ("temperature_c", "dewpoint_c", "wind_speed_kt", "wind_gust_kt", "precip_mm", "snow_mm", "visibility_km", "cloud_ceiling_ft")


@query("Q4_weather_sentinels", f"WITH {RAW_WEATHER} SELECT code AS airport_code, epoch(hour)::BIGINT AS at, {', '.join(WX_NAMES)} FROM w3")
def q4(t):
    from legwise.functions.text import code
    from legwise.operators.joins import keep_known

    typed = raw_weather(t).withColumn("airport_code", code(F.col("airport_code")))
    unique = W.first_rows(typed, ["airport_code", "obs_time_utc"], ["seq"])
    known = keep_known(unique, "airport_code", station_codes(t), "airport_code")
    return Q.null_sentinels(known, list(WX_NAMES)).select(
        "airport_code", F.unix_timestamp("obs_time_utc").alias("at"), *WX_NAMES)


@query("Q5_physical_bounds", f"WITH {RAW_WEATHER} SELECT code AS airport_code, epoch(hour)::BIGINT AS at, {', '.join(WX_NAMES)} FROM w4")
def q5(t):
    from legwise.functions.weather import PHYSICAL_BOUNDS

    return Q.null_implausible(q4(t), PHYSICAL_BOUNDS)


@query("Q6_complete_hourly_grid", f"WITH {GRID} SELECT station, cell, (temperature_c IS NULL AND wind_speed_kt IS NULL)::INT AS imputed FROM cells")
def q6(t):
    grid = Q.complete_hours(t.hourly, "station", "hour", ["temperature_c", "wind_speed_kt"], "imputed")
    return grid.select("station", F.expr("unix_seconds(hour) div 3600").alias("cell"), F.col("imputed").cast("int").alias("imputed"))


FILLED = GRID + "," + ",".join(f"""
near_{m} AS (SELECT station, cell, {m} AS x,
  LAST_VALUE(CASE WHEN {m} IS NOT NULL THEN cell END IGNORE NULLS) OVER b AS i0, LAST_VALUE({m} IGNORE NULLS) OVER b AS v0,
  FIRST_VALUE(CASE WHEN {m} IS NOT NULL THEN cell END IGNORE NULLS) OVER a AS i1, FIRST_VALUE({m} IGNORE NULLS) OVER a AS v1 FROM cells
  WINDOW b AS (PARTITION BY station ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY station ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fill_{m} AS (SELECT station, cell, CASE WHEN x IS NOT NULL THEN x WHEN COALESCE(cell - i0 <= 3, FALSE) OR COALESCE(i1 - cell <= 3, FALSE)
  THEN COALESCE(v0 + (v1 - v0) * (cell - i0) / NULLIF(i1 - i0, 0), v0, v1) END AS {m} FROM near_{m})""" for m in ("temperature_c", "wind_speed_kt")) + """,
sky AS (SELECT station, cell, COALESCE(LAST_VALUE(condition IGNORE NULLS) OVER (PARTITION BY station ORDER BY cell ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 'Unknown') AS condition FROM cells),
filled AS (SELECT * FROM fill_temperature_c JOIN fill_wind_speed_kt USING (station, cell) JOIN sky USING (station, cell))
"""


def filled_hours(t):
    grid = Q.complete_hours(t.hourly, "station", "hour", ["temperature_c", "wind_speed_kt"])
    return Q.fill_short_gaps(grid, "station", "hour", ["temperature_c", "wind_speed_kt"], "condition")


@query("Q7_short_gap_filling", f"WITH {FILLED} SELECT station, cell, ROUND(temperature_c, 6) AS temperature_c, ROUND(wind_speed_kt, 6) AS wind_speed_kt, condition FROM filled")
def q7(t):
    return filled_hours(t).select("station", F.expr("unix_seconds(hour) div 3600").alias("cell"),
                                  *[F.round(m, 6).alias(m) for m in ("temperature_c", "wind_speed_kt")], "condition")


@query("Q8_residual_median_fill", f"""
WITH {HOURLY.strip()}, x AS (SELECT station, hour, CASE WHEN hour(hour) % 5 <> 0 THEN temperature_c END AS temperature_c, CASE WHEN hour(hour) % 7 <> 0 THEN wind_speed_kt END AS wind_speed_kt FROM hourly),
m AS (SELECT station, quantile_cont(temperature_c, 0.5) AS t, quantile_cont(wind_speed_kt, 0.5) AS w FROM x GROUP BY 1)
SELECT station, epoch(hour)::BIGINT AS at, COALESCE(temperature_c, t) AS temperature_c, COALESCE(wind_speed_kt, w) AS wind_speed_kt FROM x JOIN m USING (station)
""")
def q8(t):
    holed = t.hourly.withColumns({
        "temperature_c": F.when(F.hour("hour") % 5 != 0, F.col("temperature_c")),
        "wind_speed_kt": F.when(F.hour("hour") % 7 != 0, F.col("wind_speed_kt"))})
    return Q.fill_key_medians(holed, "station", ["temperature_c", "wind_speed_kt"]).select(
        "station", F.unix_seconds("hour").alias("at"), "temperature_c", "wind_speed_kt")


@query("Q9_flight_verdicts", f"WITH {RAW} SELECT flight_id, origin, destination, carrier_code, tail_number, verdict FROM verdicts")
def q9(t):
    return Q.judge_flights(raw_flights(t), station_codes(t), "seq").select(
        "flight_id", "origin", "destination", "carrier_code", "tail_number", F.col("_verdict").alias("verdict"))


@query("Q10_local_to_utc", f"WITH {RAW} SELECT flight_id, epoch_us(dep_utc) AS dep_us, epoch_us(arr_utc) AS arr_us FROM timed")
def q10(t):
    return Q.judge_flights(raw_flights(t), station_codes(t), "seq").select(
        "flight_id", F.unix_micros("scheduled_departure_utc").alias("dep_us"), F.unix_micros("scheduled_arrival_utc").alias("arr_us"))


GAP = f"""
WITH zones AS (SELECT r_regionkey AS r, CASE r_regionkey {" ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES))} END AS zone FROM region),
x AS (SELECT o_orderkey, o_orderdate + INTERVAL 150 MINUTE AS local, zone FROM orders JOIN zones ON r = o_orderkey % 5),
y AS (SELECT *, timezone('UTC', timezone(zone, local)) AS u FROM x)
SELECT o_orderkey, epoch_us(CASE WHEN timezone(zone, timezone('UTC', u)) <> local THEN date_trunc('hour', u) ELSE u END) AS us FROM y
"""


@query("Q10_skipped_hours", GAP)
def q10_gap(t):
    from legwise.functions.clock import local_to_utc

    zones = F.array(*[F.lit(z) for z in ZONES])
    local = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 150 * 60000000)
    zone = F.get(zones, (F.col("o_orderkey") % 5).cast("int"))
    return t.orders.select("o_orderkey", F.unix_micros(local_to_utc(local, zone)).alias("us"))


@query("Q11_unparseable_count", f"WITH {RAW} SELECT COUNT(*) FILTER (dep_local IS NULL) AS unparseable, COUNT(*) AS n FROM uniq")
def q11(t):
    judged = Q.judge_flights(raw_flights(t), station_codes(t), "seq")
    return judged.agg(F.count_if(F.col("_dep_local").isNull()).alias("unparseable"), F.count(F.lit(1)).alias("n"))


@query("Q12_distance_repair", f"""
WITH {RAW}, m AS (SELECT origin, destination, quantile_cont(dist_ok, 0.5) AS med FROM timely GROUP BY 1, 2)
SELECT flight_id, ROUND(COALESCE(dist_ok, med), 6) AS distance_km FROM timely LEFT JOIN m USING (origin, destination) WHERE verdict IS NULL
""")
def q12(t):
    return cleaned(t)[0].select("flight_id", F.round("distance_km", 6).alias("distance_km"))


@query("Q13_absurd_delays", f"WITH {RAW} SELECT flight_id, ROUND(dep_ok, 6) AS departure_delay_min, ROUND(arr_ok, 6) AS arrival_delay_min FROM timely WHERE verdict IS NULL")
def q13(t):
    return cleaned(t)[0].select("flight_id", *[F.round(d, 6).alias(d) for d in Q.DELAYS])


@query("Q14_clean_flights", f"WITH {RAW} SELECT flight_id, tail_known, cancelled, ROUND(block, 6) AS scheduled_block_min FROM timely WHERE verdict IS NULL")
def q14(t):
    return cleaned(t)[0].select("flight_id", F.col("tail_known").cast("int").alias("tail_known"),
                                F.col("cancelled").cast("int").alias("cancelled"),
                                F.round("scheduled_block_min", 6).alias("scheduled_block_min"))


@query("Q1_weather_audit_log", f"""
WITH {RAW_WEATHER}, {", ".join(f"o_{m} AS (SELECT COUNT(*) FILTER (w3.{m} IS NOT NULL AND w4.{m} IS NULL) AS n FROM w3 JOIN w4 USING (code, hour))" for m in WX_NAMES)},
s AS (SELECT COUNT(*) FILTER (seq % 10 = 3) + COUNT(*) FILTER (seq % 14 = 5) + COUNT(*) FILTER (seq % 9 = 1) AS n FROM w2),
span AS (SELECT (epoch(MAX(hour)) - epoch(MIN(hour))) / 3600 + 1 AS hours FROM w2)
SELECT 'duplicate observations' AS step, (SELECT COUNT(*) FROM w0) - (SELECT COUNT(*) FROM w1) AS rows_affected
UNION ALL SELECT 'unknown stations', (SELECT COUNT(*) FROM w1) - (SELECT COUNT(*) FROM w2) UNION ALL SELECT 'sentinel cells', (SELECT n FROM s)
UNION ALL SELECT 'out-of-range cells', {" + ".join(f"(SELECT n FROM o_{m})" for m in WX_NAMES)}
UNION ALL SELECT 'reconstructed hours', (SELECT hours FROM span)::BIGINT * 5 - (SELECT COUNT(*) FROM w2)
""")
def q15(t):
    return Q.clean_weather(raw_weather(t), station_codes(t), "seq")[1].select("step", "rows_affected").where(
        F.col("step") != "median-filled cells")
