"""S: sources and sinks, P: projections, F: filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from legwise.catalog.frames import FLIGHTS, OPERATED, SCORED
from legwise.catalog.registry import query
from legwise.functions.base import flag
from legwise.functions.schedule import route_key
from legwise.functions.clock import PEAK_HOURS
from legwise.operators import aggregates as A
from legwise.operators import joins as J
from legwise.operators import projections as P
from legwise.operators.ordering import hashed_sample
from legwise.operators.quality import split_valid
from legwise.operators.quantiles import median_of, smallest_mode
from legwise.operators.splits import chronological_split
from legwise.session import fresh_path
from legwise.sources import dimensions as D
from legwise.sources import readers, sinks


@query("S1_csv_scan_with_schema", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s1(t):
    from pyspark.sql.types import StructType

    path = fresh_path(t.spark, "orders-csv")
    wanted = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    wanted.write.option("header", True).csv(path)
    schema = StructType.fromDDL("o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE")
    return readers.read_csv(t.spark, path, schema).where(F.col("_corrupt").isNull()).drop(
        "_corrupt", "_ingest")


@query("S1_csv_missing_and_unreadable", """
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (o_orderkey % 4 = 0) AS n_missing, COUNT(*) FILTER (o_orderkey % 7 = 3 AND o_orderkey % 4 <> 0) AS n_unreadable,
 ROUND(SUM(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 3 THEN o_totalprice END), 2) AS total FROM orders
""")
def s1b(t):
    """Missing texts in a number column are NULL; other texts there go to the quarantine, and no row is lost."""
    path, price = fresh_path(t.spark, "orders-csv"), F.col("o_totalprice").cast("string")
    told = F.when(F.col("o_orderkey") % 4 == 0, "N/A").when(F.col("o_orderkey") % 7 == 3, "twelve").otherwise(price)
    t.orders.select("o_orderkey", told.alias("o_totalprice")).write.option("header", True).csv(path)
    rows = readers.read_csv(t.spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_totalprice").isNull() & F.col("_corrupt").isNull()).alias("n_missing"),
        F.count("_corrupt").alias("n_unreadable"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S2_parquet_scan", "SELECT * FROM supplier")
def s2(t):
    return readers.read_parquet(t.spark, t.path("supplier"))


@query("S3_parquet_projection", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount > 0.05")
def s3(t):
    return readers.read_parquet(t.spark, t.path("lineitem"), ["l_orderkey", "l_discount"]).where(
        F.col("l_discount") > 0.05)


@query("S4_partitioned_parquet_sink", """
SELECT month(l_shipdate)::INT AS month, COUNT(*) AS n, ROUND(SUM(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1
""")
def s4(t):
    path = fresh_path(t.spark, "lineitem-by-month")
    rows = t.lineitem.select("l_quantity", "l_shipdate", F.month("l_shipdate").alias("month"))
    sinks.write_parquet(rows, path, ["month"], ["l_shipdate"])
    return readers.read_parquet(t.spark, path).groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("S5_csv_report_sink", f"WITH {OPERATED} SELECT carrier_code, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM operated GROUP BY 1")
def s5(t):
    path = fresh_path(t.spark, "carrier-report")
    report = A.rate_by(t.operated, ["carrier_code"], "late").withColumn("rate", F.round("rate", 6))
    sinks.write_report_csv(report, path)
    return t.spark.read.schema(report.schema).option("header", True).csv(path)


@query("S6_nested_json_source", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def s6(t):
    return t.events.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("S6_nested_requests", """
SELECT event_id::VARCHAR AS request_id, CASE WHEN event_id % 2 = 0 THEN (props::JSON->>'k')::INT / 5.0::DOUBLE END AS visibility_km, event_id % 7 = 0 AS has_dest_weather FROM events
""")
def s6b(t):
    """Requests with nested weather blocks, written and read as JSON lines."""
    from legwise.catalog.serving import requests_of
    from legwise.sources.schemas import REQUEST

    path = fresh_path(t.spark, "requests-json")
    requests_of(t).write.json(path)
    return readers.read_json(t.spark, path, REQUEST).select(
        "request_id", F.col("origin_weather.visibility_km").alias("visibility_km"),
        F.col("dest_weather").isNotNull().alias("has_dest_weather"))


@query("S7_json_facts_sink", f"WITH {OPERATED} SELECT origin, COUNT(*) AS n, ROUND(AVG(dep_delay), 6) AS mean_min FROM operated GROUP BY 1")
def s7(t):
    path = fresh_path(t.spark, "facts-json")
    facts = t.operated.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("dep_delay"), 6).alias("mean_min"))
    sinks.write_facts_json(facts, path)
    return readers.read_json(t.spark, path, facts.schema)


# A literal dimension for the five regions.
CLIMATES = ((0, "arid"), (1, "temperate"), (2, "tropical"), (3, "temperate"), (4, "arid"))


@query("S8_literal_dimension", f"""
WITH climate(region, zone) AS (VALUES {", ".join(f"({r}, '{z}')" for r, z in CLIMATES)})
SELECT zone, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN climate ON n_regionkey = region GROUP BY 1
""")
def s8(t):
    dim = D.literal_dimension(t.spark, CLIMATES, "region INT, zone STRING")
    placed = J.attach(t.customer, t.nation, ["c_nationkey"], ["n_nationkey"], {"n_regionkey": "region_key"}, "inner")
    zoned = J.attach(placed, dim, ["region_key"], ["region"], {"zone": "zone"}, "inner")
    return zoned.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


# Fixed-date holidays used to name the order dates.
NAMED_DAYS = ((1, 1, "New Year's Day"), (7, 4, "Independence Day"), (11, 11, "Veterans Day"), (12, 25, "Christmas Day"), (12, 26, "Boxing Day"))
NAMED_SQL = "CASE " + " ".join(
    "WHEN month(d) = {} AND day(d) = {} THEN '{}'".format(m, d, n.replace("'", "''")) for m, d, n in NAMED_DAYS) + " END"
CALENDAR = f"""
official AS (SELECT DISTINCT o_orderdate::DATE AS d, {NAMED_SQL.replace("(d)", "(o_orderdate)")} AS name FROM orders),
named AS (SELECT d, name, (name IN ('Christmas Day', 'New Year''s Day', 'Independence Day'))::INT AS major, 0 AS src FROM official
  WHERE name IS NOT NULL AND d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' + 7),
extra AS (SELECT make_date(y, 12, x.d) AS d, x.n AS name, 1 AS major, 1 AS src
  FROM (SELECT UNNEST(generate_series(1996, 2000)) AS y) ys, (VALUES (24, 'Christmas Eve'), (26, 'Day after Christmas'), (31, 'New Year''s Eve')) x(d, n)),
calendar AS (SELECT d AS holiday_date, name AS holiday_name, major AS is_major_travel FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY src, name) AS r FROM (SELECT * FROM named UNION ALL SELECT * FROM extra)) WHERE r = 1)
"""


def order_calendar(t):
    day = F.to_date(F.col("o_orderdate").cast("timestamp"))
    name = F.lit(None).cast("string")
    for m, d, n in NAMED_DAYS:
        name = F.when((F.month("d") == m) & (F.dayofmonth("d") == d), n).otherwise(name)
    official = t.orders.select(day.alias("d")).distinct().withColumn("name", name).where(F.col("name").isNotNull())
    return D.holiday_calendar(official, "d", "name", "1996-01-01", "2000-12-31")


@query("S9_holiday_calendar", f"WITH {CALENDAR} SELECT holiday_date::VARCHAR AS holiday_date, holiday_name, is_major_travel FROM calendar")
def s9(t):
    return order_calendar(t).withColumn("holiday_date", F.col("holiday_date").cast("string"))


@query("S10_feature_manifest", f"""
WITH {OPERATED} SELECT COUNT(*) AS n_rows, ROUND(AVG(late), 6) AS positive_rate, 4 AS n_features, 'missing_one' AS missing,
  2 AS size_time, 2 AS size_flight FROM operated
""")
def s10(t):
    groups = {"time": ["dep_ts", "day"], "flight": ["k", "missing_one"]}
    return D.feature_manifest(t.operated, "late", groups).withColumn("positive_rate", F.round("positive_rate", 6))


# ---------------------------------------------------------------- P
@query("P1_prefixed_dimension", "SELECT n_nationkey AS origin_n_nationkey, n_name AS origin_n_name, n_regionkey AS origin_n_regionkey FROM nation")
def p1(t):
    return J.prefixed(t.nation, "origin_")


@query("P2_rename", "SELECT o_orderkey AS flight_id, o_totalprice AS price FROM orders")
def p2(t):
    return t.orders.select("o_orderkey", "o_totalprice").withColumnsRenamed(
        {"o_orderkey": "flight_id", "o_totalprice": "price"})


@query("P3_ordered_existing_columns", "SELECT l_orderkey, l_tax, l_discount FROM lineitem")
def p3(t):
    return P.keep_columns(t.lineitem, ["l_orderkey", "l_tax", "absent", "l_orderkey", "l_discount"])


@query("P4_drop_temporaries", "SELECT p_partkey, p_brand, p_size FROM part")
def p4(t):
    return t.part.withColumn("_h", F.upper("p_name")).drop("_h", "p_name", "p_type", "p_retailprice")


@query("P5_type_coercion", """
SELECT event_id, user_id::VARCHAR AS user_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE (event_id % 8)::VARCHAR END AS DOUBLE) AS amount FROM events
""")
def p5(t):
    raw = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 9 == 0, "bad").otherwise(
        (F.col("event_id") % 8).cast("string")).alias("amount"))
    return P.coerce_types(raw, ["user_id"], ["amount"]).withColumn("amount", F.col("amount").cast("double"))


TRAIN_LEVELS = "levels AS (SELECT o_orderpriority AS p, ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority <> '5-LOW'))"


@query("P6_ordinal_codes", f"WITH {TRAIN_LEVELS} SELECT o_orderkey, COALESCE(code, -1)::INT AS o_orderpriority_code FROM orders LEFT JOIN levels ON o_orderpriority = p")
def p6(t):
    train = t.orders.where((F.col("o_orderdate") < "1997-01-01") & (F.col("o_orderpriority") != "5-LOW"))
    model = P.fit_codes(train, ["o_orderpriority"])
    return P.apply_codes(t.orders, model).select("o_orderkey", "o_orderpriority_code")


@query("P7_levels_of_training_rows", f"WITH {TRAIN_LEVELS} SELECT p AS level, code::INT AS code FROM levels")
def p7(t):
    train = t.orders.where((F.col("o_orderdate") < "1997-01-01") & (F.col("o_orderpriority") != "5-LOW"))
    model = P.fit_codes(train, ["o_orderpriority"])
    seen = P.apply_codes(train, model)
    return seen.select(F.col("o_orderpriority").alias("level"), F.col("o_orderpriority_code").alias("code")).distinct()


@query("P8_default_fill", f"""
WITH {FLIGHTS}, m AS (SELECT tail_number AS v FROM flights WHERE tail_number IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, tail_number LIMIT 1)
SELECT flight_id, COALESCE(tail_number, (SELECT v FROM m)) AS tail_number,
  ROUND(COALESCE(dep_delay, (SELECT quantile_cont(dep_delay, 0.5) FROM flights)), 6) AS dep_delay FROM flights
""")
def p8(t):
    filled = P.fill_defaults(t.flights, {
        "tail_number": smallest_mode(t.flights, "tail_number"),
        "dep_delay": median_of(t.flights, F.col("dep_delay"))})
    return filled.select("flight_id", "tail_number", F.round("dep_delay", 6).alias("dep_delay"))


@query("P9_model_frame", f"WITH {FLIGHTS} SELECT k::DOUBLE AS k, NULL::DOUBLE AS humidity, carrier_code, origin::VARCHAR AS origin FROM flights")
def p9(t):
    return P.model_frame(t.flights, {"k": "double", "humidity": "double", "carrier_code": "string", "origin": "string"})


@query("P10_route_key", "SELECT l_suppkey::VARCHAR || '-' || l_partkey::VARCHAR AS route, COUNT(*) AS n FROM lineitem GROUP BY 1")
def p10(t):
    return t.lineitem.groupBy(route_key(F.col("l_suppkey"), F.col("l_partkey")).alias("route")).agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- F
@query("F1_known_keys", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def f1(t):
    dim = t.customer.where(F.col("c_mktsegment") != "MACHINERY")
    return J.keep_known(t.orders, "o_custkey", dim, "c_custkey").select("o_orderkey")


@query("F1_unknown_keys", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def f1_anti(t):
    dim = t.customer.where(F.col("c_mktsegment") != "MACHINERY")
    return J.keep_unknown(t.orders, "o_custkey", dim, "c_custkey").select("o_orderkey")


@query("F2_reject_self_pairs", f"WITH {FLIGHTS} SELECT flight_id FROM flights WHERE origin <> destination")
def f2(t):
    return t.flights.where(F.col("origin") != F.col("destination")).select("flight_id")


@query("F3_ordered_instants", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate")
def f3(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    later = F.coalesce(F.col("l_shipdate") > F.col("o_orderdate"), F.lit(False))
    return joined.where(later).select("l_orderkey", "l_linenumber", "l_partkey")


@query("F4_plausible_block", f"WITH {FLIGHTS} SELECT flight_id FROM flights WHERE (epoch_us(arr_ts) - epoch_us(dep_ts)) / 60000000 BETWEEN 40 AND 100")
def f4(t):
    from legwise.functions.clock import minutes_between

    return t.flights.where(minutes_between(F.col("dep_ts"), F.col("arr_ts")).between(40, 100)).select("flight_id")


@query("F5_missing_target", f"WITH {FLIGHTS}, x AS (SELECT *, CASE WHEN k <> 3 THEN dep_delay END AS target FROM flights) SELECT flight_id FROM x WHERE NOT (target IS NULL AND cancelled = 0)")
def f5(t):
    target = F.when(F.col("k") != 3, F.col("dep_delay"))
    return t.flights.where(~(target.isNull() & (F.col("cancelled") == 0))).select("flight_id")


@query("F6_operated_only", f"WITH {OPERATED} SELECT flight_id, dep_delay FROM operated")
def f6(t):
    return t.operated.select("flight_id", "dep_delay")


@query("F7_interactive_filter", f"WITH {OPERATED} SELECT flight_id FROM operated WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND carrier_code IN ('click', 'view')")
def f7(t):
    return t.operated.where(
        F.col("day").between("2024-01-05", "2024-01-12") & F.col("carrier_code").isin("click", "view")
    ).select("flight_id")


@query("F8_chronological_split", """
SELECT CASE WHEN o_orderdate::DATE <= DATE '1999-06-30' THEN 'train' WHEN o_orderdate::DATE <= DATE '2000-06-30' THEN 'valid' ELSE 'test' END AS split,
 COUNT(*) AS n, MIN(o_orderdate)::DATE::VARCHAR AS first_day, MAX(o_orderdate)::DATE::VARCHAR AS last_day FROM orders GROUP BY 1
""")
def f8(t):
    day = F.to_date(F.col("o_orderdate").cast("timestamp"))
    rows = chronological_split(t.orders.withColumn("day", day), "day", "1999-06-30", "2000-06-30")
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"))


@query("F9_large_groups", f"WITH {OPERATED} SELECT tail_number, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM operated GROUP BY 1 HAVING COUNT(*) > 60")
def f9(t):
    return A.rate_by(t.operated, ["tail_number"], "late", 60).withColumn("rate", F.round("rate", 6))


@query("F10_group_key_range", f"WITH {OPERATED} SELECT (k - 50)::INT AS gap, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM operated WHERE k - 50 BETWEEN -7 AND 7 GROUP BY 1")
def f10(t):
    gap = (F.col("k") - 50).alias("gap")
    return A.rate_by(t.operated, [gap], "late").where(F.col("gap").between(-7, 7)).withColumn("rate", F.round("rate", 6))


@query("F11_peak_hours", f"WITH {OPERATED} SELECT carrier_code, ROUND(AVG(late), 6) AS rate, COUNT(*) AS n FROM operated WHERE hour(dep_ts) IN (7, 8, 17, 18, 19) GROUP BY 1")
def f11(t):
    peak = t.operated.where(F.hour("dep_ts").isin(*PEAK_HOURS))
    return A.rate_by(peak, ["carrier_code"], "late").withColumn("rate", F.round("rate", 6))


@query("F12_seeded_sample", f"WITH {SCORED} SELECT id, score, label FROM scored ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 2000")
def f12(t):
    return hashed_sample(t.scored, 2000, "id").select("id", "score", "label")


@query("F13_request_validation", f"""
WITH {FLIGHTS}, r AS (SELECT flight_id, list_filter([
  CASE WHEN NOT COALESCE(length(carrier_code) BETWEEN 4 AND 5, FALSE) THEN 'carrier_code length' END,
  CASE WHEN NOT COALESCE(k BETWEEN 5 AND 90, FALSE) THEN 'k out of range' END,
  CASE WHEN COALESCE(origin = destination, TRUE) THEN 'same origin and destination' END], lambda x: x IS NOT NULL) AS reasons FROM flights)
SELECT flight_id, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons FROM r
""")
def f13(t):
    valid, rejected = split_valid(t.flights, {
        "carrier_code length": ~F.length("carrier_code").between(4, 5),
        "k out of range": ~F.col("k").between(5, 90),
        "same origin and destination": F.col("origin") == F.col("destination")})
    return valid.select("flight_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons")).unionByName(
        rejected.select("flight_id", F.lit(False).alias("accepted"), F.array_join("reasons", "; ").alias("reasons")))
