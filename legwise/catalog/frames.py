"""How the bundled tables stand in for flights, routes, weather and scores.

Every view is a projection or join of whole tables; the SQL twins below define
the same views for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legwise.functions.base import flag
from legwise.session import configure
from legwise.sources.readers import read_parquet


class Tables:
    """Lazy access to the tables of one folder, and to the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # ------------------------------------------------------------ flights
    @cached_property
    def flights(self) -> DataFrame:
        """events as flights: one row per event, five stations, some tails unknown."""
        k = F.from_json("props", "k INT")["k"]
        ts = F.col("ts").cast("timestamp")
        flown = F.col("event_id") % 17 != 0
        base = self.events.select(
            F.col("event_id").alias("flight_id"),
            F.col("event_type").alias("carrier_code"),
            F.when(F.col("user_id") % 29 != 0, F.col("user_id")).alias("tail_number"),
            (F.col("event_id") % 5).alias("origin"),
            (F.floor("value") % 5).alias("destination"),
            ts.alias("dep_ts"),
            F.timestamp_micros(F.unix_micros(ts) + (20 + k).cast("bigint") * 60000000).alias("arr_ts"),
            F.to_date(ts).alias("day"),
            k.alias("k"),
            F.when(flown, F.col("value") - 30).alias("dep_delay"),
            F.when(flown, F.col("value") - 35).alias("arr_delay"),
            flag(~flown).cast("int").alias("cancelled"),
            (F.col("event_id") % 6).alias("leg"),
        )
        return base.withColumn("late", flag(F.col("dep_delay") >= 15).cast("int"))

    @cached_property
    def operated(self) -> DataFrame:
        return self.flights.where(F.col("cancelled") == 0)

    # ------------------------------------------------------------ stations
    @cached_property
    def stations(self) -> DataFrame:
        """nation as stations with coordinates, hub flag, elevation, capacity and zone."""
        n = F.col("n_nationkey")
        zones = F.array(*[F.lit(z) for z in ZONES])
        return self.nation.select(
            n.alias("station"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"),
            (n * 0.9 + 25.0).alias("latitude"), (n * -2.1 - 70.0).alias("longitude"),
            (n % 3 == 0).cast("int").alias("is_hub"), (n * 250).alias("elevation_ft"),
            (n + 20).alias("capacity"), (n % 4 + 2).alias("num_runways"),
            F.get(zones, F.col("n_regionkey")).alias("timezone"))

    @cached_property
    def legs(self) -> DataFrame:
        """lineitem as legs from the supplier's nation to the customer's nation."""
        return (
            self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", F.col("s_nationkey").alias("origin"),
                    F.col("c_nationkey").alias("destination"),
                    F.col("l_shipdate").cast("timestamp").alias("shipped"),
                    F.col("o_orderdate").cast("timestamp").alias("ordered"))
        )

    @cached_property
    def placed_legs(self) -> DataFrame:
        """legs with the station columns of both ends."""
        from legwise.operators.joins import attach_roles

        return attach_roles(self.legs, self.stations, "station",
                            {"origin": "origin_", "destination": "dest_"},
                            ["latitude", "longitude", "region", "is_hub", "elevation_ft"])

    # ------------------------------------------------------------ weather
    @cached_property
    def hourly(self) -> DataFrame:
        """events as hourly observations per station (five stations)."""
        return self.flights.groupBy(
            F.col("origin").alias("station"), F.date_trunc("hour", "dep_ts").alias("hour")
        ).agg(F.min("k").cast("double").alias("temperature_c"),
              F.count(F.lit(1)).cast("double").alias("wind_speed_kt"),
              F.min("carrier_code").alias("condition"))

    @cached_property
    def observed(self) -> DataFrame:
        """events as weather at departure: measures derived from value and k."""
        k, v = F.col("k").cast("double"), F.col("value")
        return self.events.select("event_id", "value", F.from_json("props", "k INT")["k"].alias("k")).select(
            F.col("event_id").alias("id"),
            (k / 2 - 12).alias("dep_wx_temperature_c"), (k / 3 - 8).alias("dep_wx_dewpoint_c"),
            F.when(F.col("k") % 11 != 0, k / 4).alias("dep_wx_wind_speed_kt"),
            F.when(F.col("k") % 7 != 0, k / 2).alias("dep_wx_wind_gust_kt"),
            F.when(F.col("event_id") % 13 != 0, v / 40).alias("dep_wx_precip_mm"),
            (F.col("event_id") % 23 / 2.0).alias("dep_wx_snow_mm"),
            F.when(F.col("event_id") % 19 != 0, 20 - v / 25).alias("dep_wx_visibility_km"),
            (v * 60).alias("dep_wx_cloud_ceiling_ft"),
            F.when(F.col("k") < 20, "Thunderstorm").otherwise("Clear").alias("dep_wx_condition"),
            flag(v >= 45).cast("int").alias("late"))

    # ------------------------------------------------------------ scores
    @cached_property
    def scored(self) -> DataFrame:
        """events as scored flights with many tied scores."""
        cents = F.least(F.round(F.col("value") * 100).cast("bigint"), F.lit(10000))
        points = F.from_json("props", "k INT")["k"] * 60 + F.floor(cents * 4 / 10)
        return self.events.select(
            F.col("event_id").alias("id"), flag(F.col("value") >= 45).cast("int").alias("label"),
            (points / 10000.0).alias("score"), (F.col("value") - 30).alias("delay"),
            F.to_date(F.col("ts").cast("timestamp")).alias("day"),
            F.hour(F.col("ts").cast("timestamp")).alias("hour"),
            F.col("event_type").alias("carrier_code"))


# Zones of the five regions.
ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Phoenix",
         "America/Los_Angeles")

FLIGHTS = """
flights AS (
  SELECT *, COALESCE(dep_delay >= 15, FALSE)::INT AS late FROM (
    SELECT event_id AS flight_id, event_type AS carrier_code,
           CASE WHEN user_id % 29 <> 0 THEN user_id END AS tail_number,
           event_id % 5 AS origin, FLOOR(value)::BIGINT % 5 AS destination,
           ts AS dep_ts, ts + to_minutes(20 + k) AS arr_ts, ts::DATE AS day, k,
           CASE WHEN event_id % 17 <> 0 THEN value - 30 END AS dep_delay,
           CASE WHEN event_id % 17 <> 0 THEN value - 35 END AS arr_delay,
           (event_id % 17 = 0)::INT AS cancelled, event_id % 6 AS leg
    FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events)))
"""
OPERATED = FLIGHTS + ", operated AS (SELECT * FROM flights WHERE cancelled = 0)\n"
STATIONS = """
stations AS (
  SELECT n_nationkey AS station, n_name AS name, n_regionkey AS region,
         n_nationkey * 0.9::DOUBLE + 25 AS latitude, n_nationkey * -2.1::DOUBLE - 70 AS longitude,
         (n_nationkey % 3 = 0)::INT AS is_hub, n_nationkey * 250 AS elevation_ft,
         n_nationkey + 20 AS capacity, n_nationkey % 4 + 2 AS num_runways,
         CASE n_regionkey WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
              WHEN 2 THEN 'America/Denver' WHEN 3 THEN 'America/Phoenix'
              ELSE 'America/Los_Angeles' END AS timezone
  FROM nation)
"""
LEGS = """
legs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
         s_nationkey AS origin, c_nationkey AS destination, l_shipdate AS shipped, o_orderdate AS ordered
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey)
"""
PLACED = LEGS + ", " + STATIONS + """,
placed AS (
  SELECT legs.*, o.latitude AS lat1, o.longitude AS lon1, o.region AS region1, o.is_hub AS hub1,
         o.elevation_ft AS elev1, d.latitude AS lat2, d.longitude AS lon2, d.region AS region2,
         d.is_hub AS hub2, d.elevation_ft AS elev2
  FROM legs LEFT JOIN stations o ON legs.origin = o.station
       LEFT JOIN stations d ON legs.destination = d.station)
"""
HOURLY = FLIGHTS + """,
hourly AS (
  SELECT origin AS station, date_trunc('hour', dep_ts) AS hour, MIN(k)::DOUBLE AS temperature_c,
         COUNT(*)::DOUBLE AS wind_speed_kt, MIN(carrier_code) AS condition
  FROM flights GROUP BY 1, 2)
"""
OBSERVED = """
observed AS (
  SELECT event_id AS id, k / 2.0::DOUBLE - 12 AS temp, k / 3.0::DOUBLE - 8 AS dew,
         CASE WHEN k % 11 <> 0 THEN k / 4.0::DOUBLE END AS wind,
         CASE WHEN k % 7 <> 0 THEN k / 2.0::DOUBLE END AS gust,
         CASE WHEN event_id % 13 <> 0 THEN value / 40 END AS precip,
         (event_id % 23) / 2.0::DOUBLE AS snow,
         CASE WHEN event_id % 19 <> 0 THEN 20 - value / 25 END AS vis,
         value * 60 AS ceiling, CASE WHEN k < 20 THEN 'Thunderstorm' ELSE 'Clear' END AS condition,
         (value >= 45)::INT AS late
  FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events))
"""
FILLED = OBSERVED + """, filled AS (SELECT *, COALESCE(precip, 0) AS p, COALESCE(gust, wind) AS g, COALESCE(wind, 0) AS w, COALESCE(vis, 16) AS v FROM observed),
stormy AS (SELECT *, (condition = 'Thunderstorm' OR COALESCE(g > 35 AND p > 3, FALSE))::INT AS storm FROM filled),
severe AS (SELECT *, 0.85::DOUBLE * LEAST(GREATEST(p / 6, 0), 1.7::DOUBLE) + 1.25::DOUBLE * (CASE WHEN g IS NOT NULL THEN LEAST(GREATEST((g - 24) / 26, 0), 1.6::DOUBLE) END)
  + 1.05::DOUBLE * LEAST(GREATEST((5 - v) / 5, 0), 1) + 1.55::DOUBLE * LEAST(GREATEST(snow / 18, 0), 1.7::DOUBLE) + 1.15::DOUBLE * storm + 0.35::DOUBLE * (ceiling < 800)::INT AS sev FROM stormy)
"""
SCORED = """
scored AS (
  SELECT event_id AS id, (value >= 45)::INT AS label,
         ((props::JSON->>'k')::INT * 60 + LEAST(ROUND(value * 100)::BIGINT, 10000) * 4 // 10)
           / 10000.0::DOUBLE AS score,
         value - 30 AS delay, ts::DATE AS day, EXTRACT(hour FROM ts) AS hour,
         event_type AS carrier_code
  FROM events)
"""
