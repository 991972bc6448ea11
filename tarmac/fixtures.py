"""Flight-shaped views over the star-schema tables, and the same views as SQL.

The Spark side and the SQL side must say the same; queries read their input through these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import times as T
from tarmac.functions.times import col
from tarmac.session import shared_folder

# Ten airports and their zones, in index order.
AIRPORTS = ("ATL", "ORD", "DEN", "LAX", "PHX", "SEA", "JFK", "DFW", "ANC", "HNL")
ZONES = (
    "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix",
    "America/Los_Angeles", "America/New_York", "America/Chicago", "America/Anchorage", "Pacific/Honolulu",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index) -> F.col:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (col(index) + 1).cast("int"))


def _hhmm(minutes):
    m = col(minutes)
    return (T.int_div(m, 60) * 100 + m % 60).cast("int")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flight per line item; ``flight_id`` is unique."""
    items = table(spark, sf_dir, "lineitem")
    base = items.select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))").alias("flight_id"),
        F.col("l_shipdate").cast("date").alias("FlightDate"),
        F.expr("case l_suppkey % 4 when 0 then 'WN' when 1 then 'AA' when 2 then 'DL' else 'UA' end").alias("Reporting_Airline"),
        F.expr("cast(l_partkey % 3 as int)").alias("Flight_Number_Reporting_Airline"),
        F.expr("cast(l_suppkey % 10 as int)").alias("oi"),
        F.expr("cast((l_suppkey + 1 + l_partkey % 7) % 10 as int)").alias("di"),
        F.expr("concat('N', l_suppkey)").alias("Tail_Number"),
        F.expr("cast(((l_orderkey * 7 + l_linenumber * 3) % 24) * 60 + l_partkey % 60 as int)").alias("dep_min"),
        F.expr("cast(60 + l_partkey % 240 as int)").alias("duration"),
        F.expr("case when l_tax = 0.08 then null else greatest(0.0D, l_quantity - 20) * 2 end").alias("DepDelayMinutes"),
        F.expr("round(l_discount * 100, 0)").alias("disc"),
        F.expr("cast((l_orderkey * 7 + l_suppkey) % 101 as int)").alias("noise"),
        F.col("l_quantity").alias("quantity"),
    )
    off = F.expr("(dep_min + cast(DepDelayMinutes as int) + 10) % 1440")
    timed = base.select(
        "flight_id", "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline",
        _pick(AIRPORTS, "oi").alias("Origin"), _pick(AIRPORTS, "di").alias("Dest"),
        _pick(ZONES, "oi").alias("Origin_TZ"), _pick(ZONES, "di").alias("Dest_TZ"), "Tail_Number",
        _hhmm("dep_min").alias("CRSDepTime"), _hhmm(F.expr("(dep_min + duration) % 1440")).alias("CRSArrTime"),
        "DepDelayMinutes",
        F.expr("case when DepDelayMinutes is null then null else greatest(0.0D, DepDelayMinutes + disc - 5) end").alias("ArrDelayMinutes"),
        F.expr("cast(duration - 20 as double)").alias("AirTime"), _hhmm(off).alias("WheelsOff"), "noise", "quantity",
    )
    arrival = T.hhmm_to_local_ts("FlightDate", "CRSArrTime")
    return timed.withColumns(
        {
            "dep_dt_local": T.hhmm_to_local_ts("FlightDate", "CRSDepTime"),
            "arr_dt_local": T.overnight_arrival(arrival, "CRSDepTime", "CRSArrTime"),
        }
    )


def flights_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights(spark, sf_dir).withColumns(
        {"dep_utc": T.local_to_utc("dep_dt_local", "Origin_TZ"), "arr_utc": T.local_to_utc("arr_dt_local", "Dest_TZ")}
    )


_tables: dict = {}


def flight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flights_utc`` as a written table, once per session and scale.

    The feature steps start from a written table of enriched flights, as the pipelines do: they scan
    it several times, and time zones are converted once. Every task writes the rows it reads, so nothing is
    shuffled or sorted.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        path = shared_folder(spark, "flights")
        flights_utc(spark, sf_dir).write.parquet(path)
        _tables[key] = spark.read.parquet(path)
    return _tables[key]


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FLIGHTS_SQL = f"""
base AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS flight_id,
    CAST(l_shipdate AS DATE) AS FlightDate,
    CASE l_suppkey % 4 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' ELSE 'UA' END AS Reporting_Airline,
    CAST(l_partkey % 3 AS INTEGER) AS Flight_Number_Reporting_Airline,
    CAST(l_suppkey % 10 AS INTEGER) AS oi, CAST((l_suppkey + 1 + l_partkey % 7) % 10 AS INTEGER) AS di,
    'N' || l_suppkey AS Tail_Number,
    CAST(((l_orderkey * 7 + l_linenumber * 3) % 24) * 60 + l_partkey % 60 AS INTEGER) AS dep_min,
    CAST(60 + l_partkey % 240 AS INTEGER) AS duration,
    CASE WHEN l_tax = 0.08 THEN NULL ELSE greatest(0.0::DOUBLE, l_quantity - 20) * 2 END AS DepDelayMinutes,
    round(l_discount * 100) AS disc,
    CAST((l_orderkey * 7 + l_suppkey) % 101 AS INTEGER) AS noise, l_quantity AS quantity
  FROM lineitem
), flights AS (
  SELECT flight_id, FlightDate, Reporting_Airline, Flight_Number_Reporting_Airline,
    {_sql_list(AIRPORTS)}[oi + 1] AS Origin, {_sql_list(AIRPORTS)}[di + 1] AS Dest,
    {_sql_list(ZONES)}[oi + 1] AS Origin_TZ, {_sql_list(ZONES)}[di + 1] AS Dest_TZ, Tail_Number,
    CAST(dep_min // 60 * 100 + dep_min % 60 AS INTEGER) AS CRSDepTime,
    CAST((dep_min + duration) % 1440 // 60 * 100 + (dep_min + duration) % 1440 % 60 AS INTEGER) AS CRSArrTime,
    DepDelayMinutes,
    CASE WHEN DepDelayMinutes IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, DepDelayMinutes + disc - 5) END AS ArrDelayMinutes,
    CAST(duration - 20 AS DOUBLE) AS AirTime,
    CAST((dep_min + CAST(DepDelayMinutes AS INTEGER) + 10) % 1440 // 60 * 100
      + (dep_min + CAST(DepDelayMinutes AS INTEGER) + 10) % 1440 % 60 AS INTEGER) AS WheelsOff,
    noise, quantity,
    FlightDate + to_minutes(dep_min) AS dep_dt_local,
    FlightDate + to_minutes((dep_min + duration) % 1440)
      + to_days(CASE WHEN (dep_min + duration) % 1440 < dep_min THEN 1 ELSE 0 END) AS arr_dt_local
  FROM base
)"""


def utc_sql(ts: str, zone: str) -> str:
    """Local to UTC in SQL, the earlier instant in an overlap."""
    plain = f"timezone('UTC', timezone({zone}, {ts}))"
    before = f"timezone('UTC', timezone({zone}, {ts} - INTERVAL 1 HOUR)) + INTERVAL 1 HOUR"
    return f"least({plain}, {before})"


FLIGHTS_UTC_SQL = (
    FLIGHTS_SQL
    + f""", flights_utc AS (
  SELECT *, {utc_sql('dep_dt_local', 'Origin_TZ')} AS dep_utc, {utc_sql('arr_dt_local', 'Dest_TZ')} AS arr_utc
  FROM flights
)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with planted "at least t" scores; the later ones may exceed the earlier."""
    f = flights(spark, sf_dir)
    return f.select(
        "flight_id", "FlightDate", "DepDelayMinutes",
        F.expr("cast(coalesce(DepDelayMinutes >= 15, false) as int)").alias("y"),
        F.expr("(quantity + noise % 50) / 100.0D").alias("p15"),
        F.expr("noise / 125.0D").alias("p30"),
        F.expr("(quantity + noise % 20) / 200.0D").alias("p45"),
        F.expr("(noise % 25) / 100.0D").alias("p60"),
    )


SCORED_SQL = (
    FLIGHTS_SQL
    + """, scored AS (
  SELECT flight_id, FlightDate, DepDelayMinutes, CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y,
    (quantity + noise % 50) / 100.0::DOUBLE AS p15, noise / 125.0::DOUBLE AS p30,
    (quantity + noise % 20) / 200.0::DOUBLE AS p45, (noise % 25) / 100.0::DOUBLE AS p60
  FROM flights
)"""
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with second precision: users as tails, users modulo 7 as airports."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("tm"), "user_id",
        "event_type", "value", "props", F.col("ts").cast("date").alias("day"),
        F.expr("cast(user_id % 7 as int)").alias("station"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, date_trunc('second', ts) AS tm, user_id, event_type, value, props, CAST(ts AS DATE) AS day,
    CAST(user_id % 7 AS INTEGER) AS station
  FROM events
)"""
