"""Queries: scans, flattening and sinks, on files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import fixtures as X
from tarmac.constants import DAILY_WEATHER, HOURLY_WEATHER
from tarmac.queries.registry import on_events, on_flights, on_flights_utc, query, round_columns, rounded
from tarmac.session import shared_folder
from tarmac.sources import payloads, sinks, snapshots, tables

CODES = X._sql_list(X.AIRPORTS)


@query("scan_projected", "SELECT l_suppkey, l_quantity FROM lineitem")
def scan_projected(spark, sf):
    return tables.scan_projected(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "not_there", "l_quantity"])


_PRUNED = "Reporting_Airline, Flight_Number_Reporting_Airline, Origin, Dest, CRSDepTime, CRSArrTime, DepDelayMinutes, Tail_Number"


@query(
    "scan_glob_prune",
    on_flights(
        f"""SELECT FlightDate, {_PRUNED} FROM flights WHERE FlightDate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
        AND Reporting_Airline IN ('WN', 'DL') AND Origin <> 'HNL' AND Dest <> 'HNL'"""
    ),
)
def scan_glob_prune(spark, sf):
    root = shared_folder(spark, "raw")
    raw = X.flights(spark, sf).select(
        "FlightDate", F.lower("Reporting_Airline").alias("Operating_Airline "),
        F.col("Flight_Number_Reporting_Airline").alias("Flight_Number_Marketing_Airline"),
        F.concat(F.lit(" "), F.lower("Origin")).alias("Origin"), "Dest", "CRSDepTime", "CRSArrTime", "DepDelayMinutes",
        "Tail_Number", "noise",
    )
    sinks.write_features(raw, root)
    codes = X.flights(spark, sf).select(F.col("Origin").alias("code")).filter("code <> 'HNL'").distinct()
    patterns = [f"{root}/Year=199[6-9]/Month=*", f"{root}/Year=2000/Month=*", f"{root}/Year=2000/Month=*"]
    out = tables.scan_glob_prune(spark, patterns, "1996-01-01", "1999-12-31", None, ["wn", "dl"], codes)
    return out.select("FlightDate", *_PRUNED.split(", "))


@query(
    "ingest_month_csv",
    on_flights(
        """SELECT CAST(year(FlightDate) AS INTEGER) AS Year, CAST(month(FlightDate) AS INTEGER) AS Month, count(*) AS n, sum(DepDelayMinutes) AS delay,
        count(DISTINCT Tail_Number) AS tails, min(FlightDate) AS first_day FROM flights GROUP BY ALL"""
    ),
)
def ingest_month_csv(spark, sf):
    root = shared_folder(spark, "csv")
    raw = X.flights(spark, sf).select(
        F.year("FlightDate").alias("Year"), F.month("FlightDate").alias("Month"), "FlightDate",
        F.col("Reporting_Airline").alias("Operating_Airline "), "Tail_Number", "Origin", "Dest", "CRSDepTime",
        "DepDelayMinutes", F.col("noise").alias("Unwanted"),
    )
    raw.write.option("header", "true").csv(f"{root}/landed")
    types = dict(raw.dtypes) | {"FlightDate": "string"}
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(types[c])) for c in raw.columns])
    tables.ingest_month_csv(spark, f"{root}/landed", f"{root}/raw", schema)
    out = spark.read.parquet(f"{root}/raw")
    assert "Operating_Airline" in out.columns and "Unwanted" not in out.columns
    return out.groupBy("Year", "Month").agg(
        F.count("*").alias("n"), F.sum("DepDelayMinutes").alias("delay"), F.countDistinct("Tail_Number").alias("tails"),
        F.min("FlightDate").alias("first_day"),
    )


@query("scan_airport_set", f"SELECT DISTINCT {CODES}[s_suppkey % 8 + 1] AS code, 3 AS layouts FROM supplier")
def scan_airport_set(spark, sf):
    """The three layouts give one set; each written from all suppliers' codes."""
    root = shared_folder(spark, "sets")
    codes = X.table(spark, sf, "supplier").select(X._pick(X.AIRPORTS, F.expr("s_suppkey % 8")).alias("code"), "s_suppkey").distinct()
    unique = codes.select("code").distinct()
    line = unique.agg(F.array_join(F.transform(F.collect_set("code"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ","))
    line.coalesce(1).write.text(f"{root}/line")
    codes.select(F.concat(F.lit(" "), F.lower("code"))).write.text(f"{root}/lines")
    codes.select(F.col("s_suppkey").alias("rank"), F.col("code").alias("IATA")).write.option("header", "true").csv(f"{root}/table")
    parts = [
        tables.scan_airport_set(spark, f"{root}/line"),
        tables.scan_airport_set(spark, f"{root}/lines"),
        tables.scan_airport_set(spark, f"{root}/table", "iata"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("code").agg(F.count("*").cast("int").alias("layouts"))


@query(
    "scan_airport_dim",
    f"""SELECT 'C' || c_custkey AS IATA, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS Latitude,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'America/Chicago' END AS Timezone, 'C' || c_custkey || ' — ' || c_mktsegment AS display
    FROM customer WHERE c_custkey % 11 <> 0""",
)
def scan_airport_dim(spark, sf):
    root = shared_folder(spark, "airports")
    c = X.table(spark, sf, "customer")
    c.select(
        F.expr("case when c_custkey % 11 = 0 then ' ' else concat(' c', c_custkey) end").alias("IATA"), F.lit("K").alias("ICAO"),
        F.col("c_name").alias("AirportName"), F.col("c_mktsegment").alias("City"), F.lit("S").alias("State"),
        F.lit("US").alias("Country"), F.expr("case when c_custkey % 7 = 0 then 'north' else cast(c_acctbal as string) end").alias("Latitude"),
        F.lit("1.5").alias("Longitude"),
        F.expr("case c_custkey % 3 when 0 then 'NaN' else ' America/Chicago ' end").alias("Timezone"),
    ).write.option("header", "true").csv(root)
    out = tables.airport_display(tables.scan_airport_dim(spark, root))
    return out.select("IATA", "Latitude", "Timezone", "display")


@query(
    "scan_ranking_lists",
    f"""WITH s AS (SELECT DISTINCT CASE s_nationkey % 4 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' ELSE 'UA' END AS airline,
      CAST((s_suppkey % 5 + 1) * 10 AS INTEGER) AS n, {CODES}[s_suppkey * 7 % 10 + 1] AS code FROM supplier)
    SELECT airline, n, CAST(row_number() OVER (PARTITION BY airline, n ORDER BY code) AS INTEGER) AS position, code FROM s""",
)
def scan_ranking_lists(spark, sf):
    from tarmac.queries.relations import rankings
    from tarmac.sources.files import write_named_texts

    root = shared_folder(spark, "rankings")
    lists = rankings(spark, sf).groupBy("airline", "n").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    quoted = lambda c: F.concat(F.lit('"'), F.lower(c), F.lit('"'))
    doubled = F.concat(F.transform("codes", quoted), F.slice(F.transform("codes", quoted), 1, 1))
    texts = lists.select(F.format_string("%s_top_%d.csv", "airline", "n").alias("name"), F.array_join(doubled, ",").alias("text"))
    write_named_texts(texts, "name", "text", root)
    return tables.scan_ranking_lists(spark, root).withColumn("position", F.col("position").cast("int"))


@query(
    "scan_ragged_csv",
    """SELECT CAST(s_suppkey AS VARCHAR) AS "N-NUMBER", CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS "MFR MDL CODE" FROM supplier""",
)
def scan_ragged_csv(spark, sf):
    root = shared_folder(spark, "ragged")
    s = X.table(spark, sf, "supplier")
    header = F.lit("﻿N-NUMBER , SERIAL,MFR MDL CODE,,")
    # one header per file: the rows of a file are one text, a file per small key range
    rows = s.select(
        (F.col("s_suppkey") / 50).cast("int").alias("chunk"), "s_suppkey",
        F.expr(
            "case s_suppkey % 4 when 0 then concat(s_suppkey, ' ,x') when 1 then concat(s_suppkey, ',\"a,b\", ', s_name, ' ,,,,extra')"
            " else concat(' ', s_suppkey, ',y,', s_name, ',') end"
        ).alias("line"),
    )
    files = rows.groupBy("chunk").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        F.concat_ws("\n", F.array(header), F.col("lines")).alias("value")
    )
    files.repartition("value").write.option("maxRecordsPerFile", 1).text(root)
    return tables.scan_ragged_csv(spark, root, ["N-NUMBER", "MFR MDL CODE"])


@query("scan_registry_year", "SELECT 'N' || s_suppkey AS Tail_Number, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(1975 + s_suppkey % 25 AS DOUBLE) END AS Year_Mfr FROM supplier")
def scan_registry_year(spark, sf):
    root = shared_folder(spark, "registry")
    X.table(spark, sf, "supplier").select(
        F.expr("concat('N', s_suppkey)").alias("Tail_Number"),
        F.expr("case when s_suppkey % 5 = 0 then 'n/a' else cast(1975 + s_suppkey % 25 as string) end").alias("Year_Mfr"),
    ).write.option("header", "true").csv(root)
    return tables.scan_registry_year(spark, root)


# Weather payloads: per airport and month at most 31 days, per airport and day at most 24 hours


@query(
    "explode_weather_daily",
    on_flights(
        """SELECT Origin AS airport, FlightDate AS date, max(quantity) AS temperature_2m_max, min(quantity) AS temperature_2m_min,
        CAST(count(*) AS DOUBLE) AS precipitation_sum, CAST(NULL AS DOUBLE) AS weathercode FROM flights GROUP BY ALL"""
    ),
)
def explode_weather_daily(spark, sf):
    daily = X.flights(spark, sf).groupBy("Origin", "FlightDate").agg(
        F.max("quantity").alias("hi"), F.min("quantity").alias("lo"), F.count("*").alias("n")
    )
    packed = daily.groupBy("Origin", F.trunc("FlightDate", "month").alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("FlightDate", "hi", "lo", "n"))).alias("d")
    )
    take = lambda f: F.transform("d", lambda x: f(x).cast("string"))
    series = {
        "time": take(lambda x: x["FlightDate"]), "temperature_2m_max": take(lambda x: x["hi"]),
        "temperature_2m_min": take(lambda x: x["lo"]), "precipitation_sum": take(lambda x: x["n"]),
        "windspeed_10m_max": take(lambda x: x["hi"]), "windgusts_10m_max": take(lambda x: x["hi"]),
        "weathercode": take(lambda x: F.lit("?")),
    }
    text = packed.select(F.col("Origin").alias("airport"), F.to_json(F.struct(F.struct(*[c.alias(n) for n, c in series.items()]).alias("daily"))).alias("j"))
    schema = "daily struct<" + ", ".join(f"{n}: array<string>" for n in ("time", *DAILY_WEATHER)) + ">"
    out = payloads.explode_weather_daily(text.select("airport", F.from_json("j", schema).alias("p")).select("airport", "p.daily"))
    return out.select("airport", "date", "temperature_2m_max", "temperature_2m_min", "precipitation_sum", "weathercode")


@query(
    "explode_weather_hourly",
    on_events(
        f"""SELECT airport, hour_utc, arg_min(temp, tm) AS temperature_2m FROM (SELECT station AS airport, min(tm) AS tm, arg_min(value, (tm, event_id)) AS temp,
          date_trunc('hour', {X.utc_sql("date_trunc('hour', tm)", "z")}) AS hour_utc
          FROM (SELECT *, {X._sql_list(X.ZONES)}[station + 1] AS z FROM ev) GROUP BY station, date_trunc('hour', tm), z) GROUP BY ALL"""
    ),
)
def explode_weather_hourly(spark, sf):
    e = X.events(spark, sf).withColumn("hour", F.date_trunc("hour", F.col("tm")).cast("timestamp_ntz"))
    hourly = e.groupBy("station", "hour").agg(F.min_by("value", F.struct("tm", "event_id")).alias("v"))
    packed = hourly.groupBy("station", F.col("hour").cast("date").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("hour", "v"))).alias("h")
    )
    values = F.transform("h", lambda x: x["v"].cast("string"))
    block = F.struct(
        F.transform("h", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[values.alias(n) for n in HOURLY_WEATHER],
    )
    rows = packed.select(F.col("station").alias("airport"), X._pick(X.ZONES, "station").alias("tz"), block.alias("hourly"))
    return payloads.explode_weather_hourly(rows, "tz").select("airport", "hour_utc", "temperature_2m")


@query(
    "scan_weather_cache",
    on_flights(
        f"""SELECT DISTINCT Origin AS airport, FlightDate AS date FROM flights WHERE (Origin, FlightDate) NOT IN
        (SELECT ({CODES}[o_custkey % 10 + 1], CAST(o_orderdate AS DATE)) FROM orders)"""
    ),
)
def scan_weather_cache(spark, sf):
    root = shared_folder(spark, "weather")
    cached = X.table(spark, sf, "orders").groupBy(
        X._pick(X.AIRPORTS, F.expr("o_custkey % 10")).alias("airport"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(F.max("o_totalprice").alias("temp"))
    cached.write.partitionBy("airport").parquet(root)
    needed = X.flights(spark, sf).select(F.col("Origin").alias("airport"), F.col("FlightDate").alias("date"))
    return tables.missing_weather(needed, spark.read.parquet(root))


# Snapshots: payloads of at most 50 neighbouring events


def _snapshot_files(spark, sf, root, compress=False):
    e = X.events(spark, sf)
    record = F.struct(
        F.expr("concat('F', user_id)").alias("flight_iata"), F.col("event_id").cast("string").alias("flight_number"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(" "), F.substring("event_type", 1, 2))).alias("airline_iata"),
        F.when(F.expr("event_id % 3 = 0"), F.col("value").cast("string")).alias("dep_delayed"),
        F.when(F.expr("event_id % 3 <= 1"), F.get_json_object("props", "$.k")).alias("delayed"),
    )
    payload = e.groupBy(
        X._pick(X.AIRPORTS, "station").alias("airport"), F.col("day").alias("local_date"),
        F.when(F.hour("tm") < 12, "0800").otherwise("1600").alias("slot"), F.expr("event_id div 50").alias("chunk"),
    ).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("data"))
    wrapped = payload.select(
        "airport", "local_date", "slot", F.lit("2024-01-01T00:00:00Z").alias("fetched_at_utc"),
        F.when(F.expr("chunk % 2 = 0"), F.col("data")).otherwise(F.concat(F.lit('{"results":'), F.col("data"), F.lit("}"))).alias("data"),
    )
    out = wrapped.select("airport", F.lit("all").alias("snapshots"), "local_date", "slot", "fetched_at_utc", "data")
    write = out.repartition("airport", "local_date").write.partitionBy("airport", "snapshots", "local_date", "slot")
    (write.option("compression", "gzip") if compress else write).json(root)


_SNAP_SQL = f""", sn AS (SELECT {CODES}[station + 1] AS origin, day AS local_date, CASE WHEN hour(tm) < 12 THEN '0800' ELSE '1600' END AS slot,
  CASE WHEN event_type = 'error' THEN '' ELSE upper(substr(event_type, 1, 2)) END AS carrier, 'F' || user_id AS flight, event_id, tm,
  CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS dep_delay_min FROM ev)"""


@query("scan_snapshots", on_events("SELECT origin, local_date, slot, CAST(event_id AS VARCHAR) AS flight_number, carrier AS airline_iata FROM sn", _SNAP_SQL))
def scan_snapshots(spark, sf):
    root = shared_folder(spark, "snapshots")
    _snapshot_files(spark, sf, root, compress=True)
    out = snapshots.scan_snapshots(spark, root)
    return out.select("origin", "local_date", "slot", "flight_number", F.upper(F.trim("airline_iata")).alias("airline_iata"))


@query("snapshot_records", on_events("SELECT origin, local_date, slot, carrier, flight, dep_delay_min FROM sn WHERE carrier <> ''", _SNAP_SQL))
def snapshot_records(spark, sf):
    root = shared_folder(spark, "snapshots")
    _snapshot_files(spark, sf, root)
    out = snapshots.snapshot_records(snapshots.scan_snapshots(spark, root))
    return out.select("origin", "local_date", "slot", "carrier", "flight", "dep_delay_min")


# Nested API rows, one payload per airport and hour


@query(
    "flatten_schedule",
    on_flights_utc(
        """SELECT Origin AS origin, Reporting_Airline AS carrier, CAST(Flight_Number_Reporting_Airline AS VARCHAR) AS flight_number, Dest AS dest, dep_utc AS sched_utc,
        strftime(dep_dt_local, '%H:%M') AS time24 FROM flights_utc"""
    ),
)
def flatten_schedule(spark, sf):
    f = X.flights_utc(spark, sf)
    row = F.struct(
        F.date_format("dep_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sortTime"),
        F.struct(F.date_format("dep_dt_local", "HH:mm").alias("time24")).alias("departureTime"),
        F.struct(F.lower("Reporting_Airline").alias("fs"), F.col("Flight_Number_Reporting_Airline").cast("string").alias("flightNumber")).alias("carrier"),
        F.struct(F.concat(F.col("Dest"), F.lit(" ")).alias("fs")).alias("airport"),
    )
    texts = f.groupBy(F.col("Origin").alias("origin"), "FlightDate", F.hour("dep_utc").alias("h"), F.col("CRSDepTime").alias("c")).agg(
        F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("j")
    )
    nested = texts.select("origin", F.from_json("j", payloads.SCHEDULE).alias("p")).select("origin", "p.data")
    return payloads.flatten_schedule(nested).select("origin", "carrier", "flight_number", "dest", "sched_utc", "time24")


@query(
    "flatten_status",
    on_flights_utc(
        """SELECT Reporting_Airline AS carrier, CAST(Flight_Number_Reporting_Airline AS VARCHAR) AS flight_number, Origin AS origin, Dest AS dest, CAST(dep_utc AS DATE) AS date,
        CASE WHEN noise % 3 = 2 THEN NULL ELSE round(DepDelayMinutes + CASE WHEN noise % 3 = 1 THEN 5 ELSE 0 END, 6) END AS delay FROM flights_utc"""
    ),
)
def flatten_status(spark, sf):
    f = X.flights_utc(spark, sf)
    late = F.col("dep_utc") + F.expr("make_dt_interval(0, 0, cast(DepDelayMinutes as int))")
    stamp = lambda c: F.struct(F.lit(None).cast("string").alias("local"), F.date_format(c, "yyyy-MM-dd HH:mm'Z'").alias("utc"))
    row = F.struct(
        F.struct(
            F.struct(F.col("Origin").alias("iata")).alias("airport"), stamp(F.col("dep_utc")).alias("scheduledTime"),
            stamp(F.when(F.expr("noise % 3 = 0"), late)).alias("runwayTime"),
            stamp(F.when(F.expr("noise % 3 <= 1"), late + F.expr("INTERVAL 5 MINUTES"))).alias("revisedTime"),
        ).alias("departure"),
        F.struct(F.struct(F.lower("Dest").alias("iata")).alias("airport")).alias("arrival"),
    )
    texts = f.groupBy(
        F.col("Reporting_Airline").alias("carrier"), F.col("Flight_Number_Reporting_Airline").cast("string").alias("flight_number"),
        "FlightDate", "CRSDepTime",
    ).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("j"))
    nested = texts.select("carrier", "flight_number", F.from_json("j", payloads.STATUS).alias("p")).select("carrier", "flight_number", "p.data")
    return round_columns(payloads.flatten_status(nested).select("carrier", "flight_number", "origin", "dest", "date", "delay"), ["delay"])


@query(
    "scan_rollups",
    "SELECT CAST(o_orderdate AS DATE) AS as_of_date, 'airport_total' AS group_type, 'C' || o_custkey AS group_value, round(max(o_totalprice), 2) AS dep_delay_7d_mean FROM orders GROUP BY ALL",
)
def scan_rollups(spark, sf):
    root = shared_folder(spark, "rollups")
    X.table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("as_of_date"), F.lit(" airport_total ").alias("group_type"),
        F.expr("concat('c', o_custkey)").alias("group_value"),
    ).agg(F.round(F.max("o_totalprice"), 2).alias("dep_delay_7d_mean")).write.option("header", "true").csv(root)
    return tables.scan_rollups(spark, root)


@query(
    "sinks",
    on_flights(
        """SELECT kind, count(*) AS n, sum(DepDelayMinutes) AS delay FROM flights, (VALUES ('parquet'), ('csv'), ('json'), ('gzip'), ('thr')) v(kind) GROUP BY kind"""
    ),
)
def sinks_round_trip(spark, sf):
    """Every writer, read back."""
    root = shared_folder(spark, "sinks")
    f = X.flights(spark, sf).select("flight_id", "FlightDate", "DepDelayMinutes")
    half = F.col("DepDelayMinutes") >= 15
    sinks.write_features(f, sinks.expand_template(root + "/features_{target}", "dep"))
    sinks.write_table_csv(f, f"{root}/csv")
    sinks.write_json(f, f"{root}/json")
    sinks.write_json(f, f"{root}/gzip", compress=True)
    sinks.write_balanced({15: f.filter(half), 30: f.filter(~half | half.isNull())}, f"{root}/balanced")
    schema = f.schema
    back = {
        "parquet": spark.read.parquet(f"{root}/features_dep"),
        "csv": spark.read.schema(schema).option("header", "true").csv(f"{root}/csv"),
        "json": spark.read.schema(schema).json(f"{root}/json"),
        "gzip": spark.read.schema(schema).json(f"{root}/gzip"),
        "thr": spark.read.parquet(f"{root}/balanced"),
    }
    out = None
    for kind, df in back.items():
        row = df.agg(F.count("*").alias("n"), F.sum("DepDelayMinutes").alias("delay")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "schedule_calendar",
    f"""SELECT c_custkey, slot, day, {X.utc_sql("loc", "z")} AS run_utc FROM (
      SELECT c_custkey, slot, CAST(day AS DATE) AS day, {X._sql_list(X.ZONES)}[c_custkey % 10 + 1] AS z,
        CAST(day AS TIMESTAMP) + to_minutes(mins) + to_seconds(CAST(('0x' || substr(sha256(c_name || '|' || slot), 1, 8))::BIGINT % (least(20, 1439 - mins) * 60 + 1) AS INTEGER)) AS loc
      FROM customer, (VALUES ('08:00', 480), ('16:00', 960), ('23:50', 1430)) s(slot, mins), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events))""",
)
def schedule_calendar(spark, sf):
    from tarmac.operators.calendars import schedule_calendar as calendar

    airports = X.table(spark, sf, "customer").select("c_custkey", "c_name", X._pick(X.ZONES, F.expr("c_custkey % 10")).alias("tz"))
    e = X.table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"))
    span = e.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    out = calendar(airports, "c_name", "tz", span.select("lo").scalar(), span.select("hi").scalar())
    return out.select("c_custkey", "slot", "day", "run_utc")
