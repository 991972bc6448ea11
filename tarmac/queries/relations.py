"""Queries: filters, joins, as-of and nearest lookups, interval counts, aliases, similar flights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac import fixtures as X
from tarmac.functions import times as T
from tarmac.operators import dedupe, filters, intervals, joins, lookup, ordered, similar
from tarmac.queries.history import SLIP_SQL, requests_from_orders, with_slip
from tarmac.queries.registry import on_events, on_flights, on_flights_utc, query, round_columns, rounded
from tarmac.session import materialize

CODES = X._sql_list(X.AIRPORTS)


# Filters


@query(
    "canonicalize_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey % 7 AS VARCHAR) AS Reporting_Airline,
    l_partkey % 3 AS Flight_Number_Reporting_Airline, CAST(l_suppkey AS VARCHAR) AS Tail_Number FROM lineitem""",
)
def canonicalize_columns(spark, sf):
    raw = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("l_suppkey % 7").alias("Operating_Airline "),
        F.expr("l_suppkey % 5").alias("Marketing_Airline_Network"),
        F.expr("l_partkey % 3").alias(" Flight_Number_Operating_Airline"), F.col("l_suppkey").alias("Tail_Number"),
    )
    out = filters.canonicalize_columns(raw)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Tail_Number"
    )


@query(
    "normalize_keys",
    """SELECT o_orderkey, upper(trim(' ' || lower(o_orderpriority) || ' ')) AS o_orderpriority, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
)
def normalize_keys(spark, sf):
    raw = X.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("o_orderpriority"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("o_custkey"), "o_orderdate",
    )
    return filters.normalize_keys(raw, ["o_orderpriority"], ["o_custkey"], ["o_orderdate"])


@query("filter_date_range", on_flights("SELECT flight_id, FlightDate FROM flights WHERE FlightDate BETWEEN DATE '1996-02-01' AND DATE '1998-06-30'"))
def filter_date_range(spark, sf):
    return filters.filter_date_range(X.flights(spark, sf), "FlightDate", "1996-02-01", "1998-06-30").select("flight_id", "FlightDate")


@query("filter_lookback", on_flights("SELECT flight_id, FlightDate FROM flights WHERE FlightDate BETWEEN DATE '1996-02-01' - 60 AND DATE '1998-06-30'"))
def filter_lookback(spark, sf):
    return filters.filter_lookback(X.flights(spark, sf), "FlightDate", "1996-02-01", "1998-06-30", 60).select("flight_id", "FlightDate")


@query(
    "filter_airline",
    on_flights(
        """SELECT 'single' AS kind, flight_id FROM flights WHERE Reporting_Airline = 'WN'
        UNION ALL SELECT 'list', flight_id FROM flights WHERE Reporting_Airline IN ('AA', 'DL')"""
    ),
)
def filter_airline(spark, sf):
    f = X.flights(spark, sf)
    one = filters.filter_airline(f, "Reporting_Airline", "WN", ["AA"]).select(F.lit("single").alias("kind"), "flight_id")
    some = filters.filter_airline(f, "Reporting_Airline", None, ["aa", "DL"]).select(F.lit("list").alias("kind"), "flight_id")
    return one.unionByName(some)


@query(
    "filter_both_in_set",
    on_flights(
        f"""SELECT flight_id, Origin, Dest FROM flights WHERE Origin IN (SELECT code FROM s) AND Dest IN (SELECT code FROM s)""",
        f", s AS (SELECT DISTINCT {CODES}[s_suppkey % 6 + 1] AS code FROM supplier)",
    ),
)
def filter_both_in_set(spark, sf):
    codes = X.table(spark, sf, "supplier").select(X._pick(X.AIRPORTS, F.expr("s_suppkey % 6")).alias("code")).distinct()
    return joins.filter_both_in_set(X.flights(spark, sf), codes, "Origin", "Dest").select("flight_id", "Origin", "Dest")


@query("drop_required_nulls", on_flights("SELECT flight_id, DepDelayMinutes FROM flights WHERE DepDelayMinutes IS NOT NULL"))
def drop_required_nulls(spark, sf):
    return filters.drop_required_nulls(X.flights(spark, sf), ["FlightDate", "Origin", "DepDelayMinutes"]).select("flight_id", "DepDelayMinutes")


@query(
    "filter_nonstop_od",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_suppkey % 10 = l_orderkey % 10 AND l_linenumber % 3 <> 2 AND l_partkey % 5 <> 0 AND l_quantity <> 7""",
)
def filter_nonstop_od(spark, sf):
    raw = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit(" a"), F.expr("l_suppkey % 10")).alias("origin"), F.lit("b").alias("dest"),
        F.concat(F.lit("A"), F.expr("l_orderkey % 10")).alias("want_origin"), F.lit("B").alias("want_dest"),
        F.expr("case l_linenumber % 3 when 0 then '0' when 1 then null else '1' end").alias("stops"),
        F.expr("case when l_quantity <> 7 then l_shipdate end").alias("dep"), F.col("l_shipdate").alias("arr"),
        F.expr("case when l_partkey % 5 = 0 then ' ' else cast(l_partkey as string) end").alias("number"),
    )
    out = filters.filter_nonstop_od(raw, "origin", "dest", "want_origin", "want_dest", "stops", "dep", "arr", "number")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "validate_dim_for_keys",
    """SELECT c_nationkey, reason FROM (SELECT k.c_nationkey, CASE WHEN n.n_nationkey IS NULL THEN 'MISSING_ROW' WHEN n.n_nationkey % 5 = 0 THEN 'BAD_LATLON'
      WHEN n.n_nationkey % 7 = 0 THEN 'MISSING_TZ' WHEN n.n_regionkey = 3 THEN 'UNRECOGNIZED_TZ' END AS reason
      FROM (SELECT DISTINCT c_nationkey FROM customer) k LEFT JOIN (SELECT * REPLACE (CASE WHEN n_nationkey < 22 THEN n_nationkey ELSE n_nationkey + 1000 END AS n_nationkey) FROM nation) n ON n.n_nationkey = k.c_nationkey)
    WHERE reason IS NOT NULL""",
)
def validate_dim_for_keys(spark, sf):
    dim = X.table(spark, sf, "nation").withColumn("n_nationkey", F.expr("if(n_nationkey < 22, n_nationkey, n_nationkey + 1000)")).select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.expr("case when n_nationkey % 5 = 0 then null else 1.0D end").alias("lat"), F.lit(2.0).alias("lon"),
        F.expr("case when n_nationkey % 7 = 0 then null else concat('zone', n_regionkey) end").alias("tz"),
    )
    zones = X.table(spark, sf, "region").select(F.expr("concat(if(r_regionkey = 3, 'other', 'zone'), r_regionkey)").alias("zone"))
    return joins.validate_dim_for_keys(X.table(spark, sf, "customer"), dim, "c_nationkey", "lat", "lon", "tz", zones)


# Schedules


def schedule_from_flights(spark, sf):
    return X.flight_table(spark, sf).select(
        F.col("Flight_Number_Reporting_Airline").cast("string").alias("flight_number"), F.col("Dest").alias("dest"),
        F.col("FlightDate").alias("date"), F.col("dep_utc").alias("sched_utc"), F.col("Reporting_Airline").alias("carrier"),
    )


@query(
    "match_schedule",
    on_flights_utc(
        """SELECT o_orderkey, min(dep_utc) AS sched_utc, CAST(count(dep_utc) > 0 AS INTEGER) AS matched FROM rq
        LEFT JOIN flights_utc f ON CAST(f.Flight_Number_Reporting_Airline AS VARCHAR) = rq.num AND f.Dest = rq.dst AND f.FlightDate = rq.day
          AND (hm IS NULL OR strftime(dep_utc, '%H:%M') = hm) GROUP BY o_orderkey""",
        f""", rq AS (SELECT o_orderkey, CAST(o_custkey % 3 AS VARCHAR) AS num, {CODES}[o_custkey % 10 + 1] AS dst, CAST(o_orderdate AS DATE) AS day,
          CASE WHEN o_custkey % 2 = 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') END AS hm FROM orders)""",
    ),
)
def match_schedule(spark, sf):
    requests = X.table(spark, sf, "orders").select(
        "o_orderkey", F.expr("cast(o_custkey % 3 as string)").alias("flight_number"),
        X._pick(X.AIRPORTS, F.expr("o_custkey % 10")).alias("dest"), F.col("o_orderdate").cast("date").alias("date"),
        F.expr("case when o_custkey % 2 = 0 then concat(lpad(o_orderkey % 24, 2, '0'), ':', lpad(o_custkey % 60, 2, '0')) end").alias("hhmm"),
    )
    out = joins.match_schedule(requests, schedule_from_flights(spark, sf), carrier=False)
    return out.select("o_orderkey", "sched_utc", F.col("matched").cast("int").alias("matched"))


# Weather-shaped joins


@query(
    "join_weather_daily",
    on_flights(
        """SELECT f.flight_id, o.m AS origin_temp, d.m AS dest_temp FROM flights f
        LEFT JOIN w o ON o.airport = f.Origin AND o.day = f.FlightDate LEFT JOIN w d ON d.airport = f.Dest AND d.day = f.FlightDate""",
        f", w AS (SELECT {CODES}[o_custkey % 10 + 1] AS airport, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS m FROM orders GROUP BY ALL)",
    ),
)
def join_weather_daily(spark, sf):
    weather = (
        X.table(spark, sf, "orders")
        .groupBy(X._pick(X.AIRPORTS, F.expr("o_custkey % 10")).alias("airport"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.max("o_totalprice").alias("temp"))
    )
    out = joins.join_weather_daily(X.flights(spark, sf), weather, "Origin", "FlightDate", "origin_")
    out = joins.join_weather_daily(out, weather, "Dest", "FlightDate", "dest_")
    return out.select("flight_id", "origin_temp", "dest_temp")


def hourly_from_events(spark, sf):
    """Hourly readings per station; clicks are readings of other stations, so about one hour in two has none."""
    e = X.events(spark, sf).withColumn("station", F.expr("if(event_type = 'click', station + 100, station)"))
    hour = F.date_trunc("hour", F.col("tm")).cast("timestamp_ntz")
    return e.groupBy(F.col("station").alias("airport"), hour.alias("hour_utc")).agg(F.max("value").alias("temp"))


_HOURLY_SQL = ", hw AS (SELECT CASE WHEN event_type = 'click' THEN station + 100 ELSE station END AS airport, date_trunc('hour', tm) AS hour_utc, max(value) AS temp FROM ev GROUP BY ALL)"


@query(
    "join_weather_hourly",
    on_events(
        "SELECT event_id, temp AS origin_dep_temp FROM ev LEFT JOIN hw ON airport = station AND hour_utc = date_trunc('hour', tm)", _HOURLY_SQL
    ),
)
def join_weather_hourly(spark, sf):
    out = joins.join_weather_hourly(X.events(spark, sf), hourly_from_events(spark, sf), "station", "tm", "origin_dep_")
    return out.select("event_id", "origin_dep_temp")


@query(
    "nearest_hour",
    on_events(
        """SELECT event_id, arg_min(temp, (abs(epoch(hour_utc - date_trunc('hour', tm))), hour_utc)) AS temp,
        arg_min(hour_utc, (abs(epoch(hour_utc - date_trunc('hour', tm))), hour_utc)) AS hour_utc
        FROM ev LEFT JOIN hw ON airport = station AND CAST(hour_utc AS DATE) = day GROUP BY event_id""",
        _HOURLY_SQL,
    ),
)
def nearest_hour(spark, sf):
    left = X.events(spark, sf).withColumn("target", F.date_trunc("hour", F.col("tm")).cast("timestamp_ntz"))
    right = hourly_from_events(spark, sf).select(
        F.col("airport").alias("station"), F.col("hour_utc").cast("date").alias("day"), "hour_utc", "temp"
    )
    out = joins.nearest(left, right.withColumn("at_hour", F.col("hour_utc")), ["station", "day"], "target", "hour_utc", ["at_hour", "temp"])
    return out.select("event_id", "temp", F.col("at_hour").alias("hour_utc"))


# Lookups


@query(
    "join_two_hop_lookup",
    on_flights(
        """SELECT flight_id, coalesce(nullif(trim(coalesce(r_name, '') || ' ' || coalesce(n_name, '')), ''), 'Unknown') AS aircraft_type
        FROM flights LEFT JOIN supplier ON CASE WHEN s_suppkey % 9 = 0 THEN 'X' ELSE 'N' END || s_suppkey = Tail_Number AND s_suppkey > 0
        LEFT JOIN nation ON CASE WHEN n_nationkey % 4 = 0 THEN 'X' ELSE '' END || n_nationkey = CAST(s_nationkey AS VARCHAR) LEFT JOIN region ON r_regionkey = n_regionkey"""
    ),
)
def join_two_hop_lookup(spark, sf):
    master = X.table(spark, sf, "supplier").select(
        F.expr("concat(if(s_suppkey % 9 = 0, 'X', ''), s_suppkey, '  ')").alias("n_number"), F.col("s_nationkey").cast("string").alias("model_code")
    )
    nation = X.table(spark, sf, "nation").join(
        X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    models = nation.select(
        F.expr("concat(if(n_nationkey % 4 = 0, 'X', ''), n_nationkey)").alias("code"), F.col("r_name").alias("mfr"), F.col("n_name").alias("model")
    )
    return joins.join_two_hop_lookup(X.flights(spark, sf), master, models, "Tail_Number").select("flight_id", "aircraft_type")


@query(
    "match_rate",
    on_flights(
        """SELECT round(100.0 * count(*) FILTER (t IS NULL) / count(*), 6) AS unknown_pct, round(100.0 - 100.0 * count(*) FILTER (t IS NULL) / count(*), 6) AS match_pct
        FROM (SELECT flight_id, n_name AS t FROM flights LEFT JOIN supplier ON CASE WHEN s_suppkey % 9 = 0 THEN 'X' ELSE 'N' END || s_suppkey = Tail_Number AND s_suppkey > 0
        LEFT JOIN nation ON CASE WHEN n_nationkey % 4 = 0 THEN 'X' ELSE '' END || n_nationkey = CAST(s_nationkey AS VARCHAR))"""
    ),
)
def match_rate(spark, sf):
    return round_columns(joins.match_rate(join_two_hop_lookup(spark, sf), "aircraft_type"), ["unknown_pct", "match_pct"])


@query(
    "join_aircraft_year",
    on_flights(
        """SELECT flight_id, CASE WHEN s_suppkey IS NULL THEN 'Unknown' WHEN year(FlightDate) - y <= 5 THEN '0-5' WHEN year(FlightDate) - y <= 10 THEN '6-10'
        WHEN year(FlightDate) - y <= 15 THEN '11-15' ELSE '16+' END AS Aircraft_Age_Bucket
        FROM flights LEFT JOIN (SELECT *, 1975 + s_suppkey % 25 AS y FROM supplier) ON CASE WHEN s_suppkey % 8 = 0 THEN 'X' ELSE 'N' END || s_suppkey = Tail_Number"""
    ),
)
def join_aircraft_year(spark, sf):
    from tarmac.functions.numbers import age_bucket, age_years

    registry = X.table(spark, sf, "supplier").select(
        F.expr("concat(if(s_suppkey % 8 = 0, 'X', 'N'), s_suppkey)").alias("Tail_Number"), F.expr("cast(1975 + s_suppkey % 25 as double)").alias("Year_Mfr")
    )
    out = joins.join_aircraft_year(X.flights(spark, sf), registry, "Tail_Number")
    return out.select("flight_id", age_bucket(age_years("FlightDate", "Year_Mfr")).alias("Aircraft_Age_Bucket"))


@query(
    "semi_prefilter",
    "SELECT o_orderkey FROM orders WHERE (o_custkey, CAST(o_orderdate AS DATE)) IN (SELECT (l_suppkey, CAST(l_shipdate AS DATE)) FROM lineitem)",
)
def semi_prefilter(spark, sf):
    hist = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    keys = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("d"))
    return joins.semi_prefilter(hist, keys, ["k", "d"]).select("o_orderkey")


@query(
    "asof_backward",
    on_flights(
        "SELECT f.flight_id, s.total AS last_total, s.day AS last_day FROM flights f ASOF LEFT JOIN s ON s.code = f.Origin AND f.FlightDate >= s.day",
        f", s AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN '~' ELSE '' END || {CODES}[o_custkey % 10 + 1] AS code, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS total FROM orders GROUP BY ALL)",
    ),
)
def asof_backward(spark, sf):
    stats = X.table(spark, sf, "orders").groupBy(
        F.concat(F.expr("if(o_custkey % 3 = 0, '~', '')"), X._pick(X.AIRPORTS, F.expr("o_custkey % 10"))).alias("Origin"), F.col("o_orderdate").cast("date").alias("day")
    ).agg(F.max("o_totalprice").alias("total")).withColumn("stat", F.struct("total", "day"))
    out = joins.asof_backward(X.flights(spark, sf), stats, ["Origin"], "FlightDate", "day", ["stat"])
    return out.select("flight_id", F.col("stat.total").alias("last_total"), F.col("stat.day").alias("last_day"))


@query(
    "asof_backward_bucketed",
    on_events(
        """SELECT l.event_id, s.v AS last_value FROM ev l
        ASOF LEFT JOIN (SELECT CASE WHEN event_type = 'purchase' THEN station ELSE station + 100 END AS station, tm, max(value) AS v FROM ev GROUP BY ALL) s ON s.station = l.station AND l.tm >= s.tm"""
    ),
)
def asof_backward_bucketed(spark, sf):
    e = X.events(spark, sf)
    place = F.expr("if(event_type = 'purchase', station, station + 100)").alias("station")
    stats = e.select(place, F.col("tm").alias("seen"), F.col("value").alias("v"))
    out = joins.asof_backward(e, stats, ["station"], "tm", "seen", ["v"], ordered.hour_bucket)
    return out.select("event_id", F.col("v").alias("last_value"))


@query(
    "merge_feature_sets",
    on_flights(
        """SELECT f.flight_id, g.n, g.worst FROM flights f LEFT JOIN (SELECT Reporting_Airline, CASE WHEN noise % 4 = 0 THEN '~' ELSE '' END || Origin AS Origin, Dest, FlightDate, count(*) AS n, max(DepDelayMinutes) AS worst
        FROM flights GROUP BY ALL) g USING (Reporting_Airline, Origin, Dest, FlightDate)"""
    ),
)
def merge_feature_sets(spark, sf):
    f = X.flights(spark, sf)
    keys = ["FlightDate", "Reporting_Airline", "Origin", "Dest"]
    right = f.withColumn("Origin", F.expr("concat(if(noise % 4 = 0, '~', ''), Origin)")).groupBy(*keys).agg(F.count("*").alias("n"), F.max("DepDelayMinutes").alias("worst"))
    return joins.merge_feature_sets(f, right, [*keys, "NotThere"]).select("flight_id", "n", "worst")


# Interval counts


def _near_sql(by: list[str], alias: str) -> str:
    same = " AND ".join(f"h.{k} = p.{k}" for k in by)
    keys = ", ".join(by)
    return (
        f", {alias} AS (SELECT {', '.join(f'p.{k}' for k in by)}, p.dep_utc, count(*) AS n FROM (SELECT DISTINCT {keys}, dep_utc FROM flights_utc) p"
        f" JOIN flights_utc h ON {same} AND h.dep_utc BETWEEN p.dep_utc - INTERVAL 3 HOUR AND p.dep_utc + INTERVAL 3 HOUR GROUP BY ALL)"
    )


@query(
    "interval_count",
    on_flights_utc(
        """SELECT flight_id, CAST(a.n - 1 AS INTEGER) AS origin_congestion_3h_total, CAST(b.n - 1 AS INTEGER) AS origin_airline_congestion_3h_total
        FROM flights_utc f JOIN a USING (Origin, FlightDate, dep_utc) JOIN b USING (Reporting_Airline, Origin, FlightDate, dep_utc)""",
        _near_sql(["Origin", "FlightDate"], "a") + _near_sql(["Reporting_Airline", "Origin", "FlightDate"], "b"),
    ),
)
def interval_count(spark, sf):
    f = X.flight_table(spark, sf).withColumn("t", T.epoch_seconds("dep_utc"))
    groups = {
        "origin_congestion_3h_total": ["Origin", "FlightDate"],
        "origin_airline_congestion_3h_total": ["Origin", "FlightDate", "Reporting_Airline"],
    }
    out = intervals.add_interval_counts(f, f, groups, "t", "t", 3 * 3600)
    return out.select("flight_id", *groups)


def _arrivals_sql(time: str, by: str) -> str:
    same = " AND ".join(f"h.{k} = p.{k}" for k in by.split(", "))
    return (
        f"(SELECT {', '.join('p.' + k for k in by.split(', '))}, p.{time}, count(h.arr) AS n FROM (SELECT DISTINCT {by}, {time} FROM ar) p"
        f" LEFT JOIN ar h ON {same} AND h.arr BETWEEN p.{time} - 3600000000 AND p.{time} + 3600000000 GROUP BY ALL)"
    )


@query(
    "interval_count_shifted",
    on_flights(
        "SELECT flight_id, "
        + ", ".join(
            f"CAST(greatest({a}.n - 1, 0) AS INTEGER) AS {o}"
            for a, o in (
                ("s1", "dest_arrivals_pm60_sched"), ("s2", "dest_airline_arrivals_pm60_sched"),
                ("e1", "dest_arrivals_pm60_eta"), ("e2", "dest_airline_arrivals_pm60_eta"),
            )
        )
        + f""" FROM ar JOIN {_arrivals_sql('arr', 'Dest, day')} s1 USING (Dest, day, arr)
        JOIN {_arrivals_sql('arr', 'Reporting_Airline, Dest, day')} s2 USING (Reporting_Airline, Dest, day, arr)
        JOIN {_arrivals_sql('eta', 'Dest, day')} e1 USING (Dest, day, eta)
        JOIN {_arrivals_sql('eta', 'Reporting_Airline, Dest, day')} e2 USING (Reporting_Airline, Dest, day, eta)""",
        """, ar AS (SELECT *, CAST(arr + round_even(coalesce(ArrDelayMinutes / 7, 0) * 60000000.0, 0) AS BIGINT) AS eta FROM
          (SELECT flight_id, Reporting_Airline, Dest, CAST(arr_dt_local AS DATE) AS day, epoch_us(arr_dt_local) AS arr, ArrDelayMinutes FROM flights))""",
    ),
)
def interval_count_shifted(spark, sf):
    f = X.flight_table(spark, sf).withColumns({"day": F.col("arr_dt_local").cast("date"), "arr": T.epoch_micros("arr_dt_local")})
    out = intervals.interval_count_shifted(f, "Reporting_Airline", "Dest", "day", "arr", F.col("ArrDelayMinutes") / 7)
    names = [f"{a}_{b}" for b in ("sched", "eta") for a in ("dest_arrivals_pm60", "dest_airline_arrivals_pm60")]
    return out.select("flight_id", *names)


@query(
    "schedule_congestion",
    on_flights_utc(
        """SELECT rq.id, count(f.flight_id) AS origin_congestion_3h_total,
        count(*) FILTER (f.Reporting_Airline = rq.carrier AND NOT (f.num = rq.num AND f.t = rq.t)) AS origin_airline_congestion_3h_total
        FROM rq LEFT JOIN (SELECT *, epoch(dep_utc) AS t, Flight_Number_Reporting_Airline AS num FROM flights_utc) f
          ON f.Origin = rq.org AND f.FlightDate = rq.day AND f.t BETWEEN rq.t - 10800 AND rq.t + 10800 GROUP BY rq.id""",
        """, rq AS (SELECT flight_id AS id, Origin AS org, FlightDate AS day, Reporting_Airline AS carrier, Flight_Number_Reporting_Airline AS num,
          epoch(dep_utc) + (noise % 3) * 600 AS t FROM flights_utc)""",
    ),
)
def schedule_congestion(spark, sf):
    f = X.flight_table(spark, sf).withColumn("t", T.epoch_seconds("dep_utc"))
    requests = f.withColumn("t", F.col("t") + F.expr("noise % 3 * 600"))
    out = intervals.schedule_congestion(
        requests, f, "Origin", "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "t"
    )
    return out.select(F.col("flight_id").alias("id"), "origin_congestion_3h_total", "origin_airline_congestion_3h_total")


# Names and codes

@query(
    "resolve_alias",
    rf"""WITH na AS (SELECT *, 'Q' || n_nationkey % 10 || chr(CAST(65 + n_nationkey // 10 AS INTEGER)) AS code FROM nation),
    ok AS (SELECT CASE WHEN n_regionkey = 2 THEN '~' ELSE '' END || code AS code FROM na),
    asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' (' || code || ')'
      WHEN 2 THEN ' ' || lower(code) ELSE 'no ' || c_custkey END AS txt FROM customer JOIN na ON n_nationkey = c_nationkey),
    keyed AS (SELECT *, regexp_extract(upper(txt), '\b([A-Z0-9]{{3}})\b', 1) AS x, upper(trim(txt)) AS p,
      trim(regexp_replace(regexp_replace(lower(txt), '[()\-/,]', ' ', 'g'), '\s+', ' ', 'g')) AS al FROM asked)
    SELECT c_custkey, CASE WHEN x IN (FROM ok) THEN x WHEN a.code IN (FROM ok) THEN a.code WHEN p IN (FROM ok) THEN p ELSE '' END AS code
    FROM keyed LEFT JOIN na a ON lower(a.n_name) = al""",
)
def resolve_alias(spark, sf):
    code = "concat('Q', n_nationkey % 10, chr(65 + n_nationkey div 10))"
    nation = X.table(spark, sf, "nation").withColumn("code", F.expr(code))
    text = F.expr(
        f"case c_custkey % 4 when 0 then n_name when 1 then concat(lower(n_name), ' (', {code}, ')')"
        f" when 2 then concat(' ', lower({code})) else concat('no ', c_custkey) end"
    )
    asked = X.table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", text.alias("txt"))
    aliases = lookup.alias_table(nation, "code", ["code", "n_name", F.expr("concat(n_name, ' (', code, ')')")])
    allowed = nation.select(F.expr("concat(if(n_regionkey = 2, '~', ''), code)").alias("code"))
    return lookup.resolve_alias(asked, "txt", aliases, allowed, 3).select("c_custkey", "code")


def rankings(spark, sf):
    """Airline list sizes 10, 20, … with the airports of suppliers up to that rank."""
    s = X.table(spark, sf, "supplier").select(
        F.expr("case s_nationkey % 4 when 0 then 'WN' when 1 then 'AA' when 2 then 'DL' else 'UA' end").alias("airline"),
        X._pick(X.AIRPORTS, F.expr("(s_suppkey * 7) % 10")).alias("code"), F.expr("cast((s_suppkey % 5 + 1) * 10 as int)").alias("n"),
    )
    return s.distinct()


_RANK_SQL = f""", rk AS (SELECT DISTINCT CASE s_nationkey % 4 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' ELSE 'UA' END AS airline,
  {CODES}[s_suppkey * 7 % 10 + 1] AS code, CAST((s_suppkey % 5 + 1) * 10 AS INTEGER) AS n FROM supplier)"""


def _register_pairs(name):
    @query(
        name,
        on_flights(
            """SELECT flight_id, (SELECT min(a.n) FROM rk a JOIN rk b ON a.airline = b.airline AND a.n = b.n
            WHERE a.airline = f.Reporting_Airline AND a.code = f.Origin AND b.code = f.Dest) AS airports_n FROM flights f""",
            _RANK_SQL,
        ),
    )
    def run(spark, sf):
        asked = X.flights(spark, sf).withColumnRenamed("Reporting_Airline", "airline")
        out = lookup.allowed_pairs(asked, rankings(spark, sf), "airline", "Origin", "Dest")
        return out.select("flight_id", "airports_n")


_register_pairs("allowed_pairs")
_register_pairs("first_n_cover")


@query(
    "set_union_codes",
    f"""SELECT {CODES}[s_suppkey % 4 + 1] AS code FROM supplier UNION SELECT {CODES}[c_custkey % 3 + 5] FROM customer""",
)
def set_union_codes(spark, sf):
    a = X.table(spark, sf, "supplier").select(X._pick(X.AIRPORTS, F.expr("s_suppkey % 4")).alias("code"))
    b = X.table(spark, sf, "customer").select(X._pick(X.AIRPORTS, F.expr("c_custkey % 3 + 4")).alias("code"))
    return lookup.set_union_codes([a, b], "code")


@query(
    "search_topk",
    """WITH q AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'red' WHEN 1 THEN '' WHEN 2 THEN CAST(s_suppkey AS VARCHAR) WHEN 3 THEN 'l r' WHEN 4 THEN 'z' ELSE 'Ring ' || s_suppkey % 10 END AS t FROM supplier),
    n AS (SELECT p_partkey, p_name || ' ' || p_partkey AS txt FROM part)
    SELECT s_suppkey, rank, p_partkey FROM (SELECT s_suppkey, p_partkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) AS INTEGER) AS rank
      FROM q JOIN n ON contains(lower(txt), lower(t))) WHERE rank <= 8""",
)
def search_topk(spark, sf):
    text = F.expr(
        "case s_suppkey % 6 when 0 then 'red' when 1 then '' when 2 then cast(s_suppkey as string) when 3 then 'l r' when 4 then 'z' else concat('Ring ', s_suppkey % 10) end"
    )
    asked = X.table(spark, sf, "supplier").select("s_suppkey", text.alias("t"))
    names = X.table(spark, sf, "part").select("p_partkey", F.expr("concat(p_name, ' ', p_partkey)").alias("txt"))
    return lookup.search_topk(asked, "s_suppkey", "t", names, "p_partkey", "txt", 8)


# Similar flights


def offers(spark, sf):
    """Priced flights: every line item offered, some twice or more. They need no zones, so the flight table is not written for them."""
    f = X.flights(spark, sf)
    return f.select(
        F.col("flight_id").alias("offer_id"), F.col("Origin").alias("origin"), F.col("Dest").alias("dest"),
        F.col("Reporting_Airline").alias("airline"),
        F.expr("case when noise % 3 = 0 then null else concat('Carrier ', noise % 2) end").alias("marketing_carrier"),
        F.expr("cast(Flight_Number_Reporting_Airline as string)").alias("number"), F.col("dep_dt_local").alias("departure"),
        F.expr("case when noise % 5 = 0 then null when noise % 7 = 0 then 0.0D else cast(noise as double) end").alias("price"),
    )


def similar_requests(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("request_id"), X._pick(X.AIRPORTS, F.expr("o_custkey % 10")).alias("origin"),
        X._pick(X.AIRPORTS, F.expr("(o_custkey + 1 + o_orderkey % 7) % 10")).alias("dest"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(o_custkey % 1440 as int))")).alias("departure"),
    )


_OFFERS_SQL = f""", of AS (SELECT flight_id AS offer_id, Origin AS origin, Dest AS dest, Reporting_Airline AS airline,
  CASE WHEN noise % 3 = 0 THEN NULL ELSE 'Carrier ' || noise % 2 END AS marketing_carrier, CAST(Flight_Number_Reporting_Airline AS VARCHAR) AS number,
  dep_dt_local AS departure, CASE WHEN noise % 5 = 0 THEN NULL WHEN noise % 7 = 0 THEN 0.0 ELSE CAST(noise AS DOUBLE) END AS price FROM flights),
dd AS (SELECT * FROM of QUALIFY row_number() OVER (PARTITION BY origin, dest, coalesce(marketing_carrier, airline, ''), number, departure ORDER BY offer_id) = 1),
rq AS (SELECT o_orderkey AS request_id, {CODES}[o_custkey % 10 + 1] AS origin, {CODES}[(o_custkey + 1 + o_orderkey % 7) % 10 + 1] AS dest,
  CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_custkey % 1440 AS INTEGER)) AS departure FROM orders),
sim AS (SELECT request_id, offer_id, price, CAST((epoch(dd.departure) - epoch(rq.departure)) / 60 AS BIGINT) AS similarity_minutes,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY abs(epoch(dd.departure) - epoch(rq.departure)),
    CASE WHEN price IS NULL OR price = 0 THEN 'Infinity'::DOUBLE ELSE price END, offer_id) AS INTEGER) AS rank
  FROM rq JOIN dd USING (origin, dest) WHERE abs(CAST(dd.departure AS DATE) - CAST(rq.departure AS DATE)) <= 1)"""


@query("topk_similar", on_flights("SELECT request_id, offer_id, rank FROM sim WHERE rank <= 20", _OFFERS_SQL))
def topk_similar(spark, sf):
    unique = similar.dedupe_candidates(offers(spark, sf), ["offer_id"])
    unique = unique.select("offer_id", "origin", "dest", "departure", "price")  # what the order and the result read
    return similar.topk_similar(similar_requests(spark, sf), unique, 20).select("request_id", "offer_id", "rank")


@query("rank_similar", on_flights("SELECT request_id, rank, offer_id, similarity_minutes, price FROM sim WHERE rank <= 3", _OFFERS_SQL))
def rank_similar(spark, sf):
    unique = similar.dedupe_candidates(offers(spark, sf), ["offer_id"])
    unique = unique.select("offer_id", "origin", "dest", "departure", "price")
    out = similar.topk_similar(similar_requests(spark, sf), unique, 3)
    return out.select("request_id", "rank", "offer_id", "similarity_minutes", "price")


@query(
    "dedupe_candidates",
    on_flights("SELECT offer_id, origin, dest, airline, marketing_carrier, number, departure, price FROM dd", _OFFERS_SQL),
)
def dedupe_candidates(spark, sf):
    return similar.dedupe_candidates(offers(spark, sf), ["offer_id"])


def with_position(ordered):
    """The place of each row in a globally sorted table, from its partition and its place there."""
    marked = materialize(ordered.withColumn("m", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("m", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = marked.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return marked.join(F.broadcast(starts), "part").withColumn("position", F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).drop("m", "part", "start")


_SORT_SQL = {
    "date": "departure {d} NULLS {n}, offer_id",
    "price": "price {d} NULLS {n}, offer_id",
    "airline": "lower(coalesce(marketing_carrier, airline, '')) {d}, departure NULLS LAST, offer_id",
}


def _register_sort(mode):
    column, direction = mode.split("_")
    first = {"date": "departure", "price": "price", "airline": "airline"}[column]
    order = _SORT_SQL[column].format(d=direction, n="LAST" if direction == "asc" else "FIRST")

    @query(f"sort_modes_{mode}", on_flights(f"SELECT offer_id, {first}, row_number() OVER (ORDER BY {order}) - 1 AS position FROM of", _OFFERS_SQL))
    def run(spark, sf):
        return with_position(similar.sort_modes(offers(spark, sf), mode).select("offer_id", first))


for _mode in ("date_asc", "date_desc", "price_asc", "price_desc", "airline_asc", "airline_desc"):
    _register_sort(_mode)


@query(
    "sort_stable",
    on_flights(
        "SELECT flight_id, Origin, FlightDate, dep_dt_local, row_number() OVER (ORDER BY Origin NULLS FIRST, FlightDate NULLS FIRST, dep_dt_local NULLS FIRST, flight_id) - 1 AS position FROM flights"
    ),
)
def sort_stable(spark, sf):
    f = X.flights(spark, sf)
    return with_position(f.orderBy("Origin", "FlightDate", "dep_dt_local", "flight_id").select("flight_id", "Origin", "FlightDate", "dep_dt_local"))


# Duplicates and unions


@query(
    "dedupe_latest",
    on_events(
        """SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'k:' || user_id || '|' || event_type END AS plain_key, event_id, value FROM
        (SELECT *, row_number() OVER (PARTITION BY CASE WHEN user_id % 10 = 0 THEN 'h' || event_id ELSE user_id || '|' || event_type END ORDER BY tm DESC, event_id DESC) AS r FROM ev)
        WHERE r = 1"""
    ),
)
def dedupe_latest(spark, sf):
    e = X.events(spark, sf)
    has_key = F.expr("user_id % 10 <> 0")
    key = dedupe.composite_key(
        [F.when(has_key, F.col("user_id")), F.when(has_key, F.concat(F.lit(" "), F.col("event_type")))],
        ["event_id", "tm", "user_id", "event_type", "value", "props"],
    )
    out = dedupe.dedupe_latest(e.withColumn("key", key).select("key", "event_id", "tm", "value"), ["key"], ["tm", "event_id"])
    return out.select(F.when(F.startswith("key", F.lit("k:")), F.col("key")).alias("plain_key"), "event_id", "value")


@query(
    "dedupe_first",
    on_events(
        "SELECT station, date_trunc('hour', tm) AS hour, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY station, date_trunc('hour', tm) ORDER BY tm, event_id) = 1"
    ),
)
def dedupe_first(spark, sf):
    e = X.events(spark, sf).withColumn("hour", F.date_trunc("hour", F.col("tm")).cast("timestamp_ntz"))
    return dedupe.dedupe_first(e.select("station", "hour", "tm", "event_id", "value"), ["station", "hour"], ["tm", "event_id"]).drop("tm")


@query(
    "union_parts",
    "SELECT s_suppkey AS k, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
)
def union_parts(spark, sf):
    a = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    b = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_keys", on_flights("SELECT DISTINCT Origin, Dest, Reporting_Airline FROM flights"))
def distinct_keys(spark, sf):
    return X.flights(spark, sf).select("Origin", "Dest", "Reporting_Airline").distinct()


@query(
    "group_min_max",
    on_flights("SELECT Tail_Number, min(FlightDate) AS first_day, max(FlightDate) AS last_day, min(dep_dt_local) AS first_departure FROM flights GROUP BY Tail_Number"),
)
def group_min_max(spark, sf):
    return X.flights(spark, sf).groupBy("Tail_Number").agg(
        F.min("FlightDate").alias("first_day"), F.max("FlightDate").alias("last_day"), F.min("dep_dt_local").alias("first_departure")
    )
