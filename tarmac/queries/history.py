"""Queries: baselines, rolling windows, prior events, rotation features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import fixtures as X
from tarmac.constants import DEPARTURE_WINDOWS
from tarmac.functions import numbers as N
from tarmac.functions import times as T
from tarmac.operators import joins, legs, rolling
from tarmac.queries.registry import on_events, on_flights, on_flights_utc, query, round_columns, rounded
from tarmac.schema import FLIGHT

KEY = FLIGHT.flight_key
W4 = DEPARTURE_WINDOWS


def _means(prefix: str) -> list[str]:
    return [f"{prefix}{w}" for w in W4]


def _daily_sql(keys: str) -> str:
    return (
        f"SELECT {keys}, FlightDate, avg(DepDelayMinutes) AS m FROM flights "
        f"WHERE DepDelayMinutes IS NOT NULL GROUP BY {keys}, FlightDate"
    )


def _rows_sql(keys: str, prefix: str, rounded_out: bool = True) -> str:
    r = (lambda e: f"round({e}, 6)") if rounded_out else (lambda e: e)
    cols = ", ".join(
        f"{r(f'avg(m) OVER (PARTITION BY {keys} ORDER BY FlightDate ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)')} AS {prefix}{w}"
        for w in W4
    )
    return f"SELECT {keys}, FlightDate, {cols} FROM ({_daily_sql(keys)})"


def _register_daily(name, keys):
    cols = ", ".join(keys)

    @query(
        name,
        on_flights(f"SELECT {cols}, FlightDate, round(m, 6) AS mean_delay FROM ({_daily_sql(cols)})"),
    )
    def run(spark, sf):
        return rolling.daily_mean(X.flights(spark, sf), keys, "FlightDate", "DepDelayMinutes", "m").select(
            *keys, "FlightDate", rounded("m").alias("mean_delay")
        )


_register_daily("daily_mean", ["Reporting_Airline"])
_register_daily("daily_mean_carrier_origin", ["Reporting_Airline", "Origin"])
_register_daily("daily_mean_origin", ["Origin"])


def _register_baseline(name, keys, prefix):
    @query(name, on_flights(_rows_sql(", ".join(keys), prefix)))
    def run(spark, sf):
        daily = rolling.daily_mean(X.flights(spark, sf), keys, "FlightDate", "DepDelayMinutes", "m")
        return round_columns(rolling.rolling_rows_baseline(daily, keys, "FlightDate", "m", W4, prefix), _means(prefix))


_register_baseline("rolling_rows_baseline", ["Reporting_Airline"], "carrier_depdelay_mean_last")
_register_baseline("rolling_rows_baseline_carrier_origin", ["Reporting_Airline", "Origin"], "carrier_origin_depdelay_mean_last")
_register_baseline("rolling_rows_baseline_origin", ["Origin"], "origin_depdelay_mean_last")


@query(
    "rolling_calendar_baseline",
    on_flights(
        "SELECT Origin, FlightDate, "
        + ", ".join(
            f"round(avg(m) OVER (PARTITION BY Origin ORDER BY FlightDate RANGE BETWEEN INTERVAL {w} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 6) AS origin_depdelay_mean_last{w}"
            for w in W4
        )
        + f" FROM ({_daily_sql('Origin')})"
    ),
)
def rolling_calendar_baseline(spark, sf):
    daily = rolling.daily_mean(X.flights(spark, sf), ["Origin"], "FlightDate", "DepDelayMinutes", "m")
    out = rolling.rolling_rows_baseline(daily, ["Origin"], "FlightDate", "m", W4, "origin_depdelay_mean_last", calendar=True)
    return round_columns(out, _means("origin_depdelay_mean_last"))


_BASELINE_SQL = (
    f", c AS ({_rows_sql('Reporting_Airline', 'carrier_depdelay_mean_last')})"
    f", co AS ({_rows_sql('Reporting_Airline, Origin', 'carrier_origin_depdelay_mean_last')})"
    f", o AS ({_rows_sql('Origin', 'origin_depdelay_mean_last')})"
)
_BASELINE_COLS = ["carrier_depdelay_mean_last", "carrier_origin_depdelay_mean_last", "origin_depdelay_mean_last"]


@query(
    "join_history_features",
    on_flights(
        "SELECT f.flight_id, "
        + ", ".join(f"{p}{w}" for p in _BASELINE_COLS for w in W4)
        + " FROM flights f LEFT JOIN c USING (Reporting_Airline, FlightDate)"
        " LEFT JOIN co USING (Reporting_Airline, Origin, FlightDate) LEFT JOIN o USING (Origin, FlightDate)",
        _BASELINE_SQL,
    ),
)
def join_history_features(spark, sf):
    f = X.flight_table(spark, sf)
    out = rolling.add_baselines(f, f, W4, FLIGHT)
    names = [n for p in _BASELINE_COLS for n in _means(p)]
    return round_columns(out.select("flight_id", *names), names)


@query(
    "flagship",
    on_flights(
        "SELECT flight_id, Reporting_Airline, FlightDate, DepDelayMinutes, "
        + ", ".join(f"carrier_depdelay_mean_last{w}" for w in W4)
        + ", "
        + ", ".join(f"CAST(coalesce(DepDelayMinutes >= {t}, false) AS INTEGER) AS y_dep_ge{t}" for t in (15, 30, 45, 60))
        + " FROM flights LEFT JOIN c USING (Reporting_Airline, FlightDate)",
        f", c AS ({_rows_sql('Reporting_Airline', 'carrier_depdelay_mean_last')})",
    ),
)
def flagship(spark, sf):
    f = X.flights(spark, sf)
    daily = rolling.daily_mean(f, ["Reporting_Airline"], "FlightDate", "DepDelayMinutes", "m")
    base = rolling.rolling_rows_baseline(daily, ["Reporting_Airline"], "FlightDate", "m", W4, "carrier_depdelay_mean_last")
    joined = rolling.join_history_features(f, base, ["Reporting_Airline", "FlightDate"])
    labels = N.threshold_labels("DepDelayMinutes")
    labels.pop("y_dep15")
    return round_columns(
        joined.select(
            "flight_id", "Reporting_Airline", "FlightDate", "DepDelayMinutes", *_means("carrier_depdelay_mean_last"),
            *[c.alias(n) for n, c in labels.items()],
        ),
        _means("carrier_depdelay_mean_last"),
    )


_KEY_SQL = ", ".join(KEY)
_SAME = " AND ".join(f"h.{k} = p.{k}" for k in KEY)


@query(
    "rolling_prior_events",
    on_flights(
        "SELECT flight_id, "
        + ", ".join(
            f"round(CASE WHEN n{w} > 0 THEN s{w} / n{w} END, 6) AS flightnum_od_depdelay_mean_last{w}" for w in W4
        )
        + ", CAST(coalesce(n28, 0) AS INTEGER) AS flightnum_od_support_count_last28d,"
        " CAST(coalesce(n28, 0) <= 2 AS INTEGER) AS flightnum_od_low_support_last28d"
        f" FROM flights LEFT JOIN r USING ({_KEY_SQL}, FlightDate, dep_dt_local)",
        f""", p AS (SELECT DISTINCT {_KEY_SQL}, FlightDate, dep_dt_local FROM flights),
        r AS (SELECT p.*, """
        + ", ".join(
            f"sum(h.DepDelayMinutes) FILTER (h.FlightDate >= p.FlightDate - {w}) AS s{w}, "
            f"count(h.DepDelayMinutes) FILTER (h.FlightDate >= p.FlightDate - {w}) AS n{w}"
            for w in W4
        )
        + f""" FROM p JOIN flights h ON {_SAME} AND h.FlightDate >= p.FlightDate - 28 AND h.FlightDate <= p.FlightDate
          AND (h.FlightDate < p.FlightDate OR h.dep_dt_local < p.dep_dt_local)
          GROUP BY ALL)""",
    ),
)
def rolling_prior_events(spark, sf):
    f = X.flight_table(spark, sf)
    out = rolling.rolling_prior_events(f, f, KEY, "FlightDate", "dep_dt_local", "DepDelayMinutes", W4, low_support_lt=3)
    names = [f"flightnum_od_depdelay_mean_last{w}" for w in W4]
    return round_columns(
        out.select("flight_id", *names, "flightnum_od_support_count_last28d", "flightnum_od_low_support_last28d"), names
    )


def _stats_sql(keys: str, measures: dict[str, str], rows: str = "flights") -> str:
    """Rolling [D-W, D) stats at the history's own days, one CTE per measure."""
    out = ""
    for prefix, value in measures.items():
        cols = ", ".join(
            f"sum(s) OVER w{w} / sum(n) OVER w{w} AS {prefix}_mean_{w}d, CAST(sum(n) OVER w{w} AS BIGINT) AS {prefix}_n_{w}d"
            for w in (7, 14)
        )
        frames = ", ".join(
            f"w{w} AS (PARTITION BY {keys} ORDER BY FlightDate RANGE BETWEEN INTERVAL {w} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"
            for w in (7, 14)
        )
        out += (
            f", st_{prefix} AS (SELECT {keys}, FlightDate, {cols} FROM (SELECT {keys}, FlightDate, sum({value}) AS s,"
            f" count({value}) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY {keys}, FlightDate) WINDOW {frames})"
        )
    return out


SLIP_SQL = """, slip AS (
  SELECT *, CASE WHEN d < -720 THEN d + 1440 WHEN d > 720 THEN d - 1440 ELSE d END AS wo_slip_min,
    lpad(CAST(CRSDepTime // 100 AS VARCHAR), 2, '0') || '00-' || lpad(CAST(CRSDepTime // 100 AS VARCHAR), 2, '0') || '59' AS blk
  FROM (SELECT *, (WheelsOff // 100 * 60 + WheelsOff % 100) - (CRSDepTime // 100 * 60 + CRSDepTime % 100) AS d FROM flights)
)"""


def _asof_sql(keys: list[str], measures: dict[str, str], suffix: str, rows: str = "flights", more: str = "") -> str:
    cols, joins_sql = [], ""
    for prefix in measures:
        for w in (7, 14):
            cols.append(f"round({prefix}_mean_{w}d, 6) AS {prefix}_mean_{w}d_{suffix}")
            cols.append(f"{prefix}_n_{w}d AS {prefix}_n_{w}d_{suffix}")
        same = " AND ".join(f"f.{k} = {prefix}.{k}" for k in keys)
        joins_sql += f" ASOF LEFT JOIN st_{prefix} {prefix} ON {same} AND f.FlightDate >= {prefix}.FlightDate"
    body = f"SELECT f.flight_id, {', '.join(cols)} FROM {rows} f{joins_sql}"
    return on_flights(body, more + _stats_sql(", ".join(keys), measures, rows))


def with_slip(f):
    slip = T.wrap_minute_diff(T.hhmm_to_minutes("WheelsOff"), T.hhmm_to_minutes("CRSDepTime"))
    return f.withColumns({"wo_slip_min": slip, "blk": T.dep_time_block("CRSDepTime")})


_FN = {"arrdelay": "ArrDelayMinutes", "airtime": "AirTime", "wo_slip": "wo_slip_min"}


def _register_mean_count(name, keys, measures, suffix):
    @query(name, _asof_sql(keys, measures, suffix, "slip", SLIP_SQL))
    def run(spark, sf):
        f = with_slip(X.flight_table(spark, sf))
        out = rolling.rolling_days_mean_count(f, f, keys, "FlightDate", measures, suffix)
        means = [f"{p}_mean_{w}d_{suffix}" for p in measures for w in (7, 14)]
        counts = [f"{p}_n_{w}d_{suffix}" for p in measures for w in (7, 14)]
        return round_columns(out.select("flight_id", *means, *counts), means)


_register_mean_count("rolling_days_mean_count", KEY, _FN, "fn_od")
_register_mean_count(
    "rolling_days_mean_count_carrier", FLIGHT.route_key, {"arrdelay": "ArrDelayMinutes", "airtime": "AirTime"}, "car_od"
)
_register_mean_count("rolling_days_mean_count_block", ["Origin", "blk"], {"wo_slip": "wo_slip_min"}, "origin_blk")


@query(
    "rolling_days_median",
    on_flights(
        """SELECT Reporting_Airline, Origin, Dest, FlightDate, round(any_value(med), 6) AS arrdelay_median_7d
        FROM (SELECT *, median(ArrDelayMinutes) OVER (PARTITION BY Reporting_Airline, Origin, Dest ORDER BY FlightDate
          RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS med
          FROM flights WHERE ArrDelayMinutes IS NOT NULL)
        GROUP BY ALL"""
    ),
)
def rolling_days_median(spark, sf):
    out = rolling.rolling_days_median(
        X.flight_table(spark, sf), FLIGHT.route_key, "FlightDate", "ArrDelayMinutes", 7, "arrdelay_median_7d"
    )
    return round_columns(out, ["arrdelay_median_7d"])


_TAIL_UTC = "length(Tail_Number) > 0"


@query(
    "leg_number",
    on_flights_utc(
        """SELECT flight_id, CAST(row_number() OVER (PARTITION BY Tail_Number, FlightDate ORDER BY dep_utc, flight_id) AS INTEGER)
        AS tail_leg_num_day FROM flights_utc"""
    ),
)
def leg_number(spark, sf):
    f = X.flight_table(spark, sf)
    return legs.leg_number(f, "Tail_Number", "FlightDate", "dep_utc", "flight_id").select("flight_id", "tail_leg_num_day")


@query(
    "leg_number_events",
    on_events(
        """SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY tm, event_id) AS INTEGER) AS leg FROM ev"""
    ),
)
def leg_number_events(spark, sf):
    e = X.events(spark, sf).withColumn("tail", F.col("user_id").cast("string"))
    return legs.leg_number(e, "tail", "day", "tm", "event_id", "leg").select("event_id", "leg")


@query(
    "hours_since_first",
    on_flights_utc(
        """SELECT flight_id, round(epoch(dep_utc - min(dep_utc) OVER (PARTITION BY Reporting_Airline,
        Flight_Number_Reporting_Airline, FlightDate)) / 3600.0, 6) AS flightnum_hours_since_first_departure_today FROM flights_utc"""
    ),
)
def hours_since_first(spark, sf):
    keys = ["Reporting_Airline", "Flight_Number_Reporting_Airline", "FlightDate"]
    out = legs.hours_since_first(X.flight_table(spark, sf), keys, "dep_utc")
    name = "flightnum_hours_since_first_departure_today"
    return round_columns(out.select("flight_id", name), [name])


@query(
    "recent_turn_flag",
    on_events(
        """SELECT event_id, CAST(coalesce(pd = station AND epoch(tm - pa) / 3600.0 BETWEEN 0 AND 5, false) AS INTEGER) AS recent_turn
        FROM (SELECT *, lag(tm + INTERVAL 1 HOUR) OVER w AS pa, lag(dest) OVER w AS pd
          FROM (SELECT *, CAST(event_id % 2 * 6 + user_id % 7 * (1 - event_id % 2) AS INTEGER) AS dest FROM ev)
          WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id))"""
    ),
)
def recent_turn_flag(spark, sf):
    e = X.events(spark, sf).withColumns(
        {
            "tail": F.col("user_id").cast("string"),
            "arr": F.col("tm") + F.expr("INTERVAL 1 HOUR"),
            "dest": F.expr("cast(event_id % 2 * 6 + user_id % 7 * (1 - event_id % 2) as int)"),
        }
    )
    out = legs.recent_turn_flag(e, "tail", "station", "dest", "tm", "arr", "event_id", 5.0, "recent_turn")
    return out.select("event_id", "recent_turn")


@query(
    "recent_turn_flag_flights",
    on_flights_utc(
        """SELECT flight_id, CAST(coalesce(pd = Origin AND epoch(dep_utc - pa) / 3600.0 BETWEEN 0 AND 5, false) AS INTEGER)
        AS has_recent_arrival_turn_5h
        FROM (SELECT *, lag(arr_utc) OVER w AS pa, lag(Dest) OVER w AS pd FROM flights_utc
          WINDOW w AS (PARTITION BY Tail_Number ORDER BY dep_utc, flight_id))"""
    ),
)
def recent_turn_flag_flights(spark, sf):
    out = legs.recent_turn_flag(
        X.flight_table(spark, sf), "Tail_Number", "Origin", "Dest", "dep_utc", "arr_utc", "flight_id"
    )
    return out.select("flight_id", "has_recent_arrival_turn_5h")


@query(
    "turn_time_hours",
    on_flights_utc(
        """SELECT flight_id, round(CASE WHEN pd = Origin THEN epoch(dep_utc - pa) / 3600.0 END, 6) AS turn_time_hours
        FROM (SELECT *, lag(arr_utc) OVER w AS pa, lag(Dest) OVER w AS pd FROM flights_utc
          WINDOW w AS (PARTITION BY Reporting_Airline, Flight_Number_Reporting_Airline ORDER BY dep_utc, flight_id))"""
    ),
)
def turn_time_hours(spark, sf):
    keys = ["Reporting_Airline", "Flight_Number_Reporting_Airline"]
    out = legs.turn_time_hours(X.flight_table(spark, sf), keys, "Origin", "Dest", "dep_utc", "arr_utc", "flight_id")
    return round_columns(out.select("flight_id", "turn_time_hours"), ["turn_time_hours"])


@query(
    "history_window_means",
    on_flights(
        "SELECT o.o_orderkey, "
        + ", ".join(
            f"round(sum(DepDelayMinutes) FILTER (FlightDate > day - {w}) / count(DepDelayMinutes) FILTER (FlightDate > day - {w}), 6) AS flightnum_od_depdelay_mean_last{w}"
            for w in W4
        )
        + """, count(DepDelayMinutes) AS flightnum_od_support_count_last28d,
        CAST(count(DepDelayMinutes) < 5 AS INTEGER) AS flightnum_od_low_support_last28d
        FROM req o LEFT JOIN flights f ON f.Reporting_Airline = o.carrier AND f.Flight_Number_Reporting_Airline = o.number
          AND f.Origin = o.org AND f.FlightDate <= day AND f.FlightDate > day - 28 GROUP BY o.o_orderkey""",
        f""", req AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
          CASE o_custkey % 4 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' ELSE 'UA' END AS carrier,
          CAST(o_custkey % 3 AS INTEGER) AS number, {X._sql_list(X.AIRPORTS)}[o_custkey % 10 + 1] AS org FROM orders)""",
    ),
)
def history_window_means(spark, sf):
    requests = requests_from_orders(spark, sf)
    keys = ["Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin"]
    out = rolling.history_window_means(requests, X.flight_table(spark, sf), keys, "FlightDate", "DepDelayMinutes")
    names = [f"flightnum_od_depdelay_mean_last{w}" for w in W4]
    return round_columns(
        out.select("o_orderkey", *names, "flightnum_od_support_count_last28d", "flightnum_od_low_support_last28d"), names
    )


def requests_from_orders(spark, sf):
    """One request per order: a carrier, flight number, origin and date."""
    o = X.table(spark, sf, "orders")
    return o.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("FlightDate"),
        F.expr("case o_custkey % 4 when 0 then 'WN' when 1 then 'AA' when 2 then 'DL' else 'UA' end").alias("Reporting_Airline"),
        F.expr("cast(o_custkey % 3 as int)").alias("Flight_Number_Reporting_Airline"),
        X._pick(X.AIRPORTS, F.expr("o_custkey % 10")).alias("Origin"),
    )


@query(
    "history_window_means_exclusive",
    on_flights(
        """SELECT o.o_orderkey, round(avg(DepDelayMinutes), 6) AS flightnum_od_depdelay_mean_last28,
        count(DepDelayMinutes) AS flightnum_od_support_count_last28d, CAST(count(DepDelayMinutes) < 5 AS INTEGER) AS flightnum_od_low_support_last28d
        FROM req o LEFT JOIN flights f ON f.Reporting_Airline = o.carrier AND f.Origin = o.org
          AND f.FlightDate < day AND f.FlightDate >= day - 28 GROUP BY o.o_orderkey""",
        f""", req AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
          CASE o_custkey % 4 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' ELSE 'UA' END AS carrier,
          {X._sql_list(X.AIRPORTS)}[o_custkey % 10 + 1] AS org FROM orders)""",
    ),
)
def history_window_means_exclusive(spark, sf):
    out = rolling.history_window_means(
        requests_from_orders(spark, sf), X.flight_table(spark, sf), ["Reporting_Airline", "Origin"], "FlightDate",
        "DepDelayMinutes", (28,), include_today=False,
    )
    names = ["flightnum_od_depdelay_mean_last28"]
    return round_columns(
        out.select("o_orderkey", *names, "flightnum_od_support_count_last28d", "flightnum_od_low_support_last28d"), names
    )
