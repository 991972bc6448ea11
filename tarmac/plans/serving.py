"""Batch prediction for a table of requests."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions import tiers
from tarmac.functions import times as T
from tarmac.functions.ordinal import risk_band, risk_score, severity_band
from tarmac.functions.text import carrier_name_to_code, key_text, normalize_flight_number
from tarmac.operators import intervals, joins, model_table, models, rolling
from tarmac.schema import FLIGHT
from tarmac.session import materialize


def resolve_requests(requests: DataFrame, airports: DataFrame) -> DataFrame:
    """Codes instead of names, both zones; requests with unknown airline or airport get a problem."""
    zones = airports.select("IATA", "Timezone")
    out = requests.withColumns(
        {
            "Reporting_Airline": carrier_name_to_code("airline"), "Origin": key_text("origin"), "Dest": key_text("dest"),
            "flight_number": F.trim("flightnum"),
        }
    )
    for end in ("Origin", "Dest"):
        out = out.join(zones.select(F.col("IATA").alias(end), F.col("Timezone").alias(f"{end}_TZ")), end, "left")
    problem = (
        F.when(F.col("Reporting_Airline").isNull(), "unknown_airline")
        .when(F.col("Origin_TZ").isNull(), "unknown_origin").when(F.col("Dest_TZ").isNull(), "unknown_dest")
    )
    return out.withColumn("problem", problem)


def match_or_fall_back(requests: DataFrame, schedule: DataFrame) -> DataFrame:
    """Scheduled UTC times from the schedule, else from the times the request came with."""
    keys = ("origin_key", "flight_number", "dest_key", "date")
    asked = requests.withColumns({"origin_key": F.col("Origin"), "dest_key": F.col("Dest"), "hhmm": F.lit(None).cast("string")})
    flights = schedule.select(F.col("origin").alias("origin_key"), "flight_number", F.col("dest").alias("dest_key"), "date", "sched_utc")
    found = joins.match_schedule(asked, flights, keys, carrier=False).drop("hhmm", "origin_key", "dest_key")
    clock = lambda c: F.when(
        F.col(c).rlike("^[0-9]{1,2}:[0-9]{2}$"),
        F.split_part(F.col(c), F.lit(":"), F.lit(1)).cast("int") * 100 + F.split_part(F.col(c), F.lit(":"), F.lit(2)).cast("int"),
    )
    given = T.local_to_utc(T.hhmm_to_local_ts("date", clock("sched_dep_time_24h")), "Origin_TZ")
    arrival = T.overnight_arrival_utc(T.hhmm_to_local_ts("date", clock("sched_arr_time_24h")), "Dest_TZ", given)
    usable = F.col("sched_dep_time_24h").isNotNull() & F.col("sched_arr_time_24h").isNotNull()
    return found.withColumns(
        {
            "dep_utc": F.coalesce("sched_utc", F.when(usable, given)),
            "arr_utc": F.when(~F.col("matched") & usable, arrival),
            "verification_source": F.when(F.col("matched"), "future_flights").when(usable, "user_schedule_fallback"),
            "warnings": F.array_compact(F.array(F.when(~F.col("matched") & usable, "future_flight_not_found"))),
            "problem": F.coalesce("problem", F.when(~F.col("matched") & ~usable, "needs_schedule_times")),
        }
    ).drop("sched_utc")


def request_features(
    requests: DataFrame, schedule: DataFrame, history: DataFrame, weather_daily: DataFrame, weather_hourly: DataFrame,
    low_support_lt: int = 5,
) -> DataFrame:
    """Everything a model reads, for resolved requests; missing groups stay null.

    History: Reporting_Airline, flight_number, Origin, Dest, date, delay. Weather tables have airport
    and date or hour_utc next to model-unit columns.
    """
    base = requests.withColumn("__t", T.epoch_seconds("dep_utc"))
    pool = schedule.select(
        F.col("origin").alias("Origin"), "date", F.col("carrier").alias("Reporting_Airline"), "flight_number",
        T.epoch_seconds("sched_utc").alias("__t"),
    )
    near = ["Origin", "date", "Reporting_Airline", "__t"]
    levels = {"origin_congestion_3h_total": near[:2], "__airline": near[:3]}
    counted = intervals.interval_counts(base, pool, levels, "__t", "__t", 3 * 3600)
    own = pool.groupBy(*near, "flight_number").agg(F.count("*").alias("__own"))
    route = ["Reporting_Airline", "flight_number", "Origin", "Dest", "date"]
    windows = C.DEPARTURE_WINDOWS
    past = rolling.window_means_at(base, history, route[:4], "date", "delay", windows, include_today=True)
    baselines = rolling.baselines_at(base, history, windows, replace(FLIGHT, date="date", number="flight_number", dep_delay="delay"))
    df = (
        base.join(counted, near, "left").join(own, [*near, "flight_number"], "left").join(past, route, "left")
        .join(baselines, ["Reporting_Airline", "Origin", "date"], "left")
    )
    known = F.coalesce("flight_history", F.lit(True))
    df = df.withColumns({c: F.when(known, F.col(c)) for c in past.columns if c not in route})
    zero = F.lit(0).cast("long")
    df = df.withColumns(
        {
            "origin_congestion_3h_total": F.coalesce("origin_congestion_3h_total", zero),
            "origin_airline_congestion_3h_total": F.coalesce("__airline", zero) - F.coalesce("__own", zero),
            **rolling.support_flags(windows, low_support_lt),
        }
    ).drop("__airline", "__own", "__t")
    df = joins.join_weather_daily(df, weather_daily.withColumn("has_daily", F.lit(True)), "Origin", "date", "")
    df = joins.join_weather_hourly(df, weather_hourly.withColumn("has_hourly", F.lit(True)), "Origin", "dep_utc", "")
    wanted = F.coalesce("include_weather", F.lit(True))
    weather = [c for t in (weather_daily, weather_hourly) for c in t.columns if c not in ("airport", "date", "hour_utc")]
    df = df.withColumns(
        {
            **{c: F.when(wanted, F.col(c)) for c in weather},
            **{c: F.coalesce(c, F.lit(False)) & wanted for c in ("has_daily", "has_hourly")},
        }
    )
    return df.withColumns(
        {
            "od_pair": F.concat_ws("_", "Origin", "Dest"), "dep_dow": F.weekday(T.utc_to_local("dep_utc", "Origin_TZ").cast("date")),
            "sched_dep_hour": F.hour(T.utc_to_local("dep_utc", "Origin_TZ")), "is_holiday": T.holiday_flag("date"), "aircraft_type": F.lit("Unknown"),
            "has_recent_arrival_turn_5h": F.lit(0), "tail_leg_num_day": F.lit(0),
            "flightnum_hours_since_first_departure_today": F.lit(0.0), "turn_time_hours": F.lit(0.0),
        }
    )


SWITCHES = ("include_weather", "flight_history", "airport_stats", "airline_stats")
RESULTS = ("bin_proba", "predicted_bin", "expected_delay_minutes", "severity_score", "severity_band", "risk_score", "risk_band")


def check_rankings(df: DataFrame, rankings: DataFrame, airports_n: int) -> DataFrame:
    """Requests with an airport outside the airline's list of that size get a problem.

    ``rankings`` has airline, n and code, as ``scan_ranking_lists`` reads them.
    """
    listed = rankings.filter(F.col("n") == airports_n).select("airline", "code").distinct()
    for end in ("Origin", "Dest"):
        side = listed.select(F.col("airline").alias("Reporting_Airline"), F.col("code").alias(end), F.lit(True).alias(f"__{end}"))
        df = df.join(side, ["Reporting_Airline", end], "left")
    outside = F.col("__Origin").isNull() | F.col("__Dest").isNull()
    return df.withColumn("problem", F.coalesce("problem", F.when(outside, "airport_not_in_ranking"))).drop("__Origin", "__Dest")


def score_by_key(df: DataFrame, registry: Mapping[str, models.DelayModel]) -> DataFrame:
    """Each row scored by the model its ``model_id`` names; rows without one keep null results and say so.

    The registry is joined as a table, so the number of keys adds no scan and no plan.
    """
    table = model_table.model_table(df.sparkSession, registry)
    scored = models.add_distribution(model_table.score_by_model(df, table))
    without = F.col(f"p_ge{table.thresholds[0]}").isNull() & F.col("model_family").isNotNull()
    scored = scored.withColumn("problem", F.coalesce("problem", F.when(without, "no_model")))
    return scored.withColumns({c: F.when(~without, F.col(c)) for c in ("bin_proba", "predicted_bin", "expected_delay_minutes", "severity_score")})


def batch_predict(
    requests: DataFrame, airports: DataFrame, schedule: DataFrame, history: DataFrame, weather_daily: DataFrame,
    weather_hourly: DataFrame, rollups: DataFrame, registry: Mapping[str, models.DelayModel], airports_n: int = 50, years: str = "23-25",
    rankings: DataFrame | None = None,
) -> DataFrame:
    """Requests with distribution, bands, model key, rollup stats of both airports and the airline.

    A request is predicted by the model that its key (airline, list size, years, weather, history) names.
    Requests that cannot be predicted say why in ``problem`` and have null results; none is dropped. The
    switches of ``SWITCHES`` are columns of the requests; a missing or null one is on. The matched requests
    and their features are written, because every group of features and every model reads them.
    """
    requests = requests.withColumns({s: F.lit(True) for s in SWITCHES if s not in requests.columns})
    asked = resolve_requests(requests, airports)
    if rankings is not None:
        asked = check_rankings(asked, rankings, airports_n)
    asked = materialize(match_or_fall_back(asked, schedule), "requests")
    df = request_features(asked, schedule, history, weather_daily, weather_hourly)
    no_history = F.lit(False)
    key = tiers.model_locator("Reporting_Airline", F.lit(airports_n), F.lit(years), "has_hourly", no_history)
    df = df.withColumns(
        {
            "model_family": tiers.choose_tier_by_weather("has_hourly", "has_daily", no_history),
            "model_id": F.when(F.col("Reporting_Airline").isNotNull(), key),
            "flight": normalize_flight_number("Reporting_Airline", "flight_number"),
        }
    )
    df = df.withColumn("problem", F.coalesce("problem", F.when(F.col("model_family").isNull(), "no_model_family")))
    df = score_by_key(materialize(df, "request-features"), registry)
    df = df.withColumns({"severity_band": severity_band("severity_score"), "risk_score": risk_score("bin_proba")})
    df = df.withColumn("risk_band", risk_band("risk_score"))
    df = df.join(joins.asof_dates(asked, rollups, "date", "stats_as_of_date"), "date", "left")
    for column, kind, prefix, switch in (
        ("Origin", "airport_total", "origin_stats_", "airport_stats"), ("Dest", "airport_total", "dest_stats_", "airport_stats"),
        ("Reporting_Airline", "airline_total", "airline_stats_", "airline_stats"),
    ):
        df = joins.rollup_stats(df, rollups, column, kind, prefix, "stats_as_of_date")
        wanted = F.coalesce(switch, F.lit(True))
        df = df.withColumns({c: F.when(wanted, F.col(c)) for c in df.columns if c.startswith(prefix)})
    return df.withColumns({r: F.when(F.col("problem").isNull(), F.col(r)) for r in RESULTS})
