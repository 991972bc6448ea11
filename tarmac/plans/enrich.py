"""From pruned flights to enriched flights and the history pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions import times as T
from tarmac.functions.numbers import age_bucket, age_years, coerce_numeric
from tarmac.operators import filters, joins
from tarmac.plans.config import PipelineConfig
from tarmac.schema import FLIGHT


def add_local_times(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Zones of both ends, local departure and arrival with roll-over past midnight, and UTC."""
    zones = airports.select(F.col("IATA"), F.col("Timezone"))
    for end in ("Origin", "Dest"):
        df = df.join(zones.select(F.col("IATA").alias(end), F.col("Timezone").alias(f"{end}_TZ")), end, "left")
    df = df.withColumns(
        {
            "dep_dt_local": T.hhmm_to_local_ts("FlightDate", "CRSDepTime"),
            "arr_dt_local": T.overnight_arrival(
                T.hhmm_to_local_ts("FlightDate", "CRSArrTime"), "CRSDepTime", "CRSArrTime"
            ),
        }
    )
    return df.withColumns(
        {
            "dep_local_date": F.col("dep_dt_local").cast("date"), "arr_local_date": F.col("arr_dt_local").cast("date"),
            "dep_utc": T.local_to_utc("dep_dt_local", "Origin_TZ"), "arr_utc": T.local_to_utc("arr_dt_local", "Dest_TZ"),
        }
    )


def needed_airports(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array("Origin", "Dest")).alias("IATA")).distinct()


def prepare(df: DataFrame) -> DataFrame:
    return df.withColumns({c: coerce_numeric(c) for c in C.NUMERIC_COLUMNS if c in df.columns})


def enrich(
    flights: DataFrame, airports: DataFrame, cfg: PipelineConfig, master: DataFrame | None = None,
    models: DataFrame | None = None, registry: DataFrame | None = None, weather_daily: DataFrame | None = None,
    weather_hourly: DataFrame | None = None, dest_weather: bool = False,
) -> DataFrame:
    """Local times, aircraft type and age, daily and hourly weather at both ends."""
    df = filters.filter_airline(flights, FLIGHT.carrier, cfg.single_airline, list(cfg.airlines))
    if cfg.start_date and cfg.end_date:
        df = filters.filter_date_range(df, FLIGHT.date, cfg.start_date, cfg.end_date)
    df = add_local_times(prepare(df), airports)
    if master is not None and models is not None:
        df = joins.join_two_hop_lookup(df, master, models, FLIGHT.tail)
    elif "aircraft_type" not in df.columns:
        df = df.withColumn("aircraft_type", F.lit("Unknown"))
    if registry is not None:
        df = joins.join_aircraft_year(df, registry, FLIGHT.tail)
        df = df.withColumn("Aircraft_Age_Years", age_years(FLIGHT.date, "Year_Mfr"))
    else:
        df = df.withColumn("Aircraft_Age_Years", F.lit(None).cast("double"))
    df = df.withColumn("Aircraft_Age_Bucket", age_bucket("Aircraft_Age_Years"))
    sides = [(FLIGHT.origin, "origin_", FLIGHT.dep_utc, "origin_dep_")]
    if dest_weather:
        sides.append((FLIGHT.dest, "dest_", FLIGHT.arr_utc, "dest_arr_"))
    for airport, daily_prefix, instant, hourly_prefix in sides:
        if weather_daily is not None:
            df = joins.join_weather_daily(df, weather_daily, airport, FLIGHT.date, daily_prefix)
        if weather_hourly is not None:
            df = joins.join_weather_hourly(df, weather_hourly, airport, instant, hourly_prefix)
    return df


def history_pool(flights: DataFrame, airports: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Unbalanced flights of the period and the lookback before it, with the same time rules."""
    df = filters.filter_airline(flights, FLIGHT.carrier, cfg.single_airline, list(cfg.airlines))
    if cfg.start_date and cfg.end_date:
        df = filters.filter_lookback(df, FLIGHT.date, cfg.start_date, cfg.end_date, cfg.history_lookback_days)
    df = filters.drop_required_nulls(df, [FLIGHT.date, FLIGHT.origin, FLIGHT.dest, FLIGHT.carrier])
    df = add_local_times(prepare(df), airports)
    if "DepDel15" not in df.columns:
        df = df.withColumn("DepDel15", F.coalesce((F.col("DepDelayMinutes") >= 15).cast("int"), F.lit(0)))
    return df.select(*[c for c in C.HISTORY_COLUMNS if c in df.columns])
