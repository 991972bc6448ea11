"""Flattening nested payloads: weather arrays, schedules, flight status and free JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.numbers import coerce_numeric
from tarmac.functions.times import col, local_to_utc, parse_ts_utc, parse_wall_clock, status_delay_minutes
from tarmac.operators.dedupe import dedupe_first


def json_lookup(column, path: list[str]) -> Column:
    """Text at a key path of a JSON column; null when any step is missing."""
    return F.get_json_object(col(column), "$." + ".".join(path))


def _parallel(block: str, names) -> Column:
    return F.arrays_zip(*[F.col(f"{block}.{n}").alias(n) for n in ("time", *names)])


def explode_weather_daily(payloads: DataFrame, block: str = "daily", names=C.DAILY_WEATHER) -> DataFrame:
    """One row per airport and day from a struct of parallel arrays; empty payloads give no rows."""
    rows = payloads.select("airport", F.explode(_parallel(block, names)).alias("w"))
    return rows.select(
        "airport", F.col("w.time").cast("string").try_cast("date").alias("date"),
        *[coerce_numeric(F.col(f"w.{n}")).alias(n) for n in names],
    )


def explode_weather_hourly(payloads: DataFrame, zone: str, block: str = "hourly", names=C.HOURLY_WEATHER) -> DataFrame:
    """One row per airport and UTC hour from local hours.

    Hours that occur twice are dropped, hours skipped by the clock change move forward, the first
    row of an hour wins.
    """
    rows = payloads.select("airport", zone, F.posexplode(_parallel(block, names)).alias("pos", "w"))
    text = F.col("w.time").cast("string")
    local = F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    early = local_to_utc("local", zone)
    one_hour = F.expr("INTERVAL 1 HOUR")
    ambiguous = F.convert_timezone(F.lit("UTC"), F.col(zone), early + one_hour) == F.col("local")
    gap = F.convert_timezone(F.lit("UTC"), F.col(zone), early) != F.col("local")
    hour = F.date_trunc("hour", early).cast("timestamp_ntz")
    moved = F.when(gap, F.date_trunc("hour", early - F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")).otherwise(hour)
    out = (
        rows.withColumn("local", local).filter("local is not null").filter(~ambiguous)
        .select("airport", hour.alias("hour_utc"), "pos", *[coerce_numeric(F.col(f"w.{n}")).alias(n) for n in names])
    )
    return dedupe_first(out, ["airport", "hour_utc"], ["pos"]).drop("pos")


def extract_records(payload: Column, schema: str) -> Column:
    """Records of a JSON text that is a list, or an object with ``data`` or ``results``."""
    as_list = F.from_json(payload, f"array<{schema}>")
    as_object = F.from_json(payload, f"data array<{schema}>, results array<{schema}>")
    is_list = F.startswith(F.ltrim(payload), F.lit("["))
    return F.when(is_list, as_list).otherwise(F.coalesce(as_object["data"], as_object["results"]))


SCHEDULE = (
    "data array<struct<sortTime string, departureTime struct<time24 string>,"
    " carrier struct<fs string, flightNumber string>, airport struct<fs string>>>"
)


def flatten_schedule(payloads: DataFrame) -> DataFrame:
    """Scheduled departures: carrier, flight number, destination, UTC time. Bad times stay null."""
    rows = payloads.select("origin", F.explode("data").alias("r"))
    return rows.select(
        "origin",
        F.upper(F.trim("r.carrier.fs")).alias("carrier"),
        F.trim("r.carrier.flightNumber").alias("flight_number"),
        F.upper(F.trim("r.airport.fs")).alias("dest"),
        F.col("r.departureTime.time24").alias("time24"),
        parse_ts_utc("r.sortTime").alias("sched_utc"),
    )


STATUS = (
    "data array<struct<departure struct<airport struct<iata string>, scheduledTime struct<local string, utc string>,"
    " runwayTime struct<local string, utc string>, revisedTime struct<local string, utc string>>,"
    " arrival struct<airport struct<iata string>>>>"
)


def flatten_status(payloads: DataFrame, prefer_local: bool = False) -> DataFrame:
    """Flown departures with their delay in minutes, from UTC texts or from local ones first."""
    rows = payloads.select("carrier", "flight_number", F.explode("data").alias("r"))

    def text(name: str) -> Column:
        both = F.col(f"r.departure.{name}.local"), F.col(f"r.departure.{name}.utc")
        return F.coalesce(*both) if prefer_local else both[1]

    sched, runway, revised = (parse_ts_utc(text(n)) for n in ("scheduledTime", "runwayTime", "revisedTime"))
    day = parse_wall_clock(F.col("r.departure.scheduledTime.local")) if prefer_local else sched
    return rows.select(
        "carrier", "flight_number",
        F.upper(F.trim("r.departure.airport.iata")).alias("origin"),
        F.upper(F.trim("r.arrival.airport.iata")).alias("dest"),
        day.cast("date").alias("date"), sched.alias("sched_utc"), F.coalesce(runway, revised).alias("actual_utc"),
        status_delay_minutes(sched, runway, revised).alias("delay"),
    )
