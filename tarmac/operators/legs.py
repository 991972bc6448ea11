"""Aircraft rotation features: leg number, turns, hours since the first departure."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.text import clean_sentinel
from tarmac.functions.times import epoch_seconds
from tarmac.operators.ordered import hour_bucket, ordered_rank, previous_row
from tarmac.session import materialize


def _usable(tail: str, *needed: str) -> Column:
    known = F.coalesce(F.length(F.col(tail)) > 0, F.lit(False))
    return functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in needed], known)


def _with_rest(made: DataFrame, df: DataFrame, usable: Column, out: str) -> DataFrame:
    """``made`` from the usable rows, and the other rows of ``df`` with null."""
    rest = df.filter(~usable).withColumn(out, F.lit(None).cast(made.schema[out].dataType))
    return made.select(*rest.columns).unionByName(rest)


def leg_number(df: DataFrame, tail: str, date: str, departure: str, row_id: str, out: str = "tail_leg_num_day") -> DataFrame:
    """Facts with their place in the order of departure per tail and local day; equal departures go by row id.

    Rows without tail, day or time stay null. The facts themselves are ranked, so none is joined.
    """
    usable = _usable(tail, date, departure)
    ranked = ordered_rank(df.filter(usable), [tail, date], hour_bucket(departure), [departure, row_id], out)
    return _with_rest(ranked.withColumn(out, F.col(out).cast("int")), df, usable, out)


def first_departures(df: DataFrame, keys: list[str], departure: str, out: str = "first_departure") -> DataFrame:
    return df.dropna(subset=[*keys, departure]).groupBy(*keys).agg(F.min(departure).alias(out))


def hours_since_first(
    df: DataFrame, keys: list[str], departure: str, out: str = "flightnum_hours_since_first_departure_today",
) -> DataFrame:
    """Hours since the group's first departure of the day; the minimum is combined map-side.

    The first departures are written, so that Spark's size check knows their size: while they are few, no fact is shuffled.
    """
    first = materialize(first_departures(df, keys, departure, "__first"), "first-departures")
    joined = df.join(first, keys, "left")
    return joined.withColumn(out, hours_between("__first", departure)).drop("__first")


def hours_between(start, end) -> Column:
    return (epoch_seconds(end) - epoch_seconds(start)) / 3600.0


def recent_turn_flag(
    df: DataFrame, tail: str, origin: str, dest: str, departure: str, arrival: str, row_id: str,
    max_hours: float = 5.0, out: str = "has_recent_arrival_turn_5h",
) -> DataFrame:
    """Facts with 0/1: the tail's previous leg came in here at most ``max_hours`` before; 0 without tail or time."""
    usable = _usable(tail, departure)
    linked = previous_row(df.filter(usable), [tail], hour_bucket(departure), [departure, row_id], [arrival, dest], "__prev")
    here = F.col("__prev")[dest] == F.col(origin)
    recent = hours_between(F.col("__prev")[arrival], departure).between(0.0, max_hours)
    flagged = linked.withColumn(out, (here & recent).cast("int"))
    return _with_rest(flagged, df, usable, out).withColumn(out, F.coalesce(out, F.lit(0)))


def turn_time_hours(
    df: DataFrame, keys: list[str], origin: str, dest: str, departure: str, arrival: str, row_id: str,
    out: str = "turn_time_hours",
) -> DataFrame:
    """Facts with the hours since the key's previous arrival, if that was at this origin; null without key, time or a matching arrival."""
    usable = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, departure)])
    linked = previous_row(df.filter(usable), keys, hour_bucket(departure), [departure, row_id], [arrival, dest], "__prev")
    here = F.col("__prev")[dest] == F.col(origin)
    return _with_rest(linked.withColumn(out, F.when(here, hours_between(F.col("__prev")[arrival], departure))), df, usable, out)


def tail_features(df: DataFrame, tail: str) -> DataFrame:
    return df.withColumn(tail, clean_sentinel(tail))
