"""Arrival features: route history, airtime, wheels-off slip, arrivals around the expected time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import numbers as N
from tarmac.functions import times as T
from tarmac.operators import intervals, joins, rolling
from tarmac.plans.config import PipelineConfig
from tarmac.schema import FLIGHT
from tarmac.session import materialize


def _with_slip(df: DataFrame) -> DataFrame:
    slip = T.wrap_minute_diff(T.hhmm_to_minutes(FLIGHT.wheels_off), T.hhmm_to_minutes(FLIGHT.dep_hhmm))
    return df.withColumns({"wo_slip_min": slip, "DepTimeBlk": T.dep_time_block(FLIGHT.dep_hhmm)})


def _history_stats(points: DataFrame, hist: DataFrame, keys: list[str], measures, suffix: str, windows, median: bool) -> DataFrame:
    """One row per distinct point (keys, day): rolling means, counts and the 7-day median, as of that day."""
    c = FLIGHT
    hist = joins.semi_prefilter(hist, points, keys)
    stats = rolling.rolling_days_stats(hist, keys, c.date, measures, windows)
    packed = [f"stat_{p}" for p in measures]
    out = rolling.unpack_stats(measures, suffix, windows)
    if median:
        days = rolling.rolling_days_median(hist, keys, c.date, c.arr_delay, 7, "__m")
        stats = stats.join(days.select(*keys, c.date, F.struct("__m").alias("__median")), [*keys, c.date], "left")
        packed.append("__median")
        out[f"arrdelay_median_7d_{suffix}"] = F.col("__median")["__m"]
    table = joins.asof_table(points, stats, keys, c.date, c.date, packed)
    return table.select(*keys, c.date, *[v.alias(n) for n, v in out.items()])


def arrival_features(
    df: DataFrame, hist: DataFrame, cfg: PipelineConfig = PipelineConfig(target="arr"),
    departure: DataFrame | None = None,
) -> DataFrame:
    """All arrival features and labels; one output row per flight of ``df``.

    ``df`` and ``hist`` should be written tables. Stats by flight number and by route are joined at
    the grain of flight key and day first, so that the facts are shuffled once for both; that table
    is written, because the expected arrival times read it too. It is joined after the counts, so its columns are not
    shuffled with the facts. The blocks' table is broadcast while it is small.
    """
    c = FLIGHT
    windows = cfg.arrival_windows
    period = df.agg(F.struct(F.min(c.date).alias("lo"), F.max(c.date).alias("hi"))).scalar()
    hist = _with_slip(hist).filter(
        F.col(c.date).between(F.date_sub(period["lo"], max(windows)), period["hi"])
    )
    base = df.withColumns(
        {
            "DepTimeBlk": T.dep_time_block(c.dep_hhmm), "arr_local_date": F.col(c.arr_local).cast("date"),
            "__us": T.epoch_micros(c.arr_local),
        }
    )
    by_route = {"arrdelay": c.arr_delay, "airtime": c.air_time}
    by_flight = {**by_route, "wo_slip": "wo_slip_min"}
    block = [c.origin, "DepTimeBlk"]
    points = df.select(*c.flight_key, c.date).dropna().distinct()
    flight_stats = _history_stats(points, hist, c.flight_key, by_flight, "fn_od", windows, True)
    route_stats = _history_stats(points, hist, c.route_key, by_route, "car_od", windows, True)
    block_stats = joins.small(materialize(_history_stats(base, hist, block, {"wo_slip": "wo_slip_min"}, "origin_blk", windows, False), "block-history"))
    history = materialize(flight_stats.join(route_stats, [*c.route_key, c.date], "left"), "arrival-history")

    shift = f"arrdelay_mean_{max(windows)}d_car_od"
    flight_day = [*c.flight_key, c.date]
    narrow = base.select(c.row_id, *flight_day, "arr_local_date", "__us").join(
        history.select(*flight_day, shift), flight_day, "left"
    )
    congestion = intervals.interval_count_shifted(narrow, c.carrier, c.dest, "arr_local_date", "__us", shift)
    counts = [f"dest_{a}_pm60_{k}" for k in ("sched", "eta") for a in ("arrivals", "airline_arrivals")]
    out = (
        base.join(congestion.select(c.row_id, *counts), c.row_id, "left").join(history, flight_day, "left")
        .join(block_stats, [*block, c.date], "left").drop("__us")
    )
    if departure is not None:
        out = joins.merge_feature_sets(out, departure, [c.row_id])
    return out.withColumns(N.threshold_labels(c.arr_delay, "arr", cfg.thresholds))
