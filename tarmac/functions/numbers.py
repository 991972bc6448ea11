"""Numeric expressions: coercion, units, labels, bins and weather kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.times import col


def coerce_numeric(c) -> Column:
    """Text or number to double; what does not parse, and NaN, becomes null."""
    value = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def to_kelvin(celsius) -> Column:
    return coerce_numeric(celsius) + F.lit(C.KELVIN_OFFSET)


# Source column, derived column, whether degrees are converted.
_WEATHER_RENAMES = (
    ("origin_temperature_2m_max", "origin_temp_max_K", True),
    ("origin_temperature_2m_min", "origin_temp_min_K", True),
    ("origin_precipitation_sum", "origin_daily_precip_sum_mm", False),
    ("origin_windspeed_10m_max", "origin_daily_windspeed_max_kmh", False),
    ("origin_dep_temperature_2m", "origin_dep_temp_K", True),
    ("origin_dep_precipitation", "origin_dep_precip_mm", False),
    ("origin_dep_windspeed_10m", "origin_dep_windspeed_kmh", False),
)


def unit_convert(df: DataFrame) -> DataFrame:
    """Weather columns in model units, for those source columns that exist."""
    have = set(df.columns)
    return df.withColumns(
        {
            out: to_kelvin(src) if kelvin else coerce_numeric(src)
            for src, out, kelvin in _WEATHER_RENAMES
            if src in have
        }
    )


def weather_code_cast(df: DataFrame) -> DataFrame:
    pairs = (("origin_weathercode", "origin_daily_weathercode"), ("origin_dep_weathercode", "origin_dep_hour_weathercode"))
    return df.withColumns({out: coerce_numeric(src).cast("int") for src, out in pairs if src in df.columns})


def weather_kind(code) -> Column:
    """Kind of weather for a WMO code."""
    c = coerce_numeric(code)
    return (
        F.when(c.isNull(), "unknown")
        .when(c == 0, "clear")
        .when(c.isin(1, 2, 3), "cloud")
        .when(c.isin(45, 48), "fog")
        .when(c.between(51, 67) | c.between(80, 82), "rain")
        .when(c.between(71, 77), "snow")
        .when(c >= 95, "storm")
        .otherwise("cloud")
    )


def age_years(date, year_built) -> Column:
    return F.year(col(date)) - col(year_built)


def age_bucket(years) -> Column:
    y = col(years)
    return (
        F.when(y.isNull(), "Unknown").when(y <= 5, "0-5").when(y <= 10, "6-10").when(y <= 15, "11-15").otherwise("16+")
    )


def threshold_labels(delay, target: str = "dep", thresholds=C.THRESHOLDS) -> dict[str, Column]:
    """0/1 labels "delay of at least t"; an unknown delay counts as 0."""
    labels = {
        f"y_{target}_ge{t}": F.coalesce((col(delay) >= t).cast("int"), F.lit(0)) for t in thresholds
    }
    if target == "dep" and 15 in thresholds:
        labels["y_dep15"] = labels["y_dep_ge15"]
    return labels


def delay_bin(delay) -> Column:
    """Left-closed bin label; an unknown delay counts as 0."""
    d = F.coalesce(col(delay), F.lit(0.0))
    out = None
    for bound, label in zip(C.THRESHOLDS, C.BIN_LABELS):
        out = F.when(d < bound, label) if out is None else out.when(d < bound, label)
    return out.otherwise(C.BIN_LABELS[-1])


def snapshot_delay(dep_delayed, delayed) -> Column:
    return F.coalesce(coerce_numeric(dep_delayed), coerce_numeric(delayed))
