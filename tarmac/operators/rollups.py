"""Daily and as-of rollups."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.operators.moving import moving_statistics
from tarmac.operators.rolling import rolling_days_at


def daily_rollup(df: DataFrame, keys: list[str], date: str, delay: str) -> DataFrame:
    """Flights, flights with a known delay and the sum of those delays, per key and day."""
    return df.groupBy(F.col(date).alias("date"), *keys).agg(
        F.coalesce(F.sum(delay), F.lit(0.0)).cast("double").alias("dep_delay_sum"),
        F.count(delay).alias("dep_delay_count"),
        F.count("*").alias("dep_flight_count"),
    )


def rollup_window_mean(
    requests: DataFrame, rollup: DataFrame, keys: list[str], date_end: str, window: int, min_support: int = 1,
) -> DataFrame:
    """Mean delay in [end - W, end) for each request (end date and any of the rollup's keys).

    The rollup is summed to the asked keys and days first; a single window then answers every
    request of a key.
    """
    daily = rollup.withColumnRenamed("date", date_end).groupBy(*keys, date_end).agg(
        F.sum("dep_delay_sum").alias("__s"), F.sum("dep_delay_count").alias("__c"), F.sum("dep_flight_count").alias("__f")
    )
    rolled = rolling_days_at(requests, daily, keys, date_end, ["__s", "__c", "__f"], [window])
    value = {n: F.coalesce(F.col(f"sum_{c}_{window}"), F.lit(0.0)) for n, c in (("s", "__s"), ("c", "__c"), ("f", "__f"))}
    enough = (value["c"] >= min_support) & (value["c"] > 0)
    table = rolled.select(
        *keys, date_end, F.when(enough, value["s"] / value["c"]).alias("mean_delay_min"),
        value["c"].cast("long").alias("support_count"), value["f"].cast("long").alias("flight_count"),
    )
    return requests.join(table, [*keys, date_end], "left")


def group_rollups(
    df: DataFrame, date: str, groups: dict[str, str], measures: dict[str, str], windows=C.ROLLUP_WINDOWS,
) -> DataFrame:
    """n, mean and median over the last 1, 7 and 14 days, per group and as-of date.

    ``groups`` maps a group type to its column. Facts are first counted per group, day and value, by
    GROUPING SETS over the group columns; ``moving_statistics`` does the rest for all measures and windows.
    An as-of date D covers [D - W, D - 1]; it exists when the group has data within the longest window.
    """
    parts = []
    for name, value in measures.items():
        known = df.dropna(subset=[date, value]).withColumn("__v", F.col(value).cast("double"))
        columns = [F.col(c) for c in groups.values()]
        sets = [[F.col(c), F.col(date), F.col("__v")] for c in groups.values()]
        counted = known.groupingSets(sets, *columns, F.col(date), F.col("__v")).agg(
            F.count("*").alias("__n"),
            *[F.grouping(c).alias(f"__g_{i}") for i, c in enumerate(columns)],
        )
        group_type, group_value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for i, (kind, column) in enumerate(groups.items()):
            own = F.col(f"__g_{i}") == 0
            group_type = F.when(own, kind).otherwise(group_type)
            group_value = F.when(own, F.col(column)).otherwise(group_value)
        parts.append(
            counted.select(
                group_type.alias("group_type"), group_value.alias("group_value"), F.col(date).alias("__day"),
                F.lit(name).alias("__measure"), "__v", "__n",
            )
        )
    facts = functools.reduce(DataFrame.unionByName, parts).filter("group_value is not null")
    by = ["group_type", "group_value", "__measure"]
    found = moving_statistics(facts, by, "__day", windows, "__v", "__n")
    pick = lambda name, c: F.max(F.when(F.col("__measure") == name, F.col(c)))
    columns = []
    for name in measures:
        for w in windows:
            columns += [
                F.coalesce(pick(name, f"n_{w}"), F.lit(0)).cast("long").alias(f"{name}_delay_{w}d_n"),
                pick(name, f"mean_{w}").alias(f"{name}_delay_{w}d_mean"), pick(name, f"median_{w}").alias(f"{name}_delay_{w}d_median"),
            ]
    return found.groupBy("as_of_date", "group_type", "group_value").agg(*columns)
