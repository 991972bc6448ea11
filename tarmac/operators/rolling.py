"""Leakage-safe history features.

All of them first reduce the history to sums and counts per key and day (or key, day and time).
Those partial sums combine on the map side, so a key with a third of all rows costs no more than any
other, and every window runs over at most one row per key and day.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.times import col, epoch_seconds
from tarmac.operators.joins import asof_table
from tarmac.operators.moving import moving_statistics
from tarmac.session import materialize


def _day(date: str) -> Column:
    return F.unix_date(F.col(date)).cast("long")


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def daily_mean(df: DataFrame, keys: list[str], date: str, value: str, out: str = "mean") -> DataFrame:
    """Mean per key and day; rows without key, date or value do not count."""
    known = df.dropna(subset=[*keys, date, value])
    return known.groupBy(*keys, date).agg(F.avg(value).alias(out))


def rolling_rows_baseline(
    daily: DataFrame, keys: list[str], date: str, value: str, windows, prefix: str, calendar: bool = False
) -> DataFrame:
    """Mean of the previous W daily means, the current day excluded.

    By default W counts days that have data; ``calendar`` counts calendar days.
    """
    if calendar:
        order = Window.partitionBy(*keys).orderBy(_day(date))
        frames = {w: order.rangeBetween(-w, -1) for w in windows}
    else:
        order = Window.partitionBy(*keys).orderBy(date)
        frames = {w: order.rowsBetween(-w, -1) for w in windows}
    return daily.select(
        *keys, date, *[F.avg(value).over(frames[w]).alias(f"{prefix}{w}") for w in windows]
    )


def baseline_tables(hist: DataFrame, windows, columns, calendar: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Carrier-and-origin, carrier and origin baselines.

    The history is scanned and aggregated once; the coarser days are sums of the finest ones.
    """
    c = columns
    fine = (
        hist.dropna(subset=[c.carrier, c.origin, c.date, c.dep_delay])
        .groupBy(c.carrier, c.origin, c.date)
        .agg(F.sum(c.dep_delay).alias("__s"), F.count(c.dep_delay).alias("__n"))
    )

    def coarse(keys: list[str], prefix: str) -> DataFrame:
        daily = fine.groupBy(*keys, c.date).agg((F.sum("__s") / F.sum("__n")).alias("__m"))
        return rolling_rows_baseline(daily, keys, c.date, "__m", windows, prefix, calendar)

    own = rolling_rows_baseline(
        fine.withColumn("__m", F.col("__s") / F.col("__n")), [c.carrier, c.origin], c.date, "__m", windows,
        "carrier_origin_depdelay_mean_last", calendar,
    )
    by_carrier = coarse([c.carrier], "carrier_depdelay_mean_last")
    by_origin = coarse([c.origin], "origin_depdelay_mean_last")
    return own, by_carrier, by_origin


def baselines_at(points: DataFrame, hist: DataFrame, windows, columns, calendar: bool = False) -> DataFrame:
    """The three baselines side by side for each distinct carrier, origin and day of ``points``."""
    c = columns
    own, by_carrier, by_origin = baseline_tables(hist, windows, c, calendar)
    return (
        points.select(c.carrier, c.origin, c.date).dropna().distinct()
        .join(own, [c.carrier, c.origin, c.date], "left")
        .join(by_carrier, [c.carrier, c.date], "left")
        .join(by_origin, [c.origin, c.date], "left")
    )


def add_baselines(df: DataFrame, hist: DataFrame, windows, columns, calendar: bool = False) -> DataFrame:
    """Joins the three baselines to ``df``.

    They are written, so that Spark's size check knows their size: while they are few, no fact is shuffled, else once.
    """
    c = columns
    table = materialize(baselines_at(df, hist, windows, c, calendar), "baselines")
    return df.join(table, [c.carrier, c.origin, c.date], "left")


def join_history_features(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join of a table with one row per key; keeps every fact."""
    return df.join(features, keys, "left")


def rolling_days_at(
    points: DataFrame, hist: DataFrame, keys: list[str], date: str, values: list[str], windows, include_today: bool = False,
) -> DataFrame:
    """Sums and counts of some columns in the W days before each distinct point (key, date).

    Frames are [D-W, D-1], or [D-W+1, D] with ``include_today``. Gives ``sum_{value}_{W}`` (null
    without values) and ``n_{value}_{W}``.
    """
    daily = hist.dropna(subset=[*keys, date]).groupBy(*keys, date).agg(
        *[F.sum(v).cast("double").alias(f"__s_{v}") for v in values], *[F.count(v).alias(f"__n_{v}") for v in values],
        F.lit(0).alias("__q"),
    )
    asked = points.select(*keys, date).dropna().distinct().withColumn("__q", F.lit(1))
    order = Window.partitionBy(*keys).orderBy(_day(date))
    out = {}
    for w in windows:
        frame = order.rangeBetween(-w + 1, 0) if include_today else order.rangeBetween(-w, -1)
        for v in values:
            out[f"sum_{v}_{w}"] = F.sum(f"__s_{v}").over(frame)
            out[f"n_{v}_{w}"] = F.coalesce(F.sum(f"__n_{v}").over(frame), F.lit(0).cast("long"))
    merged = daily.unionByName(asked, allowMissingColumns=True)
    return merged.select(*keys, date, "__q", *[c.alias(n) for n, c in out.items()]).filter("__q = 1").drop("__q")


def history_window_means(
    requests: DataFrame, hist: DataFrame, keys: list[str], date: str, value: str,
    windows=(7, 14, 21, 28), include_today: bool = True, low_support_lt: int = 5,
    prefix: str = "flightnum_od_",
) -> DataFrame:
    """Mean over the last W days for each request, support over the longest window."""
    table = window_means_at(requests, hist, keys, date, value, windows, include_today, prefix)
    return requests.join(table, [*keys, date], "left").withColumns(support_flags(windows, low_support_lt, prefix))


def window_means_at(points, hist, keys, date, value, windows, include_today, prefix="flightnum_od_") -> DataFrame:
    """Means per window and support of the longest, for each distinct point."""
    longest = max(windows)
    rolled = rolling_days_at(points, hist, keys, date, [value], windows, include_today)
    return rolled.select(
        *keys, date,
        *[
            _mean(F.col(f"sum_{value}_{w}"), F.col(f"n_{value}_{w}")).alias(f"{prefix}depdelay_mean_last{w}")
            for w in windows
        ],
        F.col(f"n_{value}_{longest}").alias(f"{prefix}support_count_last{longest}d"),
    )


def support_flags(windows, low_support_lt: int, prefix: str = "flightnum_od_") -> dict[str, Column]:
    """Support count (0 when there is no history) and low-support flag, after the join."""
    longest = max(windows)
    name = f"{prefix}support_count_last{longest}d"
    support = F.coalesce(F.col(name), F.lit(0).cast("long"))
    return {name: support, f"{prefix}low_support_last{longest}d": (support < low_support_lt).cast("int")}


def rolling_prior_events(
    df: DataFrame, hist: DataFrame, keys: list[str], date: str, time: str, value: str,
    windows=(7, 14, 21, 28), low_support_lt: int = 3, prefix: str = "flightnum_od_",
) -> DataFrame:
    """Facts with means and support of the history rows strictly earlier by (date, time), back to W days before the date.

    Facts without a key, date or time get null, 0 and 1. The frame [D-W, t) is the sum of whole earlier days and of the
    same day's earlier times. The facts are shuffled once, by key and day, next to the history's rows; if they are their own history
    (the same DataFrame is given for both), no other row. Days come as sums, one row per key and day.
    """
    longest = max(windows)
    day = [*keys, date]
    moment = lambda c: F.coalesce(epoch_seconds(c), F.lit(0).cast("long"))
    usable = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in (*day, time)])
    past = hist.dropna(subset=day).select(*day, moment(time).alias("__t"), F.col(value).alias("__v"), F.col(time).isNull().alias("__none"))
    asked = df.filter(usable).withColumn("__t", moment(time))
    if hist is df:
        timeless = past.filter("__none").drop("__none")
        merged = asked.withColumns({"__v": F.col(value), "__q": F.lit(True)}).unionByName(timeless, allowMissingColumns=True)
        points = past
    else:
        past = past.drop("__none")
        merged = asked.withColumn("__q", F.lit(True)).unionByName(past, allowMissingColumns=True)
        points = past.unionByName(asked.select(*day), allowMissingColumns=True)
    today = Window.partitionBy(*day).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    same_day = merged.withColumns({"__ts": F.sum("__v").over(today).cast("double"), "__tn": F.count("__v").over(today)}).filter("__q")
    per_day = points.groupBy(*day).agg(F.sum("__v").cast("double").alias("__ds"), F.count("__v").alias("__dn"))
    order = Window.partitionBy(*keys).orderBy(_day(date))
    frames = {w: order.rangeBetween(-w, -1) for w in windows}
    earlier = per_day.select(
        *day, *[F.sum("__ds").over(f).alias(f"__s{w}") for w, f in frames.items()], *[F.sum("__dn").over(f).alias(f"__n{w}") for w, f in frames.items()],
    )
    both = same_day.join(earlier, day, "left")
    zero = F.lit(0).cast("long")
    total = {w: F.coalesce(F.col(f"__s{w}"), F.lit(0.0)) + F.coalesce(F.col("__ts"), F.lit(0.0)) for w in windows}
    count = {w: F.coalesce(F.col(f"__n{w}"), zero) + F.coalesce(F.col("__tn"), zero) for w in windows}
    made = {f"{prefix}depdelay_mean_last{w}": _mean(total[w], count[w]) for w in windows}
    made[f"{prefix}support_count_last{longest}d"] = count[longest]
    found = both.select(*df.columns, *[c.alias(n) for n, c in made.items()])
    rest = df.filter(~usable).select("*", *[F.lit(None).cast("double" if "mean" in n else "long").alias(n) for n in made])
    return found.unionByName(rest).withColumns(support_flags(windows, low_support_lt, prefix))


def rolling_days_stats(hist: DataFrame, keys: list[str], date: str, measures: dict[str, str], windows=(7, 14)) -> DataFrame:
    """Mean and count of each measure in [D-W, D) for the days a key has data on.

    ``measures`` maps a prefix to a column. A day on which a measure is unknown has a null struct
    ``stat_{prefix}``, so that the as-of attach skips it.
    """
    daily = hist.dropna(subset=[*keys, date]).groupBy(*keys, date).agg(
        *[F.sum(v).cast("double").alias(f"__s_{p}") for p, v in measures.items()],
        *[F.count(v).alias(f"__n_{p}") for p, v in measures.items()],
    )
    order = Window.partitionBy(*keys).orderBy(_day(date))
    out = {}
    for p in measures:
        fields = []
        for w in windows:
            frame = order.rangeBetween(-w, -1)
            n = F.sum(f"__n_{p}").over(frame)
            some = n > 0
            fields += [
                F.when(some, F.sum(f"__s_{p}").over(frame) / n).alias(f"mean_{w}d"),
                F.when(some, n).alias(f"n_{w}d"),
            ]
        out[p] = F.struct(*fields)
    return daily.select(
        *keys, date, *[F.when(F.col(f"__n_{p}") > 0, out[p]).alias(f"stat_{p}") for p in measures]
    )


def unpack_stats(measures, suffix: str, windows) -> dict[str, Column]:
    """Plain columns from the stat structs."""
    out = {}
    for p in measures:
        for w in windows:
            out[f"{p}_mean_{w}d_{suffix}"] = F.col(f"stat_{p}")[f"mean_{w}d"]
            out[f"{p}_n_{w}d_{suffix}"] = F.col(f"stat_{p}")[f"n_{w}d"]
    return out


def rolling_days_mean_count(
    df: DataFrame, hist: DataFrame, keys: list[str], date: str, measures: dict[str, str], suffix: str, windows=(7, 14),
) -> DataFrame:
    """As-of attach of rolling means and counts: the latest history day at or before the date.

    The answers, one row per key and day, are written, so that Spark's size check knows their size: while they are few,
    no fact is shuffled, else once.
    """
    stats = rolling_days_stats(hist, keys, date, measures, windows)
    packed = [f"stat_{p}" for p in measures]
    answers = materialize(asof_table(df, stats, keys, date, date, packed), "rolling-days")
    joined = df.join(answers, [*keys, date], "left")
    return joined.withColumns(unpack_stats(measures, suffix, windows)).drop(*packed)


def rolling_days_median(hist: DataFrame, keys: list[str], date: str, value: str, window: int = 7, out: str = "median") -> DataFrame:
    """Exact median of ``value`` in [D-W, D) for the days a key has data on.

    Values are counted per key, day and value; ``moving_statistics`` selects the middle ranks by running totals.
    """
    counts = hist.dropna(subset=[*keys, date, value]).groupBy(*keys, date, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    days = counts.select(*keys, date).distinct()
    medians = moving_statistics(counts, keys, date, [window], as_of="__as_of", asked=days.withColumnRenamed(date, "__as_of"))
    asked = medians.select(*keys, F.col("__as_of").alias(date), F.col(f"median_{window}").alias(out))
    return days.join(asked, [*keys, date], "left")
