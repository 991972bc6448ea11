"""Joins: as-of, nearest, dimension lookups and key checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import constants as C
from tarmac.functions.text import normalize_tail
from tarmac.functions.times import col, epoch_seconds
from tarmac.operators.ordered import hour_bucket, join_null_safe
from tarmac.session import materialize

#: Bits of the first filter of ``semi_prefilter`` (2 MB), and of one row of it, as ``bitmap_construct_agg`` makes them.
FILTER_BITS = 1 << 24
WORD_BITS = 1 << 15

#: Most bytes in memory of a table that ``small`` has broadcast.
SMALL_BYTES = 64 << 20


def asof_table(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str],
    bucket=None, tiebreak: list[str] | None = None,
) -> DataFrame:
    """For each distinct left point the latest right row of the key at or before it, column by column.

    A column takes its latest non-null value (wrap several in a struct to take them together). Only
    the distinct left points enter the window, next to one right row per point, so with dates a key
    has at most two rows per day. For finer times pass ``bucket``, a function from a column to its
    bucket (for instance ``hour_bucket``): then a key is cut into buckets, and the last row of the
    earlier buckets is carried over.
    """
    pick_order = F.struct(*[F.col(c) for c in (tiebreak or columns)])
    stats = (
        right.dropna(subset=[*by, right_on])
        .groupBy(*by, F.col(right_on).alias("__on"))
        .agg(*[F.max_by(c, pick_order).alias(c) for c in columns])
        .withColumn("__q", F.lit(0))
    )
    asked = left.dropna(subset=[*by, left_on]).select(*by, F.col(left_on).alias("__on")).distinct()
    asked = asked.withColumn("__q", F.lit(1))
    points = stats.unionByName(asked, allowMissingColumns=True)
    if bucket is None:
        order = Window.partitionBy(*by).orderBy("__on", "__q").rowsBetween(Window.unboundedPreceding, 0)
        found = points.select(*by, "__on", "__q", *[F.last(c, True).over(order).alias(c) for c in columns])
    else:
        points = points.withColumn("__b", bucket("__on"))
        inside = Window.partitionBy(*by, "__b").orderBy("__on", "__q").rowsBetween(Window.unboundedPreceding, 0)
        found = points.select(*by, "__b", "__on", "__q", *[F.last(c, True).over(inside).alias(c) for c in columns])
        ends = points.groupBy(*by, "__b").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__on"))).alias(c) for c in columns]
        )
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "__b", *[F.last(c, True).over(before).alias(f"__c_{c}") for c in columns])
        found = found.join(carried, [*by, "__b"], "left").select(
            *by, "__on", "__q", *[F.coalesce(c, f"__c_{c}").alias(c) for c in columns]
        )
    return found.filter("__q = 1").drop("__q").withColumnRenamed("__on", left_on)


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str],
    bucket=None, tiebreak: list[str] | None = None,
) -> DataFrame:
    """Left rows with the columns of ``asof_table``; rows without key or time keep nulls."""
    answers = asof_table(left, right, by, left_on, right_on, columns, bucket, tiebreak)
    return left.join(answers, [*by, left_on], "left")


def asof_dates(requests: DataFrame, rollups: DataFrame, date: str, out: str = "as_of_date") -> DataFrame:
    """For each distinct request date the latest as-of date at or before it, over all groups.

    The unpartitioned window holds distinct dates only.
    """
    known = rollups.select(F.col("as_of_date").alias("__d")).distinct().withColumn("__q", F.lit(0))
    asked = requests.select(F.col(date).alias("__d")).distinct().withColumn("__q", F.lit(1))
    order = Window.orderBy("__d", "__q").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("__q") == 0, F.col("__d")), True).over(order)
    return (
        known.unionByName(asked).withColumn(out, latest)
        .filter((F.col("__q") == 1) & F.col("__d").isNotNull()).select(F.col("__d").alias(date), out)
    )


def rollup_stats(df: DataFrame, rollups: DataFrame, value: str, group_type: str, prefix: str = "", as_of: str = "as_of_date") -> DataFrame:
    """Adds a group's rollup row on the as-of date a row already has; missing groups are flagged."""
    measures = [c for c in rollups.columns if c not in ("as_of_date", "group_type", "group_value")]
    stats = rollups.filter(F.col("group_type") == group_type).select(
        F.col("as_of_date").alias(as_of), F.col("group_value").alias(value),
        *[F.col(c).alias(f"{prefix}{c}") for c in measures], F.lit(True).alias("__hit"),
    )
    joined = df.join(stats, [as_of, value], "left")
    return joined.withColumn(f"{prefix}missing", F.col("__hit").isNull()).drop("__hit")


def asof_global(requests: DataFrame, rollups: DataFrame, date: str, value: str, group_type: str, prefix: str = "") -> DataFrame:
    """Rollup rows of the latest as-of date at or before the request date.

    The date is looked up over all groups first; a group without a row on that date stays missing.
    """
    dated = requests.join(asof_dates(requests, rollups, date, f"{prefix}as_of_date"), date, "left")
    return rollup_stats(dated, rollups, value, group_type, prefix, f"{prefix}as_of_date")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str], bucket=hour_bucket) -> DataFrame:
    """The right row of the key with the smallest time distance; the earlier one on ties.

    Of several rows at one time the one whose ``columns`` are greatest, in their order, counts.
    A key is cut into buckets that follow the time (``bucket``, hours by default). Rows look back and ahead
    over the distinct times of their own bucket; where it has no reading on one side, the last one of the
    buckets before or the first one of those after is carried in, from one row per bucket. So a key with
    most of the readings is as many tasks as it has buckets.
    """
    record = F.struct(F.col(right_on).alias("__at"), *columns)
    stats = right.dropna(subset=[*by, right_on]).groupBy(*by, right_on).agg(F.max(F.struct(*columns)).alias("__c"))
    stats = stats.select(*by, right_on, "__c.*")
    stats = stats.select(*by, F.col(right_on).alias("__on"), record.alias("__row"), F.lit(0).alias("__q"))
    asked = left.dropna(subset=[*by, left_on]).select(*by, F.col(left_on).alias("__on")).distinct()
    points = stats.unionByName(asked.withColumn("__q", F.lit(1)), allowMissingColumns=True).withColumn("__h", bucket("__on"))
    cut = [*by, "__h"]
    read = F.when(F.col("__q") == 0, F.col("__on"))
    ends = points.groupBy(*cut).agg(F.max_by("__row", read).alias("__last"), F.min_by("__row", read).alias("__first"))
    rising = Window.partitionBy(*by).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    falling = Window.partitionBy(*by).orderBy(F.desc("__h")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*cut, F.last("__last", True).over(rising).alias("__before"), F.last("__first", True).over(falling).alias("__after"))
    back = Window.partitionBy(*cut).orderBy("__on", "__q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*cut).orderBy(F.desc("__on"), F.desc("__q")).rowsBetween(Window.unboundedPreceding, 0)
    both = points.withColumns({"__b": F.last("__row", True).over(back), "__a": F.last("__row", True).over(ahead)})
    both = both.filter("__q = 1").join(carried, cut).withColumns({"__b": F.coalesce("__b", "__before"), "__a": F.coalesce("__a", "__after")})
    gap = lambda c: F.abs(epoch_seconds(F.col(c)["__at"]) - epoch_seconds("__on"))
    ahead_wins = F.col("__b").isNull() | (gap("__a") < gap("__b"))
    found = both.select(
        *by, F.col("__on").alias(left_on),
        F.when(ahead_wins & F.col("__a").isNotNull(), F.col("__a")).otherwise(F.col("__b")).alias("__row"),
    )
    joined = left.join(found, [*by, left_on], "left")
    return joined.withColumns({c: F.col("__row")[c] for c in columns}).drop("__row")


def _row_bytes(kind) -> float:
    """About the bytes of a value in memory; no bound for arrays, maps and the like."""
    if isinstance(kind, T.StructType):
        return 8 + sum(_row_bytes(f.dataType) for f in kind.fields)
    return {T.StringType: 32, T.BinaryType: math.inf, T.ArrayType: math.inf, T.MapType: math.inf}.get(type(kind), 8)


def small(table: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A written table, with a hint to broadcast it if its rows take ``most`` bytes in memory at most, else as it is.

    For tables with a row per day or hour of a few keys, which wide facts are joined to: the session's size check is
    lower on many clusters, and then shuffles every fact. The rows are counted from the files' footers.
    """
    return F.broadcast(table) if table.count() * _row_bytes(table.schema) <= most else table


def join_weather_daily(df: DataFrame, weather: DataFrame, airport: str, date: str, prefix: str) -> DataFrame:
    """Daily weather of an airport column; weather columns get the prefix."""
    names = [c for c in weather.columns if c not in ("airport", "date")]
    side = weather.select(
        F.col("airport").alias(airport), F.col("date").alias(date), *[F.col(c).alias(f"{prefix}{c}") for c in names]
    )
    return df.join(side, [airport, date], "left")


def join_weather_hourly(df: DataFrame, weather: DataFrame, airport: str, instant_utc: str, prefix: str) -> DataFrame:
    """Hourly weather at the hour a UTC instant falls into."""
    names = [c for c in weather.columns if c not in ("airport", "hour_utc")]
    side = weather.select(
        F.col("airport").alias(airport), F.col("hour_utc").alias("__hour"),
        *[F.col(c).alias(f"{prefix}{c}") for c in names],
    )
    hour = F.date_trunc("hour", F.col(instant_utc)).cast("timestamp_ntz")
    return df.withColumn("__hour", hour).join(side, [airport, "__hour"], "left").drop("__hour")


def join_two_hop_lookup(df: DataFrame, master: DataFrame, models: DataFrame, tail: str) -> DataFrame:
    """Tail to model code to maker and model; ``aircraft_type`` is Unknown when nothing matches."""
    first = master.select(F.trim("n_number").alias("__nn"), F.trim("model_code").alias("__code"))
    second = models.select(F.trim("code").alias("__code"), F.trim("mfr").alias("__mfr"), F.trim("model").alias("__mdl"))
    text = F.trim(F.concat_ws(" ", F.coalesce("__mfr", F.lit("")), F.coalesce("__mdl", F.lit(""))))
    return (
        df.withColumn("__nn", normalize_tail(tail)).join(first, "__nn", "left").join(second, "__code", "left")
        .withColumn("aircraft_type", F.when(text != "", text).otherwise("Unknown"))
        .drop("__nn", "__code", "__mfr", "__mdl")
    )


def join_aircraft_year(df: DataFrame, registry: DataFrame, tail: str) -> DataFrame:
    return df.join(registry.select(F.col("Tail_Number").alias(tail), "Year_Mfr"), tail, "left")


def key_bits(keys: DataFrame, columns: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """(__word, __bits): a bitmap of the hashed keys, cut into rows of ``WORD_BITS`` bits."""
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    marks = keys.select(F.shiftright(at, WORD_BITS.bit_length() - 1).cast("int").alias("__word"), at.bitwiseAND(WORD_BITS - 1).alias("__at"))
    return marks.groupBy("__word").agg(F.bitmap_construct_agg("__at").alias("__bits"))


def with_marked_keys(df: DataFrame, marks: DataFrame, columns: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key has its bit set in ``key_bits``; no row is shuffled. Rows of a few other keys stay as well."""
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    placed = df.withColumns({"__word": F.shiftright(at, WORD_BITS.bit_length() - 1).cast("int"), "__at": at.bitwiseAND(WORD_BITS - 1)})
    byte = F.substring("__bits", F.shiftright("__at", 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("long")
    found = placed.join(F.broadcast(marks), "__word").filter(F.getbit(value, F.col("__at").bitwiseAND(7).cast("int")) == 1)
    return found.select(*df.columns)


def semi_prefilter(hist: DataFrame, df: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """History rows whose key occurs in ``df``, in two phases.

    A bitmap of the hashed keys, of ``bits`` bits at most whatever their number, is broadcast and drops most
    other history rows in the scan's own stage; the exact semi join then shuffles what is left. With far more
    keys than bits the first phase lets everything pass and the result is the same. Keys of different types on
    the two sides have different hashes, so then there is only the exact join. The distinct keys are written, as both
    phases read them, and Spark's size check then knows whether they are few enough for the second to shuffle nothing.
    """
    wanted = materialize(df.select(*keys).distinct(), "keys")
    types = [dict(side.dtypes) for side in (hist, df)]
    if all(types[0][k] == types[1][k] for k in keys):
        hist = with_marked_keys(hist, key_bits(wanted, keys, bits), keys, bits)
    return hist.join(wanted, keys, "left_semi")


def filter_both_in_set(df: DataFrame, codes: DataFrame, origin: str, dest: str) -> DataFrame:
    """Rows whose two ends are both in a one-column table of codes."""
    code = codes.columns[0]
    for side in (origin, dest):
        df = df.join(codes.select(F.col(code).alias(side)), side, "left_semi")
    return df


def merge_feature_sets(left: DataFrame, right: DataFrame, keys: list[str], on_duplicates: str = "error") -> DataFrame:
    """Left join on the keys both sides have; only columns new to the left side are added.

    A right side with several rows per key would multiply facts: ``error`` fails the query, ``least``
    keeps the row that is smallest by its new columns in order, ``expand`` lets it happen.
    """
    shared = [k for k in keys if k in left.columns and k in right.columns]
    if not shared:
        raise ValueError("no common join keys")
    added = [c for c in right.columns if c not in left.columns]
    side = right.select(*shared, *added)
    if on_duplicates != "expand":
        packed = side.groupBy(*shared).agg(F.min(F.struct(*added)).alias("__row"), F.count("*").alias("__n"))
        if on_duplicates == "error":
            fail = F.raise_error(F.lit("several feature rows for one key")).cast("boolean")
            packed = packed.filter(F.when(F.col("__n") > 1, fail).otherwise(True))
        side = packed.select(*shared, *[F.col("__row")[c].alias(c) for c in added])
    return join_null_safe(left, side, shared)


def validate_dim_for_keys(
    keys: DataFrame, dim: DataFrame, key: str, latitude: str, longitude: str, zone: str, zones: DataFrame,
) -> DataFrame:
    """Keys a dimension cannot serve, each with the first reason that applies."""
    known = zones.select(F.col(zones.columns[0]).alias(zone)).distinct().withColumn("__known", F.lit(True))
    side = dim.select(key, latitude, longitude, zone).withColumn("__row", F.lit(True))
    joined = keys.select(key).distinct().join(side, key, "left").join(known, zone, "left")
    reason = (
        F.when(F.col("__row").isNull(), "MISSING_ROW")
        .when(F.col(latitude).isNull() | F.col(longitude).isNull(), "BAD_LATLON")
        .when(F.col(zone).isNull(), "MISSING_TZ")
        .when(F.col("__known").isNull(), "UNRECOGNIZED_TZ")
    )
    return joined.select(key, reason.alias("reason")).filter("reason is not null")


def match_rate(df: DataFrame, column: str, unknown: str = "Unknown") -> DataFrame:
    share = F.avg((F.col(column) == unknown).cast("double")) * 100
    return df.agg(share.alias("unknown_pct"), (F.lit(100.0) - share).alias("match_pct"))


def match_schedule(
    requests: DataFrame, schedule: DataFrame, keys=("flight_number", "dest", "date"), carrier: bool = True,
) -> DataFrame:
    """The earliest scheduled flight for each request.

    Both sides have the keys; requests may have ``hhmm`` (null matches any time), schedules have
    sched_utc and, unless ``carrier`` is false, carrier. Unmatched requests keep null. Schedules are reduced to one row per key and
    time before the join; times alone are reduced in hash tables, with the carrier they are sorted.
    """
    keys = list(keys)
    timed = schedule.withColumn("__hm", F.date_format("sched_utc", "HH:mm")).groupBy(*keys, "__hm")
    first = timed.agg((F.min(F.struct("sched_utc", "carrier")) if carrier else F.min("sched_utc")).alias("__f"))
    any_time = first.groupBy(*keys).agg(F.min("__f").alias("__any"))
    want = F.col("hhmm") if "hhmm" in requests.columns else F.lit(None).cast("string")
    both = (
        requests.withColumn("__hm", want).join(any_time, keys, "left").join(first, [*keys, "__hm"], "left")
        .withColumn("__f", F.when(F.col("__hm").isNull(), F.col("__any")).otherwise(F.col("__f"))).drop("__hm", "__any")
    )
    found = {"sched_utc": F.col("__f")["sched_utc"], "carrier": F.col("__f")["carrier"]} if carrier else {"sched_utc": F.col("__f")}
    return both.withColumns({**found, "matched": F.col("__f").isNotNull()}).drop("__f")
