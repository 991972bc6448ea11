"""Order-dependent operators that stay spread out when one key holds much of the data.

A plain window puts all rows of a key into one task. Here a key is cut into buckets that follow the
order (hours of a time, slices of a number, prefixes of a hash). Rows are only ordered inside their
bucket; what lies before a bucket comes from one small row per bucket, so the per-key window sees as
many rows as there are buckets, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.times import col


def value_bucket(value) -> Column:
    """Order-preserving bucket of a double: fine near zero, 0.07 % wide further out."""
    v = col(value).cast("double")
    return (F.signum(v) * F.floor(F.log2(F.abs(v) * F.lit(1e6) + 1.0) * 1024)).cast("long")


def hour_bucket(ts) -> Column:
    t = col(ts)
    return F.unix_date(t.cast("date")).cast("long") * 24 + F.hour(t)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that may be null; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, test, how).drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    by: list[str],
    bucket: Column,
    order: list,
    sums: dict[str, str],
    descending: bool = False,
    peers: bool = True,
    totals: bool = False,
) -> DataFrame:
    """Adds ``{out}`` = running total of column ``sums[out]`` per key in the given order.

    ``bucket`` must not fall when the order rises. With ``peers`` rows of equal order count
    together (RANGE); otherwise row by row, which needs a unique order. ``totals`` also adds the
    key's whole sum as ``{out}_all``. Keys must not be null.
    """
    direction = F.desc if descending else F.asc
    frame = df.withColumn("__bucket", bucket)
    per_bucket = frame.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    whole = Window.partitionBy(*by)
    before = whole.orderBy(direction("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, "__bucket",
        *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums],
        *[F.sum(f"__t_{o}").over(whole).alias(f"{o}_all") for o in sums if totals],
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy(*[direction(c) for c in order])
    inside = (inside.rangeBetween if peers else inside.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    local = frame.withColumns({f"__l_{o}": F.sum(c).over(inside) for o, c in sums.items()})
    joined = local.join(offsets, [*by, "__bucket"], "left")
    drop = ["__bucket", *[f"__l_{o}" for o in sums], *[f"__o_{o}" for o in sums]]
    return joined.withColumns({o: F.col(f"__l_{o}") + F.col(f"__o_{o}") for o in sums}).drop(*drop)


def ordered_rank(
    df: DataFrame, by: list[str], bucket: Column, order: list, out: str = "rank", descending: bool = False
) -> DataFrame:
    """1-based position per key; ``order`` must be unique inside a key."""
    ranked = running_totals(
        df.withColumn("__one", F.lit(1).cast("long")), by, bucket, order, {out: "__one"}, descending, peers=False
    )
    return ranked.drop("__one")


def previous_row(df: DataFrame, by: list[str], bucket: Column, order: list[str], columns: list[str], out: str) -> DataFrame:
    """Adds struct ``out`` with ``columns`` of the preceding row of the key; null for the first.

    Keys and order must not be null.
    """
    frame = df.withColumn("__bucket", bucket)
    picked = F.struct(*columns)
    last = frame.groupBy(*by, "__bucket").agg(F.max_by(picked, F.struct(*order)).alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__bucket")
    carried = last.select(*by, "__bucket", F.lag("__last").over(earlier).alias("__carried"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order)
    local = frame.withColumn("__local", F.lag(picked).over(inside))
    joined = local.join(carried, [*by, "__bucket"], "left")
    return joined.withColumn(out, F.coalesce("__local", "__carried")).drop("__bucket", "__local", "__carried")


def exact_quantile_counts(counts: DataFrame, by: list[str], value: str, freq: str, p: float = 0.5) -> DataFrame:
    """Exact interpolated quantile per key from (key, value, frequency) rows.

    The rows that hold the two middle ranks are found with running totals, so no task sees all
    distinct values of a key.
    """
    merged = running_totals(counts, by, value_bucket(value), [value], {"__upto": freq}, totals=True)
    merged = merged.withColumnRenamed("__upto_all", "__n")
    position = (F.col("__n") - 1) * F.lit(p)
    low, high = F.floor(position), F.ceil(position)
    covers = lambda r: (F.col("__upto") - F.col(freq) <= r) & (r < F.col("__upto"))
    fraction = F.max(position - low)
    low_value = F.max(F.when(covers(low), F.col(value)))
    high_value = F.max(F.when(covers(high), F.col(value)))
    hits = merged.filter(covers(low) | covers(high))
    return hits.groupBy(*by).agg((low_value + (high_value - low_value) * fraction).alias("quantile"))
