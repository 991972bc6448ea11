"""Duplicates: latest or first row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.times import col
from tarmac.session import materialize

BUCKETS = 1 << 16
HOT = 1000
TASK_ROWS = 1 << 20


def composite_key(parts: list, whole: list[str]) -> Column:
    """The present key parts joined by ``|``; a hash of the whole row when none is present."""
    texts = [F.trim(col(p).cast("string")) for p in parts]
    present = F.concat_ws("|", *[F.nullif(t, F.lit("")) for t in texts])
    content = F.sha2(F.to_json(F.struct(*whole)), 256)
    return F.when(present != "", F.concat(F.lit("k:"), present)).otherwise(F.concat(F.lit("h:"), content))


def dedupe_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order per key; combined map-side, so hot keys do not pile up."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest order per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def dedupe_first_sparse(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest order per key, for keys that seldom repeat.

    Combining such rows map-side sorts every input task, which spills as tasks grow, and combines next to nothing. So rows
    are shuffled as they are and sorted once, a million a task or so. Only the hash buckets that hold a thousandth of all
    rows each (1000 buckets at most) are combined map-side, so hot keys do not pile up. ``df`` is read once more for the sizes
    of the buckets, and once for the rows of these, if there are any.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = materialize(df.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n")), "bucket-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    hot = [r["__bucket"] for r in sizes.filter(F.col("__n") * HOT >= total).collect()]
    tasks = -(-total // TASK_ROWS)
    more = [tasks] if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    first = dedupe_first(df.filter(~bucket.isin(hot)).repartition(*more, *keys), keys, order)
    return first.unionByName(dedupe_first(df.filter(bucket.isin(hot)), keys, order)) if hot else first
