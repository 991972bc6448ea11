"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group of equal keys with more than this share of all rows is hot: there are at most 1000 such groups.
HOT_SHARE = 0.001


def counted(seen: dict[str, int], column: str, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """A counter as frames of (``column``, n) of bounded size."""
    items = list(seen.items())
    for at in range(0, len(items), rows):
        part = items[at : at + rows]
        yield pd.DataFrame({column: np.array([k for k, _ in part], dtype=object), "n": [n for _, n in part]})


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def rank_among(value: Column, cuts: Sequence) -> Column:
    """How many of the sorted ``cuts`` are smaller than ``value``, by nested halving."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(cuts))


def pick(values: Sequence, index: Column, kind: str) -> Column:
    """``values[index]`` for a short list known to the driver."""
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), (index + 1).cast("int"))


def join_groups(rows: DataFrame, groups: DataFrame, key: Sequence[str], total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined to ``groups``, which has one row per key, its size ``n`` and other columns.

    A hot group (``HOT_SHARE`` of all ``total`` rows, so 1000 groups at most) is joined by broadcast; the
    rest by key, where rows of hot groups are spread by ``spread`` as they have found their group already.
    """
    more = [c for c in groups.columns if c not in key]
    hot = groups.filter(F.col("n") > HOT_SHARE * total).select(*key, *[F.col(c).alias(f"hot_{c}") for c in more])
    cold = groups.withColumn("salt", F.lit(0).cast("long"))
    spread = F.when(F.col("hot_n").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1).otherwise(0)
    joined = rows.join(F.broadcast(hot), list(key), "left").withColumn("salt", spread).join(cold, [*key, "salt"], "left")
    for c in more:
        joined = joined.withColumn(c, F.coalesce(c, f"hot_{c}")) if c == "n" else joined.withColumn(c, F.when(F.col("hot_n").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(c)))
    return joined.drop("salt", *[f"hot_{c}" for c in more])
