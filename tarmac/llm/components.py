"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import materialize


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour."""
    ways = both_ways(links)
    low = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return ways.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are tied to the smallest of them. ``a`` > ``b``."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    own = low.select("a", F.col("m").alias("b"))
    rest = links.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(rest).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, m): the smallest node that each linked node reaches; nodes that are their own smallest are left out.

    ``links`` holds (a, b). Every round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path.
    """
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = materialize(small_star(large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select("a", F.col("b").alias("m"))
        seen = mark


def nearby_labels(links: DataFrame, rounds: int = 2) -> DataFrame:
    """(a, label): the smallest node within ``rounds`` links. Equal labels mean connected, not the reverse."""
    ways = both_ways(links)
    label = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(rounds - 1):
        label = ways.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.least(F.min("label"), F.first("a")).alias("label"))
    return label
