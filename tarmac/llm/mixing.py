"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import text_of
from tarmac.session import materialize

SEED = "mix-1"
#: Up to this rate exp(-rate) is a normal number.
NEAR = 700.0


def hashed_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of an MD5 of the parts, the same in every engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)


def target_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, total: float = 1.0, source: str = "source") -> DataFrame:
    """Per source the mean number of copies (``rate``) that gives the wanted share of bytes.

    ``weights`` are wanted shares by source; a source that is not named, and any source if none is,
    weighs its bytes to the ``power``. The mix has ``total`` times the bytes of the input. Null is a
    source of its own. Rates are rounded to 9 digits.
    """
    sizes = docs.groupBy(docs[source].alias("src")).agg(F.sum(F.octet_length(text_of(docs)).cast("long")).alias("b"), F.count("*").alias("n"))
    sizes = sizes.withColumn("b", F.greatest("b", "n"))
    own = F.pow(F.col("b").cast("double"), F.lit(float(power)))
    for name, w in sorted((weights or {}).items()):
        own = F.when(F.col("src") == name, F.lit(float(w))).otherwise(own)
    sizes = materialize(sizes.withColumn("w", own), "sources")
    all_w, all_b = sizes.agg(F.sum(F.col("w").cast("decimal(38,9)")).cast("double"), F.sum("b")).first()
    factor = total * (all_b or 0) / (all_w or 1.0)
    return sizes.select("src", F.round(F.col("w") * F.lit(factor) / F.col("b"), 9).alias("rate"))


def far_cumulative(rate: float) -> list[float]:
    """The Poisson distribution function of a large ``rate``, within eight deviations and 24 of the mean.

    The first probability comes from its logarithm, by Stirling's series; what lies below it is less than 10^-14.
    """
    first, last = int(rate - 8 * math.sqrt(rate) - 24), math.ceil(rate + 8 * math.sqrt(rate) + 24)
    more = rate - first
    start = first * math.log1p(more / first) - more - math.log(2 * math.pi * first) / 2 - 1 / (12 * first) + 1 / (360 * first**3)
    steps = np.log1p((rate - np.arange(first + 1, last + 1)) / np.arange(first + 1, last + 1))
    return np.cumsum(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)]))).tolist()


def cumulative(rates: DataFrame) -> DataFrame:
    """Adds the Poisson distribution function as an array ``cdf``, eight deviations beyond the mean, and ``least``, the count it starts at.

    That is 0 as long as exp(-rate) does not vanish, up to NEAR; beyond, eight deviations below the mean.
    """

    @F.pandas_udf("array<double>")
    def far(found: pd.Series) -> pd.Series:
        return found.map(lambda r: far_cumulative(r) if r > NEAR else [])

    near = F.least("rate", F.lit(NEAR))
    top = F.ceil(near + 8 * F.sqrt(near) + 24).cast("int")
    step = lambda acc, k: F.struct(
        (acc["p"] * near / k).alias("p"),
        (acc["c"] + acc["p"] * near / k).alias("c"),
        F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * near / k)).alias("cdf"),
    )
    p0 = F.exp(-near)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf"))
    exact = F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"])
    least = F.when(F.col("rate") > NEAR, (F.col("rate") - 8 * F.sqrt("rate") - 24).cast("int")).otherwise(0)
    return rates.withColumn("far", far("rate")).withColumn("cdf", F.when(F.col("rate") > NEAR, F.col("far")).otherwise(exact)).withColumn("least", least).drop("far")


ADDED = ("rate", "copies", "copy", "shuffle_key")


def draw(docs: DataFrame, rates: DataFrame, seed: str = SEED, source: str = "source", key: str = "doc_id") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with each row as often as drawn, and the names under which it holds ``ADDED``, none of which ``docs`` has."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    name = {n: mark + n for n in (*ADDED, "src", "poisson")}
    table = cumulative(rates).select(F.col("src").alias(name["src"]), F.col("rate").alias(name["rate"]), F.struct("least", "cdf").alias(name["poisson"]))
    joined = docs.join(table, docs[source].eqNullSafe(table[name["src"]]), "left")
    u = hashed_unit(F.lit(seed), F.coalesce(docs[key].cast("string"), F.lit("")))
    poisson = F.col(name["poisson"])
    drawn = (
        joined.withColumn(name["copies"], poisson["least"] + F.size(F.filter(poisson["cdf"], lambda c: c < u)))
        .filter(F.col(name["copies"]) > 0)
        .withColumn(name["copy"], F.explode(F.sequence(F.lit(0), F.col(name["copies"]) - 1)))
    )
    order = F.concat_ws("|", F.lit(seed), F.lit("order"), docs[key].cast("string"), F.col(name["copy"]).cast("string"))
    drawn = drawn.withColumn(name["shuffle_key"], F.conv(F.substring(F.md5(order), 1, 15), 16, 10).cast("long"))
    return drawn.drop(name["src"], name["poisson"]), {n: name[n] for n in ADDED}


def shuffled(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """What ``draw`` gives, globally shuffled by a range partition on a hash."""
    drawn, name = draw(docs, rates, seed)
    return drawn.orderBy(name["shuffle_key"], name["copy"]), name


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, total: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` mixed to target weights and globally shuffled.

    The draw inverts the distribution at a hash of ``seed`` and the doc_id: the same row gets the same count
    on every cluster, whatever the rate. Rows that repeat an id get the same count each. A null id hashes as an empty one; a null
    source is a source of its own. Returns the columns of ``docs`` and rate, copies, copy, shuffle_key; columns of ``docs`` with
    these names are replaced, all others keep their values. Empty texts weigh one byte; an empty table gives an empty table.
    """
    mixed, name = shuffled(docs, target_rates(docs, weights, power, total), seed)
    return mixed.drop(*ADDED).withColumnsRenamed({name[n]: n for n in ADDED})


def mix_only(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, total: float = 1.0, seed: str = SEED) -> DataFrame:
    """The rows of ``mix`` with the columns of ``docs`` alone, all with their own values whatever their names."""
    return shuffled(docs, target_rates(docs, weights, power, total), seed)[0].select(*[docs[f"`{c}`"] for c in docs.columns])
