"""Exact, reproducible sampling and splits.

Rows are ordered by a hash of their id. Counts per hash prefix tell where the n-th row of a class
lies; only the rows of that prefix are ordered, to find the hash of the n-th. All rows are compared with it
where they are read. No class is ever sorted or shuffled as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import materialize

PREFIX = 4  # hex digits: 65536 buckets per class


def hash_order(seed, key_columns: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_columns]))


def _with_bucket(df: DataFrame, seed, key_columns: list[str]) -> DataFrame:
    hashed = df.withColumn("__h", hash_order(seed, key_columns))
    return hashed.withColumn("__b", F.substring("__h", 1, PREFIX))


def _cuts(hashed: DataFrame, strata: list[str], quota) -> DataFrame:
    """(strata, ``__stop``): the hash of the last of the ``quota`` lowest rows of a stratum.

    It is empty if the quota is 0, null if it takes the whole stratum or is null. ``quota`` maps the per-bucket
    counts (strata, ``__n`` rows) to them with a column ``__quota``. Only the rows of the bucket that holds the last
    one are shuffled. A stratum is a class of a 0/1 label, per threshold or part: the table has a handful of rows, which
    bounds the broadcasts.
    """
    counts = quota(hashed.groupBy(*strata, "__b").agg(F.count("*").alias("__n")))
    order = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__upto", F.sum("__n").over(order))
    reached = F.col("__upto") >= F.col("__quota")
    cuts = upto.groupBy(*strata).agg(
        F.first("__quota").alias("__quota"),
        F.min(F.when(reached, F.col("__b"))).alias("__cut"),
        F.coalesce(F.max(F.when(~reached, F.col("__upto"))), F.lit(0)).alias("__full"),
    )
    cuts = materialize(cuts, "cuts")
    at = F.broadcast(cuts.withColumnRenamed("__cut", "__b"))
    inside = Window.partitionBy(*strata, "__b").orderBy("__h")
    placed = hashed.join(at, [*strata, "__b"]).withColumn("__r", F.row_number().over(inside))
    last = placed.filter(F.col("__r") <= F.col("__quota") - F.col("__full")).groupBy(*strata).agg(F.max("__h").alias("__last"))
    stop = F.when(F.col("__quota").isNotNull() & F.col("__cut").isNotNull(), F.coalesce("__last", F.lit("")))
    return materialize(cuts.join(last, strata, "left").select(*strata, stop.alias("__stop")), "cuts")


def _lowest(hashed: DataFrame, strata: list[str], quota) -> DataFrame:
    """Rows among the ``quota`` lowest hashes of their stratum; a null quota keeps the stratum whole.

    The rows are compared with their stratum's cut where they are read; they are not shuffled.
    """
    near = hashed.join(F.broadcast(_cuts(hashed, strata, quota)), strata)
    return near.filter(F.col("__stop").isNull() | (F.col("__h") <= F.col("__stop"))).drop("__h", "__b", "__stop")


def sample_n(df: DataFrame, n: int, key_columns: list[str], seed=42) -> DataFrame:
    """Exactly n rows (all, if there are fewer).

    The window over all buckets sees one row per hash prefix.
    """
    hashed = _with_bucket(df, seed, key_columns)
    order = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    upto = hashed.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(order))
    reached = F.col("__upto") >= n
    point = upto.agg(
        F.struct(
            F.min(F.when(reached, F.col("__b"))).alias("cut"),
            F.coalesce(F.max(F.when(~reached, F.col("__upto"))), F.lit(0)).alias("full"),
        )
    ).scalar()
    near = hashed.withColumn("__p", point).filter(F.col("__p.cut").isNull() | (F.col("__b") <= F.col("__p.cut")))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h"))
    inside = F.col("__p.cut").isNull() | (F.col("__b") < F.col("__p.cut"))
    kept = near.withColumn("__r", place).filter(inside | (F.col("__r") <= F.lit(n) - F.col("__p.full")))
    return kept.drop("__h", "__b", "__p", "__r")


def _class_sizes(counts: DataFrame, label: str, within: list[str]) -> DataFrame:
    """Adds the sizes of both classes to per-bucket counts."""
    whole = Window.partitionBy(*within)
    size = lambda y: F.coalesce(F.sum(F.when(F.col(label) == y, F.col("__n"))).over(whole), F.lit(0))
    return counts.withColumns({"__pos": size(1), "__neg": size(0)})


def _balanced_quota(label: str, within: list[str], pos_frac: float):
    def quota(counts: DataFrame) -> DataFrame:
        pos, neg = F.col("__pos"), F.col("__neg")
        need_neg = F.bround(pos * (1 - pos_frac) / pos_frac, 0).cast("long")
        need_pos = F.least(F.bround(neg * pos_frac / (1 - pos_frac), 0).cast("long"), pos)
        of_pos = F.when(need_neg <= neg, pos).otherwise(need_pos)
        of_neg = F.when(need_neg <= neg, need_neg).otherwise(neg)
        wanted = F.when(F.col(label) == 1, of_pos).otherwise(of_neg)
        sized = _class_sizes(counts, label, within)
        return sized.withColumn("__quota", F.when((pos > 0) & (neg > 0), wanted)).drop("__pos", "__neg")

    return quota


def balance_classes(
    df: DataFrame, label: str, key_columns: list[str], pos_frac: float = 0.5, seed=42, max_rows: int | None = None,
) -> DataFrame:
    """Exactly the wanted share of positives, as many rows as the classes allow.

    All of one class and as many of the other as the share asks for; an empty class leaves the table
    as it is. A row limit samples the balanced rows.
    """
    return balance_thresholds(df, {0: label}, key_columns, pos_frac, seed, max_rows).drop("thr")


def balance_thresholds(
    df: DataFrame, labels: dict[int, str], key_columns: list[str], pos_frac: float = 0.5, seed=42,
    max_rows: int | None = None,
) -> DataFrame:
    """``balance_classes`` for several labels at once; column ``thr`` tells which label a row is for.

    The cuts are found on ids and labels alone, for all labels in the same passes; the wide rows are
    read once, compared with the cuts where they are read, and not shuffled.
    """
    if not 0.0 < pos_frac < 1.0:
        raise ValueError("pos_frac must be in (0, 1)")
    pairs = F.array(*[F.struct(F.lit(t).alias("thr"), F.col(c).cast("int").alias("y")) for t, c in labels.items()])

    def tagged(rows: DataFrame) -> DataFrame:
        each = rows.dropna(subset=key_columns).withColumn("__s", F.explode(pairs))
        each = each.select(*rows.columns, F.col("__s.thr").alias("thr"), F.col("__s.y").alias("__y"))
        return _with_bucket(each.filter(F.col("__y").isin(0, 1)), seed, key_columns)

    narrow = tagged(df.select(*key_columns, *dict.fromkeys(labels.values())))
    cuts = _cuts(narrow, ["thr", "__y"], _balanced_quota("__y", ["thr"], pos_frac))

    def chosen(hashed: DataFrame) -> DataFrame:
        near = hashed.join(F.broadcast(cuts), ["thr", "__y"])
        return near.filter(F.col("__stop").isNull() | (F.col("__h") <= F.col("__stop"))).drop("__stop", "__h", "__b", "__y")

    rows = chosen(tagged(df))
    if max_rows is not None:
        cap = f"{seed}-cap"
        limit = _cuts(_with_bucket(chosen(narrow), cap, key_columns), ["thr"], lambda c: c.withColumn("__quota", F.lit(max_rows)))
        near = _with_bucket(rows, cap, key_columns).join(F.broadcast(limit), "thr")
        rows = near.filter(F.col("__stop").isNull() | (F.col("__h") <= F.col("__stop")))
    return rows.select(*df.columns, "thr")


def stratified_cap(df: DataFrame, label: str, key_columns: list[str], max_rows: int, seed=42) -> DataFrame:
    """At most ``max_rows`` rows with the classes' shares kept; a smaller table stays whole."""

    def quota(counts: DataFrame) -> DataFrame:
        pos, neg = F.col("__pos"), F.col("__neg")
        keep_pos = F.bround(F.lit(max_rows) * (pos / (pos + neg)), 0).cast("long")
        keep_pos = F.greatest(F.lit(1), F.least(keep_pos, pos))
        keep_neg = F.greatest(F.lit(1), F.least(F.lit(max_rows) - keep_pos, neg))
        kept = F.when(F.col(label) == 1, keep_pos).otherwise(keep_neg)
        return _class_sizes(counts, label, []).withColumn("__quota", F.when(pos + neg > max_rows, kept)).drop("__pos", "__neg")

    hashed = _with_bucket(df.filter(F.col(label).isin(0, 1)), seed, key_columns)
    return _lowest(hashed, [label], quota)


def trailing_split(df: DataFrame, date: str, last_days: int, inclusive: bool = False, out: str = "is_eval") -> DataFrame:
    """Marks the last N days as evaluation; ``inclusive`` also takes the day N days before the last."""
    cutoff = F.date_sub(df.agg(F.max(date)).scalar(), last_days)
    test = F.col(date) >= cutoff if inclusive else F.col(date) > cutoff
    return df.withColumn(out, F.coalesce(test, F.lit(False)))


def stratified_split(
    df: DataFrame, label: str, key_columns: list[str], parts: dict[str, float], seed=42, out: str = "part",
    clip: tuple[float, float] = (0.05, 0.95),
) -> DataFrame:
    """Assigns each row to a part so that every part has the same class shares.

    ``parts`` maps all parts but the last (given with share 0) to a share of the rows; shares are
    held inside ``clip``. Each class is cut at rounded counts of its hash order, whatever its size; a small class
    may leave a part empty. The cuts are found on ids and labels; rows are compared with them where they are read and
    are not shuffled. Rows without a label or an id go.
    """
    names, ends, share = list(parts), [], 0.0
    for name in names[:-1]:
        share += min(max(parts[name], clip[0]), clip[1])
        ends.append(share)
    known = df.dropna(subset=[label, *key_columns])
    narrow = _with_bucket(known.select(*key_columns, F.col(label).alias("__y")), seed, key_columns)
    each = F.array(*[F.lit(i) for i in range(len(ends))])

    def quota(counts: DataFrame) -> DataFrame:
        size = F.sum("__n").over(Window.partitionBy("__y", "__i"))
        of = F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("__i") + 1)
        return counts.withColumn("__quota", F.round(size * of, 0).cast("long"))

    cuts = _cuts(narrow.withColumn("__i", F.explode(each)), ["__y", "__i"], quota)
    wide = cuts.groupBy("__y").agg(*[F.max(F.when(F.col("__i") == i, F.coalesce("__stop", F.lit("g")))).alias(f"__stop{i}") for i in range(len(ends))])
    near = _with_bucket(known, seed, key_columns).join(F.broadcast(wide), known[label] == wide["__y"])
    choice = None
    for i, name in enumerate(names[:-1]):
        test = F.col("__h") <= F.col(f"__stop{i}")
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return near.select(*df.columns, choice.otherwise(names[-1]).alias(out))
