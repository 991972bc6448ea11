"""Exact de-duplication by a tree of merged digest runs (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import join_groups, text_of
from tarmac.session import materialize

KEY = ("digest", "n_bytes", "check")
ROUNDS = 3


def merge_runs(runs: DataFrame, n_runs: int, keep: str = "max", rounds: int = ROUNDS) -> DataFrame:
    """One row per key from runs that hold ``run``, the key, ``best`` and ``n``.

    Each round merges the runs whose numbers share their upper bits; the number of bits is chosen so
    that ``rounds`` rounds end in one run, whatever the number of partitions. Every input task first
    folds its own rows to one per key (the sorted run), so a hot text costs a row per task and round.
    """
    best = F.max if keep == "max" else F.min
    bits = max(1, math.ceil(math.log2(max(2, n_runs)) / rounds))
    while True:
        runs = (
            runs.withColumn("run", F.shiftright("run", bits))
            .groupBy("run", *KEY)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
        n_runs = -(-n_runs // (1 << bits))
        if n_runs <= 1:
            return runs.drop("run")


def digests(docs: DataFrame) -> DataFrame:
    """A written narrow table: doc_id, digest (SHA-256), byte length, a second hash, row and run number.

    Texts are taken as equal if the digest, the length and the independent second hash all agree.
    """
    text = text_of(docs)
    return materialize(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("run"),
        ),
        "digests",
    )


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """Equal texts: which row stays, and how many there are. One row per row of ``docs``.

    ``keep`` is ``max`` or ``min``: the largest or smallest doc_id stays. Null and empty texts are equal.
    A null doc_id is smaller than any other under ``max`` and under ``min`` too. Rows that repeat id and
    text: exactly one of them stays. An empty table gives an empty table. Other columns of ``docs`` are
    not read. Returns doc_id, keep_id, group_size, kept, text_sha256, row.
    """
    rows = digests(docs)
    total, last = rows.agg(F.count("*"), F.max("run")).first()
    runs = rows.select("run", *KEY, F.struct("doc_id", "row").alias("best"), F.lit(1).cast("long").alias("n"))
    merged = merge_runs(runs, (last or 0) + 1, keep).filter("n > 1")
    groups = materialize(merged.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"), "groups")

    found = join_groups(rows, groups, KEY, total or 0, F.col("row"))
    size, single = F.col("n"), F.col("n").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    row = F.when(single, F.col("row")).otherwise(F.col("keep_row"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
        (row == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def keep_one(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat id and text one stays, whichever; such rows alone are shuffled with their texts.
    """
    decided = exact_dedup(docs, keep).filter(F.col("kept") | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    decided = materialize(decided.select("doc_id", "text_sha256", "kept"), "kept")
    marks = decided.filter("kept").select("doc_id", "text_sha256")
    again = decided.filter("not kept").select("doc_id", "text_sha256").distinct()
    digest = "_text_sha256"
    while digest in map(str.lower, docs.columns):
        digest += "_"
    named = docs.withColumn(digest, F.sha2(text_of(docs).cast("binary"), 256))

    def among(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left["doc_id"].eqNullSafe(right["doc_id"]) & (left[digest] == right["text_sha256"]), how)

    stay = among(named, marks, "left_semi")
    if not again.isEmpty():
        once = among(named, again, "left_semi").dropDuplicates(["doc_id", digest])
        stay = among(stay, again, "left_anti").unionByName(once)
    return stay.drop(digest)
