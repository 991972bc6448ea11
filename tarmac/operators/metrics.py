"""Evaluation tables and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.times import col
from tarmac.operators.ordered import running_totals, value_bucket


def reliability_table(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Count, mean prediction and positive rate per right-closed bin; p = 0 is in the first."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p)))
    number = F.greatest(F.ceil(clipped * bins), F.lit(1)).cast("int")
    table = (
        df.dropna(subset=[p]).withColumns({"__p": clipped, "bin": number}).groupBy("bin")
        .agg(
            F.count("*").alias("count"), F.avg("__p").alias("mean_pred"),
            F.avg(F.col(label).cast("double")).alias("empirical_pos_rate"),
        )
    )
    left, right = (F.col("bin") - 1) / bins, F.col("bin") / bins
    return table.withColumns({"bin_left": left, "bin_right": right, "bin_mid": (left + right) / 2})


def confusion_matrix(df: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("y"), (F.col(p) >= threshold).cast("int").alias("pred")).agg(
        F.count("*").alias("n")
    )


def classification_report(df: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cells = df.select(F.col(label).cast("int").alias("y"), (F.col(p) >= threshold).cast("int").alias("pred"))
    sides = cells.select(
        F.explode(F.array(F.struct(F.lit(0).alias("c")), F.struct(F.lit(1).alias("c")))).alias("s"), "y", "pred"
    ).select(F.col("s.c").alias("class"), "y", "pred")
    hit = (F.col("y") == F.col("class")) & (F.col("pred") == F.col("class"))
    table = sides.groupBy("class").agg(
        F.sum(hit.cast("long")).alias("tp"),
        F.sum((F.col("pred") == F.col("class")).cast("long")).alias("predicted"),
        F.sum((F.col("y") == F.col("class")).cast("long")).alias("support"),
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    both = precision + recall
    return table.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        F.when(both > 0, 2 * precision * recall / both).otherwise(0.0).alias("f1"), "support",
    )


def curve(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row per distinct score, highest first: positives and negatives at and above it."""
    points = df.dropna(subset=[p]).groupBy(F.col(p).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    return running_totals(
        points, [], value_bucket("score"), ["score"], {"tp": "pos", "fp": "neg"}, descending=True, totals=True
    )


def ranking_scores(df: DataFrame, label: str, p: str) -> DataFrame:
    """AUC, average precision and the threshold with the largest TPR - FPR, in one row.

    Ties are one point of the curve. Without both classes AUC and AP are null. The first (highest)
    of several best thresholds wins; infinity when no threshold beats chance.
    """
    merged = curve(df, label, p).withColumns(
        {"__p": F.nullif(F.col("tp_all"), F.lit(0)).cast("double"), "__n": F.nullif(F.col("fp_all"), F.lit(0)).cast("double")}
    )
    tpr, fpr = F.col("tp") / F.col("__p"), F.col("fp") / F.col("__n")
    pairs = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    best = F.max(F.struct((tpr - fpr).alias("j"), F.col("score"), tpr.alias("tpr"), fpr.alias("fpr")))
    out = merged.agg(
        (F.sum(pairs) / (F.first("__p") * F.first("__n"))).alias("auc"),
        (F.sum(F.col("pos") * precision) / F.first("__p")).alias("average_precision"),
        best.alias("b"),
    )
    some = F.col("b.j") > 0
    return out.select(
        "auc", "average_precision",
        F.when(some, F.col("b.score")).otherwise(F.lit(float("inf"))).alias("youden_threshold"),
        F.when(some, F.col("b.tpr")).otherwise(0.0).alias("youden_tpr"),
        F.when(some, F.col("b.fpr")).otherwise(0.0).alias("youden_fpr"),
    )


def probability_scores(df: DataFrame, label: str, p: str, threshold: float = 0.5, clip: float = 1e-6) -> DataFrame:
    """Log-loss, Brier score and accuracy of a binary prediction."""
    y, q = F.col(label).cast("double"), F.col(p).cast("double")
    safe = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), q))
    return df.agg(
        F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("logloss"),
        F.avg((q - y) * (q - y)).alias("brier"),
        F.avg(((q >= threshold).cast("double") == y).cast("double")).alias("accuracy"),
    )


def bin_scores(df: DataFrame, true_bin: str, bins: str, labels=C.BIN_LABELS, clip: float = 2.220446049250313e-16) -> DataFrame:
    """Five-class log-loss and accuracy of the delay distribution."""
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(true_bin)).cast("int")
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.element_at(F.col(bins), index)))
    first = F.array_position(F.col(bins), F.array_max(bins)).cast("int")
    return df.agg(F.avg(-F.log(p)).alias("bin_logloss"), F.avg((first == index).cast("double")).alias("bin_accuracy"))


def bin_accuracy(df: DataFrame, true_bin: str, pred_bin: str) -> DataFrame:
    """Rows per true and predicted bin."""
    return df.groupBy(true_bin, pred_bin).agg(F.count("*").alias("n"))
