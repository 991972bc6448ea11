"""A bounded sample of labelled texts, and logistic regression on a few features of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import text_of
from tarmac.session import materialize

#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) modulo ``parts``; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = SAMPLE) -> DataFrame:
    """(y, text) of up to ``limit`` labelled documents, the same ones on every run; written.

    ``learn`` says, from the labels table, which rows may be learned from. Null labels are left out; of
    several labels of a document the largest counts. The chosen ids are broadcast: ``limit`` bounds them.
    """
    chosen = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_id")
    texts = docs.select(docs["doc_id"].alias("_doc"), text_of(docs).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("y", "text"), "labelled")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of the columns and a bias by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
