"""Quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import text_of
from tarmac.llm.labelled import SAMPLE, labelled_sample, remainder

# Frequent function words, English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were "
    "de la le et les des en un du une que est pour qui dans par sur au plus pas ne se ce il sont "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "el y los del las por con no su para al lo como más o pero sus".split()
)

BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.15


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all are 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    n = int(raw.sum())
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(lines)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    pairs = Counter(zip(words, words[1:], strict=False))
    letters = int(raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum())
    low = Counter({w.lower(): k for w, k in counts.items()})
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        letters / n,
        int(raw[48:58].sum()) / n,
        int(raw[65:91].sum()) / n,
        int(raw[128:].sum()) / n,
        int(raw[[44, 46, 59, 58, 33, 63, 39, 34]].sum()) / n,
        int(raw[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]].sum()) / n,
        int(raw[124]) / len(words),
        int(raw[46]) / len(words),
        len(counts) / len(words),
        counts.most_common(1)[0][1] / len(words),
        sum(k for k in pairs.values() if k > 1) / len(words),
        sum(k for k in seen.values() if k > 1) / len(lines),
        sum(len(x) * (k - 1) for x, k in seen.items()) / n,
        sum(k for w, k in low.items() if w in FUNCTION_WORDS) / len(words),
        sum(k for w, k in counts.items() if not w[-1].isalnum()) / len(words),
        sum(k for w, k in counts.items() if not any(map(str.isalpha, w))) / len(words),
        sum(1 for x in lines if x.rstrip()[-1] in ".!?\"”»") / len(lines),
        n / len(lines),
    ]


NAMES = (
    "log_bytes log_words log_lines word_mean word_sd word_max letters digits capitals beyond_ascii punctuation symbols bars stops "
    "distinct top_word repeated_pairs repeated_lines repeated_bytes function_words unfinished no_letter ended line_bytes"
).split()


class Trees(NamedTuple):
    """Complete binary trees as arrays of (tree, node): the children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = 5.0) -> Trees:
    """Boosting of logistic loss; every split is found on histograms of gradients over quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    bias = math.log(share / (1 - share))
    out = np.full(n, bias)
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    feature, cut, value = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            index = ((at - first)[:, None] * (width * bins) + flat).ravel()
            size = many * width * bins
            gs = np.bincount(index, np.repeat(g, width), size).reshape(many, width, bins).cumsum(2)
            hs = np.bincount(index, np.repeat(h, width), size).reshape(many, width, bins).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            node = at
            at = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        gl, hl = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[t] = -rate * gl / (hl + 1)
        out += value[t, at]
    return Trees(feature, cut, value, bias)


def traverse(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Probabilities: all trees and rows go down one level at a time."""
    at = np.zeros((len(x), len(trees.feature)), dtype=np.int64)
    tree, row = np.arange(len(trees.feature)), np.arange(len(x))[:, None]
    for _ in range(int(math.log2(trees.feature.shape[1] + 1))):
        at = 2 * at + 1 + (x[row, trees.feature[tree, at]] > trees.cut[tree, at])
    return 1 / (1 + np.exp(-np.clip(trees.bias + trees.value[tree, at].sum(1), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 0, parts: int = 5, limit: int = SAMPLE) -> Trees:
    """Trees from up to ``limit`` labels whose crc32 remainder by ``parts`` is not ``held_out``.

    The statistics are computed in Spark; the driver gets ``limit`` rows of two dozen numbers. Without labels
    the trees are one leaf that says a half.
    """
    sample = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), parts) != held_out, limit)

    def measure(batches):
        for pdf in batches:
            out = pd.DataFrame([statistics(t) for t in pdf["text"]], columns=NAMES)
            yield out.assign(y=pdf["y"].to_numpy())

    found = sample.mapInPandas(measure, ", ".join(f"{n} double" for n in NAMES) + ", y int").toPandas()
    if not len(found):
        found = pd.DataFrame([[0.0] * len(NAMES) + [0], [0.0] * len(NAMES) + [1]], columns=[*NAMES, "y"])
    return fit_trees(found[NAMES].to_numpy(), found["y"].to_numpy(dtype=float))


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """Score 0 to 1 and decision for every whole text: doc_id, score, predicted (score >= ``threshold``).

    Null and empty texts have statistics of 0 and get the score of those. Rows repeat as in ``docs``; an
    empty table gives an empty table. Only doc_id and text are read, and doc_id never reaches the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(traverse(shared.value, np.array([statistics(t) for t in texts])))

    scored = docs.select(docs["doc_id"].alias("doc_id"), rate(text_of(docs)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
