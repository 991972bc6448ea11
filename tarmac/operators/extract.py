"""Counts mentioned in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C


def _pattern_hits(text: Column, regex: str, method: str, confidence: float, order: int) -> Column:
    snippets = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.transform(
        snippets,
        lambda s: F.struct(
            F.lit(confidence).alias("confidence"), F.regexp_extract(s, regex, 1).cast("int").alias("value"),
            F.lit(order).alias("order"), F.lit(method).alias("method"), s.alias("snippet"),
        ),
    )


def extract_count_patterns(
    df: DataFrame, text: str, noun: str = "gates", patterns=C.COUNT_PATTERNS, low: int = 1, high: int = 2000,
) -> DataFrame:
    """Adds the best count of ``noun`` in a text: value, method, confidence, notes.

    Works on arrays inside the row, so that whole texts are read once per pattern and nothing is
    shuffled. The steps are columns of their own: each pattern runs once, however often its matches
    are looked at.
    """
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    by_pattern = [
        _pattern_hits(F.col("__flat"), "(?i)" + p.replace("{noun}", noun), m.replace("{noun}", noun), confidence, -rank)
        for rank, (p, m, confidence) in enumerate(patterns)
    ]
    hits = df.withColumn("__flat", flat).withColumn("__hits", F.flatten(F.array(*by_pattern))).drop("__flat")
    hits = hits.withColumn("__found", F.filter("__hits", lambda h: h["value"].between(low, high))).drop("__hits")
    order = F.transform("__found", lambda h: F.struct(h["confidence"], h["value"], h["order"], h["method"], h["snippet"]))
    staged = hits.withColumns(
        {
            "__best": F.array_max(order),
            "__values": F.array_sort(F.array_distinct(F.transform("__found", lambda h: h["value"]))),
        }
    )
    best, conflict = F.col("__best"), F.size("__values") > 1
    notes = F.concat(F.lit("matched snippet: '"), best["snippet"], F.lit("'"))
    listed = F.concat(
        notes, F.lit(" | multiple candidates: ["),
        F.array_join(F.transform("__values", lambda v: v.cast("string")), ", "), F.lit("]"),
    )
    none = best.isNull()
    return staged.withColumns(
        {
            "value": best["value"],
            "method": F.when(none, "no_match").otherwise(best["method"]),
            "confidence": F.when(none, 0.0)
            .when(conflict, F.greatest(F.lit(0.4), best["confidence"] - 0.15)).otherwise(best["confidence"]),
            "notes": F.when(none, "No count pattern matched").when(conflict, listed).otherwise(notes),
        }
    ).drop("__found", "__best", "__values")
