"""Token counts by a two-tier lookup inside the map tasks; no pre-token is ever shuffled."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import text_of
from tarmac.llm.pretokens import Lengths, once, plain, vocabulary

WORDS = "word_bpe_49k.json"


def frequent_lengths(docs: DataFrame, vocab: str = WORDS, sample: int = 2000, entries: int = 50_000, per_row: int = 500) -> dict[str, int]:
    """Token counts of the most frequent pieces among about ``sample`` rows, chosen by a hash of their place.

    The table only saves work: any other table gives the same counts, so it may come from a bounded
    sample. It has ``entries`` entries at most (some 5 MB), which bounds the broadcast. Each task counts
    the pieces of its own sampled rows and returns its most frequent ones as one row, ``per_row`` for each
    sampled row at most; so the driver sums up ``sample`` times ``per_row`` counts at most (some 20 MB), and no piece
    is shuffled. Rows are chosen by place, not by doc_id, which may repeat.
    """
    every = max(1, docs.count() // sample)
    placed = docs.select(text_of(docs).alias("text"), F.monotonically_increasing_id().alias("place"))
    chosen = placed.filter(F.pmod(F.xxhash64("place", F.lit(5)), F.lit(every)) == 0).select("text")

    def tally(batches):
        seen: Counter = Counter()
        rows = 0
        for pdf in batches:
            rows += len(pdf)
            for text in pdf["text"]:
                if plain(text, ()):
                    seen.update(text.lower().split())
        top = seen.most_common(min(entries, per_row * rows))
        if top:
            yield pd.DataFrame({"pieces": [[p for p, _ in top]], "counts": [[n for _, n in top]]})

    total: Counter = Counter()
    for row in chosen.mapInPandas(tally, "pieces array<string>, counts array<long>").collect():
        total.update(dict(zip(row["pieces"], row["counts"], strict=True)))
    top = sorted((p for p in total if total[p] > 1), key=lambda p: (-total[p], p))[:entries]
    encode = Lengths(vocabulary(vocab))
    return {p: encode.whole(p) for p in top}


def count_tokens(docs: DataFrame, vocab: str = WORDS, limit: int = 2048, frequent: dict[str, int] | None = None) -> DataFrame:
    """Tokens of every whole text, as the tokenizer library gives them without added special tokens.

    Null and empty texts have 0 tokens and 0 bytes. Texts with unusual characters or strings of special
    tokens are encoded whole by the library. Rows repeat as they do in ``docs``; an empty table gives an
    empty table. Other columns are not read. Returns doc_id, n_bytes, n_tokens, over_limit (more than
    ``limit`` tokens).
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocab) if frequent is None else frequent)

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = once(Lengths, vocabulary(vocab), table.value).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    text = text_of(docs)
    counted = docs.select(docs["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
