"""Repeated passages by level-wise doubling: only what is repeated at one length is looked at in twice that length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.bitmaps import bits_of, has
from tarmac.llm.columns import join_groups, text_of
from tarmac.llm.shingles import WordHashes, mixed
from tarmac.session import materialize

#: Bytes of text that are hashed at once, and windows in a row of candidates.
PACK, RUN = 1 << 20, 2048
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_hashes = WordHashes()


def lengths_of(words: int) -> list[int]:
    """Window lengths in words, each at most twice the one before, up to ``words``."""
    return sorted({-(-words // 4), -(-words // 2), words})


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(h: np.ndarray, length: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A hash of each ``length`` consecutive elements, put together from halves; never 0."""

    def poly(n: int) -> tuple[np.ndarray, np.uint64]:
        if n == 1:
            return h, base
        half, power = poly(n // 2)
        m = n // 2
        out, power = half[: len(half) - m] + half[m:] * power, power * power
        if n % 2:
            out, power = out[:-1] + h[n - 1 :] * power, power * base
        return out, power

    if len(h) < length:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mixed(poly(length)[0]) | np.uint64(1)


def sliding(op, x: np.ndarray, size: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``size`` consecutive elements, by doubling."""
    width = 1
    while 2 * width <= size:
        x, width = op(x[:-width], x[width:]), 2 * width
    return op(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def inside(counts: np.ndarray, words: int) -> np.ndarray:
    """For texts put one after the other: whether a window of ``words`` that starts here ends in the same text."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + words <= ends)[: max(0, total - words + 1)]


class Levels:
    """Windows of one pack of texts that may be repeated, judged by the levels known so far.

    A window of ``words`` stands for itself at a shorter length by the smallest hash of that length inside it.
    Equal windows have equal smallest hashes at equal offsets, so a window can only be repeated if that hash is
    found at two places; all other short windows need no count.
    """

    def __init__(self, texts: list[list[bytes]], words: int, lengths: list[int], known: list[np.ndarray]):
        self.words, self.lengths, self.known = words, lengths, known
        self.counts = np.array([len(t) for t in texts], dtype=np.int64)
        self.h = word_hashes([w for t in texts for w in t])
        self.alive = inside(self.counts, words)
        for length, bits in zip(lengths, known, strict=False):
            if self.alive.any():
                low = sliding(np.minimum, window_hashes(self.h, length), words - length + 1)
                self.alive &= has(bits, low)

    def anchors(self) -> np.ndarray:
        """Hashes of the next length at the places that stand for a window still alive, one for each place."""
        if not self.alive.any():
            return np.empty(0, dtype=np.uint64)
        length = self.lengths[len(self.known)]
        h = window_hashes(self.h, length)
        span = self.words - length + 1
        low = np.where(self.alive, sliding(np.minimum, h, span), np.uint64(0))
        edge = np.zeros(span - 1, dtype=np.uint64)
        return h[sliding(np.maximum, np.concatenate([edge, low, edge]), span) == h]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows still alive, and two hashes of each."""
        at = np.flatnonzero(self.alive)
        return at, *(window_hashes(self.h, self.words, b)[at] if len(at) else np.empty(0, np.uint64) for b in _BASES)


def packs(pdf: pd.DataFrame):
    """Row ranges of some ``PACK`` bytes of text; a longer text is a range of its own."""
    size = np.cumsum(pdf["text"].str.len().to_numpy())
    start = 0
    while start < len(pdf):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + PACK, side="right")))
        yield pdf.iloc[start:end]
        start = end


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, tie, text and ``h``: the tie orders texts that share a doc_id, the hash names doc_id and text."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return base.withColumn("tie", F.crc32(F.col("text").cast("binary"))).withColumn("h", F.xxhash64("doc_id", "tie", "text"))


def named(rows: DataFrame) -> DataFrame:
    """With the doc_id as two columns without nulls, which pandas keeps as whole numbers."""
    return rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})


def doc_id() -> Column:
    return F.when(~F.col("no_id"), F.col("id")).alias("doc_id")


def copies_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie) of the texts that an earlier document has as a whole, and ``h`` of all others; both written.

    All windows of a copy also start earlier, so a copy needs no windows, and as its windows also occur in the
    first of the copies, no other text needs them either.
    """
    key = ["digest", "n_bytes"]
    rows = texts.select("doc_id", "tie", "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = materialize(rows, "digests")
    groups = rows.groupBy(*key).agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups, "groups")
    found = join_groups(rows, groups, key, rows.count(), F.col("h"))
    found = materialize(found.select("doc_id", "tie", "h", (F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("copy")), "copies")
    return found.filter("copy").select("doc_id", "tie").distinct(), found.filter("not copy").select("h").distinct()


def repeated(texts: DataFrame, live, known: list, words: int, lengths: list[int]) -> DataFrame:
    """(h): hashes of the next length that stand at two places or more, counted in the tasks first; written."""

    def count(batches):
        for pdf in batches:
            found = []
            for part in packs(pdf[has(live.value, pdf["h"].to_numpy())]):
                found.append(Levels([split(t) for t in part["text"]], words, lengths, [k.value for k in known]).anchors())
            h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    counts = texts.select("text", "h").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return materialize(counts.filter("n > 1").select("h"), "repeated")


def candidates(texts: DataFrame, live, known: list, words: int, lengths: list[int]) -> DataFrame:
    """(doc_id, tie, starts, a, b): windows of full length whose shorter ones are all repeated, up to ``RUN`` in a row; written."""
    schema = "id long, no_id boolean, tie long, starts array<int>, a array<long>, b array<long>"

    def find(batches):
        for pdf in batches:
            for part in packs(pdf[has(live.value, pdf["h"].to_numpy())]):
                level = Levels([split(t) for t in part["text"]], words, lengths, [k.value for k in known])
                at, a, b = level.windows()
                first = np.cumsum(level.counts) - level.counts
                row = np.searchsorted(first, at, side="right") - 1
                # A text without words starts where the next one does; searchsorted takes the last, which has words.
                ids, no_ids, ties = part["id"].tolist(), part["no_id"].tolist(), part["tie"].tolist()
                rows = []
                for r in np.unique(row):
                    low, high = np.searchsorted(row, [r, r + 1])
                    for s in range(low, high, RUN):
                        own = slice(s, min(s + RUN, high))
                        rows.append((ids[r], no_ids[r], ties[r], (at[own] - first[r]).astype(np.int32), a[own].view(np.int64), b[own].view(np.int64)))
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "no_id", "tie", "starts", "a", "b"])

    rows = named(texts).select("id", "no_id", "tie", "text", "h").mapInPandas(find, schema)
    return materialize(rows.select(doc_id(), "tie", "starts", "a", "b"), "candidates")


def covered_starts(found: DataFrame) -> DataFrame:
    """(doc_id, tie, starts): the windows that also start earlier.

    A window's earliest place follows from one grouping by its hashes; all other places of it are covered. The
    earliest places go back to their texts, where the rest of the candidates are the covered ones, so a window
    that stands in a third of all texts costs each task one row.
    """
    each = found.select("doc_id", "tie", F.explode(F.arrays_zip("starts", "a", "b")).alias("w"))
    earliest = each.groupBy("w.a", "w.b").agg(F.min(F.struct("doc_id", "tie", "w.starts")).alias("first"))
    own = earliest.groupBy("first.doc_id", "first.tie").agg(F.collect_list("first.starts").alias("earliest"))
    starts = found.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    same = starts["doc_id"].eqNullSafe(own["doc_id"]) & (starts["tie"] == own["tie"])
    rest = F.when(F.col("earliest").isNull(), F.col("starts")).otherwise(F.array_except("starts", "earliest"))
    joined = starts.join(own, same, "left").select(starts["doc_id"], starts["tie"], F.array_distinct(rest).alias("starts"))
    return joined.filter(F.size("starts") > 0)


def remove_repeats(docs: DataFrame, words: int = 20) -> DataFrame:
    """Each text without the words of passages of ``words`` words or more that also start earlier.

    Words are split at ASCII white space and taken as they are. A window of ``words`` words is covered if the same
    words also start in a document with a smaller doc_id, or earlier in the same one; all words of covered windows
    go. Windows are judged on the input.

    Level by level: short windows that stand at two places or more are found first, then those of twice the length
    among what they leave, up to ``words``, unless no candidate is left. Levels reach the tasks as bitmaps of
    bounded size, which let too much through rather than too little; windows of full length are compared by two
    64-bit hashes.

    Null, empty and blank texts have no words. A null doc_id comes before all others; different texts that share a
    doc_id are documents in the order of a checksum, equal ones are the same document and keep the same words.
    Texts are read whole, whatever their length. An empty table gives an empty table. Other columns are not read.
    Returns doc_id, n_words, n_removed, kept (the words that stay, joined by one space), removed (spans of words
    from, to, the end excluded).
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    copies, rest = copies_of(texts)
    live = spark.sparkContext.broadcast(bits_of(rest))
    lengths, known = lengths_of(words), []
    for _ in lengths[:-1]:
        again = repeated(texts, live, known, words, lengths)
        if again.isEmpty():
            break
        known.append(spark.sparkContext.broadcast(bits_of(again)))
    whole = copies.select("doc_id", "tie", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    if len(known) == len(lengths) - 1:
        found = covered_starts(candidates(texts, live, known, words, lengths))
        same = found["doc_id"].eqNullSafe(copies["doc_id"]) & (found["tie"] == copies["tie"])
        whole = whole.unionByName(found.join(copies, same, "left_anti").select("doc_id", "tie", F.lit(False).alias("whole"), "starts"))
    return cut_out(texts, materialize(whole, "covered"), words)


def cut_out(texts: DataFrame, covered: DataFrame, words: int) -> DataFrame:
    """The texts without the words of their covered windows; ``whole`` marks copies, where each window is covered."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for i, no_id, text, whole, starts in zip(pdf["id"], pdf["no_id"], pdf["text"], pdf["whole"], pdf["starts"], strict=True):
                own = split(text)
                if whole is True and len(own) >= words:
                    edges = [(0, len(own))]
                elif starts is not None and len(starts):
                    change = np.zeros(len(own) + 1, dtype=np.int64)
                    change[starts] += 1
                    change[np.asarray(starts) + words] -= 1
                    gone = np.r_[0, np.cumsum(change)[:-1] > 0, 0]
                    edges = np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist()
                else:
                    edges = []
                kept, at = [], 0
                for a, b in edges:
                    kept += own[at:a]
                    at = b
                kept += own[at:]
                rows.append((i, no_id, len(own), len(own) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [{"from": a, "to": b} for a, b in edges]))
            yield pd.DataFrame(rows, columns=["id", "no_id", "n_words", "n_removed", "kept", "removed"])

    same = texts["doc_id"].eqNullSafe(covered["doc_id"]) & (texts["tie"] == covered["tie"])
    joined = named(texts.join(covered, same, "left").select(texts["doc_id"], "text", "whole", "starts")).drop("doc_id")
    done = joined.mapInPandas(cut, "id long, no_id boolean, n_words long, n_removed long, kept string, removed array<struct<from:int,to:int>>")
    return done.select(doc_id(), "n_words", "n_removed", "kept", "removed")
