"""Fill-in-middle documents; cuts are found from counts of content-defined chunks that a worker remembers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import text_of

_UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
_RUN = re.compile("[A-Za-z]+")
#: Characters that the rolling hash sees, the share of places at which it cuts, and the longest chunk.
WINDOW, EVERY, LONGEST = 16, 8, 4096
#: Characters of all chunks that one generation of a worker's memory holds.
MEMORY = 16_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks of a text that is not empty: where a hash of the last ``WINDOW`` characters says so, or after ``LONGEST``.

    Equal passages are cut alike wherever they stand.
    """
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) * _MIX
    base, width = _BASE, 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            longer = h.copy()
            longer[width:] += h[:-width] * base
            h, base, width = longer, base * base, 2 * width
        cuts = np.flatnonzero((h * _MIX) >> np.uint64(64 - EVERY) == 0) + 1
    ends = []
    before = 0
    for end in [*cuts.tolist(), len(text)]:
        ends.extend(range(before + LONGEST, end, LONGEST))
        if end > before:
            ends.append(end)
        before = end
    return ends


class Chunks:
    """Summaries of chunks by their content: units, and whether the first and the last character is a letter.

    Two generations of bounded size: a chunk seen again moves to the young one, the old one is dropped when the young one is full.
    """

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.young: dict[str, tuple[int, bool, bool]] = {}
        self.old: dict[str, tuple[int, bool, bool]] = {}

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summarize(chunk)
            if self.held > self.memory:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found


def letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def summarize(chunk: str) -> tuple[int, bool, bool]:
    runs = _RUN.findall(chunk)
    return len(chunk) - len("".join(runs)) + len(runs), letter(chunk[0]), letter(chunk[-1])


class Cutter:
    """Units of a text and the places after given numbers of them, from the summaries of its chunks."""

    def __init__(self, text: str, chunks: Chunks):
        self.text = text
        self.ends = chunk_ends(text) if text else []
        self.begun, self.joined = [], []  # units begun up to the end of each chunk; whether its first belongs to one before
        total, inside, start = 0, False, 0
        for end in self.ends:
            n, first, last = chunks.summary(text[start:end])
            self.joined.append(inside and first)
            total += n - self.joined[-1]
            self.begun.append(total)
            inside, start = last, end
        self.n = total

    def place(self, k: int) -> int:
        """Characters of the first ``k`` units: where unit k + 1 begins."""
        if k >= self.n:
            return len(self.text)
        at = int(np.searchsorted(self.begun, k + 1))
        start = self.ends[at - 1] if at else 0
        skip = k - (self.begun[at - 1] if at else 0) + self.joined[at]
        for i, unit in enumerate(_UNIT.finditer(self.text, start, self.ends[at])):
            if i == skip:
                return unit.start()
        raise AssertionError("counts and text differ")


_chunks: list[Chunks] = []


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. No piece holds a marker, so the first of each kind is the one that was put in."""

    def rebuilt(first: str, second: str, prefix_first: bool) -> Column:
        i = F.locate(second, output)
        j = F.call_function("locate", F.lit("<M>"), output, i + 3)
        one, two = F.substr(output, F.lit(len(first) + 1), i - len(first) - 1), F.substr(output, i + 3, j - i - 3)
        middle = F.substr(output, j + 3)
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(form == "plain", output).when(form == "psm", rebuilt("<P>", "<S>", True)).otherwise(rebuilt("<S>", "<P>", False))


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Each text with its middle moved to the end, cut between units (runs of ASCII letters and single other characters).

    Two hashes of the doc_id choose the cuts, two the form: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is
    <S>suffix<P>prefix<M>middle. A text stays ``plain`` if it is empty, holds a marker or is drawn so.

    Null texts count as empty. A null doc_id draws as the empty string does; rows that share a doc_id draw alike. Texts
    are read whole, whatever their length. An empty table gives an empty table. Other columns are not read.
    Returns doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output, restored.
    """

    @F.pandas_udf("n long, prefix long, middle long")
    def cut(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        if not _chunks:
            _chunks.append(Chunks())
        rows = []
        for text, a, b in zip(texts, one, two, strict=True):
            c = Cutter(text, _chunks[0])
            low, high = sorted((a % (c.n + 1), b % (c.n + 1)))
            first = c.place(low)
            rows.append((c.n, first, c.place(high) - first))
        return pd.DataFrame(rows, columns=["n", "prefix", "middle"], dtype="int64")

    h1, h2, h3, h4 = draws(docs["doc_id"], seed)
    text = F.col("text")
    base = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = text.contains("<P>") | text.contains("<S>") | text.contains("<M>")
    plain = (text == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = base.select("doc_id", "text", form.alias("form"), cut("text", "h1", "h2").alias("c"))
    prefix = F.substr("text", F.lit(1), F.col("c.prefix").cast("int"))
    middle = F.substr("text", (F.col("c.prefix") + 1).cast("int"), F.col("c.middle").cast("int"))
    suffix = F.substr("text", (F.col("c.prefix") + F.col("c.middle") + 1).cast("int"))
    psm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle)
    spm = F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    cut_chars = lambda c: F.when(F.col("form") != "plain", F.col(f"c.{c}"))
    rows = rows.select("doc_id", F.col("c.n").alias("n"), "form", cut_chars("prefix").alias("prefix_chars"), cut_chars("middle").alias("middle_chars"), output.alias("output"))
    return rows.withColumn("restored", restore(F.col("output"), F.col("form")))
