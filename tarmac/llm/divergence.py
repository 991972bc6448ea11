"""Divergence of a language's sources: identical texts are collapsed first, pairs of sources are evaluated sparsely."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.bitmaps import bits_of, has
from tarmac.session import materialize

#: Bytes of UTF-8 that belong to no term become spaces, A-Z become a-z; every byte of a character beyond ASCII stays.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries that a task keeps before it hands its sums on, and rows of a batch.
ENTRIES, ROWS = 1_000_000, 20_000
SCALE = 1_000_000_000
TALLY = "lang string, term string, sources array<string>, docs array<long>, n array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


class Tally:
    """Occurrences and documents of each term by language and source."""

    def __init__(self):
        self.sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, terms: list[bytes], source: str, times: int = 1) -> None:
        n, docs = self.sums.setdefault((lang, source), (Counter(), Counter()))
        before = len(n)
        if times == 1:
            n.update(terms)
            docs.update(set(terms))
        else:
            for term, k in Counter(terms).items():
                n[term] += times * k
                docs[term] += times
        self.size += len(n) - before

    def batches(self):
        """A row for each language and term, with its sources in arrays."""
        by_lang: dict[str, list] = {}
        for (lang, source), own in self.sums.items():
            by_lang.setdefault(lang, []).append((source, *own))
        self.sums, self.size = {}, 0
        for lang, groups in by_lang.items():
            number: dict[bytes, int] = {}
            at = np.array([number.setdefault(t, len(number)) for _, n, _ in groups for t in n], dtype=np.int64)
            order = np.argsort(at, kind="stable")
            docs = np.array([docs[t] for _, n, docs in groups for t in n], dtype=np.int64)[order]
            n = np.array([k for _, n, _ in groups for k in n.values()], dtype=np.int64)[order]
            source = np.repeat(np.arange(len(groups)), [len(n) for _, n, _ in groups])[order]
            ends = np.r_[0, np.cumsum(np.bincount(at, minlength=len(number)))]
            terms, names = list(number), pa.array([s for s, _, _ in groups], pa.string())
            for low in range(0, len(terms), ROWS):
                high = min(low + ROWS, len(terms))
                own, offsets = slice(ends[low], ends[high]), pa.array(ends[low : high + 1] - ends[low], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (names.take(pa.array(source[own])), pa.array(docs[own]), pa.array(n[own]))]
                columns = [pa.array([lang] * (high - low), pa.string()), pa.array(terms[low:high], pa.binary()).cast(pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "docs", "n"])


def texts_of(docs: DataFrame) -> DataFrame:
    """lang, source and text without nulls, and a hash of language and text."""
    named = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.withColumn("h", F.xxhash64("lang", "text"))


def tally_texts(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, docs, n): sums of each task, every distinct text of a language read once.

    A bitmap holds the hashes of texts that occur again. Texts without their bit are counted where they are
    read. The others are grouped by language and text, with their number in each source, and counted once
    for all of these; only they are shuffled.
    """
    texts = texts_of(docs)
    again = materialize(texts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(again))

    def single(batches):
        tally = Tally()
        for batch in batches:
            alone = pa.array(~has(bits.value, batch.column("h").to_numpy()))
            for row in zip(*[batch.column(c).filter(alone) for c in ("lang", "text", "source")], strict=True):
                lang, text, source = (v.as_py() for v in row)
                tally.add(lang, terms_of(text), source)
                if tally.size > ENTRIES:
                    yield from tally.batches()
        yield from tally.batches()

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        return pd.Series(has(bits.value, h.to_numpy()))

    def collapsed(batches):
        tally = Tally()
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("lang", "text", "sources", "times")], strict=True):
                lang, text, sources, times = (v.as_py() for v in row)
                terms = terms_of(text)
                for source, n in zip(sources, times, strict=True):
                    tally.add(lang, terms, source, n)
                    if tally.size > ENTRIES:
                        yield from tally.batches()
        yield from tally.batches()

    key = ["lang", "digest", "n_bytes", "h"]
    copies = texts.filter(repeated("h")).select(
        "lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("n_bytes"), "h", "source", "text"
    )
    by_source = copies.groupBy(*key, "source").agg(F.count("*").alias("n"))
    sources = by_source.groupBy(*key).agg(F.collect_list(F.struct("source", "n")).alias("s"))
    once = copies.groupBy(*key).agg(F.min("text").alias("text")).join(sources, key)
    once = once.select("lang", "text", F.col("s.source").alias("sources"), F.col("s.n").alias("times"))
    return texts.mapInArrow(single, TALLY).unionByName(once.mapInArrow(collapsed, TALLY))


def kept_terms(tallies: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, total, lead): the terms in ``least`` documents of their language or more; written.

    All rows of a term meet by one shuffle. ``total`` counts the term in the language, ``lead`` is 1 in one row a term.
    """
    rows = tallies.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "docs", "n")).alias("e"))
    sums = rows.groupBy("lang", "term", F.col("e.sources").alias("source")).agg(F.sum("e.docs").alias("docs"), F.sum("e.n").alias("n"))
    term = Window.partitionBy("lang", "term")
    wide = sums.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("total"), F.min("source").over(term).alias("low"))
    kept = wide.filter(F.col("all_docs") >= least)
    return materialize(kept.select("lang", "term", "source", "n", "total", (F.col("source") == F.col("low")).cast("long").alias("lead")), "kept_terms")


def share(n: str, all_n: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (all_n + 2 * terms)), exactly; 0 where no term is kept."""
    return F.expr(f"CASE WHEN {terms} = 0 THEN 0 ELSE 1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({all_n} + 2 * {terms} AS DECIMAL(21, 0)) END")


def divergence(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def exact(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_terms(entries: DataFrame) -> DataFrame:
    """(lang, x, y, value): for each pair of sources x < y, what their common terms add to the sum over single ones.

    ``entries`` holds (lang, term, source, p, p0) for every term that a source has. A task walks the sorted entries
    and keeps a sum for each pair; the pairs of a term are never rows.
    """

    def walk(batches):
        sums: dict[tuple, int] = {}
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            last = ((pdf["lang"] == pdf["lang"].iloc[-1]) & (pdf["term"] == pdf["term"].iloc[-1])).to_numpy()
            rest = pdf[last]
            add_pairs(pdf[~last], sums)
            if len(sums) > ENTRIES:
                yield pairs_frame(sums)
                sums = {}
        if rest is not None:
            add_pairs(rest, sums)
        if sums:
            yield pairs_frame(sums)

    placed = entries.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return placed.mapInPandas(walk, "lang string, x string, y string, value long")


def pairs_frame(sums: dict) -> pd.DataFrame:
    keys = list(sums)
    return pd.DataFrame({"lang": [k[0] for k in keys], "x": [k[1] for k in keys], "y": [k[2] for k in keys], "value": list(sums.values())})


def add_pairs(pdf: pd.DataFrame, sums: dict) -> None:
    """Whole terms, sorted by language, term and source: neighbours at each distance within a term are its pairs."""
    if not len(pdf):
        return
    new = np.r_[True, (pdf["lang"].to_numpy()[1:] != pdf["lang"].to_numpy()[:-1]) | (pdf["term"].to_numpy()[1:] != pdf["term"].to_numpy()[:-1])]
    term = np.cumsum(new)
    p, p0 = pdf["p"].to_numpy(np.int64), pdf["p0"].to_numpy(np.int64)
    group, groups = pd.factorize(pd.MultiIndex.from_frame(pdf[["lang", "source"]]))
    for d in range(1, int(np.bincount(term).max())):
        a = np.flatnonzero(term[:-d] == term[d:])
        b = a + d
        value = exact(p[a], p[b]) - exact(p[a], p0[b]) - exact(p0[a], p[b]) + exact(p0[a], p0[b])
        pair, at = np.unique(group[a] * len(groups) + group[b], return_inverse=True)
        total = np.zeros(len(pair), dtype=np.int64)
        np.add.at(total, at, value)
        for k, v in zip(pair.tolist(), total.tolist(), strict=True):
            (lang, x), (_, y) = groups[k // len(groups)], groups[k % len(groups)]
            sums[lang, x, y] = sums.get((lang, x, y), 0) + v


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, x, y, value): the sum of ``divergence`` over all kept terms for each two sources x < y of a language.

    A term that neither source has adds the same each time; a term of one of them adds as its count says, which
    is taken once for each distinct count; ``shared_terms`` corrects the terms that both have.
    """
    other = groups.select("lang", F.col("source").alias("o"), F.col("p0").alias("q0"))
    two = groups.join(other, "lang").filter("source < o")
    none = two.select("lang", F.col("source").alias("x"), F.col("o").alias("y"), F.expr(f"CASE WHEN v = 0 THEN 0 ELSE v * ({divergence('p0', 'q0')}) END").alias("value"))
    counts = entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    one = counts.join(other, "lang").filter("source <> o")
    added = F.expr(f"k * (({divergence('p', 'q0')}) - ({divergence('p0', 'q0')}))")
    one = one.select("lang", F.least("source", "o").alias("x"), F.greatest("source", "o").alias("y"), added.alias("value"))
    parts = none.unionByName(one).unionByName(shared_terms(entries))
    return parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """How far the sources of each language are apart, and which terms set a source off from its language.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in
    ``least`` of its documents or more. All arithmetic is exact. Part ``pair`` gives each source every other one
    of its language, part ``term`` its ``top`` terms that are more frequent than in the language.

    Null text, lang and source count as ''. Empty texts count for their group only, so a group without terms has
    pairs and no terms; a language that keeps no term has pairs of value 0. Repeated rows count each time. Ties
    go to the smaller item. An empty table gives an empty table. Other columns are not read.
    Returns lang, source, part, item, value, rank.
    """
    kept = kept_terms(tally_texts(docs), least)
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    occurring = texts_of(docs).select("lang", "source").distinct()
    groups = occurring.join(langs, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "own_n"])
    groups = materialize(groups.withColumn("p0", share("0", "own_n", "v")), "groups")

    facts = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_n", "v"))
    entries = facts.select("lang", "term", "source", "p", "p0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    values = pair_values(entries, groups)
    ways = [values.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value") for a, b in (("x", "y"), ("y", "x"))]
    pairs = ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(by_value))

    terms = facts.withColumn("q", share("total", "lang_n", "v")).filter("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
