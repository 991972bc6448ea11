"""Source divergence, fill-in-middle and repeated passages against plain Python, on odd rows and on hot groups."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import bitmaps, divergence, fim, substrings

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
CLASH = ("h", "tie", "term", "n", "p", "q", "v", "rank", "value", "form", "output", "starts", "digest", "kept", "whole", "copy", "w")
LONG = "a long tale of nothing in particular, told again. " * 4000
ROWS = [
    (1, None, "en", None),
    (2, "", None, "s"),
    (3, "same text here for all of you and me", "en", "s"),
    (4, "same text here for all of you and me", "en", "t"),
    (4, "same text here for all of you and me", "en", "t"),
    (5, LONG, "en", "t"),
    (6, "snow ☃ and <S> é", "de", "t"),
    (None, "same text here for all of you and me", "en", "t"),
    (7, " \t\n", "en", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH})


def divergence_by_hand(rows, least, top):
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [(s, collections.Counter(t.translate(LOWER) for t in TERM.findall(x))) for x, at, s in rows if at == lang]
        df = collections.Counter(t for _, c in own for t in c)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)
        counts = {s: sum((c for at, c in own if at == s), collections.Counter()) for s in {s for s, _ in own}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, v=v, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * v) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, n in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:n]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("least", [1, 2, 50])
def test_divergence_of_odd_rows(docs, least):
    got = divergence.source_divergence(docs, least, 3).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == divergence_by_hand(ROWS, least, 3)
    assert divergence.source_divergence(docs.filter("1 = 0")).collect() == []


def test_divergence_with_a_hot_source_and_many_copies(spark):
    draw = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ünïcode", "ABC", "日本"]
    rows = []
    for i in range(1500):
        text = "copied in all sources" if i % 3 == 0 else " ".join(draw.choices(vocabulary[: 100 + i % 200], k=draw.randrange(30)))
        rows.append((i, text, "xy"[i % 7 == 0], "hot" if i % 2 else f"s{i % 11}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    assert {tuple(r) for r in divergence.source_divergence(df).collect()} == divergence_by_hand(rows, 10, 10)


def test_tally_flushes_and_sums(monkeypatch, docs):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    assert {tuple(r) for r in divergence.source_divergence(docs, 1, 3).collect()} == divergence_by_hand(ROWS, 1, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["abc", "Z", " ", ".", "é", "☃", "\n", "𝔘", "passage of some length, ", "x" * 5000]), max_size=60), st.integers(0, 400))
def test_places_of_units(parts, k):
    text = "".join(parts)
    units = UNIT.findall(text)
    cutter = fim.Cutter(text, fim.Chunks(memory=50))
    assert cutter.n == len(units)
    assert cutter.place(min(k, cutter.n)) == len("".join(units[:k]))


def test_chunks_are_shared_and_bounded():
    draw = random.Random(1)
    passage = "".join(draw.choices("abcdefgh ,.", k=3000))
    chunks = fim.Chunks()
    fim.Cutter("one start. " + passage, chunks)
    seen = len(chunks.young)
    fim.Cutter("another, longer start of it: " + passage + " and an end", chunks)
    assert len(chunks.young) <= seen + 3
    few = fim.Chunks(memory=1000)
    for i in range(200):
        fim.Cutter(f"{i} " * 400, few)
    assert sum(map(len, few.young)) <= 1000 + fim.LONGEST and sum(map(len, few.old)) <= 1000 + fim.LONGEST


def fim_by_hand(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def test_fill_in_middle(spark, docs):
    key = lambda r: str(r)
    assert sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=key) == sorted((fim_by_hand(r[0], r[1]) for r in ROWS), key=key)
    assert fim.fill_in_middle(docs.filter("1 = 0")).collect() == []
    texts = [(i, "<" * (i % 5) + "S> <P <M " + "ab cd☃" * (i % 17) + "<") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, fim.fill_in_middle(df).collect()), key=key) == sorted((fim_by_hand(*r) for r in texts), key=key)


def repeats_by_hand(rows, words):
    """Literally: covered if the same words start at a smaller (document, start). Rows share no doc_id here unless equal."""
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for doc_id, w in split:
        for i in range(len(w) - words + 1):
            at = (doc_id is not None, doc_id or 0, i)
            first[tuple(w[i : i + words])] = min(at, first.get(tuple(w[i : i + words]), at))
    out = []
    for doc_id, w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if first[tuple(w[i : i + words])] < (doc_id is not None, doc_id or 0, i):
                gone |= set(range(i, i + words))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def found(docs, words):
    rows = substrings.remove_repeats(docs, words).collect()
    for r in rows:
        assert sum(b - a for a, b in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


@pytest.mark.parametrize("words", [1, 2, 3, 5, 8, 20])
def test_repeats_of_odd_rows(docs, words):
    assert found(docs, words) == repeats_by_hand(ROWS, words)
    if words == 20:
        assert substrings.remove_repeats(docs.filter("1 = 0")).collect() == []


@pytest.mark.parametrize("words,size", [(4, 3), (7, 4), (20, 2)])
def test_repeats_among_few_words(spark, words, size):
    draw = random.Random(words)
    passages = [" ".join(draw.choices("abcd"[:size], k=draw.randrange(3 * words))) for _ in range(30)]
    rows = [(i, "\n".join(draw.choices(passages, k=draw.randrange(4))) + " " + " ".join(draw.choices("abcdef", k=draw.randrange(20)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, words) == repeats_by_hand(rows, words)


def test_a_passage_in_all_texts_and_a_hot_text(spark):
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{i} start {passage} {draw.random()} end") for i in range(1500)]
    rows += [(2000 + i, "a hot copy " * 9) for i in range(1500)] + [(9000, " ".join(f"u{i}" for i in range(50_000)) + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert found(df, 20) == repeats_by_hand(rows, 20)


def test_texts_that_share_an_id_are_ordered(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(1, passage + " x"), (1, passage + " y"), (1, passage + " y")], "doc_id long, text string")
    got = found(df, 20)
    assert sorted(r[2] for r in got) in ([0, 0, 25], [0, 25, 25])


def test_saturated_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "bits_of", lambda hashes: np.full(4096, 255, np.uint8))
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("abc", k=30))) for i in range(100)] + [(200, "a b"), (201, "c " * 40), (202, "c " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 6) == repeats_by_hand(rows, 6)


def test_bitmap_loses_no_hash(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    df = spark.createDataFrame([(int(x),) for x in h], "h long")
    for most in (1 << 27, 1 << 15):
        bits = bitmaps.bits_of(df, most=most)
        assert bitmaps.has(bits, h).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    assert bitmaps.has(bitmaps.bits_of(df), other).mean() < 0.1
