"""Operators against plain Python on whole small tables, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import DATA, compare, connect
from tarmac.llm import mixing, neardup, nearest, packing, sharding, tokens, toxicity, urls
from tarmac.llm.components import components
from tarmac.llm.pretokens import Ids, Lengths, vocabulary
from tarmac.llm.quality import fit_trees, traverse
from tarmac.llm.queries import ORACLES, QUERIES
from tarmac.llm.shingles import odd_sketch

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, con, name):
    _, problem = compare(spark, con, name, SF, QUERIES, ORACLES)
    assert problem is None


def test_shards_are_near_equal_and_groups_whole(spark):
    rows = [(i, "hot " * 30) for i in range(3000)] + [(3000 + i, f"text {i // 3} " * (i % 40)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_by_bytes(docs, 8).toPandas().merge(docs.toPandas(), on="doc_id")
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.03 * sizes.mean() and sizes.min() >= 0.97 * sizes.mean()
    cut = found.groupby("text")["shard"].nunique()
    assert set(cut[cut > 1].index) <= {"hot " * 30}
    for _, s in found.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_grammar():
    symbols = toxicity.Symbols(toxicity.Lexicon({}, {}))
    weight = lambda text: toxicity.text_weights(text, symbols)[1]
    assert weight("what a lovely day. the kettle will whistle") == 0
    assert weight("you are an idiot") > weight("the idiot") > weight("she said the idiot") > 0
    assert weight("you are not an idiot") < weight("the idiot")
    assert weight("i will hurt you") > 0 and weight("i will hurt my back") == 0 and weight("fires hurt you") == 0
    assert weight("idiot moron") > weight("idiot. moron.")


def test_grammar_reads_all_white_space():
    symbols = toxicity.Symbols(toxicity.Lexicon({}, {}))
    weights = lambda text: toxicity.text_weights(text, symbols)
    plain = weights("you are an idiot.\ni will hurt you.\nfine")
    assert plain[0] > 0
    assert weights("you\tare\tan\tidiot.\ni\twill\thurt\tyou.\nfine") == plain
    assert weights("you are an idiot.\r\ni will hurt you.\r\nfine") == plain
    assert weights("you are an idiot.\ri will hurt you.\rfine") == plain
    assert weights("you\xa0are\u3000an\xa0idiot.\u2028i\xa0will\xa0hurt\xa0you.\x85fine") == plain
    assert weights("idiot\r\nmoron") == weights("idiot\nmoron") != weights("idiot\tmoron") == weights("idiot moron")


def test_toxicity_on_held_out_labels(spark):
    held = QUERIES["op2_toxicity"](spark, f"{DATA}/sf0.1").filter("held_out").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id")
    right, clean_hit = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert right > 0.96 and clean_hit < 0.01


def test_quality_on_held_out_labels(spark):
    held = QUERIES["op8_quality"](spark, f"{DATA}/sf0.1").filter("held_out").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = fit_trees(x[:3000], y[:3000])
    assert ((traverse(trees, x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_frequent_pieces_come_from_a_bounded_sample(spark):
    rows = [(None if i % 3 else 7, f"common word{i % 11} only{i} " + "common " * (i % 4)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    pieces = collections.Counter(p for _, t in rows for p in t.split())
    encode = Lengths(vocabulary(tokens.WORDS))
    assert tokens.frequent_lengths(docs) == {p: encode.whole(p) for p, n in pieces.items() if n > 1}
    top = tokens.frequent_lengths(docs, entries=1)
    assert list(top) == ["common"]
    # Rows of one doc_id, or of none, are sampled like any others: a tenth of them has few of the rare pieces twice.
    fewer = tokens.frequent_lengths(docs.select("doc_id", F.concat("text", F.lit(" "), "text").alias("text")), sample=90)
    rare = [p for p in fewer if p.startswith("only")]
    assert 40 < len(rare) < 180 and "common" in fewer


def test_token_counts(spark, texts):
    library = Lengths(vocabulary(tokens.WORDS)).library
    for r in QUERIES["op3_token_counts"](spark, SF).collect():
        want = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(texts[r.doc_id].encode()), want > 2048)


odd_texts = st.text(alphabet=st.one_of(st.sampled_from("aZé \n\t .,'!1²ªß’İ́\x1c\x85☃"), st.characters(exclude_categories=["Cs"])), max_size=40)
pieces = st.lists(st.one_of(odd_texts, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "don't", "word.", "x,,", "  "])), max_size=6).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_encodings_equal_the_library(text):
    words, ids = _encoders()
    assert words.count(text) == words.whole(text)
    assert ids.encode(text) == ids.whole(text)


def _encoders(made=[]):  # noqa: B006
    if not made:
        made.extend([Lengths(vocabulary(tokens.WORDS)), Ids(vocabulary(packing.BYTES))])
    return made


def test_mix_reaches_its_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "a" if i % 3 else "b") for i in range(9000)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in mixed}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.02 and abs(sum(n.values()) / 9000 - 1) < 0.05


def test_mix_of_tiny_sources_beside_a_large_one(spark):
    rows = [(i, "x" * 20_000, "large") for i in range(400)] + [(1000 + i, None, None) for i in range(1)] + [(2000 + i, "y", "tiny") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {}
    for r in mixing.mix(docs).collect():
        found.setdefault((r.source, r.rate), collections.Counter())[r.doc_id] += 1
        assert r.copies > r.copy >= 0
    rates = {source: rate for source, rate in found}
    assert set(rates) == {"large", None, "tiny"} and rates[None] > 2000 and rates["tiny"] > 1000
    for (source, rate), copies in found.items():
        if source != "large":
            for doc, n in copies.items():
                u = (int(hashlib.md5(f"mix-1|{doc}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                c = itertools.accumulate(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(2 * rate)))
                assert n == sum(x < u for x in c)


def test_far_distribution_function():
    for rate in (701.0, 12_345.6, 3e6):
        cdf = np.array(mixing.far_cumulative(rate))
        at = int(rate) - int(rate - 8 * math.sqrt(rate) - 24)
        assert (np.diff(cdf) >= 0).all() and abs(cdf[-1] - 1) < 1e-8 and cdf[0] < 1e-14
        assert abs(cdf[at] - cdf[at - 1] - math.exp(int(rate) * math.log(rate) - rate - math.lgamma(int(rate) + 1))) < 1e-8


def test_packing_round_trip(spark, texts):
    rows = QUERIES["op7_config_packing"](spark, SF).toPandas()
    ids = _encoders()[1]
    for doc, own in rows.sort_values("piece").groupby("doc_id"):
        whole = ids.whole(texts[doc]) + packing.END
        assert own.length.sum() == len(whole) // 4 and (own.length[1:] == 1024).all() and own.piece.tolist() == list(range(len(own)))
        for r in own.itertuples():
            assert zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and (s.length.cumsum() - s.length == s.offset).all()
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 1024 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=20))
def test_plans_hold_the_stock(histogram):
    runs = packing.plan_sequences(histogram, 64, 60)
    filled, held = collections.Counter(), collections.Counter()
    order = sorted(zip(runs["length"], runs["rank"], runs["base"], runs["per"], runs["offset"], strict=True))
    for length, n in histogram.items():
        own = [o for o in order if o[0] == length]
        for rank in range(n):
            _, r, base, per, _ = [o for o in own if o[1] <= rank][-1]
            filled[base + (rank - r) // per] += length
            held[length] += 1
    assert max(filled.values()) <= 64 and held == histogram
    stock = np.bincount(list(histogram), list(histogram.values()), 65).astype(np.int64)
    alone, stock[64] = stock[64], 0
    assert len(filled) <= alone + sum(n for _, n in packing.best_fit(stock, 64))


def test_top_k_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 40)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nearest, "LEAF", 4)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 5)), 1)
    v[100:160] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * v).astype(int)
    want = set()
    for q in range(0, 300, 10):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(300) if c != q)[:5]
        want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(best)}
    assert {tuple(r) for r in nearest.top_k(df, F.col("vec_id") % 10 == 0).collect()} == want


def exact_components(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        s = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
        sets[i] = s
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_near_dedup"](spark, SF).collect()}
    assert got == exact_components(texts, 3, 85)


def test_near_duplicates_in_a_large_group(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 5), replace=False):
            words[at] = f"e{rng.integers(1 << 30)}"
        texts[i] = " ".join(words)
    for i in range(400, 600):
        texts[i] = " ".join(f"u{rng.integers(1 << 30)}" for _ in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = exact_components(texts, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_dedup(docs, 5, 80).collect()}
    assert sum(got[i] != want[i] for i in texts) <= 1


def test_near_duplicate_pairs_inside_a_large_group(spark):
    texts = {}
    for family in range(300):
        shared = [f"w{i}" for i in range(100)] + [f"f{family}x{i}" for i in range(10)]
        for own in (0, 1):
            texts[2 * family + own] = " ".join(shared + [f"o{family}x{own}x{i}" for i in range(12)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = exact_components(texts, 1, 80)
    assert len({c for _, c in want.values()}) == 300
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_dedup(docs, 1, 80).collect()}
    assert got == want


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(7)
    for size in (3, 40, 900, 6000):
        pool = rng.integers(1, 1 << 63, 2 * size, dtype=np.uint64)
        x, y = pool[:size], pool[size // 9 : size // 9 + size]
        differ = sum(((a ^ b) % (1 << 64)).bit_count() for a, b in zip(odd_sketch(x), odd_sketch(y), strict=True))
        assert differ <= len(np.setxor1d(x, y))
    assert [neardup.trees_for(p) for p in (80, 85, 50)] == [16, 12, 21]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    found = {r.a: r.m for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 200)}}


def test_mined_rules(spark):
    rules = (urls.Rule("block", "ads.test", "/"), urls.Rule("allow", "good.test", "/"))
    seen = [f"http://{h}/{w}/{i}" for i in range(40) for h, w in (("ads.test", "bets/win"), ("good.test", "news/win"), ("good.test", "bets/how"))]
    pages = spark.createDataFrame(list(enumerate([*seen, "http://x.org/bets/win/9", "http://x.org/news/9", "http://x.org/bets/how"])), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, rules).collect()}
    assert [got[i].verdict for i in range(3)] == ["block", "allow", "allow"]
    assert [got[len(seen) + i].verdict for i in range(3)] == ["block", "allow", "allow"]
    brute = collections.Counter(frozenset(t) for t in (["h:ads", "p:bets", "p:win"], ["h:good", "p:news", "p:win"], ["h:good", "p:bets", "p:how"]))
    assert sum(n for s, n in brute.items() if {"p:bets", "p:win"} <= s) == 1  # only blocked pages hold both


def test_fixed_rules_against_python(spark, con):
    import re

    from tarmac.llm.queries import URL_RULES

    want = {}
    for page, url in con.execute("SELECT page_id, url FROM pages").fetchall():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
        fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        want[page] = (host, path, best and best.host + best.path, best and best.verdict)
    for r in QUERIES["op6_url_rules"](spark, SF).collect():
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


@pytest.mark.parametrize("most", [5, 18])
def test_mined_rules_against_counting(spark, most):
    rng = np.random.default_rng(most)
    words = [f"p:w{i}" for i in range(30)]
    pages = []
    for _ in range(300):
        tokens = sorted(set(rng.choice(words, size=most, p=np.arange(1, 31) / 465)))
        bad = {"p:w29", "p:w28"} <= set(tokens) or "p:w5" in tokens
        pages.append((tokens, int(bad if rng.random() < 0.97 else not bad), int(rng.integers(1, 4))))
    labelled = spark.createDataFrame(pages, "tokens array<string>, y int, n long")
    support, confidence, gain = 0.03, 0.9, 0.02
    got = {tuple(r["items"]): (r["confidence"], r["n"]) for r in urls.mine_rules(labelled, support, confidence, gain).collect()}
    total = sum(n for _, _, n in pages)

    def counts(items):
        rows = [(y, n) for tokens, y, n in pages if set(items) <= set(tokens)]
        return sum(n for _, n in rows), sum(y * n for y, n in rows)

    assert got
    for items, (sure, n) in got.items():
        of, bad = counts(items)
        assert (n, sure) == (bad, pytest.approx(bad / of)) and bad >= support * total and sure >= confidence
    if most <= 12:
        least, kept, level = support * total, {}, [()]
        while level:
            longer = {tuple(sorted((*items, w))) for items in level for w in words if w not in items}
            level = [items for items in longer if counts(items)[1] >= least]
            kept |= {items: counts(items)[1] / counts(items)[0] for items in level}
        subs = lambda items: [kept[s] for s in itertools.combinations(items, len(items) - 1) if s]
        want = {i for i, c in kept.items() if c >= confidence and all(c >= s + gain for s in subs(i))}
        assert set(got) == want


def test_top_k_far_out_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 40)
    monkeypatch.setattr(nearest, "LEAF", 4)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 3))
    v[rng.random(size=v.shape) < 0.1] *= 2.0**24  # products of the largest components wrap a long
    v[50:60] *= 2.0**60
    v[60:70] = v[55]
    v[70] = [1e308, -1e308, 1e308]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [rows[20], rows[20], (40, [0.5, 0.5, 0.5]), (10, []), (11, []), (12, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(Fraction(c) * 256) for c in x]) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(whole):
        others = [(-sum(s * t for s, t in zip(x, y)), c) for b, (c, y) in enumerate(whole) if b != a and len(x) == len(y)]
        if q % 10 == 0:
            want += [(q, i + 1, c, max(-nearest.LIMIT, min(nearest.LIMIT, -s))) for i, (s, c) in enumerate(sorted(others)[:5])]
    assert sorted(tuple(r) for r in nearest.top_k(df, F.col("vec_id") % 10 == 0).collect()) == sorted(want)
