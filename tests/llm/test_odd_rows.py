"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from tarmac.llm import dedup, mixing, neardup, nearest, packing, quality, sharding, tokens, toxicity, urls
from tarmac.llm.queries import URL_RULES

LONG = "a long tale of nothing in particular, told again. " * 4000
ROWS = [
    (1, None, "en", None, None),
    (2, "", "en", "s", 0),
    (3, "same text here for all", None, "s", 5),
    (4, "same text here for all", "en", "s", 5),
    (4, "same text here for all", "en", "s", 5),
    (5, LONG, "en", "t", 7),
    (6, "idiot, you are a moron. I will kill you", "en", "t", 7),
    (None, "no id at all", "en", "t", 7),
    (7, " \t\n", "en", "t", 7),
    (8, "snow ☃ and <|endoftext|> and   é", "en", "t", 7),
]
CLASH = ("shard", "slot", "size", "key", "kept", "digest", "row", "n", "rate", "copy", "copies", "rank", "score", "label", "ids", "hot_n", "salt", "sig", "_text_sha256")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("1 = 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 0), (3, 1, 0), (6, 0, 1), (6, 0, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_sharding(docs, empty):
    rows = sharding.shard_by_bytes(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    got = by_id(rows)
    assert (got[1][0].size, got[1][0].text_crc32) == (8, 0) == (got[2][0].size, got[2][0].text_crc32)
    assert {got[3][0].shard} == {r.shard for r in got[4]}
    assert sharding.shard_by_bytes(empty, 3).collect() == []


def test_toxicity(docs, empty, labels):
    grammar = toxicity.learn(docs, labels)
    got = by_id(toxicity.score(docs, grammar).collect())
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0].score == got[2][0].score == got[7][0].score
    assert 0 <= got[1][0].score < 0.7 <= got[6][0].score <= 1
    assert toxicity.score(empty, grammar).collect() == []
    assert 6 not in by_id(toxicity.keep_clean(docs, grammar).collect())
    assert toxicity.keep_clean(docs, grammar).columns == docs.columns
    nothing = toxicity.learn(empty, labels.filter("1 = 0"))
    assert by_id(toxicity.score(docs, nothing).collect())[6][0].predicted == 1


def test_tokens(docs, empty):
    got = by_id(tokens.count_tokens(docs).collect())
    assert (got[1][0].n_tokens, got[1][0].n_bytes, got[2][0].n_tokens, got[7][0].n_tokens) == (0, 0, 0, 0)
    assert got[5][0].over_limit and len(got[4]) == 2
    assert tokens.count_tokens(empty).collect() == []


def test_mixing(docs, empty):
    out = mixing.mix(docs)
    rows = out.collect()
    assert set(out.columns) == {*docs.columns, "rate", "copies", "copy", "shuffle_key"}
    assert all(0 <= r.copy < r.copies for r in rows)
    assert mixing.mix(empty).collect() == []


def test_mixing_keeps_columns_of_any_name(docs):
    named = docs.withColumns({c: F.lit(f"own {c}") for c in ("src", "rate", "copies", "copy", "shuffle_key", "_rate", "__src", "cdf", "least", "a.b")})
    only = mixing.mix_only(named).collect()
    assert len(only) == mixing.mix(named).count() > 0 and list(only[0].asDict()) == named.columns
    assert all(r[c] == f"own {c}" for r in only for c in ("src", "rate", "copies", "copy", "shuffle_key", "_rate", "__src", "cdf", "least", "a.b"))
    mixed = mixing.mix(named).collect()
    assert all(r["src"] == "own src" and r["_rate"] == "own _rate" and r["rate"] > 0 and 0 <= r["copy"] < r["copies"] for r in mixed)
    assert sorted(str(r["doc_id"]) for r in mixed) == sorted(str(r["doc_id"]) for r in only)


def test_exact_dedup(docs, empty):
    rows = dedup.exact_dedup(docs).collect()
    got = by_id(rows)
    assert got[1][0].keep_id == got[2][0].keep_id == 2 and got[2][0].kept and not got[1][0].kept
    assert got[3][0].group_size == 3 and sum(r.kept for r in got[4]) == 1
    assert got[None][0].kept
    assert dedup.exact_dedup(empty).collect() == []
    kept = dedup.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "4", "5", "6", "7", "8", "None"])
    assert kept.columns == docs.columns
    assert {r.doc_id for r in dedup.keep_one(docs, "min").collect()} == {1, 3, 5, 6, 7, 8, None}


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "h"), (2, "no scheme", "h"), (3, "http://A.Example.COM/en/x?y#z", "h"), (3, "http://A.Example.COM/en/x?y#z", "h"), (4, "http://x.net", "h"), (None, "://", "h"), (5, "http://" + "a/" * 50_000, "h")],
        "page_id long, url string, token string",
    ).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "n", "tokens")})
    rows = urls.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == 7
    got = {r.page_id: r for r in rows}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[2].host, got[2].path) == ("", "")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[4].path, got[4].rule) == ("", None)
    assert urls.judge_urls(pages.filter("1 = 0"), URL_RULES).collect() == []


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    got = by_id(rows)
    assert got[1][0].length == got[2][0].length == 1
    assert len(got[4]) == 2 and len({(r.sequence_id, r.offset) for r in got[4]}) == 2
    assert packing.pack(empty).collect() == []


def test_quality(docs, empty, labels):
    trees = quality.learn(docs, labels)
    got = by_id(quality.score(docs, trees).collect())
    assert got[1][0].score == got[2][0].score == got[7][0].score and 0 <= got[1][0].score <= 1
    assert quality.score(empty, trees).collect() == []
    half = quality.learn(empty, labels.filter("1 = 0"))
    assert {round(r.score, 6) for r in quality.score(docs, half).collect()} == {0.5}


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, -0.5]), (3, None), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (50, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "dim", "shard", "block", "rank", "score")})
    found = sorted(tuple(r) for r in nearest.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert found == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, -8192)]
    assert nearest.top_k(df.filter("1 = 0"), F.col("vec_id") % 50 == 0).collect() == []
    far = spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50]), (2, [2.0**50 - 4]), (3, [-(2.0**50)])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest.top_k(far, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 3]


def test_near_dedup(docs, empty):
    rows = neardup.near_dedup(docs, 3, 85).collect()
    got = by_id(rows)
    assert len(rows) == len(ROWS)
    assert [got[i][0].n_shingles for i in (1, 2, 7)] == [0, 0, 0]
    assert [got[i][0].component_id for i in (1, 2, 3, 4, 7, None)] == [1, 2, 3, 3, 7, None]
    assert got[None][0].kept and not got[4][0].kept
    assert neardup.near_dedup(empty, 3, 85).collect() == []
    assert {r.doc_id for r in neardup.keep_one_of_each(docs).collect()} == {1, 2, 3, 5, 6, 7, 8, None}
