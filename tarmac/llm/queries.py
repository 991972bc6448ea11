"""Registered queries of the operators, and the SQL they must equal where SQL can express them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import dedup, divergence, fim, mixing, neardup, nearest, packing, quality, sharding, substrings, tokens, toxicity, urls
from tarmac.llm.labelled import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules of the URL query: verdict, host, path.
URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def ship_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it; a cluster has it by --py-files as well."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def query(sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_sampled_splitters(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)


@query()
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out=1, parts=3), 0.7)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query()
def op3_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.WORDS, 2048)


@query(
    """
WITH sizes AS (
  SELECT source, greatest(sum(coalesce(strlen(text), 0)), count(*)) AS b FROM documents GROUP BY source
), w AS (SELECT *, sqrt(b) AS w FROM sizes),
all_w AS (SELECT sum(b) AS b, CAST(sum(CAST(w AS DECIMAL(38, 9))) AS DOUBLE) AS w FROM w),
rates AS (SELECT source, round(w.w * (all_w.b / all_w.w) / w.b, 9) AS rate FROM w, all_w),
pmf AS (
  SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 8 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM rates)
), cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (
  SELECT d.doc_id, d.source, (CAST('0x' || substr(md5('mix-1|' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.source, c.rate, CAST(count(*) FILTER (WHERE c.c < d.u) AS INTEGER) AS copies
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source, c.rate
)
SELECT doc_id, source, rate, copies, CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('mix-1|order|' || doc_id || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM counted WHERE copies > 0)
"""
)
def op4_poisson_mix(spark, sf_dir):
    """The mix's rows without their texts: weights are the square roots of the sources' bytes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), power=0.5, seed="mix-1")
    return mixed.select("doc_id", "source", "rate", "copies", "copy", "shuffle_key")


@query(
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
)
def op5_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), "max").drop("row")


@query()
def op6_url_rules(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op7_config_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing.BYTES, 1024)


@query()
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels"), held_out=0, parts=5), 0.3)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
)
def op9_exact_top_k(spark, sf_dir):
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256)


@query()
def op10_near_dedup(spark, sf_dir):
    return neardup.near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


@query(
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), tf AS (SELECT r, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM tf GROUP BY lang, term HAVING count(*) >= 10),
size AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
occurs AS (SELECT lang, source, term, sum(n) AS n FROM tf GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(o.n, 0) AS n
  FROM grp g JOIN kept k USING (lang) LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), own AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL),
p AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 2)) // (own.n + 2 * size.v) AS p,
    1 + (1000000000::HUGEINT * (c.total + 2)) // (size.n + 2 * size.v) AS q
  FROM cells c JOIN own USING (lang, source) JOIN size USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), all_parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM all_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
)
def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least=10, top=10)


@query(
    """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), u AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), cuts AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n, units, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), pieces AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces
"""
)
def op12_fill_in_middle(spark, sf_dir):
    done = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed="1", plain_percent=10, spm_percent=20)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query(
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS n FROM d),
seen AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq FROM w
), late AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS covered FROM seen WHERE i + 19 <= n
), marked AS (
  SELECT w.doc_id, w.i, w.word, max(CASE WHEN l.covered THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN late l ON l.doc_id = w.doc_id AND l.i = w.i
), kept AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
)
def op13_substring_dedup(spark, sf_dir):
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"), words=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
