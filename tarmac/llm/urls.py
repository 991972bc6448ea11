"""Verdicts on URLs: given rules first, then association rules that FP-growth mines (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import join_groups
from tarmac.session import materialize

BLOCKED = "!block"
#: Copies of one transaction that a row is unfolded to at once.
COPIES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host (h:) and words of the path (p:), numbers left out."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, words), lambda x: (F.length(x) > 2) & ~x.rlike(r"^p:\p{N}+$")))


def under_rarest(sets: DataFrame, labelled: DataFrame) -> DataFrame:
    """(token, sets): the rows of ``sets`` (items and more) under the rarest of their tokens."""
    counts = labelled.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("k"))
    named = sets.withColumn("token", F.explode("items")).join(counts, "token", "left")
    first = named.groupBy(*sets.columns).agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "token"))["token"].alias("token"))
    return first.groupBy("token").agg(F.sort_array(F.collect_list(F.struct(*sets.columns))).alias("sets"))


def held(tokens: Column) -> Column:
    """Those of the column ``sets`` whose items are all among the tokens."""
    return F.filter("sets", lambda s: F.size(F.array_except(s["items"], tokens)) == 0)


def recount(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """(items, confidence, n) of token sets: in how many labelled pages that hold the set it means ``block``, and the share of these."""
    asked = labelled.select("tokens", "y", "n", F.explode("tokens").alias("token")).join(under_rarest(found, labelled), "token")
    seen = asked.select("y", "n", F.explode(held(F.col("tokens"))["items"]).alias("items"))
    bad = F.sum(F.col("y") * F.col("n"))
    return seen.groupBy("items").agg((bad / F.sum("n")).alias("confidence"), bad.alias("n"))


def mine_rules(labelled: DataFrame, support: float = 0.002, confidence: float = 0.9, gain: float = 0.02, width: int = 12) -> DataFrame:
    """(items, confidence, n): token combinations that mean ``block``, from rows of (tokens, y, n).

    ``n`` is how many pages a row stands for. A transaction holds the ``width`` tokens that tell most about
    the label among those with the support; this bounds the combinations of a page by 2^``width`` whatever
    its URL. A rule stays if its support and confidence suffice and it is surer by ``gain`` than each
    rule with one token less. Candidates come from these cut transactions; their supports and confidences are counted
    again over all tokens of all pages (``recount``). A token with the support is in ``support`` of the pages, so there are no
    more of these than tokens a page / ``support``.
    """
    total, bad = labelled.agg(F.sum("n"), F.sum(F.when(F.col("y") == 1, F.col("n")))).first()
    least, base = support * (total or 0), (bad or 0) / max(1, total or 0)
    if not bad:
        return labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, n long")
    counts = labelled.select(F.explode("tokens").alias("token"), "y", "n").groupBy("token").agg(F.sum("n").alias("k"), F.sum(F.col("y") * F.col("n")).alias("b"))
    telling = counts.filter(F.col("k") >= least).select("token", (F.abs(F.col("b") / F.col("k") - base) * F.sqrt("k")).alias("tells"))
    found = labelled.withColumn("id", F.monotonically_increasing_id())
    found = materialize(found, "labelled")
    strong = found.select("id", F.explode("tokens").alias("token")).join(telling, "token").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("tells")).alias("w"), "token"))), 1, width)["token"].alias("items"))
    baskets = found.join(strong, "id").select("items", "y", "n").groupBy("items", "y").agg(F.sum("n").alias("n"))
    # Equal transactions are one row with a weight; FP-growth wants them one by one. A heavy one is dealt
    # out in chunks first, so no task holds all its copies.
    marked = baskets.select(F.when(F.col("y") == 1, F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items")).alias("items"), "n")
    chunks = marked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    chunks = chunks.repartition(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "items", "at")
    copies = chunks.select(F.explode(F.array_repeat("items", F.least(F.lit(COPIES), F.col("n") - F.col("at")).cast("int"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(copies)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "itemsets")
    found = sets.filter(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"))
    rules = materialize(recount(found, labelled), "rules")
    less = rules.filter("size(items) > 1").select("items", F.explode("items").alias("out")).select("items", F.expr("array_remove(items, out)").alias("sub"))
    best = less.join(rules.select(F.col("items").alias("sub"), F.col("confidence").alias("c")), "sub").groupBy("items").agg(F.max("c").alias("c"))
    kept = rules.filter(F.col("confidence") >= confidence).join(best, "items", "left")
    return kept.filter(F.col("c").isNull() | (F.col("confidence") >= F.col("c") + gain)).select("items", "confidence", "n")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """Host, path, fitting rule and verdict of each page.

    Pages that a given rule decides are the labels for mining; the other pages are blocked if a mined rule
    holds for their tokens, else allowed. Each distinct (host, path) is judged once.

    Null URLs and those without :// have empty host and path, no rule, and are allowed. Repeated pages get
    equal rows. Without labels, or on an empty table, nothing is mined. Other columns are not read.
    Returns page_id, host, path, rule, verdict, mined_confidence (null unless a mined rule decided).
    """
    url = pages["url"].cast("string")
    read = pages.select(pages["page_id"].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = materialize(read.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "given.rule", "given.verdict"), "pages")
    places = seen.groupBy("host", "path", "verdict").agg(F.count("*").alias("n"))
    places = materialize(places.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))), "places")
    labelled = places.filter("verdict is not null").select("tokens", (F.col("verdict") == "block").cast("int").alias("y"), "n")
    labelled = materialize(labelled.groupBy("tokens", "y").agg(F.sum("n").alias("n")), "labels")
    mined = materialize(mine_rules(labelled, support, confidence), "mined")
    index = under_rarest(mined, labelled)

    open_ = places.filter("verdict is null")
    holds = F.array_max(F.transform(held(F.col("tokens")), lambda r: r["confidence"]))
    hit = open_.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(index, "token").select("host", "path", holds.alias("c"))
    hit = hit.filter("c is not null").groupBy("host", "path").agg(F.max("c").alias("mined_confidence"))
    groups = materialize(open_.join(hit, ["host", "path"]).select("host", "path", "n", "mined_confidence"), "verdicts")
    judged = join_groups(seen, groups, ("host", "path"), seen.count(), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    verdict = F.coalesce("verdict", F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_confidence")
