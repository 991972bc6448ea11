"""Names to codes: aliases, allowed airports and substring search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.text import alias_normalize, extract_code, key_text
from tarmac.functions.times import col

#: Hash ranges that the postings of a piece are cut into.
BLOCKS = 256


def alias_table(names: DataFrame, code: str, candidates: list) -> DataFrame:
    """One row per normalised alias; of two codes with one alias the later in code order wins."""
    texts = F.array_distinct(F.array_compact(F.array(*[alias_normalize(c) for c in candidates])))
    rows = names.select(F.col(code).alias("code"), F.explode(texts).alias("alias")).filter("alias <> ''")
    return rows.groupBy("alias").agg(F.max("code").alias("code"))


def resolve_alias(queries: DataFrame, text: str, aliases: DataFrame, allowed: DataFrame, length: int, out: str = "code") -> DataFrame:
    """A code found in the text, else the alias's code, else the plain text; only allowed codes count."""
    valid = allowed.select(F.col(allowed.columns[0]).alias("__c")).distinct()
    side = aliases.select(F.col("alias").alias("__a"), F.col("code").alias("__ac"))
    asked = queries.withColumns(
        {"__x": extract_code(text, length), "__a": alias_normalize(text), "__p": key_text(text)}
    ).join(side, "__a", "left")
    for source in ("__x", "__ac", "__p"):
        hit = valid.select(F.col("__c").alias(source), F.lit(True).alias(f"{source}_ok"))
        asked = asked.join(hit, source, "left")
    picked = F.coalesce(*[F.when(F.col(f"{s}_ok"), F.col(s)) for s in ("__x", "__ac", "__p")], F.lit(""))
    return asked.withColumn(out, picked).drop("__x", "__a", "__p", "__ac", "__x_ok", "__ac_ok", "__p_ok")


def allowed_pairs(requests: DataFrame, rankings: DataFrame, airline: str, origin: str, dest: str, out: str = "airports_n") -> DataFrame:
    """The smallest list size whose list holds both ends of the request; null when there is none.

    A code's list sizes are collected per airline; there are as many as ranking files per airline.
    """
    sizes = rankings.groupBy(F.col("airline").alias("__al"), F.col("code").alias("__co")).agg(
        F.collect_set("n").alias("__sizes")
    )

    def side(name: str, end: str) -> DataFrame:
        return sizes.select(F.col("__al").alias(airline), F.col("__co").alias(end), F.col("__sizes").alias(name))

    joined = requests.join(side("__o", origin), [airline, origin], "left").join(side("__d", dest), [airline, dest], "left")
    return joined.withColumn(out, F.array_min(F.array_intersect("__o", "__d"))).drop("__o", "__d")


def set_union_codes(parts: list[DataFrame], code: str) -> DataFrame:
    """Distinct codes of several tables, sorted."""
    out = parts[0].select(code)
    for p in parts[1:]:
        out = out.union(p.select(code))
    return out.distinct().orderBy(code)


def _grams(text, size: int):
    last = F.length(text) - (size - 1)
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def search_topk(queries: DataFrame, query_id: str, text: str, names: DataFrame, name_id: str, search_text: str, k: int = 8) -> DataFrame:
    """The first k names, in ``name_id`` order, whose text contains the query; empty queries match all.

    Instead of testing every pair, names are indexed by their 1- to 3-character pieces; the index holds
    ids. A query is joined on the rarest of its pieces, block of ids by block; a block is a hash range of ids, so
    a piece that is in most names is spread over as many tasks. A query of up to three characters is a piece
    itself: its postings are the answer, and every task keeps the first k of them before they are
    brought together. Longer ones are verified. Equal queries are searched once. ``name_id`` must be unique.
    """
    asked = queries.withColumn("__q", alias_normalize(text))
    unique = asked.select("__q").distinct()
    normal = alias_normalize(search_text)
    entries = names.select(F.col(name_id).alias("__id"), normal.alias("__text"))
    pieces = F.array_distinct(F.flatten(F.array(*[_grams(F.col("__text"), n) for n in (1, 2, 3)])))
    index = entries.select("__id", F.explode(pieces).alias("__g")).withColumn("__block", F.pmod(F.xxhash64("__id"), F.lit(BLOCKS)))
    order = Window.partitionBy("__q").orderBy("__id")
    first = lambda hits: hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    blocks = index.groupBy("__g", "__block").agg(F.count("*").alias("__n")).groupBy("__g").agg(F.sum("__n").alias("__f"), F.collect_set("__block").alias("__blocks"))
    own = F.when(F.length("__q") <= 3, F.array("__q")).otherwise(_grams(F.col("__q"), 3))
    needed = unique.filter("__q <> ''").select("__q", F.explode(F.array_distinct(own)).alias("__g"))
    known = needed.join(blocks, "__g", "left")
    rarest = known.groupBy("__q").agg(F.min_by(F.struct("__g", "__blocks"), F.struct(F.coalesce("__f", F.lit(0)), "__g")).alias("__r"))
    wanted = rarest.select("__q", F.col("__r.__g").alias("__g"), F.explode("__r.__blocks").alias("__block"))
    postings = lambda those: wanted.filter(those).join(index, ["__g", "__block"]).select("__q", "__id")
    top_short = first(postings("length(__q) <= 3"))
    verified = postings("length(__q) > 3").join(entries, "__id").filter(F.contains(F.col("__text"), F.col("__q")))
    top_long = first(verified.select("__q", "__id"))

    every = entries.select("__id").orderBy("__id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("__id")))
    found = top_long.unionByName(top_short).unionByName(every.select(F.lit("").alias("__q"), "__id", "rank"))
    return asked.select(query_id, "__q").join(found, "__q").select(query_id, "rank", F.col("__id").alias(name_id))
