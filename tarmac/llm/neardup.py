"""Near-duplicates by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import join_groups, text_of
from tarmac.llm.components import components, nearby_labels
from tarmac.llm.shingles import SKETCH, TOKENS, minwise, odd_sketch, set_keys, shared, shingle_set, two_bits
from tarmac.session import materialize

SET = ("set_a", "set_b", "n_shingles")
LEAF = 32
#: Tokens that name a node, and the chance with which a pair at the threshold may meet in no tree.
DEPTH = 3
MISSED = 2e-5
ROUNDS = 4
FIRST_PIVOTS = 4
PIVOTS = 8
#: Comparisons that are made in one node without branching on.
FEW = 4_096
#: Comparisons of a node that one task makes, as far as SLICES tasks suffice.
SLICE, SLICES = 1 << 20, 32


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """A written narrow table: doc_id, number of shingles, two names of the set, its minwise tokens, two bits of each."""

    def read(batches):
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(text, words)
                sig = minwise(s) if len(s) else None
                rows.append((d, len(s), *set_keys(s), sig, *(two_bits(sig) if sig else (0, 0))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bit0", "bit1"]).astype({"doc_id": "Int64"})

    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return materialize(pairs.mapInPandas(read, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bit0 long, bit1 long"), "fingerprints")


def id_bits(ids: DataFrame, per_id: int = 16, most: int = 1 << 27) -> np.ndarray:
    """A bitmap of hashed ids: ``per_id`` bits for each, ``most`` bits (16 MB) at most whatever their number."""
    size = min(most, max(1 << 15, per_id * ids.count()) + (1 << 15) - 1 >> 15 << 15)
    at = F.pmod(F.xxhash64("id"), F.lit(size))
    words = ids.groupBy((at / (1 << 15)).cast("long").alias("w")).agg(F.bitmap_construct_agg((at % (1 << 15)).cast("long")).alias("bits"))
    out = np.zeros((size >> 15, 1 << 12), dtype=np.uint8)
    for r in words.toLocalIterator():
        out[r["w"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, size, sketch, hashes): the full shingle sets of the documents in ``ids`` and of few others, from whole texts; written.

    Texts are not shuffled: each task keeps the rows whose id has its bit set.
    """
    shared_bits = docs.sparkSession.sparkContext.broadcast(id_bits(ids))

    def read(batches):
        bits = shared_bits.value
        for pdf in batches:
            at = pdf["h"].to_numpy() % (8 * len(bits))
            own = pdf[(bits[at >> 3] >> (at & 7) & 1).astype(bool)]
            for start in range(0, len(own), 500):
                part = own.iloc[start : start + 500]
                found = [shingle_set(t, words) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "size": [len(s) for s in found], "sketch": [odd_sketch(s) for s in found], "hashes": [s.astype("<u8").tobytes() for s in found]})

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text")).filter("id is not null")
    return materialize(texts.withColumn("h", F.xxhash64("id")).mapInPandas(read, "id long, size long, sketch array<long>, hashes binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; written."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([100 * both >= percent * all_ for both, all_ in map(shared, x, y)], dtype="bool")

    left, right = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
    return materialize(pairs.distinct().join(left, "a").join(right, "b").filter(similar("hashes_a", "hashes_b")).select("a", "b"), "similar")


def likely(a, b, percent: int):
    """Whether two documents agree in as many tokens as similar ones do, less five deviations.

    Two bits of a token agree by chance with 1/4; a pair at the threshold is lost with a chance of 10^-6.
    """
    q = percent / 100 + (1 - percent / 100) / 4
    least = int(TOKENS * q - 5 * math.sqrt(TOKENS * q * (1 - q)))
    differ = a["bit0"].bitwiseXOR(b["bit0"]).bitwiseOR(a["bit1"].bitwiseXOR(b["bit1"]))
    return F.bit_count(differ) <= TOKENS - least


def alike(a, b, percent: int):
    """``likely``, and no more elements on one side only than a similar pair has.

    Two sketches differ in at most as many bits as their sets in elements, so the second test loses no pair.
    """
    differ = sum((F.bit_count(a["sketch"][i].bitwiseXOR(b["sketch"][i])) for i in range(SKETCH // 64)), F.lit(0))
    return likely(a, b, percent) & (differ * (100 + percent) <= (a["size"] + b["size"]) * (100 - percent))


def trees_for(percent: int) -> int:
    """Trees that a pair at the threshold needs, so that it meets in none with a chance of ``MISSED`` at most.

    No two trees share a token; below 74 percent the tokens do not suffice and the chance is higher.
    """
    return min(TOKENS // DEPTH, math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** DEPTH))) if percent < 100 else 1


def in_order(a: str, b: str) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def node():
    """The node of (tree, sig): the minwise tokens of the tree, ``DEPTH`` from token ``DEPTH`` times tree on."""
    size = 4 * DEPTH
    return F.xxhash64("tree", F.substring("sig", F.col("tree") * size + 1, F.lit(size))).alias("node")


def first_nodes(reps: DataFrame, trees: int) -> DataFrame:
    """(node, n, tree, doc, bit0, bit1): the documents of nodes that have two at least, and the number in the node."""
    every = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(node(), F.struct("tree", "doc", "bit0", "bit1").alias("m"))
    rows = every.join(every.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node")
    return rows.select("node", "n", "m.*")


def leaf_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All likely pairs of each small node; lists are bounded by the size of a leaf."""
    nodes = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("doc", "bit0", "bit1"))).alias("m"))
    later = lambda m, i, x: F.filter(F.slice(m, i + 2, F.size(m)), lambda y: (y["doc"] != x["doc"]) & likely(x, y, percent))
    pairs = nodes.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(later(F.col("m"), F.col("i"), F.col("x"))).alias("y"))
    return pairs.select(*in_order("x.doc", "y.doc"))


def pivot_pairs(rows: DataFrame, percent: int, level: int, total: int) -> DataFrame:
    """Each document of a large node with that node's central document, once for all trees in which it is the same one.

    Central documents lie in large nodes of many trees, as they hold the tokens that most of the node has. The
    documents are dealt into parts; a tree takes the central document of its own part, so a document meets that of
    every part, and a row of a node becomes one comparison. Few documents are central in their part in many trees, so
    most comparisons fall together. The first level takes them from all documents, each later one from a share of its own.
    """
    facts, test = (("bit0", "bit1", "size", "sketch"), alike) if level else (("bit0", "bit1"), likely)
    central = rows.groupBy("doc").agg(F.sum("n").alias("score"))
    part = F.pmod(F.xxhash64("doc"), F.lit(PIVOTS if level else FIRST_PIVOTS))
    scored = rows.join(central, "doc").withColumn("near", -F.pmod(part - F.col("tree"), F.lit(PIVOTS if level else FIRST_PIVOTS)))
    if level:
        scored = scored.filter(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(ROUNDS - 2)) == level - 1)
    top = F.max(F.struct("near", "score", "doc", "label", *facts)).alias("p")
    tops = materialize(scored.groupBy("node").agg(top, F.max("n").alias("n")), "central")
    pairs = join_groups(rows.select("node", "doc", "label", F.struct(*facts).alias("own")), tops, ["node"], total, F.col("doc"))
    met = (F.col("p.doc") != F.col("doc")) & (F.col("p.label") != F.col("label")) & test(F.col("own"), F.col("p"), percent)
    return pairs.filter(met).select(*in_order("doc", "p.doc")).distinct()


def mixed_nodes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (node, doc, bit0, bit1, size, sketch) with their label, the node's size ``n``, its largest label ``main`` and the
    number of documents outside that, ``minor``. Nodes of one label go. ``known`` holds (a, label).
    """
    rows = rows.join(known.withColumnRenamed("a", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    labels = rows.groupBy("node", "label").agg(F.count("*").alias("k"))
    nodes = labels.groupBy("node").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"))
    nodes = nodes.select("node", "n", F.col("top.label").alias("main"), (F.col("n") - F.col("top.k")).alias("minor")).filter("minor > 0")
    return rows.join(nodes, "node")


def rest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Every document outside its node's largest label with all documents of other labels, as far as they are ``alike``.

    The documents of a node with many comparisons are dealt over several tasks.
    """
    rows = rows.withColumn("slices", F.least(F.lit(SLICES), 1 + F.floor(F.col("minor") * F.col("n") / SLICE)).cast("int"))
    facts = F.struct("bit0", "bit1", "size", "sketch")
    others = rows.filter("label <> main").select("node", F.col("doc").alias("other"), F.col("label").alias("other_label"), facts.alias("y"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    met = rows.select("node", "doc", "label", "main", facts.alias("x"), F.pmod(F.xxhash64("doc"), F.col("slices")).cast("int").alias("slice")).join(others, ["node", "slice"])
    met = met.filter("doc <> other and label <> other_label and (label = main or doc < other)").filter(alike(F.col("x"), F.col("y"), percent))
    return met.select(*in_order("doc", "other"))


def similar_links(docs: DataFrame, reps: DataFrame, words: int, percent: int, trees: int, leaf: int = LEAF) -> DataFrame:
    """Links between representatives: confirmed pairs that connect all documents any tree brings together.

    ``reps`` holds (doc, sig, bit0, bit1). Nodes of up to ``leaf`` documents are compared exhaustively,
    as far as their tokens agree often enough (``likely``). A larger node is compared to its central
    documents, in ``ROUNDS`` - 1 rounds, unless all its documents are known to be connected. As soon as few
    comparisons are left in a node (documents outside its main component times all its documents), and in the
    last round in any case, all of these are made, whatever the size of the node. Documents known to be
    connected are not compared again, so this keeps components, not every link.
    """
    rows = materialize(first_nodes(reps, trees), "nodes").withColumn("label", F.col("doc"))
    small, large = rows.filter(F.col("n") <= leaf), rows.filter(F.col("n") > leaf)
    total = rows.count()
    pairs = materialize(leaf_pairs(small, percent).unionByName(pivot_pairs(large, percent, 0, total)), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select(F.col("doc").alias("id")))
    sets = sets_of(docs, ids.distinct(), words)
    links = confirmed(pairs, sets, percent)
    large = large.join(sets.select(F.col("id").alias("doc"), "size", "sketch"), "doc")
    for level in range(1, ROUNDS):
        last = level == ROUNDS - 1
        known = components(links).withColumnRenamed("m", "label") if last else nearby_labels(links)
        rows = materialize(mixed_nodes(large.select("node", "tree", "doc", "bit0", "bit1", "size", "sketch"), known), "mixed")
        few = (F.col("minor") * F.col("n") <= FEW) | F.lit(last)
        large = rows.filter(~few)
        more = confirmed(rest_pairs(rows.filter(few), percent).unionByName(pivot_pairs(large, percent, level, total)), sets, percent)
        links = links.unionByName(more)
        if large.isEmpty():
            break
    return links


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, trees: int | None = None) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Texts are lower-cased (A-Z) and split at ASCII white space; shingles have ``words`` words. Documents
    with equal sets are one class, whose smallest doc_id stands for it in the similarity join. Links are
    confirmed on full sets. A pair at the threshold meets in no tree with a chance of 2 * 10^-5 at most (from 74
    percent on, see ``trees_for``), whatever the size of its nodes, and is lost by ``likely`` with 10^-6.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a doc_id are
    one document. A null doc_id takes no part: its component is null and it is kept. An empty table gives
    an empty table. Other columns are not read. One row per row of ``docs``: doc_id, n_shingles,
    component_id (the smallest doc_id), kept.
    """
    rows = fingerprints(docs, words)
    total = rows.count()
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(linked.groupBy(*SET).agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("sig", "bit0", "bit1")], F.count("*").alias("n")), "classes")
    links = similar_links(docs, classes.select("doc", "sig", "bit0", "bit1"), words, percent, trees or trees_for(percent))
    found = components(links).withColumnRenamed("a", "doc")
    groups = classes.drop("sig", "bit0", "bit1").join(found, "doc", "left").filter("n > 1 or m is not null")
    groups = materialize(groups.select(*SET, F.coalesce("m", "doc").alias("component"), "n"), "groups")
    joined = join_groups(rows.select("doc_id", *SET), groups, SET, total, F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component."""
    gone = materialize(near_dedup(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
