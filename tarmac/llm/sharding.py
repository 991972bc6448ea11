"""Shards of near-equal size by sampled splitters (DataFrame functions only)."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.columns import pick, rank_among, text_of
from tarmac.session import materialize

OUT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def place_large(groups: list[tuple[int, int, int]], shards: int, share: float):
    """Shards for the groups of equal texts that are large, largest first.

    A group stays whole where a shard has room for it; else it is cut over the emptiest shards.
    Returns pieces (key, size, first row, end row, shard, first slot), bytes and rows used by shard.
    """
    used, rows, pieces = [0] * shards, [0] * shards, []

    def put(key, size, lo, hi, s):
        pieces.append((key, size, lo, hi, s, rows[s]))
        used[s] += size * (hi - lo)
        rows[s] += hi - lo

    for key, size, n in sorted(groups, key=lambda g: (-g[1] * g[2], g[0])):
        at = 0
        while at < n:
            s = min(range(shards), key=lambda i: (used[i], i))
            take = n - at
            if size * take > share - used[s]:
                take = min(take, max(1, int((share - used[s]) // size)))
            put(key, size, at, at + take, s)
            at += take
    return pieces, used, rows


def shard_by_bytes(docs: DataFrame, shards: int = 24, sample: int = 4096, large: float = 0.02, slice_rows: int = 500_000) -> DataFrame:
    """Shards 0 to ``shards`` - 1 of near-equal bytes, equal texts together.

    The size of a row is the UTF-8 bytes of its text plus 8. Rows are ordered by a hash of the text.
    Splitters are quantiles of about ``sample`` keys, drawn with a chance in proportion to size; a range
    with more than ``slice_rows`` rows is subdivided. Shard boundaries are cut by the exact bytes of all
    slices, so sizes differ by no more than ``large`` of a shard and one row. A group of equal texts is
    never cut, unless no shard has room for the whole group. Groups above ``large`` of a shard are placed
    one by one; there are at most ``shards / large`` of these, so the driver may hold them.

    Null and empty text: 8 bytes, crc 0, equal. Repeated rows are rows of one group. Null doc_id is kept.
    An empty table gives an empty table. Other columns of ``docs`` are not read.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark, text = docs.sparkSession, text_of(docs)
    rows = materialize(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    if not n_rows:
        return spark.createDataFrame([], OUT)
    share = total / shards
    slice_rows = min(slice_rows, max(256, n_rows // 1024))

    counted = rows.groupBy("key", "size").agg(F.count("*").alias("n")).filter(F.col("size") * F.col("n") > large * share)
    groups = [tuple(g) for g in counted.collect()]
    pieces, used, used_rows = place_large(groups, shards, share)
    names = {(k, z): g for g, (k, z, _) in enumerate(groups)}
    group_df = spark.createDataFrame([(k, z, g, -(-n // slice_rows)) for g, (k, z, n) in enumerate(groups)], "key long, size long, g int, parts long")
    piece_df = spark.createDataFrame([(names[k, z], lo, hi, s, at) for k, z, lo, hi, s, at in pieces], "pg int, lo long, hi long, piece_shard int, piece_slot long")
    marked = rows.join(F.broadcast(group_df), ["key", "size"], "left")

    # Splitters: a row stands for floor(size / step + u) sample points, so points follow bytes.
    small_bytes = total - sum(z * n for _, z, n in groups)
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    points = F.floor(F.col("size") * (sample / max(1, small_bytes)) + u)
    drawn = sorted(tuple(r) for r in marked.filter(F.col("g").isNull()).select("key", points.alias("p")).filter("p > 0").collect())
    sums = list(itertools.accumulate(p for _, p in drawn))
    ranges = min(shards * 8, len(drawn))
    cuts = sorted({drawn[bisect.bisect_left(sums, sums[-1] * i / ranges)][0] for i in range(1, ranges)}) if ranges > 1 else []
    ranged = marked.withColumn("range", F.when(F.col("g").isNull(), rank_among(F.col("key"), cuts)))

    # Subdivide overfull ranges: evenly within the range, as keys are hashes.
    full = {r: n for r, n in ranged.filter("range is not null").groupBy("range").count().collect()}
    edge = [-(1 << 63), *cuts, (1 << 63) - 1]
    parts = [-(-full.get(r, 0) // slice_rows) or 1 for r in range(len(cuts) + 1)]
    step = [max(1.0, (edge[r + 1] - edge[r]) / parts[r]) for r in range(len(cuts) + 1)]
    inside = (F.col("key").cast("double") - pick([float(e) for e in edge[:-1]], F.col("range"), "double")) / pick(step, F.col("range"), "double")
    sub = F.least(F.greatest(F.floor(inside), F.lit(0)), pick(parts, F.col("range"), "long") - 1)
    sliced = ranged.select(
        "doc_id", "size", "text_crc32", "key", "g",
        F.coalesce(F.col("range"), F.lit(len(parts)) + F.col("g")).alias("range"),
        F.when(F.col("g").isNull(), sub).otherwise(F.pmod(F.xxhash64("doc_id"), "parts")).alias("sub"),
    )

    # Rows and bytes before each slice: one row per slice, in order; large groups count from 0 each.
    stats = sliced.groupBy("range", "sub", "g").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = stats.select("range", "sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    in_slice = Window.partitionBy("range", "sub")
    placed = (
        sliced.withColumn("idx", F.row_number().over(in_slice.orderBy("key", "doc_id")))
        .withColumn("end", F.sum("size").over(in_slice.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["range", "sub"])
    )
    room = [max(0.0, share - b) for b in used]
    scale = small_bytes / max(1.0, sum(room))
    ends = [int(x * scale) for x in itertools.accumulate(room)][:-1]
    pos = F.col("n0") + F.col("idx") - 1
    placed = materialize(
        placed.select(
            "doc_id", "size", "text_crc32", "g", pos.alias("pos"),
            F.when(F.col("g").isNull(), rank_among(F.col("b0") + F.col("end"), ends)).alias("own_shard"),
        ),
        "placed",
    )
    first = dict(placed.filter("own_shard is not null").groupBy("own_shard").agg(F.min("pos")).collect())
    base = [used_rows[s] - first.get(s, 0) for s in range(shards)]
    at = (F.col("g") == F.col("pg")) & (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))
    return placed.join(F.broadcast(piece_df), at, "left").select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        F.coalesce("own_shard", "piece_shard").cast("int").alias("shard"),
        F.coalesce(F.col("pos") + pick(base, F.col("own_shard"), "long"), F.col("piece_slot") + F.col("pos") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
