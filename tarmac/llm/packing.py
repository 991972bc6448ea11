"""Packing into sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.columns import text_of
from tarmac.llm.pretokens import Ids, once, vocabulary
from tarmac.session import materialize

BYTES = "byte_bpe_50k.json"
CAPACITY = 1024
END = (2).to_bytes(4, "little")
ROUNDS = 300
RATE = 0.05
BENT = 1.0
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)
LENGTHS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of each piece: every piece but the first is full, so only the first can be shorter."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def token_pieces(docs: DataFrame, vocab: str = BYTES, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every text's ids and the end id: doc_id, piece, start, length, ids_crc32, with ``ids`` if wanted."""

    def cut(batches):
        encode = once(Ids, vocabulary(vocab)).encode
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = [
                    (d, i, a, len(b) // 4, zlib.crc32(b), b)[: 6 if with_ids else 5]
                    for d, text in zip(pdf["doc_id"][at : at + 256], pdf["text"][at : at + 256], strict=True)
                    for i, (a, b) in enumerate(cut_pieces(encode(text) + END, capacity))
                ]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])
                yield out.astype({"doc_id": "Int64"})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(cut, LENGTHS + (", ids binary" if with_ids else ""))


def best_config(price: np.ndarray, stock: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack pricing: how often to take each length so that the summed price is largest.

    Unbounded knapsack over the capacity by dynamic programming, one vector step for each fill.
    ``price[l]`` is 0 for lengths that have no stock.
    """
    lengths = np.flatnonzero(stock)
    value, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    p = price[lengths]
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        value[c] = value[c - 1]
        if n:
            gain = p[:n] + value[c - lengths[:n]]
            i = int(gain.argmax())
            if gain[i] > value[c]:
                value[c], took[c] = gain[i], lengths[i]
    take, c = np.zeros(len(stock), dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            take[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return take


def solve_configs(stock: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many sequences each fills (fractions), by multiplicative weights over the lengths.

    The prices start at the lengths themselves, the dual solution if nothing were wasted. In each round the
    knapsack finds the configuration worth most, which gets a small part of the sequences; a length's price
    is then multiplied down the further its covered share is ahead of the others. So all lengths are covered
    at nearly the same rate, and none beyond its stock.
    """
    size = np.arange(len(stock))
    open_ = stock.astype(float)
    total = np.maximum(stock, 1)
    step = max(1.0, (stock * size).sum() / capacity / rounds)
    price = np.where(stock > 0, size / capacity * (1 + BENT * size / capacity), 0.0)
    solution = []
    for _ in range(rounds):
        open_[open_ < 1e-6] = 0
        if not open_.any():
            break
        take = best_config(np.where(open_ > 0, price, 0.0), open_, capacity)
        used = take > 0
        times = float(min(step, (open_[used] / take[used]).min()))
        open_ -= times * take
        solution.append((take, times))
        price *= np.exp(-RATE * times * take / total)
    return solution


def round_configs(stock: np.ndarray, solution: list[tuple[np.ndarray, float]], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of sequences that hold exactly the stock.

    Each configuration is used as often as its fraction says and the stock allows, largest first, then
    once more where it still fits. What is left is packed by best fit, largest first, on the counts. The
    same is done with parts of the fractions, as a poorer start may leave an easier rest; the plan with the
    fewest sequences counts.
    """
    plans = [round_share(stock, solution, capacity, share) for share in SHARES]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def round_share(stock: np.ndarray, solution: list[tuple[np.ndarray, float]], capacity: int, share: float) -> list[tuple[np.ndarray, int]]:
    left, plan = stock.copy(), defaultdict(int)
    kept: dict[bytes, np.ndarray] = {}
    summed: Counter = Counter()
    for take, n in solution:
        summed[take.tobytes()] += share * n
        kept[take.tobytes()] = take
    for extra in (0, 1) if share == 1 else (0,):
        for key, n in sorted(summed.items(), key=lambda s: (-s[1], s[0])):
            take = kept[key]
            used = take > 0
            times = int(min(int(n + 1e-9) if not extra else 1, (left[used] // take[used]).min()))
            if times > 0:
                left -= times * take
                plan[key] += times
    for take, n in best_fit(left, capacity):
        plan[take.tobytes()] += n
        kept[take.tobytes()] = take
    return [(kept[k], n) for k, n in plan.items()]


def best_fit(stock: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit by decreasing length, on counts of lengths and of equal open sequences."""
    bins: dict[int, Counter] = defaultdict(Counter)  # room: contents -> how many
    for length in range(len(stock) - 1, 0, -1):
        n = int(stock[length])
        while n:
            room = next((r for r in range(length, capacity) if bins.get(r)), None)
            if room is None:
                each = min(n, capacity // length)
                full = n // each
                bins[capacity - each * length][(length,) * each] += full
                n -= full * each
                continue
            content, count = next(iter(bins[room].items()))
            each = min(n, room // length)
            times = min(count, n // each)
            bins[room][content] -= times
            if not bins[room][content]:
                del bins[room][content]
            bins[room - each * length][content + (length,) * each] += times
            n -= times * each
    return [(np.bincount(content, minlength=len(stock)), n) for same in bins.values() for content, n in same.items()]


def runs_of(plan: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: the pieces of one length with ranks from ``rank`` on go to sequences from
    ``base`` on, ``per`` into each, from ``offset`` on. Sorted by length and rank.

    A configuration has at most 44 different lengths (1 + 2 + ... + 45 > 1024), so the runs are bounded by
    the number of configurations, whatever the number of documents.
    """
    found, taken, base = [], Counter(), 0
    for take, n in sorted(plan, key=lambda p: (-p[1], p[0].tobytes())):
        at = 0
        for length in np.flatnonzero(take)[::-1].tolist():
            per = int(take[length])
            found.append((length, taken[length], base, per, at))
            taken[length] += n * per
            at += length * per
        base += n
    found.sort()
    a = np.array(found, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "per", "offset"), a.T, strict=True))


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        stock[length] += n
    full = stock[capacity]
    stock[capacity] = 0
    plan = round_configs(stock, solve_configs(stock, capacity, rounds), capacity)
    if full:
        alone = np.zeros(capacity + 1, dtype=np.int64)
        alone[capacity] = 1
        plan.append((alone, int(full)))
    return runs_of(plan)


def ranked(pieces: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """Adds ``rank`` among the pieces of equal length; the hottest length is counted in parts.

    Parts are hashes of the document; a length's parts are numbered one after the other by their counts.
    """
    n = max(32, -(-pieces.count() // part_rows))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    counts = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    placed = parted.withColumn("i", F.row_number().over(inside)).join(starts, ["length", "part"])
    return placed.withColumn("rank", F.col("n0") + F.col("i") - 1).drop("part", "i", "n0")


def pack(docs: DataFrame, vocab: str = BYTES, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Places every piece of every text: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one id, the end id. Rows with the same doc_id are packed one by
    one. Texts above ``capacity`` are cut into full pieces, the first may be shorter. An empty table gives
    an empty table. Other columns are not read. Join ``token_pieces(with_ids=True)`` for the ids.
    Only the histogram (at most ``capacity`` counts) reaches the driver.
    """
    pieces = materialize(token_pieces(docs, vocab, capacity), "pieces")
    histogram = dict(pieces.groupBy("length").count().collect())
    runs = plan_sequences(histogram, capacity, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches):
        r = shared.value
        wide = int(r["rank"].max(initial=0)) + 1 if len(r["rank"]) else 1
        for pdf in batches:
            if len(pdf):
                length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
                span = max(wide, int(rank.max()) + 1)
                i = np.searchsorted(r["length"] * span + r["rank"], length * span + rank, side="right") - 1
                k = rank - r["rank"][i]
                pdf["sequence_id"] = r["base"][i] + k // r["per"][i]
                pdf["offset"] = r["offset"][i] + (k % r["per"][i]) * length
                yield pdf.drop(columns="rank").astype({"doc_id": "Int64"})

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, LENGTHS + ", sequence_id long, offset long")
