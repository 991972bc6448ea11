"""Similar flights: ranking priced flights around a request, and ordering them for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.times import epoch_seconds
from tarmac.operators.dedupe import dedupe_first_sparse
from tarmac.operators.ordered import hour_bucket
from tarmac.session import materialize

INFINITY = float("inf")
#: Positions in a block of the departure order, as a multiple of k.
BLOCK = 4


def price_order(price: str):
    """Prices for sorting: null, NaN and 0 count as infinite."""
    p = F.col(price).cast("double")
    return F.when(p.isNull() | F.isnan(p) | (p == 0), F.lit(INFINITY)).otherwise(p)


def dedupe_candidates(flights: DataFrame, order: list[str]) -> DataFrame:
    """One offer per route, carrier, number and local departure: the first in the given order."""
    carrier = F.coalesce("marketing_carrier", "airline", F.lit(""))
    keyed = flights.withColumn("__carrier", carrier)
    return dedupe_first_sparse(keyed, ["origin", "dest", "__carrier", "number", "departure"], order).drop("__carrier")


def topk_similar(requests: DataFrame, flights: DataFrame, k: int = 20, days: int = 1) -> DataFrame:
    """The k flights nearest in departure time on the request's route, cheapest first on ties.

    Requests: request_id, origin, dest, departure. Flights: offer_id, origin, dest, departure, price
    and more. Candidates depart within ``days`` calendar days of the request.

    No request is paired with its whole route. Offers and distinct request times are put into one
    departure order; a running count of offers gives both their position. The order is cut into blocks of 4k positions, as
    arrays that reach k positions over the block's end, so a request time meets one block and takes the k
    offers before and the k after its position out of it, as far as they are within its days: these 2k are never rows, and are not shuffled. Of offers
    with one departure time only the k cheapest can matter, and a second position orders those cheapest last, so that the 2k
    looked at always contain the k wanted. The order's rows are written, as both the counts per bucket and the positions read them.
    """
    route = ["origin", "dest"]
    same_time = Window.partitionBy(*route, "departure").orderBy("__price", "offer_id")
    useful = (
        flights.withColumn("__price", price_order("price"))
        .withColumn("__tie", F.row_number().over(same_time)).filter(F.col("__tie") <= k)
    )
    points = requests.select(*route, "departure").distinct()
    line = (
        useful.withColumn("__offer", F.lit(1).cast("long"))
        .unionByName(points.withColumns({"__offer": F.lit(0).cast("long"), "__tie": F.lit(k + 1)}), allowMissingColumns=True)
        .withColumn("__bucket", hour_bucket("departure"))
    )
    line = materialize(line, "departure-order")
    earlier = Window.partitionBy(*route).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_day = Window.partitionBy(*route).orderBy(F.floor(F.col("__bucket") / 24))
    upto = lambda last: F.coalesce(F.sum("__in").over(by_day.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
    offsets = line.groupBy(*route, "__bucket").agg(F.sum("__offer").alias("__in")).select(
        *route, "__bucket", F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__before"),
        upto(-days - 1).alias("__low"), upto(days).alias("__high"),
    )
    inside = Window.partitionBy(*route, "__bucket")
    backward_tie = F.when(F.col("__offer") == 1, -F.col("__tie")).otherwise(F.col("__tie"))
    rows = lambda *order: inside.orderBy("departure", *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumns(
        {"__f": F.sum("__offer").over(rows("__tie")), "__b": F.sum("__offer").over(rows(backward_tie))}
    ).join(offsets, [*route, "__bucket"])
    forward, backward = F.col("__f") + F.col("__before"), F.col("__b") + F.col("__before")
    spread = BLOCK * k
    payload = [c for c in flights.columns if c not in route]
    kept = F.struct("__price", *payload).alias("__offer_row")
    both = placed.filter("__offer = 1").select(*route, forward.alias("__f"), backward.alias("__b"), kept)
    block = lambda position: F.floor(position / F.lit(spread)).cast("long")
    side = lambda name, position, first, last: F.transform(
        F.sequence(block(first), block(last)), lambda i: F.struct(i.alias("block"), F.lit(name).alias("side"), position.alias("pos"))
    )
    ahead_of = side(1, F.col("__f"), F.greatest(F.col("__f") - k, F.lit(0).cast("long")), F.col("__f") - 1)
    behind = side(-1, F.col("__b"), F.col("__b"), F.col("__b") + (k - 1))
    dealt = both.select(*route, F.explode(F.concat(ahead_of, behind)).alias("__at"), "__offer_row")
    dealt = dealt.select(*route, F.col("__at.block").alias("__block"), F.col("__at.side").alias("__side"), F.col("__at.pos").alias("__pos"), "__offer_row")
    in_order = lambda name: F.array_sort(
        F.collect_list(F.when(F.col("__side") == name, F.struct("__pos", "__offer_row"))), lambda x, y: (x["__pos"] - y["__pos"]).cast("int")
    )
    blocks = dealt.groupBy(*route, "__block").agg(in_order(1).alias("__ahead"), in_order(-1).alias("__behind"))
    asked = placed.filter("__offer = 0").select(
        *route, F.col("departure").alias("requested"), forward.alias("__f"), "__low", "__high", block(forward).alias("__block")
    )
    met = asked.join(blocks, [*route, "__block"])
    part = lambda rows, first, last: F.when(
        (F.size(rows) > 0) & (first <= last),
        F.slice(rows, F.greatest(first - rows[0]["__pos"] + 1, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")),
    ).otherwise(F.slice(rows, F.lit(1), F.lit(0)))
    after = part(F.col("__ahead"), F.col("__f") + 1, F.least(F.col("__f") + k, F.col("__high")))
    before = part(F.col("__behind"), F.greatest(F.col("__f") - (k - 1), F.col("__low") + 1), F.col("__f"))
    seconds = lambda o: epoch_seconds(o["departure"]) - epoch_seconds("requested")
    minutes = lambda o: F.floor(seconds(o) / 60.0 + 0.5).cast("long")
    near = met.select(*route, "requested", F.transform(F.concat(after, before), lambda x: x["__offer_row"]).alias("__near"))
    near = near.withColumn("__near", F.filter("__near", lambda o: F.abs(F.date_diff(o["departure"].cast("date"), F.col("requested").cast("date"))) <= days))
    keys = F.transform("__near", lambda o, i: F.struct(F.abs(minutes(o)).alias("a"), o["__price"].alias("p"), o["offer_id"].alias("o"), i.alias("i")))
    best = near.withColumn("__keys", F.slice(F.sort_array(keys), 1, k)).select(
        *route, "requested", F.transform("__keys", lambda s: F.element_at("__near", s["i"] + 1)).alias("__best")
    )
    found = requests.select("request_id", *route, F.col("departure").alias("requested")).join(best, [*route, "requested"])
    # The outer form, as Spark pushes the other's test for empty arrays below the join and makes the arrays again for it.
    found = found.select(*route, "requested", "request_id", F.posexplode_outer("__best").alias("__rank", "__o")).filter("__rank is not null")
    found = found.select(*route, "requested", "request_id", *[F.col("__o")[c].alias(c) for c in payload], (F.col("__rank") + 1).alias("rank"))
    gap = F.floor((epoch_seconds("departure") - epoch_seconds("requested")) / 60.0 + 0.5).cast("long")
    return found.select(*route, "requested", "request_id", *payload, gap.alias("similarity_minutes"), F.abs(gap).alias("similarity_minutes_abs"), "rank")


def sort_modes(df: DataFrame, mode: str = "date_asc", row_id: str = "offer_id") -> DataFrame:
    """Display orders; missing prices are last when rising and first when falling."""
    airline = F.lower(F.coalesce("marketing_carrier", "airline", F.lit("")))
    by_date = F.asc_nulls_last("departure")
    orders = {
        "date_asc": [by_date],
        "date_desc": [F.desc_nulls_first("departure")],
        "price_asc": [F.asc_nulls_last("price")],
        "price_desc": [F.desc_nulls_first("price")],
        "airline_asc": [airline.asc(), by_date],
        "airline_desc": [airline.desc(), by_date],
    }
    return df.orderBy(*orders.get(mode, orders["date_asc"]), row_id)
