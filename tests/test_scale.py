"""Skewed data against brute force, and the shape of the plans."""

import datetime as dt
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac import fixtures as X
from tarmac.operators import intervals, joins, legs, lookup, ordered, rolling, similar
from tarmac.queries import QUERIES
from tarmac.session import materialize

SF = "/root/testdata/sf0.001"
# Streams, training and file writers start jobs of their own while the query is built.
EAGER = (
    "stream_", "train_", "calibrate_", "feature_importance", "score_ge", "explain_predictions", "batch_predict", "permutation_importance", "scan_", "sinks", "ingest_",
    "snapshot_records", "departure_training_tables",
)


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows, half of them of one tail, many at equal times."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        tail = "HOT" if rng.random() < 0.5 else f"T{rng.randrange(40)}"
        at = start + dt.timedelta(minutes=30 * rng.randrange(48 * 20))
        rows.append((i, tail, at.date(), at, at + dt.timedelta(hours=1), rng.choice("XY"), rng.choice("XY"), float(rng.randrange(90))))
    schema = "id int, tail string, day date, dep timestamp_ntz, arr timestamp_ntz, org string, dst string, delay double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["id", "tail", "day", "dep", "arr", "org", "dst", "delay"])


def test_leg_numbers_of_a_hot_tail(skewed):
    df, pdf = skewed
    got = {r["id"]: r["n"] for r in legs.leg_number(df, "tail", "day", "dep", "id", "n").collect()}
    want = pdf.sort_values(["tail", "day", "dep", "id"]).groupby(["tail", "day"]).cumcount() + 1
    assert got == dict(zip(pdf.loc[want.index, "id"], want))


def test_turns_of_a_hot_tail(skewed):
    df, pdf = skewed
    got = {r["id"]: r["x"] for r in legs.recent_turn_flag(df, "tail", "org", "dst", "dep", "arr", "id", 5.0, "x").collect()}
    p = pdf.sort_values(["tail", "dep", "id"]).copy()
    prev = p.groupby("tail")[["arr", "dst"]].shift(1)
    gap = (p["dep"] - prev["arr"]).dt.total_seconds() / 3600
    want = ((prev["dst"] == p["org"]) & (gap >= 0) & (gap <= 5)).astype(int)
    assert got == dict(zip(p["id"], want))


def test_rank_and_totals_of_a_hot_key(skewed):
    df, pdf = skewed
    got = {r["id"]: (r["pos"], r["sum"]) for r in ordered.running_totals(
        ordered.ordered_rank(df, ["tail"], ordered.value_bucket("delay"), ["delay", "id"], "pos", descending=True),
        ["tail"], ordered.value_bucket("delay"), ["delay"], {"sum": "delay"},
    ).collect()}
    for tail, g in pdf.groupby("tail"):
        order = g.sort_values(["delay", "id"], ascending=False).reset_index(drop=True)
        for i, r in order.iterrows():
            assert got[r["id"]] == (i + 1, g.loc[g["delay"] <= r["delay"], "delay"].sum())


def test_value_bucket_keeps_order(spark):
    values = [-1e9, -5.0, -0.1, 0.0, 1e-9, 1e-6, 0.1, 0.1000001, 3.0, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered.value_bucket("v").alias("b")).orderBy("v")
    buckets = [r["b"] for r in df.collect()]
    assert buckets == sorted(buckets)


def test_exact_median_of_many_values(spark):
    rng = random.Random(3)
    data = {k: [rng.gauss(0, 1000) for _ in range(n)] for k, n in (("a", 501), ("b", 500), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r["k"]: r["quantile"] for r in ordered.exact_quantile_counts(counts, ["k"], "v", "n").collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(pd.Series(vs).median())


def test_similar_flights_with_many_ties(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    offers = []
    for i in range(700):
        hour = 12 if rng.random() < 0.4 else rng.randrange(24 * 6)  # many offers at one time
        offers.append((i, "A", "B" if rng.random() < 0.9 else "C", start + dt.timedelta(hours=hour), rng.choice([None, 0.0, 10.0, 20.0, 30.0, 40.0]), "aa"))
    asked = [(r, "A", "B", start + dt.timedelta(minutes=17 * r)) for r in range(0, 400, 5)]
    flights = spark.createDataFrame(offers, "offer_id int, origin string, dest string, departure timestamp_ntz, price double, airline string")
    requests = spark.createDataFrame(asked, "request_id int, origin string, dest string, departure timestamp_ntz")
    got = {}
    for r in similar.topk_similar(requests, flights, 5).collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["offer_id"]))
    for rid, o, d, t in asked:
        near = [
            (round(abs((f[3] - t).total_seconds())), float("inf") if not f[4] else f[4], f[0])
            for f in offers if f[1] == o and f[2] == d and abs((f[3].date() - t.date()).days) <= 1
        ]
        want = [(i + 1, x[2]) for i, x in enumerate(sorted(near)[:5])]
        assert sorted(got.get(rid, [])) == want


def test_interval_counts_brute_force(skewed):
    df, pdf = skewed
    timed = df.withColumn("t", F.expr("unix_date(day)").cast("long") * 1440 + F.hour("dep") * 60 + F.minute("dep"))
    out = intervals.add_interval_counts(timed, timed, {"all": ["day"], "own": ["day", "tail"]}, "t", "t", 60)
    got = {r["id"]: (r["all"], r["own"]) for r in out.collect()}
    for _, r in pdf.iterrows():
        near = pdf[(pdf["day"] == r["day"]) & ((pdf["dep"] - r["dep"]).abs() <= pd.Timedelta(minutes=60))]
        assert got[r["id"]] == (len(near) - 1, (near["tail"] == r["tail"]).sum() - 1)


@pytest.mark.parametrize("half", [0, 1, 7, 60, 1000])
def test_interval_counts_across_slices(spark, half):
    rng = random.Random(half)
    pool = [(rng.choice("ab"), rng.choice("xyz"), rng.randrange(-500, 900)) for _ in range(400)]
    asked = [(k, j, t) for k in "ab" for j in "xyz" for t in rng.sample(range(-1600, 2000), 60)] + [("c", "x", 0)]
    schema = "k string, j string, t int"
    out = intervals.interval_counts(
        spark.createDataFrame(asked, schema), spark.createDataFrame(pool, schema), {"one": ["k"], "two": ["k", "j"]}, "t", "t", half
    )
    assert out.schema["t"].dataType.simpleString() == "int"
    got = {(r["k"], r["j"], r["t"]): (r["one"], r["two"]) for r in out.collect()}
    near = lambda k, t: [p for p in pool if p[0] == k and abs(p[2] - t) <= half]
    assert got == {(k, j, t): (len(near(k, t)), sum(p[1] == j for p in near(k, t))) for k, j, t in asked}


def largest_share(df, keys):
    """Rows of the largest of 64 tasks that a shuffle by the keys makes, as a share of all."""
    counts = [r["count"] for r in df.groupBy((F.pmod(F.hash(*keys), F.lit(64))).alias("p")).count().collect()]
    return max(counts) / sum(counts)


def shuffle_keys(df):
    """The key lists of the plan's hash exchanges."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+", "", found) for found in re.findall(r"hashpartitioning\(([^)]*), \d+\)?", plan)]


def test_a_hot_group_is_swept_slice_by_slice(spark):
    hot = spark.range(20000).select(F.lit("JFK").alias("k"), (F.col("id") * 4000003).alias("t"))
    out = intervals.interval_counts(hot, hot, {"n": ["k"]}, "t", "t", 3600 * 1000000)
    assert not [k for k in shuffle_keys(out) if k == "k"]
    assert out.agg(F.max("n")).first()[0] == 2 * (3600 * 1000000 // 4000003) + 1
    assert largest_share(hot.select("k", (F.col("t") - F.pmod("t", F.lit(3600 * 1000000))).alias("s")), ["k", "s"]) < 0.2


def test_a_piece_of_most_names_is_searched_block_by_block(spark):
    rng = random.Random(3)
    names = [(i, "z" * rng.randrange(3) + rng.choice(["zebra", "maze", "haze", "lark"]) + f" {i % 50}") for i in range(3000)]
    texts = ["z", "zz", "aze", "zebra 4", "maze 17", "haze", "nothing like it", "q", "", "Lark"]
    asked = spark.createDataFrame(list(enumerate(texts)) + [(99, "z")], "q int, t string")
    table = spark.createDataFrame(names, "id int, txt string")
    got = {}
    for r in lookup.search_topk(asked, "q", "t", table, "id", "txt", 5).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for q, t in list(enumerate(texts)) + [(99, "z")]:
        want = [i for i, n in names if t.lower() in n][:5]
        assert sorted(got.get(q, [])) == list(enumerate(want, 1))


def test_nearest_brute_force(skewed):
    df, pdf = skewed
    left = df.filter("id < 300").withColumn("want", F.col("dep") + F.expr("INTERVAL 7 MINUTES"))
    right = df.filter("id >= 300").select("tail", F.col("dep").alias("seen")).distinct().withColumn("at", F.col("seen"))
    got = {r["id"]: r["at"] for r in joins.nearest(left, right, ["tail"], "want", "seen", ["at"]).collect()}
    pool = pdf[pdf["id"] >= 300]
    for _, r in pdf[pdf["id"] < 300].iterrows():
        own = pool[pool["tail"] == r["tail"]]["dep"].drop_duplicates()
        gaps = (own - r["dep"] - pd.Timedelta(minutes=7)).abs()
        want = None if own.empty else min(zip(gaps, own))[1].to_pydatetime()
        assert got[r["id"]] == want


def test_nearest_looks_beyond_empty_hours(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 5, 1)
    readings = [("HOT" if rng.random() < 0.8 else "B", start + dt.timedelta(seconds=rng.randrange(3 * 86400))) for _ in range(120)]
    readings += [("ONE", start + dt.timedelta(hours=30))]
    asked = [(i, rng.choice(["HOT", "B", "ONE", "NONE", None]), start + dt.timedelta(seconds=rng.randrange(-86400, 4 * 86400))) for i in range(400)]
    asked += [(400, "ONE", None), (401, *readings[0])]
    right = spark.createDataFrame(readings, "k string, seen timestamp_ntz").withColumn("at", F.col("seen"))
    left = spark.createDataFrame(asked, "id int, k string, want timestamp_ntz")
    found = joins.nearest(left, right, ["k"], "want", "seen", ["at"])
    got = {r["id"]: r["at"] for r in found.collect()}
    assert len(got) == len(asked)
    for i, k, t in asked:
        own = sorted({s for key, s in readings if key == k})
        assert got[i] == (min(own, key=lambda s: (abs(s - t), s)) if own and t else None)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_plans_have_no_python_and_no_pair_joins(spark, name):
    text = plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[1]
    for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, f"{name}: {bad}"


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_projected"](spark, SF).filter("l_quantity > 49"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text.replace("... 1 more", "")


def test_one_window_shuffle_for_all_baseline_widths(spark):
    f = X.flights(spark, SF)
    daily = rolling.daily_mean(f, ["Origin"], "FlightDate", "DepDelayMinutes", "m")
    text = plan(rolling.rolling_rows_baseline(daily, ["Origin"], "FlightDate", "m", (7, 14, 21, 28), "w"))
    physical = text.split("== Physical Plan ==")[1]
    assert physical.count("Window [") == 1 and physical.count("Exchange hashpartitioning") == 2


def test_semi_prefilter_drops_rows_before_the_shuffle(spark):
    hist = spark.range(20_000).select((F.col("id") % 5_000).alias("k"), F.concat(F.lit("n"), F.col("id") % 7).alias("n"), "id")
    hist = hist.unionByName(spark.createDataFrame([(None, "n1", 1), (3, None, 2)], "k long, n string, id long"))
    keys = spark.createDataFrame([(k, n) for k in range(0, 300, 3) for n in ("n0", "n1", None)] + [(None, "n1")] * 3, "k long, n string")
    want = {r.id for r in hist.join(keys.distinct(), ["k", "n"], "left_semi").collect()}
    out = joins.semi_prefilter(hist, keys, ["k", "n"])
    assert out.columns == hist.columns
    assert sorted(r.id for r in out.collect()) == sorted(want) and want
    passed = {r.id for r in joins.with_marked_keys(hist, joins.key_bits(keys, ["k", "n"]), ["k", "n"]).collect()}
    assert want <= passed and len(passed) < len(want) + 20
    # One word of bits for 300 keys, and far too few bits: more rows pass the first phase, the result stays.
    for bits in (1 << 15, 64):
        assert sorted(r.id for r in joins.semi_prefilter(hist, keys, ["k", "n"], bits).collect()) == sorted(want)
    other_type = keys.withColumn("k", F.col("k").cast("int"))
    assert sorted(r.id for r in joins.semi_prefilter(hist, other_type, ["k", "n"]).collect()) == sorted(want)
    assert joins.semi_prefilter(hist, keys.filter("1 = 0"), ["k", "n"]).collect() == []


def test_semi_prefilter_plan(spark):
    plan = QUERIES["semi_prefilter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "BroadcastHashJoin [__word" in plan


def _fact_shuffles(df):
    """Exchanges and sort-merge joins in the plan of ``df``, broadcasts left out."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line or "SortMergeJoin" in line]


def test_facts_are_not_shuffled_for_few_rows(spark):
    """Splits, balancing and small tables meet the facts where those are read."""
    from tarmac.operators import sampling

    path = f"{tempfile.mkdtemp()}/facts"
    spark.range(3000).selectExpr("id", "cast(id % 3 = 0 as int) y", "cast(id % 7 as string) k", "timestamp_seconds(id) at").write.parquet(path)
    facts = spark.read.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    split = sampling.stratified_split(facts, "y", ["id"], {"a": 0.25, "b": 0.25, "c": 0.0})
    balanced = sampling.balance_thresholds(facts, {1: "y"}, ["id"], max_rows=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # facts are larger, first departures smaller
    try:
        first = legs.hours_since_first(facts, ["k"], "at")
        assert [len(_fact_shuffles(df)) for df in (split, balanced, first)] == [1, 0, 0]  # the one is of the cuts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    sizes = {(r.part, r.y): r["count"] for r in split.groupBy("part", "y").count().collect()}
    assert sizes == {("a", 0): 500, ("a", 1): 250, ("b", 0): 500, ("b", 1): 250, ("c", 0): 1000, ("c", 1): 500}
    assert balanced.count() == 100 and balanced.select("id").distinct().count() == 100


def test_ordered_statistics_shuffle_the_facts_once(spark):
    from tarmac.operators.target_stats import ordered_statistics

    facts = spark.range(500).selectExpr("id", "cast(id % 3 = 0 as int) y", "cast(id % 7 as string) a", "cast(id % 5 as string) b", "cast(id % 2 as string) c")
    out = ordered_statistics(facts, "y", ["a", "b", "c"], "id", 0.5)
    assert len(_fact_shuffles(out)) == 3  # the rows, the sums of slices and values, and their windows


def test_flight_table_is_written_without_a_shuffle(spark):
    from tarmac import fixtures

    table = fixtures.flight_table(spark, SF)
    assert not any("Year=" in f for f in table.inputFiles())


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_facts_travel_with_their_features(skewed):
    """Turns, legs and prior events join small tables only, not the facts with themselves."""
    df, _ = skewed
    ends = ("org", "dst", "dep", "arr", "id")
    assert _joins(legs.turn_time_hours(df, ["tail"], *ends)) == 1
    assert _joins(legs.recent_turn_flag(df, "tail", *ends)) == 1
    assert _joins(legs.leg_number(df, "tail", "day", "dep", "id")) == 1
    assert _joins(rolling.rolling_prior_events(df, df, ["tail"], "day", "dep", "delay")) == 1


def test_prior_events_of_rows_without_a_time_or_key(skewed, spark):
    """A history row without a time counts as the day's first; facts without a key or time keep null, 0 and 1."""
    df, _ = skewed
    day, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 9)
    rows = [(1, "a", day, None, 10.0), (2, "a", day, at, 20.0), (3, None, day, at, 30.0), (4, "a", dt.date(2024, 1, 2), at, None)]
    facts = spark.createDataFrame(rows, "id int, tail string, day date, dep timestamp_ntz, delay double")
    for hist in (facts, facts.select("*")):
        out = rolling.rolling_prior_events(facts, hist, ["tail"], "day", "dep", "delay", (7,)).collect()
        got = {r["id"]: (r["flightnum_od_depdelay_mean_last7"], r["flightnum_od_support_count_last7d"], r["flightnum_od_low_support_last7d"]) for r in out}
        assert got == {1: (None, 0, 1), 2: (10.0, 1, 1), 3: (None, 0, 1), 4: (15.0, 2, 1)}


def test_open_intervals_are_counted_before_they_are_carried(skewed):
    df, _ = skewed
    timed = df.withColumn("t", F.hour("dep").cast("long"))
    plan = intervals.interval_counts(timed, timed, {"n": ["day"]}, "t", "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2


def test_times_alone_are_matched_without_sorting(spark):
    flights = spark.createDataFrame([("1", "A", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, h), "x") for h in (9, 8)], "flight_number string, dest string, date date, sched_utc timestamp_ntz, carrier string")
    out = joins.match_schedule(flights.select("flight_number", "dest", "date").distinct(), flights, carrier=False)
    assert [(r["sched_utc"].hour, r["matched"]) for r in out.collect()] == [(8, True)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_positions_and_small_answers_shuffle_no_fact(spark):
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan("sort_modes_price_desc")
    assert "Window" not in plan("rolling_days_mean_count_block")
    assert "Expand" not in plan("asof_global")


def test_ordered_statistics_keep_the_row_id(spark):
    """Training gives the rows an id of the name ``__row``."""
    from tarmac.operators.target_stats import ordered_statistics

    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 3 % 2) for i in range(9)], "__row int, c string, y int")
    out = ordered_statistics(rows, "y", ["c"], "__row", 0.5)
    assert out.columns == ["__row", "c", "y", "c_stat"]
    assert sorted(r["__row"] for r in out.collect()) == list(range(9))


def test_offers_are_not_sorted_before_they_are_shuffled(spark):
    """Offers seldom repeat, so combining them map-side would only sort, and spill, every input task."""
    import re

    plan = QUERIES["dedupe_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, exchange, below = plan.partition("Exchange hashpartitioning")
    assert exchange and "Sort [" in above and not re.search("Sort|Aggregate|Exchange", below)


def test_hot_keys_among_keys_that_seldom_repeat(spark, monkeypatch):
    from tarmac.operators import dedupe

    rng = random.Random(19)
    keys = [("hot", 1)] * 700 + [(None, None)] * 500 + [("a", None)] * 40 + [(f"k{i}", i % 3) for i in range(3000)] + [("k7", 1)] * 2
    rows = [(k, n, o, f"v{o}") for (k, n), o in zip(keys, rng.sample(range(len(keys)), len(keys)))]
    df = spark.createDataFrame(rows, "k string, n int, o int, v string")
    want = {}
    for k, n, o, v in rows:
        want[k, n] = min(want.get((k, n), (o, v)), (o, v))
    for hot, task_rows in ((1000, 1 << 20), (100, 1 << 20), (10, 100), (3, 1 << 20)):  # many hot buckets to none
        monkeypatch.setattr(dedupe, "HOT", hot)
        monkeypatch.setattr(dedupe, "TASK_ROWS", task_rows)
        out = dedupe.dedupe_first_sparse(df, ["k", "n"], ["o"])
        assert out.columns == df.columns
        got = [((r["k"], r["n"]), (r["o"], r["v"])) for r in out.collect()]
        assert len(got) == len(want) and dict(got) == want
    assert dedupe.dedupe_first_sparse(df.filter("o < 0"), ["k", "n"], ["o"]).collect() == []


def test_runs_of_airports_in_one_file_are_spread_over_tasks(spark):
    """One small file is one task; its runs of all slots and days must not be."""
    out = QUERIES["schedule_calendar"](spark, SF)
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks) < 2 * sum(tasks) / len(tasks)
    days = out._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode(sequence")
    assert "sha2(" in days[2] and "sha2(" not in days[0]  # hashed below the days, once per airport and slot


def test_day_tables_are_broadcast_below_the_sessions_limit(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    table = materialize(spark.range(10).select("id", F.array("id").alias("many")), "few")
    few = table.select("id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(QUERIES["departure_features"](spark, SF)).split("== Physical Plan ==")[1].count("BroadcastHashJoin") == 2
        hashed = ["BroadcastHashJoin" in plan(spark.range(5).join(t, "id")) for t in (few, joins.small(table), joins.small(few, 95), joins.small(few, 96 * 10))]
        assert hashed == [False, False, False, True]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("k", [1, 3])
def test_similar_flights_across_blocks(spark, k):
    """Several blocks of the order, requests outside all offers, and no row per request and offer on the way."""
    rng = random.Random(k)
    start = dt.datetime(2024, 1, 1)
    offers = [(i, "A", rng.choice("BC"), start + dt.timedelta(minutes=10 * rng.randrange(900)), rng.choice([None, 0.0, 1.0, 2.0, float("nan")])) for i in range(500)]
    asked = [(r, "A", rng.choice("BCD"), start + dt.timedelta(minutes=rng.randrange(-4000, 14000))) for r in range(400)]
    flights = spark.createDataFrame(offers, "offer_id int, origin string, dest string, departure timestamp_ntz, price double")
    requests = spark.createDataFrame(asked + [(1000 + r[0], *r[1:]) for r in asked[:9]], "request_id int, origin string, dest string, departure timestamp_ntz")
    out = similar.topk_similar(requests, flights, k)
    assert not [line for line in plan(out).splitlines() if "Window" in line and "requested" in line]
    got = {}
    for r in out.collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["offer_id"]))
    for rid, o, d, t in asked + [(1000 + r[0], *r[1:]) for r in asked[:9]]:
        near = sorted(
            (int(abs((f[3] - t).total_seconds())) // 60, f[4] if f[4] and f[4] == f[4] else float("inf"), f[0])
            for f in offers if f[2] == d and abs((f[3].date() - t.date()).days) <= 1
        )
        assert sorted(got.get(rid, [])) == [(i + 1, x[2]) for i, x in enumerate(near[:k])]
