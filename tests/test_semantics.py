"""Hand-computed edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

from tarmac.functions import numbers as N
from tarmac.functions import ordinal as O
from tarmac.functions import text as S
from tarmac.functions import times as T
from tarmac.operators import dedupe, extract, filters, impute, intervals, joins, legs, metrics, ordered, rolling, sampling, similar
from tarmac.schema import FLIGHT
from tarmac.sources import payloads, tables

D = dt.date
TS = dt.datetime


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    df = spark.createDataFrame([tuple(v[1] for v in values.values())], schema)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "local, utc",
    [
        (TS(2024, 3, 10, 2, 30), TS(2024, 3, 10, 7, 30)),  # skipped hour
        (TS(2024, 11, 3, 1, 30), TS(2024, 11, 3, 5, 30)),  # repeated hour, first pass
        (TS(2024, 7, 1, 12, 0), TS(2024, 7, 1, 16, 0)),
    ],
)
def test_local_to_utc(spark, local, utc):
    got = one(spark, T.local_to_utc("t", F.lit("America/New_York")), t=("timestamp_ntz", local))
    assert got == utc


def test_local_times_do_not_depend_on_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        df = spark.createDataFrame([(D(2024, 3, 10), 230)], "d date, c int").select(
            T.local_to_utc(T.hhmm_to_local_ts("d", "c"), F.lit("America/New_York")).alias("u")
        )
        row = df.select("u", T.epoch_seconds("u").alias("s")).first()
        assert row["u"] == TS(2024, 3, 10, 7, 30)
        assert row["s"] == 1710055800
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "clock, expected", [(2400, None), (None, None), (0, TS(2024, 1, 1)), (5, TS(2024, 1, 1, 0, 5)), (1260, None), (-5, None), (905, TS(2024, 1, 1, 9, 5))]
)
def test_hhmm(spark, clock, expected):
    assert one(spark, T.hhmm_to_local_ts("d", "c"), d=("date", D(2024, 1, 1)), c=("int", clock)) == expected


@pytest.mark.parametrize("year, day", [(2022, 24), (2023, 23), (2024, 28), (2025, 27)])
def test_thanksgiving(spark, year, day):
    assert one(spark, T.nth_weekday("y", 11, 3, 4), y=("int", year)) == D(year, 11, day)
    assert one(spark, T.holiday_flag("d"), d=("date", D(year, 11, day - 2))) == 1
    assert one(spark, T.holiday_flag("d"), d=("date", D(year, 11, day - 3))) == 0


def test_holiday_null_date(spark):
    assert one(spark, T.holiday_flag("d"), d=("date", None)) == 0


@pytest.mark.parametrize("delay, label", [(14.9, "< 15 min"), (15.0, "15–30 min"), (30.0, "30–45 min"), (60.0, "≥ 60 min"), (None, "< 15 min")])
def test_delay_bin(spark, delay, label):
    assert one(spark, N.delay_bin("d"), d=("double", delay)) == label


def test_labels_of_unknown_delay(spark):
    labels = N.threshold_labels("d")
    assert one(spark, labels["y_dep_ge15"], d=("double", None)) == 0


def test_bins(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.2, 0.1)], "a double, b double, c double, d double")
    row = df.select(O.ge_to_bins("a", "b", "c", "d").alias("b"), *[m.alias(f"m{i}") for i, m in enumerate(O.monotone_ge(["a", "b", "c", "d"]))]).first()
    assert [row[f"m{i}"] for i in range(4)] == [0.5, 0.5, 0.2, 0.1]
    assert row["b"] == pytest.approx([0.5, 0.0, 0.3, 0.1, 0.1])


def test_overnight_arrival_serving(spark):
    df = spark.createDataFrame([(TS(2024, 5, 1, 1, 0), TS(2024, 5, 2, 3, 0))], "a timestamp_ntz, dep timestamp_ntz")
    got = df.select(T.overnight_arrival_utc("a", F.lit("America/New_York"), "dep").alias("x")).first()["x"]
    assert got == TS(2024, 5, 2, 5, 0)


def history(spark):
    rows = [(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 2.0), (D(2024, 1, 2), 4.0), (D(2024, 1, 2), 8.0), (D(2024, 1, 9), 16.0)]
    return spark.createDataFrame([("k", *r) for r in rows], "k string, d date, v double")


def test_rolling_days(spark):
    h = history(spark)
    stats = rolling.rolling_days_stats(h, ["k"], "d", {"m": "v"}, (7,)).orderBy("d").collect()
    assert [(r["stat_m"]["mean_7d"], r["stat_m"]["n_7d"]) for r in stats] == [(None, None), (1.0, 1), (pytest.approx(14 / 3), 3)]
    medians = rolling.rolling_days_median(h, ["k"], "d", "v", 7).orderBy("d").collect()
    assert [r["median"] for r in medians] == [None, 1.0, 4.0]


def test_previous_rows_mean(spark):
    daily = spark.createDataFrame([("k", D(2024, 1, i), float(i)) for i in range(1, 6)], "k string, d date, m double")
    out = rolling.rolling_rows_baseline(daily, ["k"], "d", "m", [2], "w").orderBy("d").collect()
    assert [r["w2"] for r in out] == [None, 1.0, 1.5, 2.5, 3.5]


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "k", D(2024, 1, 5)), (2, "k", None), (3, "x", D(2024, 1, 5)), (4, "k", D(2024, 1, 1))], "id int, k string, d date")
    right = spark.createDataFrame([("k", D(2024, 1, 3), 10.0), ("k", D(2024, 1, 3), 20.0), ("k", D(2024, 1, 9), 30.0)], "k string, e date, v double")
    out = {r["id"]: r["v"] for r in joins.asof_backward(left, right, ["k"], "d", "e", ["v"]).collect()}
    assert out == {1: 20.0, 2: None, 3: None, 4: None}


def prior_rows(spark, rows):
    schema = "id int, Reporting_Airline string, Flight_Number_Reporting_Airline int, Origin string, Dest string, FlightDate date, t timestamp_ntz, v double"
    return spark.createDataFrame(rows, schema)


def test_prior_events_edges(spark):
    key = ("AA", 1, "X", "Y")
    rows = [
        (1, *key, D(2024, 1, 1), TS(2024, 1, 1, 8), 10.0),
        (2, *key, D(2024, 1, 1), TS(2024, 1, 1, 9), 20.0),
        (3, *key, D(2024, 1, 1), TS(2024, 1, 1, 9), 40.0),  # same time: not prior to row 2
        (4, *key, D(2024, 1, 8), TS(2024, 1, 8, 7), None),
        (5, "AA", None, "X", "Y", D(2024, 1, 8), TS(2024, 1, 8, 7), 1.0),
    ]
    f = prior_rows(spark, rows)
    out = rolling.rolling_prior_events(f, f, FLIGHT.flight_key, "FlightDate", "t", "v", (7, 14))
    got = {r["id"]: (r["flightnum_od_depdelay_mean_last7"], r["flightnum_od_support_count_last14d"], r["flightnum_od_low_support_last14d"]) for r in out.collect()}
    assert got == {1: (None, 0, 1), 2: (10.0, 1, 1), 3: (10.0, 1, 1), 4: (pytest.approx(70 / 3), 3, 0), 5: (None, 0, 1)}


def test_history_does_not_see_the_future(spark):
    key = ("AA", 1, "X", "Y")
    rows = [(i, *key, D(2024, 1, i), TS(2024, 1, i, 8), float(i)) for i in range(1, 11)]
    changed = [r if r[0] < 6 else (*r[:-1], 999.0) for r in rows]
    out = []
    for data in (rows, changed):
        f = prior_rows(spark, data)
        got = rolling.rolling_prior_events(f, f, FLIGHT.flight_key, "FlightDate", "t", "v", (7, 14))
        base = rolling.rolling_rows_baseline(rolling.daily_mean(f, ["Origin"], "FlightDate", "v", "m"), ["Origin"], "FlightDate", "m", [7], "b")
        joined = got.join(base, ["Origin", "FlightDate"])
        out.append({r["id"]: (r["flightnum_od_depdelay_mean_last7"], r["b7"]) for r in joined.collect() if r["id"] <= 6})
    assert out[0] == out[1]


def test_interval_ends_count(spark):
    pool = spark.createDataFrame([("a", t) for t in (0, 100, 100, 200, 301)], "k string, t long")
    out = intervals.interval_counts(pool, pool, {"n": ["k"]}, "t", "t", 100).collect()
    assert {r["t"]: r["n"] for r in out} == {0: 3, 100: 4, 200: 3, 301: 1}


def test_no_pool_means_zero(spark):
    q = spark.createDataFrame([("a", 5)], "k string, t long")
    pool = spark.createDataFrame([("b", 5)], "k string, t long")
    assert intervals.add_interval_counts(q, pool, {"n": ["k"]}, "t", "t", 10).first()["n"] == 0


@pytest.mark.parametrize("pos, neg, want", [(30, 100, (30, 30)), (100, 30, (30, 30)), (5, 0, (5, 0))])
def test_balance(spark, pos, neg, want):
    df = spark.createDataFrame([(i, 1 if i < pos else 0) for i in range(pos + neg)], "id int, y int")
    out = {r["y"]: r["n"] for r in sampling.balance_classes(df, "y", ["id"]).groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert (out.get(1, 0), out.get(0, 0)) == want


def test_sampling_is_reproducible(spark):
    df = spark.range(1000)
    a = {r["id"] for r in sampling.sample_n(df, 77, ["id"]).collect()}
    b = {r["id"] for r in sampling.sample_n(df.repartition(13), 77, ["id"]).collect()}
    assert len(a) == 77 and a == b
    assert sampling.sample_n(df, 5000, ["id"]).count() == 1000


def test_split_shares_and_small_tables(spark):
    df = spark.createDataFrame([(i, i % 4 == 0 and 1 or 0) for i in range(400)], "id int, y int")
    out = sampling.stratified_split(df, "y", ["id"], {"a": 0.01, "b": 0.0}).groupBy("part", "y").count().collect()
    assert {(r["part"], r["y"]): r["count"] for r in out} == {("a", 0): 15, ("a", 1): 5, ("b", 0): 285, ("b", 1): 95}
    few = sampling.stratified_split(df.filter("id < 10"), "y", ["id"], {"a": 0.5, "b": 0.0}).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in few} == {"a": 6, "b": 4}


def test_trailing_split(spark):
    df = spark.createDataFrame([(D(2024, 1, i),) for i in range(1, 11)], "d date")
    assert sampling.trailing_split(df, "d", 3).filter("is_eval").count() == 3
    assert sampling.trailing_split(df, "d", 3, inclusive=True).filter("is_eval").count() == 4


def test_reliability_first_bin(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.11), (0, 1.0)], "y int, p double")
    out = {r["bin"]: r["count"] for r in metrics.reliability_table(df, "y", "p").collect()}
    assert out == {1: 2, 2: 1, 10: 1}


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(2000).select(
        (F.hash("id") % 100 / 100.0).alias("p"), ((F.hash("id") % 100 + F.hash(F.col("id") + 7) % 80) > 20).cast("double").alias("y")
    )
    got = metrics.ranking_scores(df, "y", "p").first()["auc"]
    assert got == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df), abs=1e-9)


def test_ranking_without_positives(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.7)], "y int, p double")
    row = metrics.ranking_scores(df, "y", "p").first()
    assert row["auc"] is None and row["average_precision"] is None and row["youden_threshold"] == float("inf")


def test_median_impute(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (float("nan"), None)], "a double, b double")
    rows = impute.numeric_impute(df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in rows) == [1.0, 2.5, 2.5, 4.0] and {r["b"] for r in rows} == {0.0}


def test_merge_guard(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 5), ("a", 6), (None, 7)], "k string, z int")
    with pytest.raises(Exception, match="several feature rows"):
        joins.merge_feature_sets(left, right, ["k"]).collect()
    assert joins.merge_feature_sets(left, right, ["k"], "least").count() == 2
    assert joins.merge_feature_sets(left, right, ["k"], "expand").count() == 3
    only = joins.merge_feature_sets(left, right.filter("k is null"), ["k"]).collect()
    assert {r["x"]: r["z"] for r in only} == {1: None, 2: 7}


def test_bad_dates_are_errors(spark):
    with pytest.raises(ValueError):
        filters.filter_date_range(history(spark), "d", "not a date", "2024-01-01")


def test_flight_number_forms(spark):
    for number in ("1821", "AA 1821", " AA1821 "):
        assert one(spark, S.normalize_flight_number(F.lit("aa"), "n"), n=("string", number)) == "AA1821"


def test_count_patterns(spark):
    texts = ["The hall has 12 gates. It opened\nwith a  total of 51   Gates and 3000 more.", "has 9000 gates", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r for r in extract.extract_count_patterns(df, "t").collect()}
    assert (got[0]["value"], got[0]["method"]) == (51, "total_of_gates") and got[0]["confidence"] == pytest.approx(0.8)
    assert got[0]["notes"] == "matched snippet: 'total of 51 Gates' | multiple candidates: [12, 51]"
    assert [(got[i]["value"], got[i]["method"], got[i]["confidence"]) for i in (1, 2)] == [(None, "no_match", 0.0)] * 2


def test_hourly_weather_clock_changes(spark):
    times = ["2024-03-10T01:00", "2024-03-10T02:00", "2024-03-10T03:00", "2024-11-03T00:00", "2024-11-03T01:00", "2024-11-03T02:00"]
    values = [str(i) for i in range(6)]
    df = spark.createDataFrame(
        [("JFK", "America/New_York", (times, values, values, values, values))],
        "airport string, tz string, hourly struct<time: array<string>, temperature_2m: array<string>,"
        " precipitation: array<string>, windspeed_10m: array<string>, weathercode: array<string>>",
    )
    out = {r["hour_utc"]: r["temperature_2m"] for r in payloads.explode_weather_hourly(df, "tz").collect()}
    # the skipped 02:00 moves to 07:00 UTC and wins over 03:00, which is the same hour; the repeated 01:00 is dropped
    assert out == {TS(2024, 3, 10, 6): 0.0, TS(2024, 3, 10, 7): 1.0, TS(2024, 11, 3, 4): 3.0, TS(2024, 11, 3, 7): 5.0}


def test_ragged_csv(spark, tmp_path):
    path = tmp_path / "master.txt"
    path.write_text('﻿N-NUMBER, MFR MDL CODE ,NAME,,\n 100 , A1 ,"x, y",\n200,B2\n300, C3 ,n,,,,extra\n', encoding="utf-8")
    rows = tables.scan_ragged_csv(spark, str(path), ["N-NUMBER", "MFR MDL CODE"]).orderBy("N-NUMBER").collect()
    assert [tuple(r) for r in rows] == [("100", "A1"), ("200", "B2"), ("300", "C3")]
    with pytest.raises(ValueError):
        tables.scan_ragged_csv(spark, str(path), ["NOPE"])


def test_ragged_csv_with_a_header_of_its_own_in_each_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text('\ufeffN-NUMBER, MFR MDL CODE ,NAME,,\n 100 , A1 ,n,\n200\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text('SERIAL,"NAME",X,MFR MDL CODE,N-NUMBER\n9,"x, y",z, B2 ,300,more\n', encoding="utf-8")
    rows = tables.scan_ragged_csv(spark, str(tmp_path), ["N-NUMBER", "MFR MDL CODE"]).collect()
    assert sorted(map(tuple, rows)) == [("100", "A1"), ("200", ""), ("300", "B2")]
    (tmp_path / "c.txt").write_text("N-NUMBER,OTHER\n1,2\n")
    with pytest.raises(ValueError, match="c.txt"):
        tables.scan_ragged_csv(spark, str(tmp_path), ["N-NUMBER", "MFR MDL CODE"])


def test_airport_dim_requires_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("IATA,Latitude\nX,1\n")
    with pytest.raises(ValueError, match="Longitude"):
        tables.scan_airport_dim(spark, str(tmp_path / "a.csv"))


def test_first_reading_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in dedupe.dedupe_first(df, ["k"], ["o"]).collect()} == {"a": "x", "b": "z"}
    assert {r["k"]: r["v"] for r in dedupe.dedupe_latest(df, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}


def test_counts_have_no_limit(spark):
    at = F.lit(dt.datetime(2024, 5, 1, 12)).cast("timestamp_ntz")
    pool = spark.range(40_000).select(F.lit("X").alias("k"), F.lit(100).cast("long").alias("t"))
    asked = spark.createDataFrame([("X", 100)], "k string, t long")
    counted = intervals.add_interval_counts(asked, pool, {"n": ["k"]}, "t", "t", 5)
    assert counted.first()["n"] == 39_999
    flags = rolling.support_flags((7, 28), 3)
    one = spark.range(1).select(F.lit(40_000).cast("long").alias("flightnum_od_support_count_last28d"), at.alias("at"))
    assert one.withColumns(flags).first()["flightnum_od_support_count_last28d"] == 40_000


def test_no_row_limit_keeps_all_rows(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "id int, y int")
    assert sampling.balance_classes(df, "y", ["id"], max_rows=None).count() == 200
    assert sampling.balance_classes(df, "y", ["id"], max_rows=50).count() == 50


def test_rankings_and_missing_models(spark):
    from tarmac.plans import serving

    asked = spark.createDataFrame([("WN", "A", "B", None), ("WN", "A", "C", None), ("DL", "A", "B", "unknown_dest")], "Reporting_Airline string, Origin string, Dest string, problem string")
    lists = spark.createDataFrame([("WN", 50, "A"), ("WN", 50, "B"), ("WN", 70, "C")], "airline string, n int, code string")
    found = {(r["Reporting_Airline"], r["Dest"]): r["problem"] for r in serving.check_rankings(asked, lists, 50).collect()}
    assert found == {("WN", "B"): None, ("WN", "C"): "airport_not_in_ranking", ("DL", "B"): "unknown_dest"}
    with pytest.raises(ValueError):
        serving.score_by_key(asked, {})


def test_another_column_order_is_an_error(spark, tmp_path):
    spark.createDataFrame([("X", "2024-01-01")], "Origin string, FlightDate string").write.option("header", "true").csv(f"{tmp_path}/m")
    right = tables.scan_month_csv(spark, f"{tmp_path}/m", types.StructType.fromDDL("Origin string, FlightDate string"))
    assert right.first()["Origin"] == "X"
    wrong = tables.scan_month_csv(spark, f"{tmp_path}/m", types.StructType.fromDDL("FlightDate string, Origin string"))
    with pytest.raises(Exception, match="CSV header"):
        wrong.collect()


def test_picks_do_not_depend_on_partitions(spark):
    left = spark.createDataFrame([("a", 1)], "k string, x int")
    right = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("z"))
    for parts in (1, 7, 13):
        assert joins.merge_feature_sets(left, right.repartition(parts), ["k"], "least").first()["z"] == 0
