"""Moving counts, means and medians against plain Python."""

import datetime
import random
import statistics

from pyspark.sql import functions as F

from tarmac.operators.moving import moving_statistics
from tarmac.operators.rolling import rolling_days_median

DAY = datetime.date(2024, 2, 20)


def test_moving_statistics_by_hand(spark):
    draw = random.Random(8)
    rows = [(draw.choice("aab"), DAY + datetime.timedelta(draw.choice([0, 1, 2, 5, 9, 30, 31])), draw.choice([-3.5, 0.0, 0.25, 7.0, 7.5, 1e6])) for _ in range(400)]
    counts = spark.createDataFrame(rows, "k string, d date, v double").groupBy("k", "d", "v").agg(F.count("*").alias("n"))
    got = {(r.k, r.as_of_date): r for r in moving_statistics(counts, ["k"], "d", (1, 7, 14)).collect()}
    assert set(got) == {(k, d + datetime.timedelta(i)) for k, d, _ in rows for i in range(1, 15)}
    for (k, at), r in got.items():
        for w in (1, 7, 14):
            own = [v for a, d, v in rows if a == k and at - datetime.timedelta(w) <= d < at]
            assert r[f"n_{w}"] == len(own)
            assert r[f"median_{w}"] == (statistics.median(own) if own else None)
            assert (r[f"mean_{w}"] is None) if not own else abs(r[f"mean_{w}"] - statistics.mean(own)) < 1e-6


def test_a_key_with_very_many_values(spark):
    n = 300_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), F.expr("cast(id % 10 as int)")).alias("d"), F.expr("double(id * 7919 % 300007) / 8").alias("v"))
    few = spark.range(100).select(F.lit("cold").alias("k"), F.lit(DAY).alias("d"), F.col("id").cast("double").alias("v"))
    got = {(r.k, r.d): r["median"] for r in rolling_days_median(hot.unionByName(few), ["k"], "d", "v", 7).collect()}
    assert got["cold", DAY] is None and len(got) == 11
    for at in (1, 7, 9):
        own = sorted((i * 7919 % 300007) / 8 for i in range(n) if max(0, at - 7) <= i % 10 < at)
        assert got["hot", DAY + datetime.timedelta(at)] == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2


def test_no_percentile_state_in_the_plan(spark):
    df = spark.createDataFrame([("a", DAY, 1.0)], "k string, d date, v double")
    plan = rolling_days_median(df, ["k"], "d", "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
    assert rolling_days_median(df.filter("1 = 0"), ["k"], "d", "v").collect() == []
