"""Repeated and interrupted batches."""

from pyspark.sql import functions as F

from tarmac.operators.dedupe import dedupe_latest
from tarmac.session import shared_folder
from tarmac.streaming import snapshots as S

SCHEMA = "k string, v int, seen int, day string"


def upsert(batch, number, root):
    S.upsert_partitions(batch, number, f"{root}/t", f"{root}/s", "day", lambda rows: dedupe_latest(rows, ["day", "k"], ["seen"]))


def rows(spark, root):
    return {(r["day"], r["k"]): r["v"] for r in spark.read.schema(SCHEMA).parquet(f"{root}/t").collect()}


def test_upsert_keeps_untouched_days_and_repeats_batches(spark):
    root = shared_folder(spark, "upsert")
    first = spark.createDataFrame([("a", 1, 1, "d1"), ("b", 2, 1, "d1"), ("a", 3, 1, "d2")], SCHEMA)
    second = spark.createDataFrame([("a", 9, 2, "d1"), ("c", 8, 2, "d1")], SCHEMA)
    upsert(first, 0, root)
    upsert(second, 1, root)
    want = {("d1", "a"): 9, ("d1", "b"): 2, ("d1", "c"): 8, ("d2", "a"): 3}
    assert rows(spark, root) == want
    upsert(second, 1, root)  # the same batch again, as after a failure
    assert rows(spark, root) == want


def test_older_rows_do_not_win(spark):
    root = shared_folder(spark, "upsert")
    upsert(spark.createDataFrame([("a", 5, 7, "d1")], SCHEMA), 0, root)
    upsert(spark.createDataFrame([("a", 1, 3, "d1")], SCHEMA), 1, root)
    assert rows(spark, root) == {("d1", "a"): 5}


def test_late_rows_are_counted(spark):
    root = shared_folder(spark, "late")
    schema = "ts timestamp, origin string, carrier string, delay double"
    batches = [["2024-01-10 10:00:00"], ["2024-01-12 10:00:00"], ["2024-01-01 10:00:00"]]
    query = None
    for number, times in enumerate(batches):
        df = spark.createDataFrame([(t,) for t in times], "t string").select(
            F.col("t").cast("timestamp").alias("ts"), F.lit("X").alias("origin"), F.lit("AA").alias("carrier"), F.lit(1.0).alias("delay")
        )
        df.write.mode("append").parquet(f"{root}/in")
        days = S.rollup_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), "ts", ["origin", "carrier"], "delay")
        query = S.stream_upsert(days, f"{root}/t", f"{root}/w", ["origin", "carrier"])
        query.awaitTermination()
    assert S.dropped_by_watermark(query) > 0
    dates = {str(r["date"]) for r in spark.read.parquet(f"{root}/t").collect()}
    assert dates == {"2024-01-10", "2024-01-12"}
