"""Queries: the incremental path, run to the end on the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import fixtures as X
from tarmac.queries.inputs import _SNAP_SQL, _snapshot_files
from tarmac.queries.registry import on_events, query
from tarmac.session import shared_folder
from tarmac.sources.snapshots import snapshot_records
from tarmac.streaming import snapshots as S


def event_stream(spark, sf):
    """The events table as a stream of departures."""
    schema = X.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return as_departures(raw)


def as_departures(raw):
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"), F.expr("cast(user_id % 7 as int)").alias("origin"),
        F.col("event_type").alias("carrier"), F.when(F.col("event_type") != "error", F.col("value")).alias("delay"),
    )


_ROLLUP_SQL = """SELECT day AS date, station AS origin, event_type AS carrier, round(coalesce(sum(CASE WHEN event_type <> 'error' THEN value END), 0), 4) AS dep_delay_sum,
  count(CASE WHEN event_type <> 'error' THEN value END) AS dep_delay_count, count(*) AS dep_flight_count FROM ev {where} GROUP BY ALL"""


@query("stream_snapshots", on_events("SELECT origin, local_date, slot, carrier, flight, dep_delay_min FROM sn WHERE carrier <> ''", _SNAP_SQL))
def stream_snapshots(spark, sf):
    root = shared_folder(spark, "stream")
    _snapshot_files(spark, sf, f"{root}/in")
    records = snapshot_records(S.stream_snapshots(spark, f"{root}/in"))
    S.stream_append(records, f"{root}/out", f"{root}/work").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select("origin", "local_date", "slot", "carrier", "flight", "dep_delay_min")


@query(
    "stream_dedupe_daily",
    on_events(
        """SELECT origin, local_date, flight, carrier, dep_delay_min, slot FROM sn WHERE carrier <> ''
        QUALIFY row_number() OVER (PARTITION BY origin, local_date, flight ORDER BY slot DESC, carrier DESC, coalesce(dep_delay_min, -1) DESC) = 1""",
        _SNAP_SQL,
    ),
)
def stream_dedupe_daily(spark, sf):
    """Snapshots come in several batches; the latest slot of a flight and day wins."""
    root = shared_folder(spark, "stream")
    _snapshot_files(spark, sf, f"{root}/in")
    records = snapshot_records(S.stream_snapshots(spark, f"{root}/in", files_per_batch=200))
    rows = records.select(
        "origin", "flight", "carrier", "dep_delay_min", "slot", F.coalesce("dep_delay_min", F.lit(-1.0)).alias("known"), "local_date"
    )
    S.stream_dedupe_daily(
        rows, f"{root}/out", f"{root}/work", ["origin", "local_date", "flight"], ["slot", "carrier", "known"], "local_date"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("origin", "local_date", "flight", "carrier", "dep_delay_min", "slot")


@query("stream_daily_rollup", on_events(_ROLLUP_SQL.format(where="")))
def stream_daily_rollup(spark, sf):
    root = shared_folder(spark, "stream")
    days = S.rollup_stream(event_stream(spark, sf), "ts", ["origin", "carrier"], "delay")
    S.stream_upsert(days, f"{root}/out", f"{root}/work", ["origin", "carrier"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id").withColumn("dep_delay_sum", F.round("dep_delay_sum", 4))


def _two_batches(spark, sf, root, first, second, lateness):
    """Two runs of one rollup query: the second run finds more files and the first run's state."""
    events = X.table(spark, sf, "events")
    schema = events.schema
    for rows in (first, second):
        events.filter(rows).write.mode("append").parquet(f"{root}/in")
        raw = spark.readStream.schema(schema).parquet(f"{root}/in")
        days = S.rollup_stream(as_departures(raw), "ts", ["origin", "carrier"], "delay", lateness)
        S.stream_upsert(days, f"{root}/out", f"{root}/work", ["origin", "carrier"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id").withColumn("dep_delay_sum", F.round("dep_delay_sum", 4))


@query("stream_upsert", on_events(_ROLLUP_SQL.format(where="")))
def stream_upsert(spark, sf):
    """Each day comes in two runs; the second run replaces the rows of the first."""
    root = shared_folder(spark, "stream")
    return _two_batches(spark, sf, root, "event_id % 2 = 0", "event_id % 2 = 1", "60 days")


@query("stream_late_data", on_events(_ROLLUP_SQL.format(where="WHERE day >= DATE '2024-01-15'")))
def stream_late_data(spark, sf):
    """Days before the 15th come after the watermark has passed them and change nothing."""
    root = shared_folder(spark, "stream")
    return _two_batches(
        spark, sf, root, "ts >= timestamp_ntz'2024-01-15 00:00:00'", "ts < timestamp_ntz'2024-01-15 00:00:00'", "1 day"
    )
