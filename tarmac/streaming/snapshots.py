"""Incremental path: snapshots arrive as files, days are de-duplicated and rolled up.

Everything a batch writes is either a whole partition or a file set named after the batch, so a
batch that runs again after a failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarmac.operators.dedupe import dedupe_latest
from tarmac.operators.rollups import daily_rollup
from tarmac.sources.snapshots import SNAPSHOT, explode_snapshots, with_path_parts

#: Partitions of a batch that are read by name; a batch that touches more joins its keys instead.
TOUCHED = 2000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a parquet table."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def stream_snapshots(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Flight records of snapshot files as they land."""
    raw = (
        spark.readStream.schema(SNAPSHOT).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).json(folder)
    )
    return explode_snapshots(with_path_parts(raw))


def upsert_partitions(
    batch: DataFrame, batch_id: int, table: str, staging: str, partition: str,
    merge: Callable[[DataFrame], DataFrame],
) -> None:
    """Merge a batch into the partitions it touches and replace those.

    The merged partitions are staged under the batch number first. A batch that is repeated finds
    its staged result and only swaps it in again, also when the swap had been interrupted. Only the
    touched partitions are read, up to TOUCHED by a partition filter. When a batch starts, the ones
    before are done: the staged rows of the batch before the last are replaced by an empty table.
    """
    spark = batch.sparkSession
    staged = f"{staging}/batch={batch_id}"
    if not exists(spark, f"{staged}-done"):
        rows = batch
        if exists(spark, table):
            touched = [r[0] for r in batch.select(partition).distinct().limit(TOUCHED + 1).collect()]
            current = spark.read.schema(batch.schema).parquet(table)
            if len(touched) <= TOUCHED:  # read these folders only
                found = F.col(partition).isin([t for t in touched if t is not None])
                current = current.filter(found | F.col(partition).isNull() if None in touched else found)
            else:
                current = current.join(batch.select(partition).distinct(), partition, "left_semi")
            rows = current.select(*batch.columns).unionByName(batch)
        merge(rows).write.mode("overwrite").parquet(staged)
        spark.range(1).write.mode("overwrite").parquet(f"{staged}-done")
    (
        spark.read.schema(batch.schema).parquet(staged)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
    )
    old = f"{staging}/batch={batch_id - 2}"
    if exists(spark, old):
        spark.createDataFrame([], batch.schema).write.mode("overwrite").parquet(old)


def stream_dedupe_daily(
    records: DataFrame, table: str, work: str, keys: list[str], order: list[str], partition: str,
) -> StreamingQuery:
    """Keeps the latest row per key in a table partitioned by day."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_partitions(batch, batch_id, table, f"{work}/staging", partition, lambda rows: dedupe_latest(rows, keys, order))

    return (
        records.writeStream.foreachBatch(merge).option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True).start()
    )


def rollup_stream(records: DataFrame, event_time: str, keys: list[str], delay: str, lateness: str = "1 day") -> DataFrame:
    """Tumbling days per key: flights, known delays and their sum, open for late rows that long."""
    timed = records.withWatermark(event_time, lateness)
    days = timed.groupBy(F.window(event_time, "1 day").alias("w"), *keys).agg(
        F.coalesce(F.sum(delay), F.lit(0.0)).alias("dep_delay_sum"), F.count(delay).alias("dep_delay_count"),
        F.count("*").alias("dep_flight_count"),
    )
    measures = ["dep_delay_sum", "dep_delay_count", "dep_flight_count"]
    return days.select(F.col("w.start").cast("date").alias("date"), *keys, *measures)


def stream_upsert(updates: DataFrame, table: str, work: str, keys: list[str]) -> StreamingQuery:
    """Replaces the (date, keys) rows a running rollup has changed; the greatest batch wins."""
    columns = updates.columns

    def merge(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.select(*columns, F.lit(batch_id).cast("long").alias("batch_id"))
        upsert_partitions(
            numbered, batch_id, table, f"{work}/staging", "date", lambda rows: dedupe_latest(rows, ["date", *keys], ["batch_id"])
        )

    return (
        updates.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True).start()
    )


def stream_append(rows: DataFrame, table: str, work: str) -> StreamingQuery:
    """Final days only: a day is written once the watermark has passed it."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", table)
        .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Spark's own count of what came after the watermark.

    It counts pre-aggregated groups, possibly more than once: above 0 means that late data was
    dropped, not how many rows.
    """
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def finalize_day(records: DataFrame) -> DataFrame:
    """Daily rollup of a de-duplicated day."""
    return daily_rollup(records, ["origin", "carrier"], "local_date", "dep_delay_min")
