"""Schedule snapshots: JSON files per airport, local day and collector slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.numbers import snapshot_delay
from tarmac.functions.text import key_text

# Airport, day and slot as they stand in the path, with or without hive-style names.
PATH = r"/(?:airport=)?([A-Za-z0-9]{3})/snapshots(?:=[^/]*)?/(?:local_date=)?(\d{4}-\d{2}-\d{2})/(?:slot=)?(\d{4})"

RECORD = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "flight_iata", "flight_number", "airline_iata", "dep_iata", "arr_iata", "dep_time", "arr_time",
            "dep_delayed", "delayed", "status",
        )
    ]
)
SNAPSHOT = T.StructType(
    [
        T.StructField("airport", T.StringType()),
        T.StructField("local_date", T.StringType()),
        T.StructField("hhmm_local", T.StringType()),
        T.StructField("fetched_at_utc", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)


def records_of(payload: Column) -> Column:
    """The record list of a payload text: a list, or an object with ``data`` or ``results``."""
    listed = F.from_json(payload, T.ArrayType(RECORD))
    wrapped = F.from_json(
        payload, T.StructType([T.StructField("data", T.ArrayType(RECORD)), T.StructField("results", T.ArrayType(RECORD))])
    )
    return F.when(F.startswith(F.ltrim(payload), F.lit("[")), listed).otherwise(
        F.coalesce(wrapped["data"], wrapped["results"])
    )


def with_path_parts(raw: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return raw.select(
        "*",
        F.upper(F.regexp_extract(path, PATH, 1)).alias("path_airport"),
        F.regexp_extract(path, PATH, 2).try_cast("date").alias("path_date"),
        F.regexp_extract(path, PATH, 3).alias("path_slot"),
    )


def explode_snapshots(raw: DataFrame) -> DataFrame:
    """One row per flight record. The path says which airport, day and slot; contents do not."""
    rows = raw.select(
        F.col("path_airport").alias("origin"), F.col("path_date").alias("local_date"), F.col("path_slot").alias("slot"),
        "fetched_at_utc", F.explode(records_of(F.col("data"))).alias("r"),
    ).filter("r is not null")
    return rows.select("origin", "local_date", "slot", "fetched_at_utc", "r.*")


def scan_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all snapshots below a folder; gzip is read as it is."""
    raw = spark.read.schema(SNAPSHOT).option("recursiveFileLookup", "true").json(folder)
    return explode_snapshots(with_path_parts(raw))


def snapshot_records(records: DataFrame) -> DataFrame:
    """Origin, carrier and delay per record; records without carrier are skipped."""
    carrier = key_text("airline_iata")
    return records.filter(F.length(carrier) > 0).select(
        "origin", "local_date", "slot", carrier.alias("carrier"),
        F.coalesce(F.nullif(F.trim("flight_iata"), F.lit("")), F.trim("flight_number")).alias("flight"), "arr_iata", "dep_time",
        snapshot_delay("dep_delayed", "delayed").alias("dep_delay_min"),
    )
