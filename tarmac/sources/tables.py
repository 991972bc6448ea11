"""Parquet and CSV sources: flights, airports, rankings, registries, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import constants as C
from tarmac.functions.numbers import coerce_numeric
from tarmac.functions.text import key_text
from tarmac.operators import filters, joins
from tarmac.session import materialize


def scan_projected(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist; all of them when none does."""
    df = spark.read.parquet(path)
    keep = [c for c in wanted if c in df.columns]
    return df.select(*keep) if keep else df


def scan_glob_prune(
    spark: SparkSession, patterns: list[str], start=None, end=None, single_airline=None, airlines=None,
    codes: DataFrame | None = None, columns=C.PRUNED_COLUMNS,
) -> DataFrame:
    """All parquet files of some globs as pruned, filtered flights.

    Globs are expanded by Spark, each path once; hive partitions, date and airline filters are
    pushed into the scan.
    """
    paths = list(dict.fromkeys(patterns))
    raw = spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(*paths)
    df = filters.canonicalize_columns(raw)
    df = df.select(*[c for c in columns if c in df.columns])
    if "FlightDate" in df.columns:
        if dict(df.dtypes)["FlightDate"] != "date":
            df = df.withColumn("FlightDate", F.col("FlightDate").cast("date"))
        if start and end:
            df = filters.filter_date_range(df, "FlightDate", start, end)
    df = df.withColumns({c: key_text(c) for c in ("Reporting_Airline", "Origin", "Dest") if c in df.columns})
    df = filters.filter_airline(df, "Reporting_Airline", single_airline, airlines)
    if codes is not None:
        df = joins.filter_both_in_set(df, codes, "Origin", "Dest")
    return df


def scan_month_csv(spark: SparkSession, path: str, schema: T.StructType, keep=C.MONTHLY_COLUMNS) -> DataFrame:
    """A landed monthly CSV: trimmed header names, kept columns, real dates.

    ``schema`` gives the columns in order, so nothing is inferred from the data; a file whose header names
    others, or in another order, is an error.
    """
    named = T.StructType([T.StructField(f.name.strip(), f.dataType, f.nullable) for f in schema.fields])
    df = spark.read.csv(
        path, header=True, schema=named, enforceSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    df = df.select(*[c for c in keep if c in df.columns])
    return df.withColumn("FlightDate", F.col("FlightDate").cast("string").try_cast("date"))


def ingest_month_csv(spark: SparkSession, path: str, out: str, schema: T.StructType, keep=C.MONTHLY_COLUMNS) -> None:
    """Monthly CSV to parquet partitioned by Year and Month; a month that comes again replaces itself."""
    df = scan_month_csv(spark, path, schema, keep)
    (
        df.hint("rebalance", "Year", "Month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("Year", "Month").parquet(out)
    )


def _unquote(c):
    return F.upper(F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")))


def scan_airport_set(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Airport codes from one line, one code per line, or a CSV with a named column.

    Without the column in the header every cell counts as a code.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if column:
        table = spark.read.csv(path, header=True, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        match = next((c for c in table.columns if c.strip().strip("\"'").upper() == column.strip().upper()), None)
        if match:
            return table.select(_unquote(F.col(f"`{match}`")).alias("code")).filter("code <> ''").distinct()
    cells = lines.select(F.explode(F.split("value", ",")).alias("cell"))
    return cells.select(_unquote(F.col("cell")).alias("code")).filter("code <> ''").distinct()


def unusual_codes(codes: DataFrame) -> DataFrame:
    """Codes that are not three letters long, for a warning."""
    return codes.filter(F.length("code") != 3)


def scan_airport_dim(spark: SparkSession, path: str, require_position: bool = False) -> DataFrame:
    """Airports with coordinates and zone; blank zones are null, rows without code are dropped.

    ``require_position`` also drops rows whose coordinates do not parse.
    """
    raw = spark.read.csv(path, header=True)
    missing = {"IATA", "Latitude", "Longitude", "Timezone"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks columns {sorted(missing)}")
    zone = F.trim("Timezone")
    df = raw.withColumns(
        {
            "IATA": key_text("IATA"), "Latitude": coerce_numeric("Latitude"), "Longitude": coerce_numeric("Longitude"),
            "Timezone": F.when(~F.lower(zone).isin("nan", "none", ""), zone),
        }
    ).filter("IATA <> ''")
    texts = [c for c in C.AIRPORT_COLUMNS if c in df.columns and c not in ("IATA", "Latitude", "Longitude", "Timezone")]
    df = df.withColumns({c: F.trim(c) for c in texts})
    return df.dropna(subset=["Latitude", "Longitude"]) if require_position else df


def airport_display(airports: DataFrame) -> DataFrame:
    """Lookup rows for a search box: code, name, city, state and a display text."""
    right = F.coalesce(F.nullif("City", F.lit("")), F.nullif("AirportName", F.lit("")), F.col("IATA"))
    return airports.withColumn("display", F.concat(F.col("IATA"), F.lit(" — "), right))


def scan_ranking_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking files ``{AIRLINE}_top_{N}.csv``: airline, n, position, code; the first of equal codes stays."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pattern = "^([A-Za-z0-9]{2})_top_([0-9]+)\\.csv$"
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*_top_*.csv").text(folder).select(
        F.upper(F.regexp_extract(name, pattern, 1)).alias("airline"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("n"),
        F.array_distinct(
            F.filter(F.transform(F.split("value", "[,\\n]"), _unquote), lambda c: c != "")
        ).alias("codes"),
    )
    listed = rows.filter("n is not null").select("airline", "n", F.posexplode("codes").alias("position", "code"))
    return listed.withColumn("position", F.col("position") + 1)


def _clean_name(c):
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, "\ufeff|ï»¿", "")), '^"|"$', ""))


def ragged_headers(spark: SparkSession, path: str) -> DataFrame:
    """The column names of every file, from its first line: file, names (without blank ones at the end)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("row")
    )
    first = lines.filter("at = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    names = F.transform(F.split("header", ","), _clean_name)
    filled = F.array_max(F.transform(names, lambda n, i: F.when(n != "", i + 1).otherwise(0)))
    return first.select("file", F.slice(names, F.lit(1), filled).alias("names"))


def scan_ragged_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Registry files: byte-order mark, blank trailing headers, rows of uneven length, padded cells.

    Every file has a header of its own; files may order their columns differently or have more of them.
    Rows are cut or filled to the header's width; wanted columns are trimmed. A file that lacks a wanted
    column, and a path without any line, is an error.
    """
    headers = materialize(ragged_headers(spark, path), "headers")
    absent = F.array_except(F.array(*[F.lit(c) for c in columns]), F.col("names"))
    width, bad, missing = headers.select("file", F.size("names").alias("w"), absent.alias("absent")).agg(
        F.max("w"), F.min(F.when(F.size("absent") > 0, F.col("file"))), F.min_by("absent", F.when(F.size("absent") > 0, F.col("file")))
    ).first()
    if width is None:
        raise ValueError(f"empty table: {path}")
    if bad is not None:
        raise ValueError(f"{bad} lacks columns {missing}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.csv(
        path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE", escape="\\",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    cells = raw.select(F.col("_metadata.file_path").alias("file"), F.array(*schema.names).alias("cells")).join(headers, "file")
    value = lambda c: F.get("cells", F.array_position("names", F.lit(c)).cast("int") - 1)
    return cells.select(*[F.trim(F.coalesce(value(c), F.lit(""))).alias(c) for c in columns])


def scan_registry_year(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("Tail_Number"), coerce_numeric("Year_Mfr").alias("Year_Mfr"))


def scan_rollups(spark: SparkSession, path: str) -> DataFrame:
    """As-of rollups from CSV: dates, trimmed types, upper-case values, numbers."""
    raw = spark.read.csv(path, header=True)
    keys = ("as_of_date", "group_type", "group_value")
    return raw.select(
        F.col("as_of_date").try_cast("date").alias("as_of_date"), F.trim("group_type").alias("group_type"),
        key_text("group_value").alias("group_value"),
        *[coerce_numeric(c).alias(c) for c in raw.columns if c not in keys],
    )


def missing_weather(needed: DataFrame, cached: DataFrame) -> DataFrame:
    """Airport days that the weather table does not hold yet: what is left to fetch."""
    return needed.select("airport", "date").distinct().join(
        cached.select("airport", "date").distinct(), ["airport", "date"], "left_anti"
    )
