"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_template(path: str, target: str, thr: int | None = None) -> str:
    """Fills ``{target}`` and ``{thr}`` of a configured path."""
    return path.format(target=target) if thr is None else path.format(target=target, thr=thr)


def write_features(df: DataFrame, path: str, partition_by=("Year", "Month"), date: str = "FlightDate") -> None:
    """Feature, history and scored tables: parquet by month, each month replaced as a whole."""
    if set(partition_by) == {"Year", "Month"} and "Year" not in df.columns:
        df = df.withColumns({"Year": F.year(date), "Month": F.month(date)})
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    )


def write_balanced(tables: dict[int, DataFrame], path: str) -> None:
    """Balanced training tables of all thresholds below one path, one partition per threshold."""
    for thr, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/thr={thr}")


def write_table_csv(df: DataFrame, path: str) -> None:
    """Small report tables (reliability, importance, counts) with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, compress: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", "gzip") if compress else writer).json(path)
