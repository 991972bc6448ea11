"""Writing small named text files from tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_named_texts(df: DataFrame, name: str, text: str, folder: str) -> None:
    """One file per row, named by the row.

    Spark names its files itself, so rows are written as partitions first and the files are renamed
    through the file system they are on. Meant for small reports; one row per file.
    """
    spark = df.sparkSession
    staged = f"{folder}/_named"
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).repartition(F.col("name")).write.partitionBy("name").text(staged)
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(staged).getFileSystem(hadoop)
    for entry in system.globStatus(path(f"{staged}/name=*/part-*")):
        source = entry.getPath()
        target = source.getParent().getName()[len("name="):]
        system.rename(source, path(f"{folder}/{target}"))
    system.delete(path(staged), True)
