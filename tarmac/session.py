"""Session settings the library reads, and the shared folder for written intermediates."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "tarmac") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A cluster has to name that folder. Only a local session, which has no executors to lose, falls
    back to a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tarmac-")
        root = _local_roots[context.applicationId]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df, purpose: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive lost executors, and lets several later passes scan the
    result instead of computing it again.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(df, purpose: str):
    """``materialize`` for the time of a block; the files go with it, so nothing that is read later may depend on them."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
