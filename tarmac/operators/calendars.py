"""When the collector runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.text import hash_spread
from tarmac.functions.times import col, local_to_utc


def schedule_calendar(
    airports: DataFrame, name: str, zone: str, first_day, last_day, slots=C.COLLECTOR_SLOTS,
    spread_minutes: int = C.COLLECTOR_SPREAD_MINUTES,
) -> DataFrame:
    """Run times per airport, slot and day in UTC.

    Each run is moved by a stable offset within the spread, which never crosses local midnight. Airports are a small file, often
    of one task, and their runs many rows; so airports are dealt to all tasks first, and the offset is hashed once per slot, not per day.
    """
    choices = []
    for slot in slots:
        hour, minute = (int(x) for x in slot.split(":"))
        start = hour * 60 + minute
        allowed = max(0, min(spread_minutes, 24 * 60 - 1 - start))
        choices.append(
            F.struct(F.lit(slot).alias("slot"), F.lit(start * 60).alias("start"), F.lit(allowed * 60).alias("spread"))
        )
    tasks = int(airports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = airports.repartition(tasks).withColumn("s", F.explode(F.array(*choices)))
    second = F.col("s.start") + hash_spread(name, F.col("s.slot"), F.col("s.spread"))
    moved = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    runs = starts.withColumn("__moved", moved).withColumn("day", F.explode(F.sequence(col(first_day), col(last_day))))
    local = F.col("day").cast("timestamp_ntz") + F.col("__moved")
    return runs.withColumns({"slot": F.col("s.slot"), "run_local": local}).withColumn(
        "run_utc", local_to_utc("run_local", zone)
    ).drop("s", "__moved")
