"""Active sessions of an unbounded signal: values above a fixed level, joined while the gaps are short.

The adaptive level of the batch segmentation needs the whole run; a stream takes a fixed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_sessions(events: DataFrame, level: float, gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n, peak of each closed session; ``events`` has user_id, ts (timestamp) and value, bounded or not."""
    return (
        events.filter(F.col("value") >= level)
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("session"), "user_id")
        .agg(F.count("*").alias("n"), F.max("value").alias("peak"))
        .select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "peak")
    )
