"""Joining frames to the intervals of their run that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a stretch; a frame meets only the intervals that touch its stretch of its run.
WIDTH = 256


def within(intervals: DataFrame, frames: DataFrame, low: str = "start_idx", high: str = "end_idx", width: int = WIDTH) -> DataFrame:
    """The frames from ``low`` to ``high`` of every interval, with the interval's columns; overlapping intervals each have their own rows.

    Both sides are joined by run and stretch, so a long run is many keys; an interval stands in each stretch that it touches, and a
    frame in one, so no row comes twice.  An interval that ends before it starts has no frames.
    """
    touched = F.sequence(F.floor(F.col(low) / width).cast("long"), F.greatest(F.floor(F.col(high) / width), F.floor(F.col(low) / width)).cast("long"))
    spread = intervals.withColumn("_stretch", F.explode(touched))
    placed = frames.withColumn("_stretch", F.floor(F.col("idx") / width).cast("long"))
    return placed.join(spread, ["run", "_stretch"]).filter(F.col("idx").between(F.col(low), F.col(high))).drop("_stretch")
