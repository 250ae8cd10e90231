"""A steady crop around a person from the boxes found in some of a run's frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators.sequence import by_frame, by_frame_backward, smooth_zero_padded

CORNERS = ("x0", "y0", "x1", "y1")


def interpolated(frames: DataFrame, values: tuple[str, ...], known: Column) -> DataFrame:
    """``values`` linear between the frames where ``known`` holds, and constant before the first and after the last of them."""
    order = by_frame()
    point = F.when(known, F.struct("idx", *values))
    before = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(point, ignorenulls=True).over(by_frame_backward().rowsBetween(Window.unboundedPreceding, 0))
    placed = frames.withColumns({"_before": before, "_after": after})
    share = F.coalesce(F.try_divide(F.col("idx") - F.col("_before.idx"), F.col("_after.idx") - F.col("_before.idx")), F.lit(0.0))
    line = {v: F.coalesce(F.col(f"_before.{v}") + share * (F.col(f"_after.{v}") - F.col(f"_before.{v}")), F.col(f"_before.{v}"), F.col(f"_after.{v}")) for v in values}
    return placed.withColumns(line).drop("_before", "_after")


def stable_crops(frames: DataFrame, padding: float = 1.8, smallest: float = 400.0, window: int = 15, least: int = 5) -> DataFrame:
    """run, idx, x0, y0, x1, y1: a square around the box of each frame of ``frames`` (run, idx, x0, y0, x1, y1, width, height).

    Frames without a box have null corners; the corners are interpolated, the centre and the padded size smoothed over ``window`` frames
    with zeros beyond the ends, the size kept within a fifth of the run's median, and the square shifted into the picture of width by
    height.  A run with fewer than ``least`` boxes gets whole pictures.
    """
    known = F.col("x0").isNotNull()
    filled = interpolated(frames.withColumn("boxes", F.count(F.when(known, 1)).over(Window.partitionBy("run"))), CORNERS, known)
    side = F.greatest(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * padding, F.lit(smallest))
    sized = filled.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "side": side})
    smooth = sized.select("run", "idx", "width", "height", "boxes", *(smooth_zero_padded(c, window).alias(c) for c in ("cx", "cy", "side")))
    middle = smooth.groupBy("run").agg(F.median("side").alias("middle"))
    half = F.least(F.greatest(F.col("side"), F.col("middle") * 0.8), F.col("middle") * 1.2) / 2
    placed = smooth.join(middle, "run").withColumn("half", half)

    def axis(centre: str, size: str) -> tuple[Column, Column]:
        low, high, most = F.col(centre) - F.col("half"), F.col(centre) + F.col("half"), F.col(size)
        right = F.when(low < 0, high - low).otherwise(high)
        left = F.greatest(low, F.lit(0.0))
        return F.greatest(F.when(right > most, left - (right - most)).otherwise(left), F.lit(0.0)), F.least(right, most)

    (x0, x1), (y0, y1) = axis("cx", "width"), axis("cy", "height")
    few = F.col("boxes") < least
    whole = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("width"), "y1": F.col("height")}
    return placed.select("run", "idx", *(F.when(few, whole[k]).otherwise(c).alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))
