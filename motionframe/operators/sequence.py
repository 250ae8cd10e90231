"""Sequence operators over frames (run, idx, t_ms, ...): windows per run, islands and interval merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class SegmentConfig:
    """Thresholds of the segmentation; the defaults suit the hourly event signal."""

    window: int = 5
    factor: float = 1.5
    pad_ms: int = HOUR_MS
    merge_gap_ms: int = HOUR_MS * 3 // 2
    min_ms: int = 2 * HOUR_MS
    max_ms: int = 48 * HOUR_MS


def by_frame() -> Window:
    return Window.partitionBy("run").orderBy("idx")


def by_frame_backward() -> Window:
    """For what follows a frame: a window that ends with the last row is gone through anew for every row, one that begins there is not."""
    return Window.partitionBy("run").orderBy(F.col("idx").desc())


def velocity(frames: DataFrame, value: str = "v", name: str = "velocity") -> DataFrame:
    """Adds the change of ``value`` a second; 0 at the first frame and where time stands still."""
    order = by_frame()
    seconds = (F.col("t_ms") - F.lag("t_ms").over(order)) / 1000.0
    change = F.col(value) - F.lag(value).over(order)
    return frames.withColumn(name, F.when(F.lag("t_ms").over(order).isNull() | (seconds <= 0), F.lit(0.0)).otherwise(F.try_divide(change, seconds)))


def joint_intensity(frames: DataFrame, joints: list[str], name: str = "intensity") -> DataFrame:
    """Adds the mean speed of the joints known in both frames, 0 if there is none or no time passed."""
    order = by_frame()
    seconds = (F.col("t_ms") - F.lag("t_ms").over(order)) / 1000.0
    moves = [F.abs(F.col(j) - F.lag(j).over(order)) for j in joints]
    known = sum((F.when(m.isNull(), 0).otherwise(1) for m in moves), F.lit(0))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in moves), F.lit(0.0))
    return frames.withColumn(name, F.when(seconds.isNull() | (seconds <= 0) | (known == 0), F.lit(0.0)).otherwise(F.try_divide(total / seconds, known)))


def smooth_shrinking(column: str, window: int) -> Column:
    """Centred mean whose window shrinks at the edges."""
    return F.avg(column).over(by_frame().rowsBetween(-(window // 2), window // 2))


def smooth_zero_padded(column: str, window: int) -> Column:
    """Centred mean as a convolution: beyond the edges stand zeros."""
    return F.sum(column).over(by_frame().rowsBetween(-(window // 2), (window - 1) // 2)) / window


def adaptive_threshold(smoothed: DataFrame, factor: float) -> DataFrame:
    """run, threshold: ``factor`` times the median of the positive values, 0 without any."""
    return smoothed.groupBy("run").agg(F.coalesce(F.median(F.when(F.col("smooth") > 0, F.col("smooth"))) * factor, F.lit(0.0)).alias("threshold"))


def smoothed_signal(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    speeds = velocity(frames).withColumn("speed", F.abs("velocity"))
    return speeds.select("run", "idx", "t_ms", smooth_shrinking("speed", config.window).alias("smooth"))


def islands(flagged: DataFrame) -> DataFrame:
    """run, start_idx, end_idx, peak of every stretch of frames with ``active``; needs ``smooth``."""
    numbered = flagged.withColumn("place", F.col("idx") - F.row_number().over(Window.partitionBy("run", "active").orderBy("idx")))
    return numbered.filter("active").groupBy("run", "place").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.max("smooth").alias("peak")).drop("place")


def active_frames(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    """Frames with ``smooth``, ``active`` and the frame range that padding reaches from each of them."""
    smooth = smoothed_signal(frames, config)
    threshold = adaptive_threshold(smooth, config.factor)
    around = Window.partitionBy("run").orderBy("t_ms").rangeBetween(-config.pad_ms, config.pad_ms)
    return (
        smooth.withColumns({"pad_from": F.min("idx").over(around), "pad_to": F.max("idx").over(around)})
        .join(threshold, "run")
        .withColumn("active", (F.col("threshold") > 0) & (F.col("smooth") >= F.col("threshold")))
    )


def padded_islands(active: DataFrame) -> DataFrame:
    """run, start_idx, end_idx of the islands, extended by the padding time."""
    numbered = active.withColumn("place", F.col("idx") - F.row_number().over(Window.partitionBy("run", "active").orderBy("idx")))
    return numbered.filter("active").groupBy("run", "place").agg(F.min("pad_from").alias("start_idx"), F.max("pad_to").alias("end_idx")).drop("place")


def merge_intervals(intervals: DataFrame, start: str, end: str, gap: int, *carried: Column) -> DataFrame:
    """run, ``start``, ``end``: intervals of a run joined while the next starts within ``gap`` of the furthest end so far.

    ``carried`` are aggregates over the intervals that are joined.
    """
    order = Window.partitionBy("run").orderBy(start, end)
    furthest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(furthest.isNull() | (F.col(start) - furthest > gap), 1).otherwise(0)
    grouped = intervals.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("run", "part").agg(F.min(start).alias(start), F.max(end).alias(end), *carried).drop("part")


def with_times(intervals: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds start_ms and end_ms of the frames at both ends."""
    times = frames.select("run", F.col("idx").alias("at"), "t_ms")
    first = times.select("run", F.col("at").alias("start_idx"), F.col("t_ms").alias("start_ms"))
    last = times.select("run", F.col("at").alias("end_idx"), F.col("t_ms").alias("end_ms"))
    return intervals.join(first, ["run", "start_idx"]).join(last, ["run", "end_idx"])


def segments(frames: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """run, start_idx, end_idx, start_ms, end_ms, peak of the active intervals of every run."""
    config = config or SegmentConfig()
    active = active_frames(frames, config)
    timed = with_times(padded_islands(active), active)
    merged = merge_intervals(timed.select("run", "start_ms", "end_ms"), "start_ms", "end_ms", config.merge_gap_ms)
    kept = merged.filter((F.col("end_ms") - F.col("start_ms")).between(config.min_ms, config.max_ms))
    inside = kept.join(active.select("run", "idx", "t_ms", "smooth"), "run").filter(F.col("t_ms").between(F.col("start_ms"), F.col("end_ms")))
    return inside.groupBy("run", "start_ms", "end_ms").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.max("smooth").alias("peak"))


def frame_windows(flagged: DataFrame, pad: int = 3, gap: int = 5, least: int = 8) -> DataFrame:
    """run, start_idx, end_idx: islands padded by frames and merged; a run without one is one window as a whole."""
    bounds = flagged.groupBy("run").agg(F.max("idx").alias("last"))
    padded = islands(flagged).join(bounds, "run").select("run", F.greatest(F.col("start_idx") - pad, F.lit(0)).alias("start_idx"), F.least(F.col("end_idx") + pad, F.col("last")).alias("end_idx"))
    kept = merge_intervals(padded, "start_idx", "end_idx", gap).filter(F.col("end_idx") - F.col("start_idx") + 1 >= least)
    whole = bounds.join(kept, "run", "left_anti").select("run", F.lit(0).cast("long").alias("start_idx"), F.col("last").alias("end_idx"))
    return kept.unionByName(whole)


def resample(frames: DataFrame, value: str, length: int) -> DataFrame:
    """run, step, value at ``length`` even places of each run, linear between the known frames and constant outside."""
    ends = frames.groupBy("run").agg(F.max("idx").alias("last"))
    known = frames.filter(F.col(value).isNotNull()).select("run", F.col("idx").cast("double").alias("at"), F.col(value).alias("known"), F.lit(None).cast("long").alias("step"))
    wanted = ends.select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("step"), "last")
    wanted = wanted.select("run", (F.col("step") * F.col("last") / (length - 1)).alias("at"), F.lit(None).cast("double").alias("known"), "step")
    one = Window.partitionBy("run")
    before, after = (order.rowsBetween(Window.unboundedPreceding, 0) for order in (one.orderBy("at", F.col("step").asc_nulls_first()), one.orderBy(F.col("at").desc(), F.col("step").desc_nulls_last())))
    point = F.when(F.col("known").isNotNull(), F.struct("at", "known"))
    both = known.unionByName(wanted).withColumns({"left": F.last(point, ignorenulls=True).over(before), "right": F.last(point, ignorenulls=True).over(after)})
    share = F.try_divide(F.col("at") - F.col("left.at"), F.col("right.at") - F.col("left.at"))
    line = F.col("left.known") + F.coalesce(share, F.lit(0.0)) * (F.col("right.known") - F.col("left.known"))
    return both.filter("step IS NOT NULL").select("run", "step", F.coalesce(line, F.col("left.known"), F.col("right.known")).alias(value))


def forward_fill(frames: DataFrame, value: str, default: float = 0.0) -> DataFrame:
    """Missing values take the last known one, ``default`` before the first."""
    so_far = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.lit(default)))


def sampled_frames(frames: DataFrame, samples: int = 16) -> DataFrame:
    """run, sample, idx: evenly spaced frames, the last repeated in short runs."""
    ends = frames.groupBy("run").agg(F.max("idx").alias("last"))
    each = ends.select("run", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("sample"))
    even = F.floor(F.col("sample") * F.col("last") / (samples - 1)).cast("long")
    return each.select("run", "sample", F.when(F.col("last") + 1 >= samples, even).otherwise(F.least("sample", "last")).alias("idx"))


def airtime_segments(frames: DataFrame, value: str, gap_ms: int, pad_ms: int, min_ms: int, max_ms: int) -> DataFrame:
    """Intervals where ``value`` exceeds its mean by a standard deviation, merged over gaps, padded and of usual length."""
    level = frames.groupBy("run").agg((F.avg(value) + F.stddev_pop(value)).alias("level"))
    flagged = frames.join(level, "run").select("run", "idx", "t_ms", F.col(value).alias("smooth"), (F.col(value) > F.col("level")).alias("active"))
    found = with_times(islands(flagged), flagged).select("run", "start_ms", "end_ms")
    merged = merge_intervals(found, "start_ms", "end_ms", gap_ms)
    padded = merged.select("run", (F.col("start_ms") - pad_ms).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"))
    return padded.filter((F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms))


def best_segment(found: DataFrame) -> DataFrame:
    """Each run's segment of the highest peak, the first of equals."""
    order = Window.partitionBy("run").orderBy(F.col("peak").desc(), "start_idx")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
