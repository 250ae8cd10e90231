"""Scoring of detections: confidence refinement, suppression of overlaps, ranking and competition rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators.intervals import within


def keypoint_quality(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """detection_id, quality: mean over a detection's frames of the mean keypoint confidence, 0 without frames.

    ``detections`` has run, start_idx, end_idx.
    """
    of_frame = frames.select("run", "idx", F.array_compact(F.array(*(f"c{i}" for i in range(17)))).alias("c"))
    mean = F.try_divide(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), F.size("c"))
    inside = within(detections.select("run", "detection_id", "start_idx", "end_idx"), of_frame.select("run", "idx", mean.alias("mean")))
    found = inside.groupBy("detection_id").agg(F.avg("mean").alias("quality"))
    return detections.select("detection_id").join(found, "detection_id", "left").select("detection_id", F.coalesce("quality", F.lit(0.0)).alias("quality"))


def multi_factor(base: Column, quality: Column, coverage: Column, ratio: Column) -> Column:
    """Weighted mean of the factors that are known (0.4, 0.2, 0.2, 0.2), 1 at most."""
    parts = [(0.4, base), (0.2, quality), (0.2, coverage), (0.2, ratio)]
    total = sum((F.when(c.isNull(), 0.0).otherwise(w * c) for w, c in parts), F.lit(0.0))
    weight = sum((F.when(c.isNull(), 0.0).otherwise(F.lit(w)) for w, c in parts), F.lit(0.0))
    return F.least(F.try_divide(total, weight), F.lit(1.0))


def suppress_overlaps(detections: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Greedy suppression per run and trick: a detection goes if it overlaps a kept one of higher confidence by more.

    Detections that do not overlap, not even by way of others, cannot suppress each other, so only such a chain is put together.
    """
    by_start = Window.partitionBy("run", "trick_id").orderBy("start_ms", "end_ms", "detection_id")
    reached = F.max("end_ms").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = detections.withColumn("fresh", F.when(F.col("start_ms") < reached, 0).otherwise(1))
    chained = apart.withColumn("chain", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct((-F.col("confidence")).alias("rank"), "detection_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    grouped = chained.groupBy("run", "trick_id", "chain").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def overlaps(a: Column, b: Column) -> Column:
        both = F.greatest(F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]), F.lit(0))
        return both > overlap * ((a["e"] - a["s"]) + (b["e"] - b["s"]) - both)

    empty = F.slice("items", 1, 0)
    kept = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select("run", "trick_id", F.explode(kept).alias("k")).select("run", "trick_id", "k.detection_id", (-F.col("k.rank")).alias("confidence"), F.col("k.s").alias("start_ms"), F.col("k.e").alias("end_ms"))


def ranked(detections: DataFrame, difficulty: DataFrame, least: float = 0.5, n: int = 3) -> DataFrame:
    """run, rank, detection_id, trick_id, confidence, difficulty, weighted: the hardest ``n`` detections of each run, overlaps suppressed."""
    known = suppress_overlaps(detections.filter(F.col("confidence") >= least)).join(difficulty, "trick_id", "left").withColumn("difficulty", F.coalesce("difficulty", F.lit(0.0)))
    order = Window.partitionBy("run").orderBy(F.col("difficulty").desc(), F.col("confidence").desc(), "detection_id")
    best = known.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)
    return best.select("run", "rank", "detection_id", "trick_id", "confidence", "difficulty", F.round(F.col("difficulty") * F.col("confidence"), 3).alias("weighted"))


def totals(top: DataFrame) -> DataFrame:
    """run, total and max_possible of :func:`ranked` detections: what they score, and would score if they were certain."""
    return top.groupBy("run").agg(F.round(F.sum("weighted"), 3).alias("total"), F.round(F.sum("difficulty"), 3).alias("max_possible"))


def top_scored(detections: DataFrame, difficulty: DataFrame, least: float = 0.5, n: int = 3) -> DataFrame:
    """run, rank, detection_id, weighted, total: the hardest ``n`` detections of each run with their summed score."""
    best = ranked(detections, difficulty, least, n)
    return best.select("run", "rank", "detection_id", "weighted", F.sum("weighted").over(Window.partitionBy("run")).alias("total"))


def first_of_each(detections: DataFrame) -> DataFrame:
    """Repeat rule: of each run and trick only the earliest detection counts."""
    order = Window.partitionBy("run", "trick_id").orderBy("start_ms", "detection_id")
    return detections.withColumn("repeat", F.row_number().over(order)).filter("repeat = 1").drop("repeat")


def competition(detections: DataFrame, scores: DataFrame, least: float = 0.3, n: int = 3, penalty: float = 0.5) -> DataFrame:
    """run, final, counted, repeats: the sum of the best ``n`` scores after the repeat rule, off-axis rows with a penalty."""
    sure = detections.filter(F.col("confidence") >= least)
    first = first_of_each(sure).join(scores, "trick_id", "left")
    value = F.round(F.greatest(F.coalesce("score", F.lit(0.0)) - F.when(F.col("axis") == "off_axis", penalty).otherwise(0.0), F.lit(0.0)), 1)
    order = Window.partitionBy("run").orderBy(F.col("value").desc(), "detection_id")
    best = first.withColumn("value", value).withColumn("rank", F.row_number().over(order))
    final = best.groupBy("run").agg(F.round(F.sum(F.when(F.col("rank") <= n, F.col("value")).otherwise(0.0)), 1).alias("final"), F.count_if(F.col("rank") <= n).alias("counted"), F.count("*").alias("distinct_tricks"))
    total = sure.groupBy("run").agg(F.count("*").alias("all"))
    return final.join(total, "run").select("run", "final", "counted", (F.col("all") - F.col("distinct_tricks")).alias("repeats"))
