"""From frames to a judged run: detections by rules with refined confidence, suppression of overlaps, the best three, and the audit trail."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators import rules, scoring, sequence
from motionframe.sources import sinks, storage


class Analysis(NamedTuple):
    """detections (run, detection_id, trick_id, confidence, start_ms, end_ms, is_top3), top (:func:`scoring.ranked`), scores (run, total, max_possible) and audit (run, nth, kind, message)."""

    detections: DataFrame
    top: DataFrame
    scores: DataFrame
    audit: DataFrame


def analyze(frames: DataFrame, angles: DataFrame, poses: DataFrame, catalog: DataFrame, difficulty: DataFrame, least: float = 0.5, n: int = 3) -> Analysis:
    """Analyse all runs of ``frames`` with the rule ``catalog`` and the tricks' ``difficulty`` (trick_id, difficulty).

    A detection's number counts those of its run in the order of time and trick.  Runs without a detection have no rows but one of the
    audit, which says that nothing was scored.  The detections are written once, as all else is made of them.
    """
    found = sequence.with_times(rules.classified(frames, angles, catalog, poses, least), frames)
    order = Window.partitionBy("run").orderBy("start_ms", "end_ms", "trick_id")
    numbered = storage.cut(found.select("run", F.row_number().over(order).cast("long").alias("detection_id"), "trick_id", "confidence", "start_ms", "end_ms"))
    top = storage.cut(scoring.ranked(numbered, difficulty, least, n))
    scores = scoring.totals(top)
    every = frames.select("run").distinct().join(scores.select("run", "total"), "run", "left").select("run", F.coalesce("total", F.lit(0.0)).alias("total"))
    return Analysis(sinks.with_top_flag(numbered, top), top, scores, sinks.audit_entries(numbered, every))
