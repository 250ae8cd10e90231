"""Ways to find a movement in a window of frames, under one contract, and the function that dispatches to them by a movement's method.

A strategy is given one trick and the frames of one window and returns (confidence, first place, last place) or None.  Own strategies
are plain Python over one window, called through a table function, so each window with each trick gives one row or none.  The rules
of whole catalogs over long runs are native in :mod:`motionframe.operators.rules`; both give the same for the same window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from motionframe.operators import rules, trajectory
from motionframe.operators.intervals import within

#: trick (a row of trick_id, rules and references), times and values (a row a frame, NaN where unknown) to a finding or none.
Strategy = Callable[[object, np.ndarray, np.ndarray], tuple[float, int, int] | None]
TRICK = "struct<trick_id: string, rules: array<struct<phase_no: bigint, min_ms: double, max_ms: double, place: int, low: double, high: double>>, references: array<array<array<double>>>>"


def _phase_ends(scores: np.ndarray, shortest: int, longest: int) -> dict[int, tuple[float, int]]:
    """For each start the best confidence and its earliest end; ``scores`` has a row a rule and a column a frame."""
    n, found = scores.shape[1], {}
    for start in range(n - shortest + 1):
        best = np.maximum.accumulate(scores[:, start : start + longest], axis=1)
        sure = np.minimum(np.round(best.sum(axis=0) / len(scores), 9), 1.0)[shortest - 1 :]
        at = int(sure.argmax())
        if sure[at] >= rules.LEAST_PHASE:
            found[start] = (float(sure[at]), start + shortest - 1 + at)
    return found


def angle_threshold(trick, times: np.ndarray, values: np.ndarray) -> tuple[float, int, int] | None:
    """Phases that follow each other, each by the best frame of each of its ranges of angles."""
    n = len(times)
    step = times[1] - times[0] if n > 1 else 0.0
    fps = 1000 / step if step > 0 else 30.0
    phases: dict[int, list] = {}
    for r in trick.rules or ():
        phases.setdefault(r.phase_no, []).append(r)
    paths = None
    for _, phase in sorted(phases.items()):
        shortest = max(1, int(phase[0].min_ms / 1000.0 * fps // 1))
        longest = max(shortest, int(phase[0].max_ms / 1000.0 * fps // 1))
        ranged = [r for r in phase if r.place is not None]
        if ranged:
            scores = np.zeros((len(ranged), n))
            for row, r in zip(scores, ranged, strict=True):
                angle, half = values[:, r.place], (r.high - r.low) / 2
                inside = (angle >= r.low) & (angle <= r.high)
                row[inside] = np.maximum(0.0, 1 - np.abs(angle[inside] - (r.low + r.high) / 2) / half * rules.OFF_MIDDLE) if half > 0 else 1.0
            ends = _phase_ends(scores, shortest, longest)
        else:
            ends = {s: (1.0, s + shortest - 1) for s in range(n - shortest + 1)}
        if paths is None:
            paths = {s: (c, e) for s, (c, e) in ends.items()}
        else:
            paths = {s: (c + ends[e + 1][0], ends[e + 1][1]) for s, (c, e) in paths.items() if e + 1 in ends}
    if not paths:
        return None
    start = min(paths, key=lambda s: (-round(paths[s][0] / len(phases), 9), s))
    confidence = round(paths[start][0] / len(phases), 9)
    return (confidence, start, paths[start][1]) if confidence >= rules.LEAST_PHASE else None


def reference_warping(trick, times: np.ndarray, values: np.ndarray, least: float = 0.3) -> tuple[float, int, int] | None:
    """The surest of the trick's reference trajectories by banded time warping over the whole window."""
    shown = np.nan_to_num(values)
    sure = [max(0.0, 1.0 - trajectory.warped_distance(shown, np.array(r, dtype=float)) / max(len(shown), len(r), 1) / trajectory.SCALE) for r in trick.references or ()]
    return (max(sure), 0, len(times) - 1) if sure and max(sure) >= least else None


#: Strategies by method; a method that is not here takes the first.
STRATEGIES: dict[str, Strategy] = {"angle_threshold": angle_threshold, "reference_warping": reference_warping}


def evaluator(strategies: dict[str, Strategy] = STRATEGIES):
    """A table function (method, trick, times, values) with one row or none: confidence, first, last, strategy.

    The strategies travel with the function, so own ones need not be installed on the executors.
    """
    known, default = dict(strategies), next(iter(strategies))

    class Evaluated:
        def eval(self, method: str, trick, times, values):
            name = method if method in known else default
            if trick is None or not times:
                return
            shown = np.array([[np.nan if x is None else x for x in row] for row in values], dtype=float)
            found = known[name](trick, np.array(times, dtype=float), shown)
            if found is not None:
                yield float(found[0]), int(found[1]), int(found[2]), name

    return udtf(Evaluated, returnType="confidence double, first bigint, last bigint, strategy string")


def trick_windows(segments: DataFrame, frames: DataFrame, tricks: DataFrame) -> DataFrame:
    """run, start_idx, end_idx and the columns of ``tricks`` for every segment and trick; a run without a segment is one as a whole."""
    runs = frames.groupBy("run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    bounds = runs.join(segments.select("run", "start_idx", "end_idx"), "run", "left").select("run", F.coalesce("start_idx", "first_idx").alias("start_idx"), F.coalesce("end_idx", "last_idx").alias("end_idx"))
    return bounds.crossJoin(tricks)


def detections(segments: DataFrame, frames: DataFrame, columns: list[str], tricks: DataFrame, strategies: dict[str, Strategy] = STRATEGIES) -> DataFrame:
    """run, start_idx, end_idx (the window), trick_id, strategy, confidence, first_idx, last_idx of what the tricks' methods find.

    ``tricks`` is trick_id, method, trick (``TRICK``, its places counting in ``columns``).  A window's frames are put together once, and
    each trick meets them there.
    """
    spark = frames.sparkSession
    nothing = spark.createDataFrame([(0,)], "unit int").drop("unit")
    windows = trick_windows(segments, frames, nothing)
    item = F.struct("idx", F.col("t_ms").cast("double").alias("t"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    gathered = within(windows, frames.select("run", "idx", "t_ms", *columns)).groupBy("run", "start_idx", "end_idx").agg(F.sort_array(F.collect_list(item)).alias("f"))
    held = gathered.select("run", "start_idx", "end_idx", F.transform("f", lambda x: x["t"]).alias("times"), F.transform("f", lambda x: x["v"]).alias("shown"))
    met = held.crossJoin(tricks.select("trick_id", "method", "trick"))
    call = evaluator(strategies)(F.col("method").outer(), F.col("trick").outer(), F.col("times").outer(), F.col("shown").outer())
    found = met.lateralJoin(call)
    return found.select("run", "start_idx", "end_idx", "trick_id", "strategy", "confidence", (F.col("start_idx") + F.col("first")).alias("first_idx"), (F.col("start_idx") + F.col("last")).alias("last_idx"))


def packed_tricks(catalog: DataFrame, columns: list[str], references: DataFrame | None = None) -> DataFrame:
    """trick_id, method, trick of a rule catalog (:mod:`rules`, with method) and ``references`` (trick_id, references)."""
    place = F.array_position(F.array(*(F.lit(c) for c in columns)), F.col("joint")).cast("int") - 1
    rule = F.struct(F.col("phase_no").cast("long").alias("phase_no"), "min_ms", "max_ms", place.alias("place"), "low", "high")
    grouped = catalog.groupBy("trick_id", "method").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    known = grouped.join(references, "trick_id", "left") if references is not None else grouped.withColumn("references", F.lit(None).cast("array<array<array<double>>>"))
    return known.select("trick_id", "method", F.struct("trick_id", "rules", "references").cast(TRICK).alias("trick"))
