"""Classification of windows by rule catalogs: phases that follow each other, each with ranges of joint angles.

A catalog row is one angle rule of a phase: trick_id, phase_no (from 0), phase, min_ms, max_ms, joint, low, high; a phase
without rules is a row whose joint is null.  Frames are run, idx, t_ms and a column for every joint angle, null where
it is not known.  All is joins, windows and aggregations over (run, trick, phase, start), so no run is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators import scoring
from motionframe.sources import storage

#: The least confidence of a phase, and how much the distance from a range's middle costs.
LEAST_PHASE, OFF_MIDDLE = 0.5, 0.5


def flattened(tricks: DataFrame) -> DataFrame:
    """Catalog rows of nested tricks (trick_id, phases: array of name, duration_range_ms, angle_rules)."""
    phases = tricks.select("trick_id", F.posexplode("phases").alias("phase_no", "p"))
    rules = phases.select("trick_id", F.col("phase_no").cast("long").alias("phase_no"), "p", F.explode_outer("p.angle_rules").alias("r"))
    return rules.select(
        "trick_id",
        "phase_no",
        F.col("p.name").alias("phase"),
        F.element_at("p.duration_range_ms", 1).cast("double").alias("min_ms"),
        F.element_at("p.duration_range_ms", 2).cast("double").alias("max_ms"),
        F.col("r.joint").alias("joint"),
        F.col("r.min").alias("low"),
        F.col("r.max").alias("high"),
    )


def _frames_per_second(frames: DataFrame) -> DataFrame:
    """run, fps from the first two frames, 30 where that is not known; last, the last frame."""
    second = F.min(F.when(F.col("idx") == 1, F.col("t_ms"))) - F.min(F.when(F.col("idx") == 0, F.col("t_ms")))
    return frames.groupBy("run").agg(second.alias("dt"), F.max("idx").alias("last")).select("run", F.when(F.col("dt") > 0, 1000 / F.col("dt")).otherwise(30.0).alias("fps"), "last")


def _phases(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """run, trick_id, phase_no, shortest and longest length in frames, rules and last; one row a run and phase."""
    phases = catalog.groupBy("trick_id", "phase_no").agg(F.first("min_ms").alias("min_ms"), F.first("max_ms").alias("max_ms"), F.count("joint").alias("rules"))
    each = _frames_per_second(frames).crossJoin(F.broadcast(phases))  # a rule catalog has tens of rows, not data
    shortest = F.greatest(F.lit(1), F.floor(F.col("min_ms") / 1000.0 * F.col("fps")))
    longest = F.greatest(F.col("shortest"), F.floor(F.col("max_ms") / 1000.0 * F.col("fps")))
    return each.withColumn("shortest", shortest.cast("long")).withColumn("longest", longest.cast("long")).select("run", "trick_id", "phase_no", "shortest", "longest", "rules", "last")


def angle_rows(frames: DataFrame, joints: list[str]) -> DataFrame:
    """run, idx, joint, angle of the known angles."""
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("joint"), F.col(j).alias("angle")) for j in joints))).alias("a")
    return frames.select("run", "idx", each).select("run", "idx", "a.joint", "a.angle").filter("angle IS NOT NULL")


def rule_scores(angles: DataFrame, catalog: DataFrame) -> DataFrame:
    """run, idx, trick_id, phase_no, joint, low, high, score of every frame and rule: 1 in the middle of the range, 0 outside it."""
    met = angles.join(F.broadcast(catalog.filter("joint IS NOT NULL")), "joint")
    half = (F.col("high") - F.col("low")) / 2
    inside = F.col("angle").between(F.col("low"), F.col("high"))
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("angle") - (F.col("low") + F.col("high")) / 2) / half * OFF_MIDDLE)
    score = F.when(inside, F.when(half > 0, near).otherwise(1.0)).otherwise(0.0)
    return met.select("run", "idx", "trick_id", "phase_no", "joint", "low", "high", score.alias("score"))


def phase_ends(frames: DataFrame, angles: DataFrame, catalog: DataFrame) -> DataFrame:
    """run, trick_id, phase_no, start, end, confidence: from every start the earliest end of the highest confidence, if that suffices.

    A rule counts by its best frame so far, so its score is a running maximum from the start.
    """
    phases = _phases(frames, catalog)
    keys = ["run", "trick_id", "phase_no"]
    each = rule_scores(angles, catalog).filter("score > 0").join(phases, keys)
    # every frame serves the starts from which the phase can reach it
    reach = each.select(*keys, "joint", "low", "high", "score", "idx", "shortest", "longest", "rules", "last", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("idx") - F.col("longest") + 1), F.col("idx"))).alias("start"))
    rule = Window.partitionBy(*keys, "start", "joint", "low", "high").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    best = reach.withColumn("best", F.max("score").over(rule))
    # a rise of one rule's best score is added to the sum from its frame on
    before = Window.partitionBy(*keys, "start", "joint", "low", "high").orderBy("idx")
    rises = best.withColumn("rise", F.col("best") - F.coalesce(F.lag("best").over(before), F.lit(0.0))).filter("rise > 0")
    at = rises.groupBy(*keys, "start", "idx").agg(F.sum("rise").alias("rise"), F.first("shortest").alias("shortest"), F.first("longest").alias("longest"), F.first("rules").alias("rules"), F.first("last").alias("last"))
    so_far = Window.partitionBy(*keys, "start").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    confidence = F.least(F.round(F.sum("rise").over(so_far) / F.col("rules"), 9), F.lit(1.0))
    # a rise within the shortest length counts at that length's end
    end = F.greatest(F.col("idx"), F.col("start") + F.col("shortest") - 1)
    scored = at.select(*keys, "start", end.alias("end"), confidence.alias("confidence"), "last").filter(F.col("end") <= F.col("last"))
    top = scored.groupBy(*keys, "start").agg(F.max("confidence").alias("confidence"), F.max_by("end", F.struct("confidence", -F.col("end"))).alias("end"))
    with_rules = top.filter(F.col("confidence") >= LEAST_PHASE).select(*keys, "start", "end", "confidence")
    # a phase without rules takes its shortest length
    free = phases.filter("rules = 0").select(*keys, "shortest", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("start"))
    ends = free.withColumn("end", F.col("start") + F.col("shortest") - 1).filter(F.col("end") <= F.col("last"))
    return with_rules.unionByName(ends.select(*keys, "start", "end", F.lit(1.0).alias("confidence")))


def phase_matches(frames: DataFrame, angles: DataFrame, catalog: DataFrame) -> DataFrame:
    """run, trick_id, confidence, start_idx, end_idx of the tricks whose phases follow each other: the best start, the earliest of equals."""
    ends = storage.cut(phase_ends(frames, angles, catalog))
    lengths = catalog.groupBy("trick_id").agg((F.max("phase_no") + 1).alias("phases"))
    most = lengths.agg(F.max("phases")).first()[0] or 0  # of the catalog, which is small
    path = ends.filter("phase_no = 0").select("run", "trick_id", F.col("start").alias("first"), "end", F.col("confidence").alias("total")).join(F.broadcast(lengths), "trick_id")
    for nth in range(1, most):
        step = ends.filter(F.col("phase_no") == nth).select("run", "trick_id", (F.col("start") - 1).alias("end"), F.col("end").alias("next"), "confidence")
        more = path.filter(F.col("phases") > nth).join(step, ["run", "trick_id", "end"])
        path = path.filter(F.col("phases") <= nth).unionByName(more.select("trick_id", "run", "first", F.col("next").alias("end"), (F.col("total") + F.col("confidence")).alias("total"), "phases"))
    scored = path.withColumn("confidence", F.round(F.col("total") / F.col("phases"), 9))
    order = Window.partitionBy("run", "trick_id").orderBy(F.col("confidence").desc(), "first")
    best = scored.withColumn("nth", F.row_number().over(order)).filter((F.col("nth") == 1) & (F.col("confidence") >= LEAST_PHASE))
    return best.select("run", "trick_id", "confidence", F.col("first").alias("start_idx"), F.col("end").alias("end_idx"))


def classified(frames: DataFrame, angles: DataFrame, catalog: DataFrame, poses: DataFrame, least: float = 0.5) -> DataFrame:
    """run, trick_id, confidence, start_idx, end_idx of the matches whose confidence, refined by the keypoints' quality, reaches ``least``."""
    found = phase_matches(frames, angles, catalog).withColumn("detection_id", F.xxhash64("run", "trick_id"))
    quality = scoring.keypoint_quality(found, poses)
    unknown: Column = F.lit(None).cast("double")
    refined = F.round(scoring.multi_factor(F.col("confidence"), F.col("quality"), unknown, unknown), 6)
    return found.join(quality, "detection_id").withColumn("confidence", refined).filter(F.col("confidence") >= least).select("run", "trick_id", "confidence", "start_idx", "end_idx")


def lookup(tricks: DataFrame, trick_id: str) -> DataFrame:
    """The trick of that id; no row if there is none."""
    return tricks.filter(F.col("trick_id") == trick_id).limit(1)


def strategy(method: Column, model_loaded: bool) -> Column:
    """temporal_model only where it is asked for and a model is loaded, else angle_threshold."""
    return F.when((method == "temporal_model") & F.lit(model_loaded), "temporal_model").otherwise("angle_threshold")
