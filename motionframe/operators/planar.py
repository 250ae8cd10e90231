"""Turns of a body seen by one camera: what each frame shows, the airborne stretches, and what was turned in each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.functions import geometry as g
from motionframe.operators.intervals import within
from motionframe.operators.sequence import by_frame, islands, merge_intervals, smooth_zero_padded
from motionframe.sources.storage import cut

_SEGMENT = ["run", "start_idx", "end_idx"]
#: Joints whose mean is the trunk, and the vertex of each bend with its ends.
TRUNK = (5, 6, 11, 12)
KNEES, HIPS = ((11, 13, 15), (12, 14, 16)), ((5, 11, 13), (6, 12, 14))
#: Shoulders further apart in height than this turn sideways.
SIDEWAYS = 0.05


def _trunk(axis: str) -> Column:
    return sum((F.col(f"{axis}{k}") for k in TRUNK), F.lit(0.0)) / len(TRUNK)


def frame_physics(poses: DataFrame) -> DataFrame:
    """run, idx, trunk_x, trunk_y, body_angle and turn (radians, signed), lean (of the shoulders), knee, hip (degrees), and what tells twists.

    ``poses`` is run, idx, x0.. and y0..; every keypoint counts, however sure it is.  ``across`` is the shoulders' distance to the side,
    ``shift`` its change, and ``bends`` whether that changes its sign; all changes are 0 at the first frame.
    """
    order = by_frame()
    cosines = {f"cos_{a}_{b}_{c}": F.expr(g.cosine(*(f"{axis}{k}" for k in (a, b, c) for axis in "xy"))) for a, b, c in (*KNEES, *HIPS)}
    shown = poses.select("run", "idx", _trunk("x").alias("trunk_x"), _trunk("y").alias("trunk_y"), F.atan2(F.col("y0") - _trunk("y"), F.col("x0") - _trunk("x")).alias("body_angle"), F.abs(F.col("y5") - F.col("y6")).alias("lean"), (F.col("x5") - F.col("x6")).alias("across"), *(c.alias(k) for k, c in cosines.items()))
    degrees = [F.expr(g.of_cosine(k)) for k in cosines]
    step = F.col("body_angle") - F.lag("body_angle").over(order)
    turn = F.when(step > F.pi(), step - 2 * F.pi()).when(step < -F.pi(), step + 2 * F.pi()).otherwise(step)
    bent = shown.select("run", "idx", "trunk_x", "trunk_y", "body_angle", F.coalesce(turn, F.lit(0.0)).alias("turn"), "lean", ((degrees[0] + degrees[1]) / 2).alias("knee"), ((degrees[2] + degrees[3]) / 2).alias("hip"), (F.col("across") - F.lag("across").over(order)).alias("shift"))
    return bent.withColumn("bends", F.coalesce(F.signum("shift") != F.signum(F.lag("shift").over(order)), F.lit(False))).withColumn("shift", F.coalesce("shift", F.lit(0.0)))


def airborne(physics: DataFrame, fps: float = 30.0) -> DataFrame:
    """run, start_idx, end_idx of the stretches of fast turning, joined over short gaps, padded, and of usual length; they may overlap."""
    smooth = physics.withColumn("size", F.abs("turn")).select("run", "idx", smooth_zero_padded("size", max(3, int(fps * 0.1))).alias("smooth"))
    level = smooth.groupBy("run").agg((F.avg("smooth") + F.stddev_pop("smooth")).alias("level"), F.max("idx").alias("last"))
    flagged = smooth.join(level, "run").select("run", "idx", "smooth", "last", (F.col("smooth") > F.col("level")).alias("active"))
    joined = merge_intervals(islands(flagged), "start_idx", "end_idx", int(0.3 * fps)).join(level.select("run", "last"), "run")
    pad = int(0.2 * fps)
    # a stretch ends with the frame after its last fast one
    padded = joined.select("run", F.greatest(F.lit(0), F.col("start_idx") - pad).cast("long").alias("start_idx"), F.least(F.col("last"), F.col("end_idx") + 1 + pad).alias("end_idx"))
    seconds = (F.col("end_idx") - F.col("start_idx")) / fps
    return padded.filter((seconds > 0.25) & (seconds < 5.0))


def segment_physics(segments: DataFrame, physics: DataFrame, fps: float = 30.0) -> DataFrame:
    """run, start_idx, end_idx, seconds, degrees, flips, direction, shape, knee, hip, twist_intensity, twists, sideways and lean of each segment.

    Bends and lean are means over the frames whose turning exceeds seven tenths of the segment's frames, or over all if none does.
    """
    inside = cut(within(segments.select(*_SEGMENT), physics))
    level = inside.groupBy(*_SEGMENT).agg(F.percentile(F.abs("turn"), 0.7).alias("level"))
    marked = inside.join(level, _SEGMENT).withColumns({"peak": F.abs("turn") > F.col("level"), "nth": F.col("idx") - F.col("start_idx")})
    peak = lambda c: F.coalesce(F.avg(F.when(F.col("peak"), F.col(c))), F.avg(c)).alias(c)
    of = marked.groupBy(*_SEGMENT).agg(
        F.sum("turn").alias("turned"),
        peak("knee"),
        peak("hip"),
        peak("lean"),
        F.coalesce(F.avg(F.when(F.col("nth") >= 1, F.abs("shift"))), F.lit(0.0)).alias("twist_intensity"),
        F.count_if((F.col("nth") >= 2) & F.col("bends")).alias("bends"),
    )
    knee, hip, degrees = F.col("knee"), F.col("hip"), F.degrees(F.abs("turned"))
    shape = F.when((knee < 90) & (hip < 90), "tuck").when((knee > 140) & (hip < 100), "pike").when((knee > 140) & (hip > 140), "layout").otherwise("open")
    return of.select(
        *_SEGMENT,
        ((F.col("end_idx") - F.col("start_idx")) / fps).alias("seconds"),
        degrees.alias("degrees"),
        F.bround(degrees / 360, 1).alias("flips"),
        F.when(F.col("turned") > 0, "forward").otherwise("backward").alias("direction"),
        shape.alias("shape"),
        "knee",
        "hip",
        "twist_intensity",
        # about four changes of direction are a full twist
        F.bround(F.col("bends") / 4, 1).alias("twists"),
        (F.col("lean") > SIDEWAYS).alias("sideways"),
        "lean",
    )
