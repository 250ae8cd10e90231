"""Per-frame kinematics of 2D poses and their development over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import geometry as g
from motionframe.operators import sequence

#: Fixed values of the feature scales.
ANGLE_SCALE, VELOCITY_CLIP, ACCELERATION_CLIP, TILT_VELOCITY_CLIP, COM_VELOCITY_CLIP, ROTATION_SCALE, COM_SCALE = 180.0, 1000.0, 50_000.0, 2000.0, 20.0, 1080.0, 5.0


def joint_angles(poses: DataFrame) -> DataFrame:
    """run, idx, t_ms and the 14 angles, NULL where a joint is not seen.

    Cosines, angles and means of sides are columns one after the other: written out in full the code is too long to be compiled.
    """
    cosines = g.joint_cosines()
    of_corner = poses.select("run", "idx", "t_ms", *(F.expr(e).alias(f"cos_{name}") for name, e in cosines.items()))
    single = of_corner.select("run", "idx", "t_ms", *(F.expr(g.of_cosine(f"cos_{name}")).alias(name) for name in cosines))
    return single.select("*", *(F.expr(g.mean_of_sides(f"left_{joint}", f"right_{joint}")).alias(joint) for joint in g.PAIRED))


def body_frame(poses: DataFrame) -> DataFrame:
    """run, idx, t_ms, centre of mass, torso length, tilt and shoulder symmetry."""
    symmetry = f"CASE WHEN {g.seen(('left_shoulder', 'right_shoulder'))} THEN (y6 - y5) / ({g.torso_length()}) END"
    made = {"com_x": g.centre_of_mass("x"), "com_y": g.centre_of_mass("y"), "torso": g.torso_length(), "tilt": g.body_tilt(), "symmetry": symmetry}
    return poses.select("run", "idx", "t_ms", *(F.expr(e).alias(k) for k, e in made.items()))


def limb_ratios(poses: DataFrame) -> DataFrame:
    return poses.select("run", "idx", *(F.expr(g.limb_ratio(k)).alias(k) for k in g.LIMBS))


def relative_positions(poses: DataFrame) -> DataFrame:
    """run, idx, cell, value: the 34 keypoint coordinates from the centre of mass in torso lengths, without unseen ones."""
    made = {"com_x": g.centre_of_mass("x"), "com_y": g.centre_of_mass("y"), "torso": g.torso_length()}
    points = F.array(*(F.struct(F.lit(2 * i + k).cast("long").alias("cell"), F.col(f"{a}{i}").alias("at"), F.col(f"c{i}").alias("c"), F.lit(k).alias("axis")) for i in range(17) for k, a in enumerate("xy")))
    each = poses.select("run", "idx", *(F.expr(e).alias(k) for k, e in made.items()), F.explode(points).alias("p"))
    value = (F.col("p.at") - F.when(F.col("p.axis") == 0, F.col("com_x")).otherwise(F.col("com_y"))) / F.col("torso")
    return each.filter(F.col("p.c") >= g.MIN_CONFIDENCE).select("run", "idx", "p.cell", value.alias("value")).filter("value IS NOT NULL")


def temporal_features(body: DataFrame) -> DataFrame:
    """run, idx, t_ms, tilt, tilt_velocity, rotation (running), height, height_velocity from :func:`body_frame`."""
    order = sequence.by_frame()
    torso = body.groupBy("run").agg(F.coalesce(F.median("torso"), F.lit(1.0)).alias("unit"))
    first = F.first("com_y").over(order.rowsBetween(Window.unboundedPreceding, 0))
    timed = body.join(torso, "run").withColumns(
        {
            "seconds": F.coalesce(F.when(F.col("t_ms") > F.lag("t_ms").over(order), (F.col("t_ms") - F.lag("t_ms").over(order)) / 1000.0), F.lit(1.0 / 30)),
            "height": -(F.col("com_y") - first) / F.col("unit"),
            "turn": F.expr(g.wrap("(tilt - lag(tilt) OVER (PARTITION BY run ORDER BY idx))")),
            "start": F.lag("idx").over(order).isNull(),
        }
    )
    rise = F.col("height") - F.lag("height").over(order)
    return timed.select(
        "run",
        "idx",
        "t_ms",
        "tilt",
        F.when(F.col("start"), 0.0).otherwise(F.col("turn") / F.col("seconds")).alias("tilt_velocity"),
        F.sum(F.coalesce("turn", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rotation"),
        "height",
        F.when(F.col("start"), 0.0).otherwise(rise / F.col("seconds")).alias("height_velocity"),
    )


def normalised(features: DataFrame) -> DataFrame:
    """The temporal features on comparable scales; the running rotation is scaled but not clipped."""
    clipped = lambda c, most: F.expr(g.clip(c, f"-{most:.1f}D", f"{most:.1f}D")) / most
    return features.select(
        "run",
        "idx",
        (F.col("tilt") / ANGLE_SCALE).alias("tilt"),
        clipped("tilt_velocity", TILT_VELOCITY_CLIP).alias("tilt_velocity"),
        (F.col("rotation") / ROTATION_SCALE).alias("rotation"),
        (F.col("height") / COM_SCALE).alias("height"),
        clipped("height_velocity", COM_VELOCITY_CLIP).alias("height_velocity"),
    )
