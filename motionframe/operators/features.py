"""The 75 features of a frame as cells: 9 angles, 9 velocities, 34 positions, 8 limb ratios, 6 of the body, 9 accelerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import geometry as g
from motionframe.operators import kinematics, sequence

#: The joint angles among the features, in their order.
ANGLES = ("left_knee", "right_knee", "left_hip", "right_hip", "left_elbow", "right_elbow", "left_shoulder", "right_shoulder", "spine")
#: First cell of each kind.
VELOCITY, POSITION, RATIO, BODY, ACCELERATION, WIDTH, LEGACY_WIDTH = 9, 18, 52, 60, 66, 75, 60
#: The six cells of the body.
TILT, TILT_VELOCITY, HEIGHT, HEIGHT_VELOCITY, ROTATION, SYMMETRY = range(60, 66)


def _cells(at: int, columns: list[str]) -> list[Column]:
    return [F.struct(F.lit(at + k).cast("long").alias("cell"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)]


def frame_rows(poses: DataFrame) -> DataFrame:
    """run, idx, cell, value of the known features of every frame; unknown ones have no row."""
    order = sequence.by_frame()
    seconds = (F.col("t_ms") - F.lag("t_ms").over(order)) / 1000.0
    angles = kinematics.joint_angles(poses).select("run", "idx", "t_ms", *ANGLES).withColumn("seconds", seconds)
    first = F.col("seconds").isNull()
    moved = {f"v_{j}": F.when(first | (F.col("seconds") <= 0), 0.0).otherwise((F.col(j) - F.lag(j).over(order)) / F.col("seconds")) for j in ANGLES}
    moving = angles.withColumns(moved)
    step = F.when(F.col("seconds") > 0, F.col("seconds")).otherwise(1.0 / 30)
    pushed = {f"a_{j}": F.when(F.col("idx") < 2, 0.0).otherwise(F.coalesce((F.col(f"v_{j}") - F.lag(f"v_{j}").over(order)) / step, F.lit(0.0))) for j in ANGLES}
    moving = moving.withColumns(pushed)
    of_angles = moving.select("run", "idx", F.explode(F.array(*_cells(0, list(ANGLES)), *_cells(VELOCITY, [f"v_{j}" for j in ANGLES]), *_cells(ACCELERATION, [f"a_{j}" for j in ANGLES]))).alias("c"))
    body = kinematics.body_frame(poses)
    timed = kinematics.temporal_features(body).join(body.select("run", "idx", "symmetry"), ["run", "idx"])
    # without a tilt on either side the body does not turn
    timed = timed.withColumn("tilt_velocity", F.coalesce("tilt_velocity", F.lit(0.0)))
    of_body = timed.select("run", "idx", F.explode(F.array(*_cells(BODY, ["tilt", "tilt_velocity", "height", "height_velocity", "rotation", "symmetry"]))).alias("c"))
    ratios = kinematics.limb_ratios(poses).select("run", "idx", F.explode(F.array(*_cells(RATIO, list(g.LIMBS)))).alias("c"))
    parts = of_angles.unionByName(of_body).unionByName(ratios).select("run", "idx", "c.cell", "c.value")
    positions = kinematics.relative_positions(poses).select("run", "idx", (F.col("cell") + POSITION).alias("cell"), "value")
    return parts.unionByName(positions).filter("value IS NOT NULL")


def normalised(cells: DataFrame) -> DataFrame:
    """The cells on comparable scales; positions and ratios stay, the running rotation is scaled but not clipped."""
    x, c = F.col("value"), F.col("cell")
    clipped = lambda most: F.greatest(F.lit(-most), F.least(F.lit(most), x)) / most
    scaled = (
        F.when(c < VELOCITY, x / kinematics.ANGLE_SCALE)
        .when(c < POSITION, clipped(kinematics.VELOCITY_CLIP))
        .when(c < BODY, x)
        .when(c == TILT, x / kinematics.ANGLE_SCALE)
        .when(c == TILT_VELOCITY, clipped(kinematics.TILT_VELOCITY_CLIP))
        .when(c == HEIGHT, x / kinematics.COM_SCALE)
        .when(c == HEIGHT_VELOCITY, clipped(kinematics.COM_VELOCITY_CLIP))
        .when(c == ROTATION, x / kinematics.ROTATION_SCALE)
        .when(c == SYMMETRY, x)
        .otherwise(clipped(kinematics.ACCELERATION_CLIP))
    )
    return cells.withColumn("value", scaled)


def vectors(cells: DataFrame, width: int = WIDTH) -> DataFrame:
    """run, idx, vec: an array of ``width`` values a frame, null where a feature is unknown."""
    of_frame = cells.groupBy("run", "idx").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("known"))
    listed = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda k: F.element_at("known", k))
    return of_frame.select("run", "idx", listed.alias("vec"))


def widened(frames: DataFrame) -> DataFrame:
    """``vec`` of 60 values filled up to 75 with zeros; longer ones are cut after 75."""
    return frames.withColumn("vec", F.when(F.size("vec") < WIDTH, F.concat(F.slice("vec", 1, LEGACY_WIDTH), F.array_repeat(F.lit(0.0), WIDTH - LEGACY_WIDTH))).otherwise(F.slice("vec", 1, WIDTH)))


def for_warping(frames: DataFrame) -> DataFrame:
    """``vec`` for the comparison of trajectories: angles and velocities scaled, the others as they are, 0 where unknown."""

    def scaled(x: Column, at: Column) -> Column:
        clipped = F.greatest(F.lit(-kinematics.VELOCITY_CLIP), F.least(F.lit(kinematics.VELOCITY_CLIP), x)) / kinematics.VELOCITY_CLIP
        return F.coalesce(F.nanvl(F.when(x.isNull(), None).when(at < VELOCITY, x / kinematics.ANGLE_SCALE).when(at < POSITION, clipped).otherwise(x), F.lit(0.0)), F.lit(0.0))

    return frames.withColumn("vec", F.transform("vec", scaled))


def channels(cells: DataFrame, length: int = 64) -> DataFrame:
    """run, cell, channel: each feature of a resampled run (run, idx, cell, value) as an array over its ``length`` steps."""
    window = Window.partitionBy("run", "cell")
    ends = cells.withColumn("last", F.max("idx").over(window))
    return ends.filter(F.col("last") < length).groupBy("run", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("channel"))
