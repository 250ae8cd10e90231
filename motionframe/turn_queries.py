"""Registered queries of turns, jumps and crops; their SQL is in :mod:`motionframe.plans.turn_sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe import further_queries
from motionframe.operators import analysis, boxes, describe, features, kinematics, planar, rotation, rules, training, turns
from motionframe.operators import biomechanics as bio
from motionframe.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Frames a second of the test runs, which are short.
FPS = 10.0


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _turns(spark, d):
    return adapters.rotation_frames(adapters.read(spark, d, "embeddings"))


def _poses(spark, d):
    return adapters.pose_frames(adapters.read(spark, d, "embeddings"))


def _segments(spark, d):
    return turns.hysteresis_segments(rotation.tracking(_turns(spark, d)), turns.TurnConfig(FPS))


def _body(spark, d):
    return bio.biomechanics(adapters.ankles(adapters.read(spark, d, "embeddings")).join(_turns(spark, d), ["run", "idx"]), FPS)


@_query
def smoothed_orientations(spark, d):
    frames = _turns(spark, d)
    return _rounded(turns.smoothed_orientations(frames, describe.smoothing_width(frames)).select("run", "idx", "ox", "oy", "oz"))


@_query
def hysteresis_segments(spark, d):
    return _segments(spark, d)


@_query
def body_intensity(spark, d):
    return _rounded(turns.body_intensity(_poses(spark, d), FPS))


@_query
def intensity_segments(spark, d):
    return turns.intensity_segments(turns.body_intensity(_poses(spark, d), FPS), FPS)


@_query
def frame_turns(spark, d):
    return _rounded(bio.frame_turns(_turns(spark, d)), 3)


@_query
def body_biomechanics(spark, d):
    return _rounded(_body(spark, d).select("run", "idx", "flip", "twist", "knee", "hip", "spine", "shoulder", "elbow", "vx", "vy", "vz", "height", "airborne"), 2)


@_query
def takeoff_entries(spark, d):
    return bio.entries(_segments(spark, d), _body(spark, d))


@_query
def turn_signatures(spark, d):
    return _rounded(bio.signatures(_segments(spark, d), _body(spark, d)), 2)


@_query
def stable_crops(spark, d):
    return _rounded(boxes.stable_crops(adapters.person_boxes(adapters.read(spark, d, "events"))), 3)


@_query
def turn_axis(spark, d):
    frames = _turns(spark, d)
    tilted = describe.turned_vectors(frames).join(rotation.tracking(frames).select("run", "idx", "tilt"), ["run", "idx"])
    return describe.flip_axis(_segments(spark, d), tilted)


@_query
def segment_physics(spark, d):
    frames = _turns(spark, d)
    return describe.physics(_segments(spark, d), frames, rotation.tracking(frames))


@_query
def planar_frames(spark, d):
    shown = planar.frame_physics(_poses(spark, d))
    return _rounded(shown.select("run", "idx", "trunk_x", "trunk_y", "body_angle", "turn", "lean", "knee", "hip"))


@_query
def planar_segments(spark, d):
    return planar.airborne(planar.frame_physics(_poses(spark, d)), FPS)


@_query
def planar_physics(spark, d):
    shown = planar.frame_physics(_poses(spark, d))
    return _rounded(planar.segment_physics(planar.airborne(shown, FPS), shown, FPS), 3)


@_query
def training_tensors(spark, d):
    cells = features.normalised(features.frame_rows(_poses(spark, d)))
    made = training.tensors(cells)
    return _rounded(made.select("run", F.posexplode(F.arrays_zip("flat", "channels")).alias("place", "v")).select("run", F.col("place").cast("long").alias("place"), F.col("v.flat").alias("flat"), F.col("v.channels").alias("channels")), 3)


@_query
def seeded_split(spark, d):
    rows = adapters.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return training.tail_split(training.shuffled(rows, "id", 42), 0.15)


#: What the tricks of the small rule catalog are worth, and how many detections of a run count.
DIFFICULTY, COUNTED = (("squat", 3.5), ("reach", 2.0), ("still", 1.25)), 2


def _analysis(spark, d):
    poses = _poses(spark, d)
    frames = kinematics.joint_angles(poses)
    angles = rules.angle_rows(frames, ["left_knee", "right_knee", "left_shoulder", "spine"])
    return analysis.analyze(frames, angles, poses, further_queries._rules(spark), spark.createDataFrame(DIFFICULTY, "trick_id string, difficulty double"), 0.3, COUNTED)


@_query
def analysis_detections(spark, d):
    return _rounded(_analysis(spark, d).detections)


@_query
def analysis_scores(spark, d):
    return _analysis(spark, d).scores


@_query
def analysis_audit(spark, d):
    return _analysis(spark, d).audit


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
