import math

import pytest

from motionframe import queries
from motionframe.functions import geometry as g
from motionframe.functions import names
from motionframe.operators import catalog, kinematics, matching, scoring, sequence
from pyspark.sql import functions as F


def pose(spark, points, confidence=1.0, frames=1):
    columns = {f"{a}{i}": float(points[i][k]) for i in range(17) for k, a in enumerate("xy")} | {f"c{i}": confidence for i in range(17)}
    rows = [{"run": 1, "idx": t, "t_ms": t * 100.0, **columns} for t in range(frames)]
    return spark.createDataFrame(rows)


STANDING = [(320, 100), (310, 90), (330, 90), (300, 95), (340, 95), (280, 180), (360, 180), (270, 280), (370, 280), (265, 370), (375, 370), (300, 380), (340, 380), (300, 500), (340, 500), (300, 620), (340, 620)]


def test_standing_pose(spark):
    row = kinematics.joint_angles(pose(spark, STANDING)).first()
    assert row.left_knee == pytest.approx(180, abs=0.01) and row.spine == pytest.approx(180, abs=0.01)
    assert row.knee == pytest.approx((row.left_knee + row.right_knee) / 2)
    body = kinematics.body_frame(pose(spark, STANDING)).first()
    assert (body.com_x, body.com_y) == (320, 380) and body.torso == pytest.approx(200) and body.tilt == pytest.approx(0)


def test_unseen_joints_have_no_angles(spark):
    row = kinematics.joint_angles(pose(spark, STANDING, confidence=0.2)).first()
    assert all(row[k] is None for k in g.joint_angles())
    body = kinematics.body_frame(pose(spark, STANDING, confidence=0.2)).first()
    assert body.torso is None and body.com_x == pytest.approx(sum(p[0] for p in STANDING) / 17)


@pytest.mark.parametrize("c,want", [((0.0, 1.0), 90), ((-1.0, 0.0), 180), ((1.0, 1.0), 45), ((2.0, 0.0), 0)])
def test_angle(spark, c, want):
    found = spark.range(1).select(F.expr(g.angle("1e0", "0e0", "0e0", "0e0", f"{c[0]}D", f"{c[1]}D")).alias("a")).first().a
    assert found == pytest.approx(want, abs=0.01)


def test_wrap_and_null_clip(spark):
    row = spark.range(1).select(F.expr(g.wrap("190e0")).alias("a"), F.expr(g.wrap("-181e0")).alias("b"), F.expr(g.clip("cast(NULL AS DOUBLE)", "-1e0", "1e0")).alias("c")).first()
    assert row.a == pytest.approx(-170) and row.b == pytest.approx(179) and row.c is None


def signal(spark, values, step=100):
    return spark.createDataFrame([(1, i, i * step, float(v)) for i, v in enumerate(values)], "run long, idx long, t_ms long, v double")


def test_velocity_of_a_drop(spark):
    assert [r.velocity for r in sequence.velocity(signal(spark, [160, 100])).orderBy("idx").collect()] == [0, -600]


def test_idle_signal_has_no_segment_and_two_bursts_have_two(spark):
    config = sequence.SegmentConfig(pad_ms=50, merge_gap_ms=150, min_ms=200, max_ms=3000)
    assert sequence.segments(signal(spark, [0] * 60, 33), config).count() == 0
    burst = [40 * math.sin(2 * math.pi * k / 30) for k in range(30)]
    idle = [0.001 * (k % 2) for k in range(60)]
    found = sequence.segments(signal(spark, idle + burst + idle + burst + idle, 33), config).orderBy("start_idx").collect()
    assert len(found) == 2 and found[0].end_idx < found[1].start_idx


def test_merge_counts_gaps_from_the_furthest_end(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 2, 4), (1, 12, 13), (1, 30, 31)], "run long, s long, e long")
    assert sorted(tuple(r) for r in sequence.merge_intervals(rows, "s", "e", 2).collect()) == [(1, 0, 13), (1, 30, 31)]


def test_run_without_island_is_one_window(spark):
    flagged = signal(spark, [0] * 5).select("run", "idx", F.col("v").alias("smooth"), F.lit(False).alias("active"))
    assert [tuple(r) for r in sequence.frame_windows(flagged).collect()] == [(1, 0, 4)]


def detections(spark, rows):
    return spark.createDataFrame(rows, "run long, detection_id long, trick_id string, confidence double, start_ms long, end_ms long")


def test_overlaps_of_one_trick_are_suppressed(spark):
    rows = [(1, 1, "a", 0.8, 0, 1000), (1, 2, "a", 0.6, 200, 1200), (1, 3, "a", 0.5, 5000, 6000), (1, 4, "b", 0.1, 0, 1000)]
    assert sorted(r.detection_id for r in scoring.suppress_overlaps(detections(spark, rows)).collect()) == [1, 3, 4]


def test_score_of_one_front_flip(spark):
    difficulty = spark.createDataFrame([("front_flip", 3.5)], "trick_id string, difficulty double")
    row = scoring.top_scored(detections(spark, [(1, 1, "front_flip", 0.8, 0, 1000)]), difficulty).first()
    assert row.weighted == pytest.approx(2.8) and row.total == pytest.approx(2.8)


def test_ensemble_mean(spark):
    a, b = (spark.createDataFrame([(1, "x", c)], "run long, trick_id string, confidence double") for c in (0.6, 0.8))
    assert matching.ensemble(a, b).first().confidence == pytest.approx(0.68)


@pytest.mark.parametrize(
    "name,want",
    [
        ("Double Full", {"rotation": 1.0, "twist": 2.0, "axis": "lateral", "shape": "layout"}),
        ("Backside 720", {"rotation": 2.0, "twist": 0.0, "axis": "longitudinal", "direction": "left"}),
        ("Side Flip", {"axis": "lateral", "direction": "left", "rotation": 1.0}),
        ("Cork", {"axis": "off_axis", "twist": 1.0}),
        ("Wall Gainer", {"entry": "wall", "direction": "backward", "family": "wall"}),
    ],
)
def test_parsed_names(spark, name, want):
    row = spark.createDataFrame([(name,)], "name string").withColumn("w", names.tokens(F.col("name"))).select(*(c.alias(k) for k, c in names.parse(F.col("w")).items())).first()
    assert {k: row[k] for k in want} == want


def test_difficulty_rises_along_prerequisites(spark):
    tricks = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 9.9), (4, 1.0)], "id long, difficulty double")
    edges = spark.createDataFrame([(2, 1), (4, 2), (4, 3)], "id long, prerequisite long")
    found = {r.id: r.difficulty for r in catalog.propagate_difficulty(tricks, edges).collect()}
    assert found == {1: 3.0, 2: 3.5, 3: 9.9, 4: 10.0}


def test_every_query_has_sql():
    assert set(queries.oracle_sql()) == set(queries.queries())
