import random

import pytest
from pyspark.sql import functions as F

from motionframe import further_queries
from motionframe.operators import rules, strategies

JOINTS = ["left_knee", "right_knee", "left_shoulder", "spine"]


def frames(spark, runs=6, n=26, seed=2):
    rng = random.Random(seed)
    rows = [(r, i, i * 33.0, *(None if rng.random() < 0.1 else rng.uniform(0, 180) for _ in JOINTS)) for r in range(runs) for i in range(n - r)]
    return spark.createDataFrame(rows, "run long, idx long, t_ms double, " + ", ".join(f"{j} double" for j in JOINTS))


def catalog(spark, method="angle_threshold"):
    return further_queries._rules(spark).withColumn("method", F.lit(method))


NO_SEGMENTS = "run long, start_idx long, end_idx long"


def test_window_rules_equal_native_rules_over_whole_runs(spark):
    shown = frames(spark)
    native = rules.phase_matches(shown, rules.angle_rows(shown, JOINTS), catalog(spark))
    found = strategies.detections(spark.createDataFrame([], NO_SEGMENTS), shown, JOINTS, strategies.packed_tricks(catalog(spark), JOINTS))
    want = sorted((r.run, r.trick_id, round(r.confidence, 6), r.start_idx, r.end_idx) for r in native.collect())
    assert sorted((r.run, r.trick_id, round(r.confidence, 6), r.first_idx, r.last_idx) for r in found.collect()) == want and len(want) > 5


def test_only_runs_without_a_segment_count_as_a_whole(spark):
    segments = spark.createDataFrame([(1, 2, 9), (1, 5, 20), (2, 0, 3)], NO_SEGMENTS)
    tricks = spark.createDataFrame([("a",), ("b",)], "trick_id string")
    got = sorted(tuple(r) for r in strategies.trick_windows(segments, frames(spark, 4), tricks).collect())
    bounds = [(0, 0, 25), (1, 2, 9), (1, 5, 20), (2, 0, 3), (3, 0, 22)]
    assert got == sorted((*b, t) for b in bounds for t in "ab")


def test_methods_dispatch_and_own_strategies_travel(spark):
    shown = frames(spark, 2)

    def longest(trick, times, values):
        return (0.75, 0, len(times) - 1) if len(times) > 5 else None

    own = {"angle_threshold": strategies.angle_threshold, "longest": longest}
    tricks = strategies.packed_tricks(catalog(spark, "longest").filter("trick_id = 'still'"), JOINTS).unionByName(strategies.packed_tricks(catalog(spark, "unheard of").filter("trick_id = 'reach'"), JOINTS))
    segments = spark.createDataFrame([(0, 4, 20), (0, 0, 3)], NO_SEGMENTS)
    got = strategies.detections(segments, shown, JOINTS, tricks, own).collect()
    assert sorted((r.run, r.start_idx, r.confidence, r.first_idx, r.last_idx) for r in got if r.strategy == "longest") == [(0, 4, 0.75, 4, 20), (1, 0, 0.75, 0, 24)]
    assert {r.strategy for r in got if r.trick_id == "reach"} <= {"angle_threshold"}


def test_reference_warping_finds_itself(spark):
    shown = frames(spark, 2).fillna(0.0)
    reference = [[float(x) for x in r] for r in shown.filter("run = 1").orderBy("idx").select(*JOINTS).collect()]
    references = spark.createDataFrame([("squat", [reference])], "trick_id string, references array<array<array<double>>>")
    tricks = strategies.packed_tricks(catalog(spark, "reference_warping"), JOINTS, references)
    got = strategies.detections(spark.createDataFrame([], NO_SEGMENTS), shown, JOINTS, tricks).collect()
    assert [(r.run, r.trick_id, r.confidence, r.first_idx, r.last_idx) for r in got] == [(1, "squat", pytest.approx(1.0), 0, 24)]
