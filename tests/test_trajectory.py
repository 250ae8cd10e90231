import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import generate, trajectory
from motionframe.streaming import sessions


def test_warped_distance_properties():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((20, 3)), rng.standard_normal((25, 3))
    assert trajectory.warped_distance(a, a) == 0
    assert trajectory.warped_distance(a, b) == pytest.approx(trajectory.warped_distance(b, a))
    assert trajectory.warped_distance(a, b, band=1.0) <= trajectory.warped_distance(a, b, band=0.2)


def plain_distance(a, b, band):
    n, m = len(a), len(b)
    reach = max(1, int(band * max(n, m)))
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - reach), min(m, i + reach) + 1):
            best[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
    return best[n, m]


def test_warped_distance_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for n, m, band in ((1, 1, 0.2), (7, 9, 0.5), (30, 27, 0.2), (12, 40, 0.2), (40, 33, 1.0)):
        a, b = rng.standard_normal((n, 4)), rng.standard_normal((m, 4))
        assert trajectory.warped_distance(a, b, band) == pytest.approx(plain_distance(a, b, band))


def test_best_reference_needs_enough_confidence(spark):
    rows = [(1, 5, 0.4), (1, 4, 0.4), (1, 6, 0.1), (2, 5, 0.2)]
    got = trajectory.best_reference(spark.createDataFrame(rows, "query long, reference long, confidence double")).collect()
    assert [tuple(r) for r in got] == [(1, 4, 0.4)]


def test_generated_sequences_are_reproducible(spark):
    definitions = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 1.5)], "trick_id long, flips double, twists double")
    a = generate.generate(definitions, 3).orderBy("trick_id", "sample", "step").collect()
    b = generate.generate(definitions.repartition(2), 3).orderBy("trick_id", "sample", "step").collect()
    assert a == b and len(a) == 2 * 3 * generate.FRAMES
    assert a[generate.FRAMES - 1].flip_deg == pytest.approx(360, abs=5)
    bins = {r.trick_id: (r.flip_bin, r.twist_bin) for r in generate.encoded_properties(definitions, [0, 0.5, 1, 2]).collect()}
    assert bins == {1: (2, 0), 2: (3, 2)}


def test_sessions_of_a_bounded_signal(spark):
    rows = [(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-01 01:00:00", 9.0), (1, "2024-01-01 04:00:00", 7.0), (1, "2024-01-01 04:10:00", 1.0)]
    events = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.n, r.peak) for r in sessions.active_sessions(events, 5.0).collect())
    assert got == [(1, 7.0), (2, 9.0)]
