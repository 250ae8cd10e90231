import random

import numpy as np
import pytest

from motionframe.operators import training
from motionframe.sources import storage

CELLS = "run long, idx long, cell long, value double"


def test_tensors_equal_linear_interpolation(spark):
    rng = random.Random(2)
    rows = [(r, i, c, None if rng.random() < 0.3 else rng.uniform(-1, 1)) for r in range(4) for i in range([1, 5, 64, 90][r]) for c in range(5) if (r, c) != (2, 3)]
    got = {r.run: (np.array(r.flat).reshape(8, 5), np.array(r.channels).reshape(5, 8)) for r in training.tensors(spark.createDataFrame(rows, CELLS), 8, 5).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for run, (flat, channels) in got.items():
        last = max(i for r, i, _, _ in rows if r == run)
        for c in range(5):
            known = [(i, v) for r, i, k, v in rows if r == run and k == c and v is not None]
            want = np.interp(np.linspace(0, last, 8), *zip(*known, strict=True)) if known else np.zeros(8)
            assert flat[:, c] == pytest.approx(want, abs=1e-9)
        assert (flat.T == channels).all()
    assert training.tensors(spark.createDataFrame([], CELLS)).count() == 0


def test_a_long_run_is_not_gone_through_anew_for_every_frame(spark):
    rng = random.Random(4)
    rows = [(0, i, c, None if rng.random() < 0.4 else rng.uniform(-1, 1)) for i in range(15_000) for c in range(2)] + [(1, 0, 0, 2.0)]
    made = training.resampled(spark.createDataFrame(rows, CELLS), 64)
    # a frame that ends with the last row costs its whole length for every row
    assert "unboundedfollowing" not in made._jdf.queryExecution().toString().lower()
    got = {(r.run, r.cell, r.step): r.value for r in made.collect()}
    for c in range(2):
        known = [(i, v) for r, i, k, v in rows if (r, k) == (0, c) and v is not None]
        want = np.interp(np.linspace(0, 14_999, 64), *zip(*known, strict=True))
        assert [got[0, c, k] for k in range(64)] == pytest.approx(want, abs=1e-9)
    assert {got[1, 0, k] for k in range(64)} == {2.0} and len(got) == 3 * 64


def test_order_depends_on_seed_and_keys_alone(spark):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(500)], "id long, v string")
    one = {r.id: r.place for r in training.shuffled(rows, "id", 1).collect()}
    again = {r.id: r.place for r in training.shuffled(rows.repartition(9), "id", 1).collect()}
    other = {r.id: r.place for r in training.shuffled(rows, "id", 2).collect()}
    assert sorted(one.values()) == list(range(500)) and one == again and one != other
    split = training.tail_split(training.shuffled(rows, "id", 1), 0.2).collect()
    assert sum(r.held_out for r in split) == 100 and all(r.held_out == (r.place >= 400) for r in split)


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "x long, k long").repartition(13)
    assert {r.x: r.place for r in storage.numbered(rows, "x").collect()} == {x: x for x in range(101)}
    assert storage.numbered(rows.filter("x < 0"), "x").collect() == []


def test_a_perceptron_tells_separate_courses_apart(spark):
    rng = random.Random(3)
    shape = lambda c: [(k if c == 1 else 11 - k if c == 2 else 5) / 11 + rng.gauss(0, 0.05) for k in range(12)]
    rows = [(k, k % 3, shape(k % 3)) for k in range(240)]
    frame = spark.createDataFrame(rows, "run long, label int, flat array<double>")
    model = training.train(frame.filter("run < 180"), 3, hidden=(8,), iterations=60)
    found = training.predicted(model, frame.filter("run >= 180"))
    best = {r.run: int(np.argmax(r.p)) for r in found.collect()}
    assert sum(best[k] == k % 3 for k in range(180, 240)) >= 57
    classes = spark.createDataFrame([("no_trick", 0), ("rise", 1), ("fall", 2)], "label string, class long")
    detected = {r.run: r.trick_id for r in training.detected(found, classes, 0.5, 1).collect()}
    assert {k: v for k, v in detected.items() if best[k]} == {k: ["", "rise", "fall"][c] for k, c in best.items() if c}
