import math
import random

import pytest

from motionframe.operators import biomechanics

DDL = "run long, idx long, t_ms double, ox double, oy double, oz double, tx double, ty double, tz double, left_ankle double, right_ankle double, " + ", ".join(f"j{k} double" for k in range(19))


def frame(run, idx, orient=(0, 0, 0), place=(0, 1, 0), ankles=(0.0, 0.0), **joints):
    return (run, idx, idx * 100.0, *map(float, orient), *map(float, place), *ankles, *(float(joints.get(f"j{k}", 0.0)) for k in range(19)))


def body(spark, rows, **kw):
    return biomechanics.biomechanics(spark.createDataFrame(rows, DDL), 10.0, **kw)


def test_a_jump_with_half_a_somersault(spark):
    # ten frames a second: five on the ground, six in the air, three on the ground; forward about x by 30 degrees a frame in the air
    rows = []
    for i in range(14):
        up = max(0.0, 1.0 - ((i - 7.5) / 3) ** 2) if 5 <= i <= 10 else 0.0
        angle = math.radians(30 * min(max(i - 4, 0), 6))
        rows.append(frame(1, i, (angle, 0, 0), (0.2 * i, 1 + up, 0), (0.05 + up, 0.1 + up), j3=90 if 5 <= i <= 10 else 0, j4=90 if 5 <= i <= 10 else 0, j0=80, j1=80))
    got = body(spark, rows).orderBy("idx").collect()
    assert [r.airborne for r in got] == [5 <= i <= 10 for i in range(14)]
    assert [round(r.flip) for r in got] == [30 * min(max(i - 4, 0), 6) for i in range(14)]
    assert all(r.twist == 0 for r in got)
    assert (got[0].vx, got[0].vy) == (0, 0) and got[3].vx == pytest.approx(2.0) and got[0].height == pytest.approx(0.95)
    assert (got[7].ax, got[7].ay, got[7].az) == pytest.approx((1, 0, 0)) and (got[2].ax, got[2].ay, got[2].az) == (0, 0, 0)
    segments = spark.createDataFrame([(1, 0, 13), (1, 3, 3), (1, 0, 4), (7, 0, 9)], "run long, start_idx long, end_idx long")
    by_end = {(r.run, r.start_idx, r.end_idx): r for r in biomechanics.signatures(segments, body(spark, rows)).collect()}
    whole = by_end[1, 0, 13]
    assert (whole.flip_deg, whole.twist_deg) == pytest.approx((180, 0), abs=1e-6) and whole.direction == "backward"
    assert (whole.ax, whole.ay, whole.az) == pytest.approx((1, 0, 0)) and whole["shape"] == "tuck" and whole.knee == 90 and whole.hip == 80
    assert whole.entry == "running" and whole.seconds == pytest.approx(1.3) and whole.peak_height == pytest.approx(0.95 + 1 - (0.5 / 3) ** 2)
    ground = by_end[1, 0, 4]  # no frame in the air: all count
    assert (ground.knee, ground.entry, ground.direction, ground.flip_deg) == (0, "standing", "forward", 0) and (ground.ax, ground.ay) == (1, 0)
    for none in (by_end[1, 3, 3], by_end[7, 0, 9]):
        assert (none.flip_deg, none.direction, none["shape"], none.knee, none.entry, none.seconds) == (0, "forward", "layout", 180, "standing", 0)


def test_ground_by_the_body_where_ankles_are_unknown(spark):
    rows = [frame(1, i, place=(0, y, 0), ankles=(None, 5.0)) for i, y in enumerate([1.0, 0.9, 1.0, 1.2, 1.21, 1.3] + [1.0] * 5 + [0.1])]
    got = body(spark, rows).orderBy("idx").collect()  # only the first ten frames show the ground
    assert got[0].height == pytest.approx(0.1) and [r.airborne for r in got][:6] == [False, False, False, False, True, True]
    assert body(spark, rows, ground=0.0).filter("airborne").count() == 11
    assert biomechanics.biomechanics(spark.createDataFrame([], DDL)).count() == 0


def test_entries(spark):
    cases = [
        ([(0, 0), (0, 0), (0, 0)], 2, "standing"),
        ([(2, 0), (2, 0), (2, 0)], 2, "running"),
        ([(1, 0), (0, 0), (-0.5, 0)], 2, "wall"),
        ([(0.4, 0), (0, 0), (-0.5, 0)], 2, "standing"),
        ([(1, 0), (0, 0), (0.5, 0)], 2, "standing"),
        ([(1, 0), (-1, 0), (-1, 0)], 1, "standing"),
        ([(9, 0), (9, 0), (9, 0)], 0, "standing"),
        ([(9, 0)] * 12, 11, "standing"),
    ]
    rows, segments = [], []
    for run, (speeds, takeoff, _) in enumerate(cases):
        x = 0.0
        for i, (v, _) in enumerate([(0, 0), *speeds]):  # the segment starts at frame 1
            x += v / 10
            rows.append(frame(run, i, place=(x, 1, 0), ankles=(1.0, 1.0) if i >= takeoff + 1 else (0.0, 0.0)))
        segments.append((run, 1, len(speeds)))
    found = biomechanics.entries(spark.createDataFrame(segments, "run long, start_idx long, end_idx long"), body(spark, rows)).collect()
    assert {r.run: r.entry for r in found} == {run: want for run, (_, _, want) in enumerate(cases)}


def product(a, b):
    return (a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2], a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])


def of_vector(v):
    angle = math.sqrt(sum(x * x for x in v))
    return (math.cos(angle / 2), *(x * (math.sin(angle / 2) / angle if angle else 0.5) for x in v))


def test_turns_of_random_orientations_put_together_give_the_step(spark):
    rng = random.Random(4)
    walk = [tuple(rng.gauss(0, 1.2) for _ in range(3)) for _ in range(40)]
    got = biomechanics.frame_turns(spark.createDataFrame([frame(1, i, v) for i, v in enumerate(walk)], DDL)).orderBy("idx").collect()
    assert (got[0].flip, got[0].twist) == (0, 0)
    for before, now, r in zip(walk, walk[1:], got[1:], strict=False):
        p, q = of_vector(before), of_vector(now)
        step = product(q, (p[0], -p[1], -p[2], -p[3]))
        up = product(product(p, (0, 0, 1, 0)), (p[0], -p[1], -p[2], -p[3]))[1:]
        # what is left after the turn about the up axis has no part along it; its sign is that of the product's vector
        half = math.radians(r.twist) / 2 * (1 if step[0] >= 0 else -1)
        twist = (math.cos(half), *(u * math.sin(half) for u in up))
        rest = product(step, (twist[0], -twist[1], -twist[2], -twist[3]))
        assert sum(a * b for a, b in zip(rest[1:], up, strict=True)) == pytest.approx(0, abs=1e-9)
        assert abs(r.flip) == pytest.approx(math.degrees(2 * math.atan2(math.sqrt(sum(x * x for x in rest[1:])), abs(rest[0]))), abs=1e-6)
        size = math.sqrt(sum(x * x for x in step[1:]))
        assert (r.ax, r.ay, r.az) == pytest.approx([x / size * (1 if step[0] >= 0 else -1) for x in step[1:]])
