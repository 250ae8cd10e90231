import random

import numpy as np
import pytest

from motionframe.operators import boxes


def plain(corners, width, height, padding=1.8, smallest=400.0, window=15):
    """The crops of one run, frame by frame; None where no box was found."""
    at = [i for i, c in enumerate(corners) if c is not None]
    if len(at) < 5:
        return [(0, 0, width, height)] * len(corners)
    full = [np.interp(range(len(corners)), at, [corners[i][k] for i in at]) for k in range(4)]
    cx, cy = (full[0] + full[2]) / 2, (full[1] + full[3]) / 2
    side = np.maximum(np.maximum(full[2] - full[0], full[3] - full[1]) * padding, smallest)
    mean = lambda v: np.array([sum(v[max(0, i - window // 2) : i + window // 2 + 1]) / window for i in range(len(v))])
    cx, cy, side = mean(cx), mean(cy), mean(side)
    side = np.clip(side, np.median(side) * 0.8, np.median(side) * 1.2)
    out = []
    for x, y, s in zip(cx, cy, side, strict=True):
        row = []
        for c, most in ((x, width), (y, height)):
            low, high = c - s / 2, c + s / 2
            if low < 0:
                low, high = 0, high - low
            if high > most:
                low, high = low - (high - most), most
            row.append((max(0, low), high))
        out.append((row[0][0], row[1][0], row[0][1], row[1][1]))
    return out


def test_crops_equal_a_plain_loop(spark):
    rng = random.Random(9)
    runs = {}
    for k in range(25):
        n, x, y = rng.choice([6, 15, 80]), rng.uniform(0, 1900), rng.uniform(0, 1000)
        corners = []
        for _ in range(n):
            x, y, w, h = x + rng.gauss(0, 40), y + rng.gauss(0, 20), rng.uniform(30, 300), rng.uniform(50, 500)
            corners.append(None if rng.random() < 0.4 else (x, y, x + w, y + h))
        if k % 3 == 0:
            corners[: n // 3] = [None] * (n // 3)  # gaps at both ends
            corners[-2:] = [None] * 2
        runs[k] = (corners if k else [None] * n, *((1920.0, 1080.0) if k % 2 else (640.0, 360.0)))
    rows = [(k, i, *(c or (None,) * 4), w, h) for k, (corners, w, h) in runs.items() for i, c in enumerate(corners)]
    frames = spark.createDataFrame(rows, "run long, idx long, x0 double, y0 double, x1 double, y1 double, width double, height double")
    got = {(r.run, r.idx): (r.x0, r.y0, r.x1, r.y1) for r in boxes.stable_crops(frames).collect()}
    assert len(got) == len(rows)
    few = 0
    for k, (corners, w, h) in runs.items():
        few += sum(c is not None for c in corners) < 5
        for i, want in enumerate(plain(corners, w, h)):
            assert got[k, i] == pytest.approx(want, abs=1e-6), (k, i)
    assert few and few < len(runs)


def test_interpolation_is_flat_outside(spark):
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])] + [(2, 0, None)], "run long, idx long, v double")
    got = {(r.run, r.idx): r.v for r in boxes.interpolated(frames, ("v",), frames.v.isNotNull()).collect()}
    assert [got[1, i] for i in range(6)] == [2, 2, 4, 6, 8, 8] and got[2, 0] is None
