import math
import random

import numpy as np
import pytest

from motionframe.operators import intervals, turns


def machine(rate, tilt, tilt_sum, twist_sum, fps, least=120.0):
    """The segments of one run, frame by frame."""
    n = len(rate)
    if n < 10:
        return [(0, n - 1)]
    size = max(3, int(fps * 0.1))
    half = (size - 1) // 2
    smooth = np.array([sum(rate[max(0, i + half - size + 1) : i + half + 1]) / size for i in range(n)])
    high, low = max(smooth.mean() + smooth.std(), 8.0), max(smooth.mean() * 0.5, 3.0)
    gap, short, pad, pause, apart, most = (int(k * fps) for k in (0.6, 0.3, 0.3, 0.1, 0.5, 3.5))
    regions, last = [], None
    for i in range(n):
        if smooth[i] > high:
            if last is not None and i - last <= gap:
                regions[-1][1] = i
            else:
                regions.append([i, i])
            last = i
    found = []
    for a, b in regions:
        while a > 0 and smooth[a - 1] > low:
            a -= 1
        while b < n - 1 and smooth[b + 1] > low:
            b += 1
        a, b = max(0, a - pad), min(n - 1, b + pad)
        if b - a >= short:
            if found and a <= found[-1][1] + gap:
                found[-1][1] = max(found[-1][1], b)
            else:
                found.append([a, b])

    def valleys(a, b, is_low):
        out, i = [], a
        while i <= b:
            if is_low(i):
                j = i
                while j < b and is_low(j + 1):
                    j += 1
                end = j + 1 if j < b else j
                if end - i >= pause:
                    out.append(a + ((i - a) + (end - a)) // 2)
                i = j + 1
            else:
                i += 1
        return out

    pieces = []
    for a, b in found:
        if b - a < 1.5 * fps:
            pieces.append((a, b))
            continue
        points = valleys(a, b, lambda i: tilt[i] < (35 if b - a > 3.0 * fps else 20))
        if b - a > 3.0 * fps:
            level = max(smooth[a : b + 1].mean() * 0.3, 2.0)
            for p in valleys(a, b, lambda i: smooth[i] < level):
                if all(abs(p - q) > apart for q in points):
                    points.append(p)
        edges = [a, *sorted(points), b]
        for s, e in zip(edges, edges[1:], strict=False):
            if e - s < short:
                continue
            if e - s <= most:
                pieces.append((s, e))
                continue
            k = int((e - s) / most)
            chunk = (e - s) // (k + 1)
            cuts = [s]
            for j in range(1, k + 1):
                lo, hi = max(0, j * chunk - apart), min(e - s + 1, j * chunk + apart)
                cuts.append(min(range(s + lo, s + hi), key=lambda i: (smooth[i], i)))
            cuts = [*sorted(cuts), e]
            pieces += [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= short]
    kept = []
    for a, b in pieces:
        turned, twisted = abs(tilt_sum[b] - tilt_sum[a]), abs(twist_sum[b] - twist_sum[a])
        seconds, top = (b - a) / fps, max(tilt[a : b + 1])
        if turned + 0.7 * twisted >= least and max(smooth[a : b + 1]) >= 8 and not (seconds < 0.5 and turned < 200) and not (seconds < 0.8 and top < 60 and turned < 180):
            kept.append((a, b))
    return kept


def signal(rng, n, fps):
    """Quarters of degrees, so that sums are exact: bursts of rotation, pauses, and a tilt that comes and goes."""
    rate, tilt = [], []
    while len(rate) < n:
        level, upright = rng.choice([0, 1, 2, 4, 12, 30, 45]), rng.choice([5, 25, 50, 120])
        for _ in range(rng.randrange(1, max(2, int(rng.choice([0.1, 0.5, 2, 5]) * fps)))):
            rate.append(max(0, level + rng.randrange(-4, 5) / 4))
            tilt.append(max(0, upright + rng.randrange(-8, 9) / 4))
    rate, tilt = rate[:n], tilt[:n]
    twist = np.cumsum([r * rng.choice([-1, 0, 0.5]) for r in rate])
    return rate, tilt, np.cumsum(rate), twist


@pytest.mark.parametrize("fps", [30.0, 10.0])
def test_segments_equal_a_state_machine(spark, fps):
    rng = random.Random(int(fps))
    runs = {k: signal(rng, rng.choice([3, 9, 10, 40, 300, 900]), fps) for k in range(40)}
    rows = [(k, i, float(i), *(float(x[i]) for x in s)) for k, s in runs.items() for i in range(len(s[0]))]
    frames = spark.createDataFrame(rows, "run long, idx long, t_ms double, rate double, tilt double, tilt_cumulative double, twist_cumulative double")
    got = sorted(tuple(r) for r in turns.hysteresis_segments(frames, turns.TurnConfig(fps)).collect())
    want = sorted((k, *seg) for k, s in runs.items() for seg in machine(*s, fps))
    assert got == want and len(want) > 60
    lengths = [b - a for _, a, b in want]
    assert max(lengths) > 1.5 * fps and any(k for k in runs if sum(w[0] == k for w in want) > 3)


def test_no_frames_no_segments(spark):
    none = spark.createDataFrame([], "run long, idx long, t_ms double, rate double, tilt double, tilt_cumulative double, twist_cumulative double")
    assert turns.hysteresis_segments(none).count() == 0


def smoothed(vectors, sigma):
    """The orientations of one run smoothed by a plain loop."""
    if sigma <= 0:
        return vectors
    q = []
    for v in vectors:
        angle = math.sqrt(sum(x * x for x in v))
        f = math.sin(angle / 2) / angle if angle > 1e-12 else 0.5
        now = [math.cos(angle / 2), *(x * f for x in v)]
        if q and sum(a * b for a, b in zip(q[-1], now, strict=True)) < 0:
            now = [-x for x in now]
        q.append(now)
    n, reach, out = len(q), int(4 * sigma + 0.5), []
    for i in range(n):
        total = [0.0] * 4
        for d in range(-reach, reach + 1):
            j = (i + d) % (2 * n)
            j = 2 * n - 1 - j if j >= n else j
            total = [t + math.exp(-0.5 * d * d / sigma**2) * x for t, x in zip(total, q[j], strict=True)]
        sign, size = (-1 if total[0] < 0 else 1), math.sqrt(sum(x * x for x in total[1:]))
        scale = 2 * math.atan2(size, abs(total[0])) / size if size else 0
        out.append([sign * scale * x for x in total[1:]])
    return out


def test_smoothing_equals_a_plain_loop(spark):
    rng = random.Random(3)
    runs = {}
    for k, (n, sigma) in enumerate([(1, 3.0), (2, 1.5), (5, 3.0), (9, 2.0), (40, 1.5), (40, 3.0), (30, 0.0), (26, 1.0)]):
        at = [0.0, 0.0, 0.0]
        walk = []
        for _ in range(n):
            at = [x + rng.gauss(0.3, 0.6) for x in at]
            walk.append(list(at))
        runs[k] = (sigma, walk)
    rows = [(k, i, i * 33.0, *v, "kept") for k, (_, walk) in runs.items() for i, v in enumerate(walk)] + [(99, 0, 0.0, 1.0, 2.0, 3.0, "kept")]
    frames = spark.createDataFrame(rows, "run long, idx long, t_ms double, ox double, oy double, oz double, note string")
    widths = spark.createDataFrame([(k, s) for k, (s, _) in runs.items()], "run long, sigma double")
    got = {(r.run, r.idx): (r.ox, r.oy, r.oz) for r in turns.smoothed_orientations(frames, widths).collect()}
    assert len(got) == len(rows) and got[99, 0] == (1.0, 2.0, 3.0)
    for k, (sigma, walk) in runs.items():
        for i, v in enumerate(smoothed(walk, sigma)):
            assert got[k, i] == pytest.approx(v, abs=1e-9), (k, i)


def plain_intensity_segments(x, fps, gap_s=0.5):
    n, gap, pad, least, most = len(x), int(gap_s * fps), int(0.15 * fps), int(0.3 * fps), int(4 * fps)
    level = np.mean(x) + 0.5 * np.std(x)
    islands = []
    for i in np.flatnonzero(np.array(x) > level):
        if islands and i - islands[-1][1] <= gap:
            islands[-1][1] = int(i)
        else:
            islands.append([int(i), int(i)])
    out = []
    for a, b in islands:
        s, e = max(0, a - pad), n - 1 if b == n - 1 else min(n - 1, b + 1 + pad)
        if least <= e - s <= most:
            if out and s <= out[-1][1] + gap:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
    return [p for s, e in out for p in ([(s, (s + e) // 2), ((s + e) // 2, e)] if e - s > most else [(s, e)])]


def test_intensity_segments_equal_a_plain_loop(spark):
    rng, fps = random.Random(8), 12.0
    runs = {k: [rng.choice([0, 0, 1, 8]) / 8 if rng.random() < 0.2 else (0.0 if (i // 37 + k) % 3 else rng.randrange(4, 9) / 8) for i in range(rng.choice([1, 20, 200, 500]))] for k in range(30)}
    frames = spark.createDataFrame([(k, i, float(v)) for k, x in runs.items() for i, v in enumerate(x)], "run long, idx long, intensity double")
    want = sorted((k, *s) for k, x in runs.items() for s in plain_intensity_segments(x, fps))
    assert sorted(tuple(r) for r in turns.intensity_segments(frames, fps).collect()) == want and len(want) > 40


def test_intensity_of_a_body_that_falls_and_turns(spark):
    rows = []
    for i in range(9):
        row = {"run": 1, "idx": i} | {f"{a}{k}": 0.0 for k in range(17) for a in "xy"}
        for k in (5, 6, 11, 12):
            row[f"y{k}"] = 10.0 if i >= 4 else 0.0
        row["x0"], row["y0"] = 1.0, (10.0 if i >= 4 else 0.0)
        rows.append(row)
    got = [r.intensity for r in turns.body_intensity(spark.createDataFrame(rows)).orderBy("idx").collect()]
    assert got == pytest.approx([0, 0, 0, 1, 1, 1, 0, 0, 0], abs=1e-6)


@pytest.mark.parametrize("width", [1, 4, 256])
def test_frames_within_intervals(spark, width):
    frames = spark.createDataFrame([(r, i) for r in (1, 2) for i in range(30)], "run long, idx long")
    spans = [(1, 0, 29), (1, 3, 3), (1, 5, 4), (2, -5, 2), (2, 28, 90), (3, 0, 9), (1, 3, 3)]
    got = sorted((r.run, r.start_idx, r.end_idx, r.idx) for r in intervals.within(spark.createDataFrame(spans, "run long, start_idx long, end_idx long"), frames, width=width).collect())
    assert got == sorted((r, a, b, i) for r, a, b in spans for i in range(max(a, 0), min(b, 29) + 1) if r < 3)
