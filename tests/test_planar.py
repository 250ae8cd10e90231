import math
import random

import numpy as np
import pytest

from motionframe.operators import planar

DDL = "run long, idx long, " + ", ".join(f"{a}{k} double" for k in range(17) for a in "xy")


def made(spark, runs):
    return spark.createDataFrame([(r, i, *(float(v) for p in pose for v in p)) for r, poses in runs.items() for i, pose in enumerate(poses)], DDL)


def walk(rng, n):
    """Poses whose head swings round the trunk in bursts."""
    out, angle = [], 0.0
    for i in range(n):
        angle += rng.gauss(0, 0.05) + (rng.choice([0.5, -0.6]) if (i // 9) % 4 == 1 else 0)
        pose = [(rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for _ in range(17)]
        pose[0] = (3 * math.cos(angle), 3 * math.sin(angle))
        out.append(pose)
    return out


def bend(a, b, c):
    u, v = np.subtract(a, b), np.subtract(c, b)
    return math.degrees(math.acos(max(-1, min(1, u @ v / (np.linalg.norm(u) * np.linalg.norm(v) + 1e-8)))))


def plain(poses, fps):
    """Segments of one run with what is seen in each, by loops."""
    trunk = [np.mean([p[k] for k in (5, 6, 11, 12)], axis=0) for p in poses]
    angle = [math.atan2(p[0][1] - t[1], p[0][0] - t[0]) for p, t in zip(poses, trunk, strict=True)]
    turn = [0.0] + [(b - a + math.pi) % (2 * math.pi) - math.pi for a, b in zip(angle, angle[1:], strict=False)]
    knee = [(bend(p[11], p[13], p[15]) + bend(p[12], p[14], p[16])) / 2 for p in poses]
    hip = [(bend(p[5], p[11], p[13]) + bend(p[6], p[12], p[14])) / 2 for p in poses]
    lean = [abs(p[5][1] - p[6][1]) for p in poses]
    n = len(poses)
    smooth = [sum(abs(x) for x in turn[max(0, i - 1) : i + 2]) / 3 for i in range(n)]
    level, gap, pad = np.mean(smooth) + np.std(smooth), int(0.3 * fps), int(0.2 * fps)
    found = []
    for i in range(n):
        if smooth[i] > level:
            if found and i - found[-1][1] <= gap:
                found[-1][1] = i
            else:
                found.append([i, i])
    out = []
    for a, b in found:
        s, e = max(0, a - pad), min(n - 1, (b if b == n - 1 else b + 1) + pad)
        if not 0.25 < (e - s) / fps < 5:
            continue
        inside = range(s, e + 1)
        edge = np.percentile([abs(turn[i]) for i in inside], 70)
        peak = [i for i in inside if abs(turn[i]) > edge] or list(inside)
        across = [poses[i][5][0] - poses[i][6][0] for i in inside]
        ways = np.sign(np.diff(across))
        total = sum(turn[i] for i in inside)
        out.append((s, e, abs(math.degrees(total)), total > 0, np.mean([knee[i] for i in peak]), np.mean([hip[i] for i in peak]), np.mean([lean[i] for i in peak]), np.mean(np.abs(np.diff(across))), round(int((np.diff(ways) != 0).sum()) / 4, 1)))
    return out


def test_segments_equal_plain_loops(spark):
    rng, fps = random.Random(7), 12.0
    runs = {r: walk(rng, rng.choice([1, 5, 40, 90])) for r in range(12)}
    shown = planar.frame_physics(made(spark, runs))
    got = sorted(planar.segment_physics(planar.airborne(shown, fps), shown, fps).collect(), key=lambda r: (r.run, r.start_idx))
    want = [(r, *row) for r in sorted(runs) for row in plain(runs[r], fps)]
    assert [(r.run, r.start_idx, r.end_idx) for r in got] == [w[:3] for w in want] and len(want) > 8
    for r, w in zip(got, want, strict=True):
        assert (r.degrees, r.knee, r.hip, r.lean, r.twist_intensity) == pytest.approx((w[3], *w[5:9]), abs=1e-6), w[:3]
        assert (r.direction == "forward") == w[4] and r.twists == w[9] and r.sideways == (w[7] > 0.05)


def test_a_straight_body_is_a_layout(spark):
    pose = [(0.0, 0.0)] * 17
    for k, at in {5: (-0.1, 1), 6: (0.1, 1), 11: (-0.1, 2), 12: (0.1, 2), 13: (-0.1, 3), 14: (0.1, 3), 15: (-0.1, 4), 16: (0.1, 4)}.items():
        pose[k] = at
    first = planar.frame_physics(made(spark, {1: [pose]})).first()
    assert (first.trunk_x, first.trunk_y, first.turn, first.lean) == (0, 1.5, 0, 0) and first.body_angle == pytest.approx(-math.pi / 2)
    assert (first.knee, first.hip) == pytest.approx((180, 180), abs=0.02)
