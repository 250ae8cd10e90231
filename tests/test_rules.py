import random

import pytest

from motionframe.operators import rules

CATALOG = [
    ("a", 0, 60.0, 200.0, "knee", 20.0, 120.0),
    ("a", 0, 60.0, 200.0, "hip", 10.0, 110.0),
    ("a", 1, 100.0, 300.0, "knee", 60.0, 180.0),
    ("b", 0, 30.0, 150.0, "hip", 0.0, 60.0),
    ("b", 1, 100.0, 100.0, None, None, None),
    ("b", 2, 30.0, 200.0, "hip", 90.0, 180.0),
    ("c", 0, 400.0, 500.0, "knee", 90.0, 90.0),
]


def phase(rows, angles, start, shortest, longest):
    """(end, confidence) of one phase by trying every end"""
    known = [r for r in rows if r[4] is not None]
    if not known:
        return min(start + shortest - 1, len(angles) - 1), 1.0
    best = (None, 0.0)
    for end in range(start + shortest - 1, min(start + longest, len(angles))):
        total = 0.0
        for _, _, _, _, joint, low, high in known:
            inside = [f[joint] for f in angles[start : end + 1] if f[joint] is not None and low <= f[joint] <= high]
            if inside:
                middle, half = (low + high) / 2, (high - low) / 2
                total += max(0.0, 1 - min(abs(x - middle) for x in inside) / half * 0.5) if half > 0 else 1.0
        score = min(total / len(known), 1.0)
        if score > best[1] + 1e-9:
            best = (end, score)
    return best if best[0] is not None and best[1] >= 0.5 else None


def brute(angles, fps):
    found = {}
    for trick in ("a", "b", "c"):
        phases = sorted({r[1] for r in CATALOG if r[0] == trick})
        for start in range(len(angles)):
            at, scores = start, []
            for p in phases:
                rows = [r for r in CATALOG if r[0] == trick and r[1] == p]
                shortest = max(1, int(rows[0][2] / 1000 * fps))
                longest = max(shortest, int(rows[0][3] / 1000 * fps))
                got = phase(rows, angles, at, shortest, longest) if at + shortest <= len(angles) else None
                if got is None:
                    break
                scores.append(got[1])
                at = got[0] + 1
            else:
                mean = sum(scores) / len(scores)
                if mean >= 0.5 and (trick not in found or mean > found[trick][0] + 1e-9):
                    found[trick] = (mean, start, at - 1)
    return found


def test_phase_matches_equal_trying_every_start_and_end(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for run in range(6):
        n = rng.randrange(1, 40)
        angles = [{"knee": rng.choice([None, 90.0, rng.uniform(0, 180)]), "hip": rng.choice([None, rng.uniform(0, 180)])} for _ in range(n)]
        rows += [(run, i, i * 1000 / 30, f["knee"], f["hip"]) for i, f in enumerate(angles)]
        # frames of one run only: the rate is not known
        want |= {(run, t): m for t, m in brute(angles, 30.0 if n == 1 else 1000 / (1000 / 30)).items()}
    frames = spark.createDataFrame(rows, "run long, idx long, t_ms double, knee double, hip double")
    catalog = spark.createDataFrame(CATALOG, "trick_id string, phase_no long, min_ms double, max_ms double, joint string, low double, high double")
    got = {(r.run, r.trick_id): (r.confidence, r.start_idx, r.end_idx) for r in rules.phase_matches(frames, rules.angle_rows(frames, ["knee", "hip"]), catalog).collect()}
    assert set(got) == set(want)
    for key, (confidence, start, end) in want.items():
        assert got[key][0] == pytest.approx(confidence, abs=1e-8) and got[key][1:] == (start, end)


def test_catalog_is_flattened_with_phases_that_have_no_rules(spark):
    schema = "trick_id string, phases array<struct<name: string, duration_range_ms: array<int>, angle_rules: array<struct<joint: string, min: double, max: double, description: string>>>>"
    made = spark.createDataFrame([("a", [("up", [100, 300], [("knee", 1.0, 2.0, None)]), ("free", [50, 60], [])])], schema)
    assert sorted((r.phase_no, r.phase, r.min_ms, r.joint, r.low) for r in rules.flattened(made).collect()) == [(0, "up", 100.0, "knee", 1.0), (1, "free", 50.0, None, None)]
