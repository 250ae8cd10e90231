import random
import struct
from dataclasses import replace

import pytest
import xxhash

from motionframe.operators import augment, features, trajectory

CELLS = "run long, idx long, cell long, value double"
NEVER = augment.AugmentConfig(**{f"{k}_chance": 0.0 for k in ("stretch", "angle", "proportions", "position", "mirror", "dropout")})
ALWAYS = augment.AugmentConfig(**{f"{k}_chance": 1.0 for k in ("stretch", "angle", "proportions", "position", "mirror", "dropout")})


def made(spark, runs=3, frames=9):
    rng = random.Random(1)
    rows = [(r, i, c, rng.uniform(0, 180)) for r in range(runs) for i in range(frames + r) for c in range(75) if rng.random() < 0.9 or c in (60, 62)]
    return rows, spark.createDataFrame(rows, CELLS), spark.createDataFrame([(r, 4 + r) for r in range(runs)] + [(90, 2), (0, 0)], "run long, count long")


def uniform(seed, run):
    """The draw of a run by the hash that Spark documents."""
    h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    return (xxhash.xxh64(struct.pack("<q", run), seed=h).intdigest() >> 11) / float(1 << 53)


def as_dict(df):
    return {(r.run, r.idx, r.cell): r.value for r in df.collect()}


def test_without_chances_variants_are_copies(spark):
    rows, cells, counts = made(spark)
    got = as_dict(augment.variants(cells, counts, 7, NEVER))
    assert got == {(r * augment.VARIANTS + k, i, c): v for r, i, c, v in rows for k in range(4 + r)}


def test_each_variant_draws_for_itself(spark):
    rows, cells, counts = made(spark)
    places = augment.mirror_places()
    got = as_dict(augment.variants(cells, counts, 7, replace(NEVER, mirror_chance=0.5)))
    want, turned = {}, 0
    for r, i, c, v in rows:
        for k in range(4 + r):
            run = r * augment.VARIANTS + k
            to, sign = places[c] if uniform(7 + 100 + 4, run) < 0.5 else (c, 1.0)
            turned += to != c
            want[run, i, to] = v * sign
    assert got == want and 0 < turned


def test_stretch_factors_are_drawn_in_their_range(spark):
    _, cells, counts = made(spark)
    got = as_dict(augment.variants(cells, counts, 7, replace(NEVER, stretch_chance=1.0)))
    lengths = {}
    for run, i, _ in got:
        lengths[run] = max(lengths.get(run, 0), i + 1)
    low, high = NEVER.stretch
    assert lengths == {r * augment.VARIANTS + k: max(4, int((9 + r) / (low + uniform(8, r * augment.VARIANTS + k) * (high - low)))) for r in range(3) for k in range(4 + r)}


def test_all_changes_come_in_their_order(spark):
    _, cells, counts = made(spark)
    got = as_dict(augment.variants(cells, counts, 7, ALWAYS))
    base = augment.variants(cells, counts, 7, NEVER)
    c = ALWAYS
    low, high = c.stretch
    by_hand = augment.stretched(base, low + augment.uniform(8, "run") * (high - low), c.fps)
    by_hand = augment.perturbed(by_hand, c.angle_deviation, c.angle_smoothing, 27, c.fps)
    by_hand = augment.mirrored(augment.blurred(augment.reproportioned(by_hand, *c.proportions, 37), c.position_deviation, 47))
    want = as_dict(augment.occluded(by_hand, c.dropout_rate, 67))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {k[2] for k in got} <= set(range(features.WIDTH))


def test_envelopes_rule_out_without_changing_the_best():
    import numpy as np

    rng = np.random.default_rng(5)
    compared = 0
    for _ in range(20):
        centre = rng.normal(size=(24, 4)) * 3
        references = [(k, centre + rng.normal(size=(24, 4)) * (0.1 if k == 17 else 4)) for k in range(40)] + [(50, rng.normal(size=(9, 4))), (51, np.zeros((0, 4)))]
        query = centre + rng.normal(size=(24, 4)) * 0.1
        sure = {k: max(0.0, 1.0 - trajectory.warped_distance(query, b) / max(len(query), len(b), 1) / 8.0) for k, b in references}
        key, confidence, full = trajectory.nearest_reference(query, references, 8.0)
        assert (key, confidence) == (min(sure, key=lambda k: (-sure[k], k)), max(sure.values()))
        compared += full
    assert compared < 0.6 * 20 * 42


def test_blocks_of_runs_meet_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "BLOCK", 4)
    rng = random.Random(6)
    runs = [(k, [[rng.uniform(0, 3) for _ in range(3)] for _ in range(rng.choice([10, 11]))]) for k in range(30)]
    frame = spark.createDataFrame(runs, "run long, trajectory array<array<double>>")
    import numpy as np

    want = {}
    for q, a in runs:
        best = max(((max(0.0, 1 - trajectory.warped_distance(np.array(a), np.array(b)) / max(len(a), len(b)) / 4.0), -r) for r, b in runs if r != q))
        want[q] = (-best[1], best[0])
    got = {r.query: (r.reference, pytest.approx(r.confidence)) for r in trajectory.best_by_warping(frame, frame, 0.0, 4.0, other_runs=True).collect()}
    assert got == want
