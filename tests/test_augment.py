import random

from motionframe.operators import augment, features


def cells(spark, frames=12):
    rng = random.Random(4)
    rows = [(1, i, c, rng.uniform(-50, 50) if c else rng.uniform(0, 180)) for i in range(frames) for c in range(75) if rng.random() < 0.9 or c in (60, 62)]
    return rows, spark.createDataFrame(rows, "run long, idx long, cell long, value double")


def as_dict(df):
    return {(r.run, r.idx, r.cell): r.value for r in df.collect()}


def test_mirroring_twice_changes_nothing(spark):
    rows, df = cells(spark)
    assert as_dict(augment.mirrored(augment.mirrored(df))) == {r[:3]: r[3] for r in rows}
    once = as_dict(augment.mirrored(df))
    have = {r[:3]: r[3] for r in rows}
    assert all(once[1, i, 1] == have[1, i, 0] for i in range(12) if (1, i, 0) in have)
    assert all(once[1, i, features.TILT] == -have[1, i, features.TILT] for i in range(12))


def test_derivatives_equal_differences(spark):
    rows, df = cells(spark)
    have = {(i, c): v for _, i, c, v in rows}
    got = {k[1:]: v for k, v in as_dict(augment.with_derivatives(df)).items()}
    for i in range(12):
        for k in range(9):
            known = (i, k) in have and (i - 1, k) in have
            want = 0.0 if i == 0 else (have[i, k] - have[i - 1, k]) * 30 if known else None
            assert abs(got.get((i, 9 + k), 1e18) - want) < 1e-6 if want is not None else (i, 9 + k) not in got
        turn = 0.0 if i == 0 else ((have[i, 60] - have[i - 1, 60] + 180) % 360 - 180) * 30
        assert abs(got[i, 61] - turn) < 1e-6


def test_noise_is_reproducible_and_stays_in_bounds(spark):
    _, df = cells(spark)
    a, b = (as_dict(augment.perturbed(d, 20.0, 3, 7)) for d in (df, df.repartition(3)))
    assert a == b and all(0 <= v <= 180 for (_, _, c), v in a.items() if c < 9)
    kept = as_dict(augment.occluded(df, 0.5, 1))
    assert {k for k in as_dict(df) if not 18 <= k[2] < 52} <= set(kept) and len(kept) < df.count()


def test_stretching_keeps_the_ends(spark):
    df = spark.createDataFrame([(1, i, 0, float(i)) for i in range(10)], "run long, idx long, cell long, value double")
    got = {k[1]: v for k, v in as_dict(augment.stretched(df, 0.5)).items() if k[2] == 0}
    assert len(got) == 20 and got[0] == 0 and abs(got[19] - 9) < 1e-9 and abs(got[10] - 10 * 9 / 19) < 1e-9


def test_even_split(spark):
    got = augment.even_split(spark.createDataFrame([(i,) for i in (5, 3, 9)], "id long"), 8).collect()
    assert sorted(map(tuple, got)) == [(3, 3), (5, 3), (9, 2)]
