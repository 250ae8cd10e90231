import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from motionframe.llm import codebook


def expected(rows, parts=16, entries=64, rounds=2):
    """Code, error, and label's error by comparing every part with every entry in Python's whole numbers."""
    kept = [(i, lab, [max(-codebook.LARGEST, min(codebook.LARGEST, math.floor(256 * x))) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    short = -len(kept[0][2]) % parts
    kept = [(i, lab, x + [0] * short) for i, lab, x in kept]
    w = len(kept[0][2]) // parts
    split = [[x[p * w : p * w + w] for p in range(parts)] for _, _, x in kept]
    books = [[split[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((square(v, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            sums, count = defaultdict(lambda: [0] * w), defaultdict(int)
            for v in split:
                k = near(v[p], p)[1]
                count[k] += 1
                sums[k] = [a + b for a, b in zip(sums[k], v[p], strict=True)]
            for k, n in count.items():
                books[p][k] = [s // n for s in sums[k]]
    coded = [[near(v[p], p) for p in range(parts)] for v in split]
    by_label = defaultdict(int)
    for (_, lab, _), c in zip(kept, coded, strict=True):
        by_label[lab] += sum(d for d, _ in c)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), by_label[lab], sha) for (i, lab, _), c in zip(kept, coded, strict=True))


def made(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label string, code string, error int")


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def vectors(seed, n, dim, coarse):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, dim)) if not coarse else rng.integers(-2, 3, (n, dim)) / 256  # coarse: many equal distances
    return [(int(i), [float(np.float32(x)) for x in v], [None, "a", "b"][k % 3]) for k, (i, v) in enumerate(zip(rng.permutation(n), values, strict=True))]


@pytest.mark.parametrize(("dim", "coarse"), [(64, False), (32, True), (37, False)])
def test_codes_equal_brute_force(spark, dim, coarse):
    rows = vectors(dim, 400, dim, coarse)
    rows += [(900, None, "a"), (901, [None] * dim, "a"), (902, [math.nan] * dim, None), (903, [math.inf] * dim, None), (904, [], "a"), (905, [1.0], "a"), (None, rows[0][1], None), rows[1], rows[1]]
    rows += [(906, [3e38] + rows[0][1][1:], "big"), (907, rows[2][1][:-1] + [-3e38], "big")]
    assert got(codebook.report(made(spark, rows))) == expected(rows)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = vectors(1, 9, 16, False)
    assert got(codebook.report(made(spark, rows))) == expected(rows)
    for none in ([], [(1, None, "a"), (2, [], None)]):
        assert codebook.report(made(spark, none)).collect() == []


def test_bounds_leave_groups_out_without_changing_codes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 64)) * 8
    rows = [(k, [float(np.float32(x)) for x in centres[k % 64] + rng.normal(size=64) * 0.05], "a") for k in range(1000)]
    coded = codebook.encode(made(spark, rows))
    first, second = coded.computed
    assert first == 1000 * 16 * 65 and second < first / 3
    assert sorted((r.vec_id, r.code) for r in coded.rows.collect()) == sorted((int(r[0]), r[1]) for r in expected(rows))


def test_decoded_vectors_lie_where_the_error_says(spark):
    rows = vectors(4, 200, 32, False)
    coded = codebook.encode(made(spark, rows))
    error = {r.vec_id: r.error for r in coded.rows.collect()}
    back = {r.vec_id: np.array(r.embedding) * 256 for r in codebook.decode(coded.rows, coded.entries).collect()}
    for i, v, _ in rows:
        assert int(round(((np.floor(np.array(v) * 256) - back[i]) ** 2).sum())) == error[i]
