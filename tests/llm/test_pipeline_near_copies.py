import random

import corpus_pipeline

from tests.llm.test_jaccard_join import shingles


def kept(rows):
    """doc_ids that are the smallest of their group; every pair is compared at five words and similarity 0.8"""
    sets = {i: shingles(t, 5) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return [i for i in sets if group[i] == i]


def test_stage_equals_all_pairs_with_copies_cut_short(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 140))]
        rows.append((10 * k, " ".join(base)))
        for j, share in enumerate((0.78, 0.8, 0.82, 0.84, 0.86)):
            rows.append((10 * k + 1 + j, " ".join(base[: round(len(base) * share)] if j == k % 5 else base[:20] + [f"x{k}y{j}z{i}" for i in range(60)])))
        scattered = list(base)
        scattered[len(base) // 2] = "edited"
        rows.append((10 * k + 7, " ".join(scattered)))
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == kept(rows)
