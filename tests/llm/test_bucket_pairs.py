import random

from pyspark.sql import functions as F

from motionframe.llm import buckets, line_dedup


def rows_of(spark, sets):
    return spark.createDataFrame([(node, x) for node, s in sets.items() for x in s], "node long, shingle long")


def test_sketches_rule_out_pairs_of_large_sets(spark):
    rng = random.Random(4)
    draw = lambda n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    common, own = draw(1100), {k: draw(400) for k in range(4)}
    # 0 and 1 share 1,100 of 1,900; 2 shares 1,400 of 1,600 with 0
    sets = {0: common + own[0], 1: common + own[1], 2: common + own[0][:300] + own[2][:100], 3: draw(1500)}
    sketched = buckets.sketches(rows_of(spark, sets))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3)], "a long, b long")
    assert [(r.a, r.b, r.n_a, r.n_b) for r in buckets._may_link(pairs, sketched, 80).collect()] == [(0, 2, 1500, 1500)]


def test_pairs_are_compared_by_distinct_shingles(spark):
    rng = random.Random(5)
    letters = "abcdefghij ü無"
    lines = []
    for _ in range(40):
        line = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 300)))
        cut = rng.randrange(len(line) + 1)
        lines += [line, line[:cut] + "".join(rng.choice(letters) for _ in range(rng.randrange(25))) + line[cut + rng.randrange(12) :] or "x"]
    lines += ["z" * 500, "z" * 700, "ab" * 400, "ba" * 300, "short", "shorter"]
    grams = [{line[i : i + 9] for i in range(max(len(line) - 8, 1))} for line in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, grams string")
    pairs = [(k, k + 1) for k in range(len(lines) - 1)]
    sizes = spark.createDataFrame([(a, b, len(grams[a]), len(grams[b])) for a, b in pairs], "a long, b long, n_a long, n_b long")
    found = sorted((r.a, r.b) for r in buckets.linked(sizes, texts, 80, line_dedup.shingles).collect())
    wanted = [(a, b) for a, b in pairs if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    assert found == wanted and len(wanted) > 10
    counted = line_dedup.distinct_shingles(texts).groupBy("node").agg(F.count("*").alias("n")).collect()
    assert {r.node: r.n for r in counted} == {k: len(g) for k, g in enumerate(grams)}
