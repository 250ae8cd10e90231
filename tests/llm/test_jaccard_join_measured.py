import random

from motionframe.llm import jaccard_join
from tests.llm.test_jaccard_join import brute


def near_copies(copies, words=150):
    """Copies of one text with up to 15 words replaced: those with few link with each other, those with many with nothing."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(copies):
        text = list(base)
        for _ in range(rng.randrange(16)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_large_group_of_near_copies_is_not_measured_pair_by_pair(spark, monkeypatch):
    rows, measured, distances = near_copies(240), [], jaccard_join.distances

    def counted(pairs, points, width):
        measured.append(pairs.count())
        return distances(pairs, points, width)

    monkeypatch.setattr(jaccard_join, "distances", counted)
    got = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert sum(measured) <= 10 * len(rows), measured
