import random
import re

from motionframe.llm import buckets, jaccard_join


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[root(i)] = min(doc, lowest.get(root(i), doc))
    return [(doc, len(sets[i]), lowest.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def corpus(seed, groups, copies, words=40, passage=True):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, words))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if passage and rng.random() < 0.5:
                text = shared + text
            rows.append((len(rows) * 7 % 10_007, " ".join(text)))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "n", "x") for i, t in rows], "doc_id long, text string, node string, component string")
    got = sorted(str(tuple(r)) for r in jaccard_join.groups(docs).collect())
    assert got == sorted(map(str, brute(rows)))


def test_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(buckets, "LEAF", 4)
    edge = [(20_001, None), (20_002, ""), (20_003, "one two"), (20_004, "One TWO"), (20_005, "one two three four"), (20_005, "quite another text here"), (20_006, "quite another text here"), (None, "one two three four"), (None, "nobody has this text at all")]
    check(spark, corpus(5, 25, 9) + edge)


def test_chain_of_near_copies(spark):
    words = [f"a{k}" for k in range(200)]
    rows = [(k, " ".join(words[:100] + [f"b{i}" for i in range(k)] + words[100 + k :])) for k in range(12)]
    check(spark, rows)


def test_empty_table(spark):
    assert jaccard_join.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
