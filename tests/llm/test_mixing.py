import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

from motionframe.llm import mixing


def expected(rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """size, source_size, target and copies of each row, by plain resharing in exact numbers."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, text, _ in rows]
    total = Counter()
    for (_, _, source), size in zip(rows, sizes, strict=True):
        total[source] += size
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes), {}, set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > most * total[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in above:
            target[s] = Fraction(most * total[s])
            budget -= target[s]
        open_ -= above
    out = []
    for (doc_id, text, source), size in zip(rows, sizes, strict=True):
        rate = target[source] / total[source] if total[source] else Fraction(0)
        key = f"mix-1:{'' if doc_id is None else doc_id}:{text or ''}"
        draw = Fraction(int(hashlib.md5(key.encode()).hexdigest()[:13], 16), 1 << 52)
        out.append((doc_id, size, total[source], float(target[source]), int(rate) + (draw < rate - int(rate))))
    return out


DDL = "doc_id long, text string, source string, size string, target string, capped string, copies int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "s", "t", "c", 7) for r in rows], DDL)


def test_mix_equals_plain_resharing(spark):
    rng = random.Random(5)
    for sources in (["a", "b", "c"], ["z", "é", "日", None, "B", "", "😀"], [None]):
        # the first source holds over a third of all words
        rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice([sources[0], rng.choice(sources)])) for k in range(200)]
        rows += [(None, None, sources[-1]), (None, "x y", sources[0]), (None, "x y", sources[0]), (7, "long " * 20_000, sources[0]), (7, "", sources[0])]
        got = [tuple(r) for r in mixing.assigned(made(spark, rows)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


def test_mixed_documents_are_whole_rows_as_often_as_assigned(spark):
    rows = [(k, f"{'word ' * (k % 9)}{k}", "ab"[k % 7 == 0]) for k in range(150)]
    docs = made(spark, rows)
    want = Counter({r[0]: r[4] for r in expected(rows)})
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert Counter(r.doc_id for r in found) == +want
    assert all((r.size, r.target, r.capped, r["copies"]) == ("s", "t", "c", 7) and r.text == rows[r.doc_id][1] for r in found)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == sorted(map(tuple, found))


def test_taken_words_come_near_targets_and_stop_at_twice_the_size(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 9)), f"s{min(int(rng.expovariate(0.4)), 6)}") for k in range(6000)]
    by_source = {}
    for r, source in zip(sorted(mixing.report(made(spark, rows)).collect(), key=lambda r: r.doc_id), [s for _, _, s in rows], strict=True):
        assert r.taken <= 2 * r["size"]
        target, taken = by_source.get(source, (0, 0))
        by_source[source] = (r.target, taken + r.taken)
    assert all(abs(taken - target) <= 0.1 * target for target, taken in by_source.values()), by_source


def test_edges(spark):
    assert mixing.assigned(made(spark, [])).collect() == [] and mixing.mixed(made(spark, [])).collect() == []
    rows = [(1, None, None), (2, "", "a"), (3, " \n", None)]
    assert sorted(tuple(r) for r in mixing.assigned(made(spark, rows)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]


def test_sources_beyond_the_broadcast_bound_are_joined_the_same(spark, monkeypatch):
    rows = [(k, "a b c"[: k % 6], f"s{k % 5}") for k in range(60)]
    want = sorted(map(str, expected(rows)))
    monkeypatch.setattr(mixing.workspace, "BROADCAST_BYTES", 0)
    assert sorted(str(tuple(r)) for r in mixing.assigned(made(spark, rows)).collect()) == want
