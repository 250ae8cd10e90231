import random

import pytest

from motionframe.llm import line_dedup


def grams(line):
    return {line[i : i + 9] for i in range(max(len(line) - 8, 1))}


def brute(rows, similarity=0.8):
    """removed lines by document; every pair of lines is compared"""
    texts = sorted({line for _, t in rows if t is not None for line in t.split("\n") if line.strip(" \t\n\v\f\r")})
    sets, group = {t: grams(t) for t in texts}, {t: t for t in texts}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    places = {}
    for doc, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if line in group:
                places.setdefault(root(line), set()).add((line_dedup.NO_ID if doc is None else doc, no))
    out = {}
    for at in places.values():
        for doc, no in sorted(at)[1:]:
            out.setdefault(doc, []).append(no)
    return {doc: sorted(at) for doc, at in out.items()}


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    stock = [fresh(rng.randrange(12, 40)) for _ in range(25)]
    rows = []
    for k in range(120):
        made = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(stock)) if rng.random() < 0.5 else fresh(rng.randrange(1, 30))
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(words)
            made.append(" ".join(line))
        rows.append((k, "\n".join(made)))
    joined = "無空白の長い行です" * 6
    return rows + [(200, None), (201, ""), (202, joined), (203, joined + "終"), (204, "short\nshort"), (None, rows[0][1]), (205, rows[3][1]), (205, rows[3][1]), (206, "y" * 400), (207, "z" * 30_000), (208, " \t\n")]


def as_frame(spark, rows):
    return spark.createDataFrame([(i, t, "h", len(t or "")) for i, t in rows], "doc_id long, text string, h string, n_chars long")


@pytest.fixture(autouse=True)
def short_bands(monkeypatch):
    """Bands of two rows miss a pair of similarity 0.8 with probability 1e-10, so that results are those of all pairs."""
    monkeypatch.setattr(line_dedup, "BANDS", 32)
    monkeypatch.setattr(line_dedup.signatures, "__defaults__", (64, 2))


@pytest.mark.parametrize("leaf", [2, 16])
def test_removed_lines_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(line_dedup.buckets, "LEAF", leaf)
    rows = corpus()
    got = {line_dedup.NO_ID if r.doc_id is None else r.doc_id: r.removed for r in line_dedup.report(as_frame(spark, rows)).collect() if r.n_removed}
    assert got == brute(rows)


def test_dedup_keeps_rows_columns_and_one_line_of_each(spark):
    rows = corpus()
    gone = brute(rows)
    want = []
    for doc, text in rows:
        lost = gone.get(line_dedup.NO_ID if doc is None else doc)
        left = text if lost is None else "\n".join(x for no, x in enumerate(text.split("\n")) if no not in lost)
        if lost is None or left.strip():
            want.append(str((doc, left, "h", len(left or ""))))
    assert sorted(str(tuple(r)) for r in line_dedup.dedup(as_frame(spark, rows)).collect()) == sorted(want)


def test_empty_table(spark):
    assert line_dedup.report(as_frame(spark, [])).count() == 0
    assert line_dedup.dedup(as_frame(spark, [])).count() == 0
