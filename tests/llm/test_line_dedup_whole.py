import random

from motionframe.llm import line_dedup


def grams(line):
    return {line[i : i + 9] for i in range(max(len(line) - 8, 1))}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def removed(spark, rows):
    frame = spark.createDataFrame([(i, t, "h", len(t or "")) for i, t in rows], "doc_id long, text string, h string, n_chars long")
    return sorted((r.doc_id is None, r.doc_id or 0, r.removed) for r in line_dedup.report(frame).collect() if r.n_removed)


def test_every_shingle_counts(spark):
    near = "considerable quantities notwithstanding " + "it is a so we " + "understanding professional circumstances responsibility acknowledged"
    changed = near.replace("so we", "so ye")
    assert similarity(near, changed) >= 0.8
    apart = ["id 000000012345 qty 000000000017", "id 000000012999 qty 000000000450"]
    assert similarity(*apart) < 0.8
    assert removed(spark, [(1, near), (2, changed), (3, apart[0]), (4, apart[1])]) == [(False, 2, [0])]


def test_lines_of_any_length(spark):
    rows = [(1, "Subscribe now\n短い文です。\n \n"), (2, "own words\nSubscribe now\n \n"), (3, "短い文です。\nSubscribe now!\nok"), (4, "ok\nok")]
    # five of the six shingles of "Subscribe now!" are those of the line without the mark
    assert removed(spark, rows) == [(False, 2, [1]), (False, 3, [0, 1]), (False, 4, [0, 1])]


def test_bands_of_production_meet_pairs_at_the_threshold(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    while len(pairs) < 3000:
        line = "".join(rng.choice(letters) for _ in range(120))
        near = line[: rng.randrange(96, 108)] + "".join(rng.choice(letters) for _ in range(rng.randrange(16)))
        if 0.8 <= similarity(line, near) < 0.81:
            pairs.append((line, near))
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    bands = {r.key.doc_id: set(r.bands) for r in line_dedup.signatures(line_dedup_input(spark, rows)).collect()}
    missed = sum(not bands[2 * k] & bands[2 * k + 1] for k in range(len(pairs)))
    assert missed <= 20  # 8 expected of 3,000


def line_dedup_input(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select(*line_dedup._keys(), "text")


def test_short_lines_at_the_threshold_meet(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    while len(pairs) < 1000:
        line = "".join(rng.choice(letters) for _ in range(rng.randrange(32, 72)))
        near = line[: len(line) - rng.randrange(1, 9)] + "".join(rng.choice(letters) for _ in range(rng.randrange(3)))
        if 0.8 <= similarity(line, near) < 0.84:
            pairs.append((line, near))
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    bands = {r.key.doc_id: set(r.bands) for r in line_dedup.signatures(line_dedup_input(spark, rows)).collect()}
    assert sum(not bands[2 * k] & bands[2 * k + 1] for k in range(len(pairs))) <= 10


def test_lines_about_one_more_space_or_of_equal_word_beginnings(spark):
    rng = random.Random(10)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(14)) for _ in range(11))[:160]
    ends = [" ".join(f"{w}{side * 4}" for w in ("beginning", "another11", "different", "something", "wholehome", "eleventhx", "ninechars", "ninelette", "worksheet", "yesterday")) for side in "xy"]
    assert removed(spark, [(1, line), (2, line + "x"), (3, ends[0]), (4, ends[1])]) == [(False, 2, [0])]
