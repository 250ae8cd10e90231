import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from motionframe.llm import spelling
from motionframe.llm.wavelet import WaveletTree


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def vocabulary(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def expected(rows):
    known = vocabulary(rows)
    out, form = {}, {}
    for w, n in known.items():
        around = [v for v in known if near(w, v)]
        best = min(around, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 10 * n else None
        out[w] = (n, len(around), known[best] if form[w] else None)
    ends = {}
    for w in known:
        end = w
        while form[end]:
            end = form[end]
        ends[w] = end
    return sorted((w, form[w] or "", ends[w], *(-1 if x is None else x for x in out[w])) for w in known)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, root string")


def got(spark, rows, **kw):
    found = spelling.variants(made(spark, rows), **kw)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found.collect())


def texts(seed, alphabet, n_words=60, edits=6):
    """Rows in which words of an alphabet and their edits stand, some often and some seldom."""
    rng = random.Random(seed)
    pool = []
    for _ in range(n_words):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12)))
        pool += [word] * rng.choice([1, 3, 30, 300])
        for _ in range(edits):
            k = rng.randrange(len(word) + 1)
            pool += [rng.choice([word[:k] + rng.choice(alphabet) + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k + 1 :]])] * rng.randrange(1, 4)
    rng.shuffle(pool)
    return [(k, " ".join(pool[k::40])) for k in range(40)]


@pytest.mark.parametrize(("large", "alphabet"), [(spelling.LARGE, "abcdéÿ÷Z"), (3, "ab")])
def test_variants_equal_brute_force_also_when_groups_are_divided(spark, large, alphabet):
    rows = texts(len(alphabet), alphabet)
    rows += [(None, rows[0][1]), (None, None), (1, ""), (2, "1234567 ,.- 日本語日本語日本"), rows[3], rows[3], (5, "x" * 30_000 + " " + "x" * 29_999), (6, "x" * 30_000 + " " + "x" * 29_999)]
    want = expected(rows)
    assert got(spark, rows, large=large) == want
    assert sum(1 for w in want if w[1]) > 5


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaaaaa": 2000, "aaaaaaab": 150, "aaaaaabb": 12, "cccccccc": 20, "ccccccccd": 2, "zzzzzzzz": 30, "zzzzzzzy": 30, "zzzzzzzx": 3}
    rows = [(k, w) for w, n in words.items() for k in range(n)]
    want = expected(rows)
    assert got(spark, rows) == want
    by_word = {w[0]: w for w in want}
    assert by_word["aaaaaabb"][1:3] == ("aaaaaaab", "aaaaaaaa")
    if "zzzzzzzx" in by_word and by_word["zzzzzzzx"][1]:
        assert by_word["zzzzzzzx"][1] in ("zzzzzzzy", "zzzzzzzz")


def test_no_words(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "short words only"), (3, "singular")]) == []


def test_tree_reports_what_rectangles_hold():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        low, least = rng.integers(0, n + 1, (2, 200))
        high, beyond = low + rng.integers(0, n, 200) % (n + 1 - low), least + rng.integers(0, n, 200)
        which, value = tree.report(low, high, least, beyond)
        want = sorted((k, int(v)) for k in range(200) for v in values[low[k] : high[k]] if least[k] <= v < beyond[k])
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == want
