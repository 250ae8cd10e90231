import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from motionframe.llm import contamination, label_model, license_scan, quality, toxicity, url_graph


def test_url_rules_and_graph(spark):
    link = '<a href="https://{}/x">'
    rows = [
        (1, "https://good.org/a", link.format("near.net")),
        (2, "http://x.example.org/es/1?q", ""),
        (3, "http://example.org/en/12", ""),
        (4, "https://Shop.com/fr/2#t", ""),
        (5, "https://shop.com/de/", ""),
        (6, "https://near.net/p", None),
        (7, "https://bad.net", link.format("shop.com") + link.format("example.org")),
        (8, "https://far.net/", link.format("bad.net")),
        (9, None, None),
        (10, "no scheme", ""),
        (11, "https://notexample.orgx/es/", ""),
        (11, "https://notexample.orgx/es/", ""),
        (12, "https://org?x", ""),
    ]
    pages = spark.createDataFrame([(*r, "k", "v") for r in rows], "page_id long, url string, html string, rule string, kind string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_graph.verdicts(pages).collect())
    assert got == [
        (1, "good.org", "/a", "org/", "allow"),
        (2, "x.example.org", "/es/1", "example.org/es/", "block"),
        (3, "example.org", "/en/12", "example.org/en/1", "block"),
        (4, "shop.com", "/fr/2", "com/fr/", "allow"),
        (5, "shop.com", "/de/", "com/de/", "block"),
        (6, "near.net", "/p", None, "allow"),
        (7, "bad.net", "", None, "block"),
        (8, "far.net", "/", None, "block"),
        (9, "", "", None, "allow"),
        (10, "", "", None, "allow"),
        (11, "notexample.orgx", "/es/", None, "allow"),
        (11, "notexample.orgx", "/es/", None, "allow"),
        (12, "org", "", None, "allow"),
    ]


def test_license_places_and_templates(spark):
    rows = [
        (1, "Released under the MIT  License. mit-license!"),
        (2, "the general, PUBLIC\nlicense"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, None),
        (5, "submit license"),
        (5, "submit license"),
        (6, "  Apache License"),
        (7, "nothing " * 3000),
    ]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 2, 3, 5, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].base_labels) == (1, 1, "gpl")
    assert got[3].base_labels == "" and got[3].labels == "cc-by-nc" and got[3].score == pytest.approx(1, abs=1e-6)
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0)
    assert got[5].n_base == 0 and got[6].first_word == 0 and got[7].n_words == 3000
    assert license_scan.scan(docs.filter("doc_id > 100")).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "ç#", "d|", "日本", "x"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(80)] + [None, "", " \n ", "é" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.verdicts(docs).collect():
        text = texts[r.doc_id] or ""
        words = words_of(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        seen, dups = set(), 0
        for line in text.split("\n"):
            dups += bool(words_of(line)) and line in seen
            seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_label_model_recovers_accuracies():
    rng = random.Random(1)
    patterns = {}
    for _ in range(20_000):
        truth = rng.random() < 0.7
        votes = tuple(-1 if rng.random() < 0.3 else int(truth if rng.random() < a else not truth) for a in (0.95, 0.8, 0.7))
        patterns[votes] = patterns.get(votes, 0) + 1
    model = label_model.fit(patterns, 3)
    assert model.posterior((1, 1, 1)) > 0.9 and model.posterior((0, 0, 0)) < 0.3
    assert model.accuracy(0) > model.accuracy(2)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 16)))) for k in range(12)] + [("n", None)]
    docs = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        item = rng.choice(items)[1] or ""
        docs.append((k, " ".join(words[:5] + item.upper().split() + words[5:])))
    docs += [(200, None), (201, "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, spans string")
    texts = dict(docs)
    for r in contamination.report(frame, bench).collect():
        words, hit, found = (texts[r.doc_id] or "").lower().split(), set(), set()
        for item, text in items:
            parts = (text or "").split()
            width = min(10, len(parts))
            for s in range(len(parts) - width + 1 if width else 0):
                for at in range(len(words) - width + 1):
                    if words[at : at + width] == parts[s : s + width]:
                        hit |= set(range(at, at + width))
                        found.add(item)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    kept = contamination.decontaminate(frame, bench, max_coverage=1.0)
    assert kept.columns == frame.columns
    assert contamination.report(frame.filter("doc_id < 0"), bench).count() == 0


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(6)
    clean = [f"wort{k}" for k in range(300)]
    insults = ["idiot", "scum"]
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        text = [rng.choice(clean) for _ in range(40)]
        if toxic:
            text[3], text[9] = rng.choice(insults), "lostra" + rng.choice("abcdefgh")
        rows.append((k, " ".join(text), toxic))
    docs = spark.createDataFrame([(i, t, True) for i, t, _ in rows] + [(1000, None, True), (1001, "", True)], "doc_id long, text string, is_toxic boolean")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows if i < 400] + [(5, None, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    links = toxicity.fit(docs, labels)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs, links).collect()}
    held = [(got[i], x) for i, _, x in rows if i >= 400]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert not got[1000] and not got[1001]
    kept = toxicity.reject(docs, links)
    assert kept.columns == docs.columns and kept.count() == sum(not v for v in got.values())
    nothing = toxicity.fit(docs, labels.filter(F.lit(False)))
    assert toxicity.score(docs, nothing).filter("is_toxic").count() == 0
