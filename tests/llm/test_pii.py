import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from motionframe.llm import pii

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}", kind))
    found.sort()
    spans = [f[2] for f in found]
    return tuple(sum(f[3] == k for f in found) for k, _ in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


PIECES = ["a@b.c", "x.y@d-e.f.g", ".@a..b", "@", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111111", "4111  1111", "1-2", "+1 (614) 555-6727", "+12", "+4", " ", ".", "-", "é", "日本", "7", "\n", "+", "(", "a_b%c@x.y.", "12345678901234567890", "user@host", "a@b.c@d.e", "a@b.c_x@d.e", "Mr John Smith", "078-05-1120", "call (212) 555-0187"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    made += [None, "", "a" * 50_000, "1" * 50_000, "1 " * 20_000, "a@" + "b." * 20_000 + "c", "+" + "1-" * 20_000 + "1", ("x@y.z " * 500)]
    return list(enumerate(made)) + [(3, made[3]), (3, "other a@b.c text"), (None, "1.2.3.4")]


def test_base_spans_equal_contract_patterns(spark, texts):
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, kind string")
    rows = pii.report(docs).collect()
    want = sorted(str((i, *brute(t)[0], brute(t)[1])) for i, t in texts)
    assert sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in rows) == want
    by_id = {i: t for i, t in texts if i not in (3, None)}
    for r in rows:
        if r.doc_id in by_id:
            assert set(brute(by_id[r.doc_id])[2]) <= set(filter(None, r.spans.split(",")))


def test_method_adds_spans_and_leaves_clean_text_alone(spark):
    docs = spark.createDataFrame([(1, "please call (212) 555-0187 today"), (2, "SSN: 078-05-1120 is on file"), (3, "part 900-00-0000 of order"), (4, "Nothing to see here, version 3.1"), (5, "my name is Mary Jones")] + [(i, "mail a@b.com") for i in range(10, 30)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[1] == "local_phone:12:26" and spans[2] == "ssn:5:16" and spans[3] == "" and spans[4] == ""
    assert spans[5] == "name:11:21"


def test_keys_and_tokens_are_spans_and_long_words_are_not(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'the token = "{key}" ok'), (2, "a-very-long-word-of-many-small-words-without-number"), (3, "1" * 40), (4, "x" * 60_000 + "1")]
    docs = spark.createDataFrame(rows + [(10 + k, f"token: {key[k:]}{key[:k]}") for k in range(20)] + [(40 + k, "mail a@b.com") for k in range(20)], "doc_id long, text string")
    found = {r.doc_id: (r.spans, r.n_spans) for r in pii.report(docs).collect()}
    assert found[1] == ("secret:13:53", 1) and found[2] == ("", 0) and found[3] == ("", 0)


def test_names_are_proposed_in_texts_without_a_title(spark):
    rows = [(1, "signed James Smith, at the end"), (2, "it was Mary Jones who came"), (3, "we went to New Place today")]
    docs = spark.createDataFrame(rows + [(40 + k, "mail a@b.com") for k in range(20)], "doc_id long, text string")
    proposed = {(r.doc_id, r.match) for r in pii.candidates(pii._texts(docs)).filter("kind = 'name'").collect()}
    assert proposed == {(1, "James Smith"), (2, "Mary Jones"), (3, "New Place")}
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert found[1] == "name:7:18" and found[2] == "name:7:17"


@pytest.mark.parametrize("kind", pii.WEAK, ids=lambda k: k.name)
def test_no_match_of_an_added_kind_fails_the_cheap_test(spark, kind):
    rng = random.Random(5)
    pieces = [*PIECES, "Ann Lee", "McAnn Lee", "Éva Kis", "555-0187", "555 123-4567", "a1" * 16, "-" * 31 + "1", "_"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) for _ in range(1500)]
    texts = spark.createDataFrame([(t,) for t in made], "text string")
    matched = texts.filter(F.size(F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))) > 0)
    assert matched.count() > 0 and matched.filter(~F.col("text").rlike(kind.test)).count() == 0


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
