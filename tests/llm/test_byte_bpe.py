import hashlib

import numpy as np
import public_tokenizers
import pytest

from motionframe.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(text):
    encoding = byte_bpe.tokenizer(PATH, public_tokenizers.PATTERN)
    ids = np.array(encoding.encode_ordinary(text or ""), dtype="<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [
    (1, "the quick brown fox's tail " * 400),
    (2, None),
    (3, ""),
    (4, "x" * 9000),
    (5, "a b  c\n\n   d\t" * 700),
    (6, "naïve café 東京 123456 " * 300 + "don't we'll " * 100),
    (6, "naïve café 東京 123456 " * 300 + "don't we'll " * 100),
    (6, "another text of the same id " * 200),
    (None, "no id " * 1000),
    (7, " " * 5000 + "end"),
    (8, "short"),
]


@pytest.mark.parametrize("chunk,overlap", [(512, 128), (1000, 200)])
def test_digests_equal_whole_text_encoding(spark, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], "doc_id long, text string, n_tokens string, digest string")
    found = byte_bpe.digests(docs, PATH, chunk_chars=chunk, overlap=overlap).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, ((i, *brute(t)) for i, t in TEXTS)))


def test_encode_round_trip(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for row in byte_bpe.encode(docs, PATH, chunk_chars=512, overlap=128).collect():
        assert row.decoded.decode() in {t or "" for i, t in TEXTS if i == row.doc_id}
        assert len(row.ids) == 4 * row.n_tokens


def test_pieces_are_narrow_and_no_whole_text_is_shuffled(spark, monkeypatch):
    text = ("the quick brown fox's tail " * 400)[:10_400]
    docs = spark.createDataFrame([(1, text, "d"), (1, text, "d")], "doc_id long, text string, digest string")
    pieces = byte_bpe._encoded_pieces(byte_bpe._chunks(docs.limit(1), 896, 128), 896, 128, PATH, public_tokenizers.PATTERN).collect()
    assert len(pieces) > 5 and sum(len(p.ids) for p in pieces) == 2 * brute(text)[0]
    plans = []
    kept = byte_bpe.workspace.cut
    monkeypatch.setattr(byte_bpe.workspace, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    assert byte_bpe.digests(docs, PATH, chunk_chars=512, overlap=128).count() == 2
    # the chunks' shuffle and the pieces' shuffle
    assert plans[0].count("Exchange hashpartitioning") == 2


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
