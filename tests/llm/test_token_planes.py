import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from motionframe.llm import token_planes

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["don't", "It'S", "we'll", "l'été", "'rest", "\"'s", "'s's", "123", "a1b2", "ÀÉ", "straße", "İstanbul", "日本語", " ", "\n", "\t", "\x85", "\xa0", "...", "!'d", "x", "supercalifragilistic", "<|endoftext|>", "²³", "''", "'m'", "é", "\x00", "ſ"]


def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(400)]


def brute(text):
    return np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_piece_encoder_equals_the_library():
    made = texts()
    whole = Tokenizer.from_file(PATH)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in made]
    assert token_planes.PieceEncoder(PATH).encode(made) == want


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (token_planes.from_planes(token_planes.to_planes(ids, mode), n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_files_round_trip(spark, mode):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(61, None), (62, ""), (62, "twice"), (63, "long text " * 500), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    found = sorted((tuple(r) for r in token_planes.round_trip(docs, PATH, block_ids=64, mode=mode).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "").encode()))
    start, want = 0, []
    for i, t in ordered:
        ids = brute(t or "") + b"\1\0\0\0"
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert found == want


def test_empty_table(spark):
    assert token_planes.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
