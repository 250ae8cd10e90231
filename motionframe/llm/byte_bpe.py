"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to ``chunk_chars`` are one chunk and are encoded where they are read.  A longer text is cut into
chunks that overlap by ``overlap`` characters; the chunks are dealt over the cluster and pre-tokenised in
parallel.  A chunk starts at an arbitrary place, so its first pre-tokens may be wrong, but the pattern looks only
forward: once the pre-tokens of two neighbours have a boundary in common inside their overlap, both go on alike.
There they are stitched, and the pieces between stitches are encoded independently.  Decoding concatenates the
raw bytes of the ids.

Where some overlap of a text has no common boundary (a long run of letters, say), the text is cut again with chunks and overlaps
``WIDER`` times as long, until it is one chunk: a single pre-token cannot be divided.

Edge cases: a null text counts as empty; an empty text has no ids; repeated rows give repeated results; null
doc_ids are kept; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import workspace

#: A text is cut only if encoding it in one call would hold up its task for a noticeable time.
CHUNK_CHARS = 16_384
OVERLAP = 1_024
WIDER = 8

#: Characters before a text's end in which a boundary could still move: the longest literal of the pattern is 3.
_UNSURE = 3

_CHUNK = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("chunk", pa.string())])
_PIECE = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("no", pa.int64()), ("ids", pa.binary())])
_WHOLE = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"


@functools.cache
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _packed(encoding: tiktoken.Encoding) -> str:
    """The narrowest type that holds every id; pieces are shuffled in it."""
    return "<u2" if encoding.max_token_value < 1 << 16 else "<u4"


def _encode(encoding: tiktoken.Encoding, text: str) -> tuple[int, bytes, bytes]:
    ids = encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    return len(ids), ids.tobytes(), encoding.decode_bytes(ids.tolist())


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _short_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary, pattern)
        for batch in batches:
            made = [_encode(encoding, text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m[0] for m in made], pa.int64()),
                    pa.array([_digest(m[1]) for m in made], pa.string()),
                    pa.array([_digest(m[2]) for m in made], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _short_encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [_encode(encoding, text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([m[k] for m in made], kind) for k, kind in ((0, pa.int64()), (1, pa.binary()), (2, pa.binary())))],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.mapInArrow(run, ENCODED)


def _chunks(long_docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """One row for each chunk: chunk ``no`` covers [no * step, (no + 1) * step + overlap) of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                count = -(-len(text) // step)
                for no in range(count):
                    made = {"doc_id": row["doc_id"], "digest": row["digest"], "no": no, "last": no == count - 1, "chunk": text[no * step : (no + 1) * step + overlap]}
                    yield pa.RecordBatch.from_pylist([made], schema=_CHUNK)

    return long_docs.mapInArrow(run, "doc_id long, digest string, no long, last boolean, chunk string")


def _seam(matcher: regex.Pattern, text: str, overlap: int) -> int | None:
    """The first pre-token boundary in the second half of an overlap, seen from the overlap's start alone."""
    for found in matcher.finditer(text):
        if found.end() >= overlap // 2:
            return found.end() if found.end() <= min(overlap, len(text)) - _UNSURE else None
    return None


def _piece(matcher: regex.Pattern, chunk: str, first: bool, last: bool, step: int, overlap: int) -> str | None:
    """The part of a chunk between its two seams; None unless its own pre-tokens meet the seam at its end.

    Both neighbours find a seam from the overlap's text alone, so they agree on it.  Its left neighbour's
    pre-tokens, from its own seam on, must have a boundary there: then, from the text's start on, every piece
    begins and ends at boundaries of the whole text.
    """
    start = 0 if first else _seam(matcher, chunk[: overlap + _UNSURE], overlap)
    if start is None:
        return None
    if last:
        return chunk[start:]
    end = _seam(matcher, chunk[step : step + overlap + _UNSURE], overlap)
    if end is None or step + end <= start:
        return None
    for found in matcher.finditer(chunk, start):
        if found.end() >= step + end:
            return chunk[start : step + end] if found.end() == step + end else None
    return None


def _encoded_pieces(chunks: DataFrame, step: int, overlap: int, vocabulary: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, matcher = tokenizer(vocabulary, pattern), regex.compile(pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                piece = _piece(matcher, row["chunk"], row["no"] == 0, row["last"], step, overlap)
                ids = None if piece is None else encoding.encode_to_numpy(piece, disallowed_special=()).astype(_packed(encoding)).tobytes()
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "digest": row["digest"], "no": row["no"], "ids": ids}], schema=_PIECE)

    return chunks.mapInArrow(run, "doc_id long, digest string, no long, ids binary")


def _joined(pieces: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Each long text's ids, put together from its pieces and decoded again; null where a seam did not meet."""
    in_order = pieces.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary, pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                parts = [p["ids"] for p in row["pieces"]]
                made = {"doc_id": row["doc_id"], "digest": row["digest"], "n_tokens": None, "ids": None, "decoded": None}
                if None not in parts:
                    ids = np.frombuffer(b"".join(parts), dtype=_packed(encoding)).astype("<u4")
                    made |= {"n_tokens": len(ids), "ids": ids.tobytes(), "decoded": encoding.decode_bytes(ids.tolist())}
                yield pa.RecordBatch.from_pylist([made], schema=_WHOLE)

    return in_order.mapInArrow(run, "doc_id long, digest string, n_tokens long, ids binary, decoded binary")


def _long_encoded(long_docs: DataFrame, vocabulary: str, pattern: str, chunk_chars: int, overlap: int, kept: list[Column]) -> DataFrame:
    """doc_id and ``kept`` (columns over n_tokens, ids and decoded) of texts of more than ``chunk_chars``."""
    marked = long_docs.withColumn("digest", F.sha2("text", 256))
    step = chunk_chars - overlap
    # the chunks are dealt over the cluster, so one huge text is not one task; there the chunks of repeated rows meet, so texts are not
    # shuffled whole to find these
    place = ["doc_id", "digest", "no"]
    chunks = _chunks(marked, step, overlap).repartition(*place).dropDuplicates(place)
    whole = workspace.cut(_joined(_encoded_pieces(chunks, step, overlap, vocabulary, pattern), vocabulary, pattern).select("doc_id", "digest", "n_tokens", *kept))
    met = whole.filter("n_tokens IS NOT NULL")
    apart = workspace.sized(whole.filter("n_tokens IS NULL").select("doc_id", "digest"), "digest")
    same = lambda other: [F.col(f"d.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in ("doc_id", "digest")]
    names = met.columns[3:]
    good = marked.select("doc_id", "digest").alias("d").join(met.alias("w"), same("w")).select("d.doc_id", "n_tokens", *names)
    if apart.isEmpty():
        return good
    rest = marked.alias("d").join(apart.alias("a"), same("a"), "left_semi").select("doc_id", "text")
    short, longer = _split_by_length(rest, chunk_chars * WIDER)
    again = _long_encoded(longer, vocabulary, pattern, chunk_chars * WIDER, overlap * WIDER, kept)
    return good.unionByName(_short_encoded(short, vocabulary, pattern).select("doc_id", "n_tokens", *kept)).unionByName(again)


def _split_by_length(docs: DataFrame, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.length(F.coalesce("text", F.lit(""))) > chunk_chars
    return texts.filter(~is_long), texts.filter(is_long)


def encode(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the bytes decoded from them, for every row."""
    short, long_docs = _split_by_length(docs, chunk_chars)
    every = [F.col("ids"), F.col("decoded")]
    return _short_encoded(short, vocabulary, pattern).unionByName(_long_encoded(long_docs, vocabulary, pattern, chunk_chars, overlap, every))


def digests(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """As :func:`encode`, but with the SHA-256 of ids and decoded bytes, so that short texts' ids never leave Python."""
    short, long_docs = _split_by_length(docs, chunk_chars)
    sums = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return _short_digests(short, vocabulary, pattern).unionByName(_long_encoded(long_docs, vocabulary, pattern, chunk_chars, overlap, sums))
