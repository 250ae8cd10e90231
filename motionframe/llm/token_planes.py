"""Token-id output as bit-plane-shuffled, zstandard-compressed blocks, and reading it back.

Documents are range-partitioned and sorted by ``doc_id``; every partition is one chunk of the output.  Inside a
chunk the ids form one stream that is cut into blocks of ``block_ids`` ids.  A block is transposed into bit
planes (plane b holds bit b of every id, packed eight to a byte) or byte planes, each compressed on its own with
zstandard; planes of zeros cost a few bytes.  A block row also indexes the documents that it holds, and a chunk
index holds the ids before each chunk, so any document is found without reading other chunks.  The container is
Parquet: the blocks are binary columns, and Spark's commit protocol guards against lost executors.

Edge cases: a null text counts as empty, so the document is its end id alone; null doc_ids come first; rows of one
doc_id follow each other in the order of their texts' UTF-8 bytes; an empty table gives an empty output.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from motionframe.llm import wordhash, workspace

BLOCK_IDS = 65_536
END_ID = 1
LEVEL = 3

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\\t-\\r \\x85\\xa0"
#: Characters whose case mapping and composition do not depend on their neighbours; other texts take the plain way.
_PLAIN = re.compile("[\\x00-įı-ſ]*")
_CODES = 0x180
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_CODES)], dtype=np.uint32)
_GAP, _LETTERS, _DIGIT, _OTHER = range(4)
_CLASS = np.array([next(k for k, of in enumerate((_SPACE, _LETTER, _NUMBER, "\\x00-\U0010ffff")) if re.match(f"[{of}]", chr(c))) for c in range(_CODES)], dtype=np.uint8)
#: The splitting pattern of the vocabulary file; for these characters it is worked out below.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CACHED_PIECES = 400_000
_CHARS_AT_ONCE = 1 << 20


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once per worker while the cache holds it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.whole.model, "end_of_word_suffix", None) or ""
        vocab = self.whole.get_vocab()
        self.ends_piece = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_piece[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.splittable = bool(suffix) and _FILE_PATTERN in str(self.whole.pre_tokenizer).replace("\\\\", "\\")
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache: dict[int, bytes] = {}

    def _learn(self, new: list[tuple[int, str]]) -> None:
        ids = np.array(self.pieces.encode(" ".join([piece for _, piece in new]), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends_piece[ids]) + 1
        if len(cuts) != len(new):  # a piece with several word ends: take these one by one
            self.cache.update((key, np.array(self.pieces.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()) for key, piece in new)
            return
        raw, at = ids.tobytes(), 0
        for (key, _), cut in zip(new, (cuts * 4).tolist(), strict=True):
            self.cache[key] = raw[at:cut]
            at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain, size = [], 0
        for at, text in enumerate(texts):
            if not self.splittable or not _PLAIN.fullmatch(text) or any(s in text for s in self.specials):
                out[at] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            plain.append(at)
            size += len(text)
            if size > _CHARS_AT_ONCE:
                self._encode_plain(texts, plain, out)
                plain, size = [], 0
        if plain:
            self._encode_plain(texts, plain, out)
        return out

    def _encode_plain(self, texts: list[str], which: list[int], out: list[bytes]) -> None:
        """Looks every distinct piece up once and lays the ids out for all its places."""
        codes = _LOWER[np.frombuffer("".join([texts[at] + "\n" for at in which]).encode("utf-32-le"), dtype=np.uint32)]
        starts, ends = _pieces(codes)
        hashes = wordhash.hash_words(wordhash.Words(codes, starts, ends, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)), lower=False)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.cache) + len(distinct) > _CACHED_PIECES:
            self.cache.clear()
        keys = distinct.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.cache]
        if new:
            self._learn([(keys[k], codes[starts[first[k]] : ends[first[k]]].tobytes().decode("utf-32-le")) for k in new])
        known = [self.cache[key] for key in keys]
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        lengths = np.array([len(k) // 4 for k in known], dtype=np.int64)
        offsets = np.cumsum(lengths) - lengths
        count = lengths[place]
        before = np.cumsum(count) - count
        laid = ids[np.repeat(offsets[place] - before, count) + np.arange(count.sum())].tobytes()
        edges = np.cumsum([0, *(len(texts[at]) + 1 for at in which)])
        bounds = (np.append(before, count.sum())[np.searchsorted(starts, edges)] * 4).tolist()
        for k, at in enumerate(which):
            out[at] = laid[bounds[k] : bounds[k + 1]]


def _pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces: runs of letters, single digits, runs of other characters, and contractions."""
    kind = _CLASS[codes]
    change = np.ones(len(kind) + 1, dtype=bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    starts = np.flatnonzero(change[:-1] & (kind != _GAP))
    ends = np.flatnonzero(change[1:] & (kind != _GAP)) + 1
    at = np.flatnonzero((codes == ord("'")) & change[:-1])
    after = np.append(codes, [0, 0]).astype(np.int64)
    one, two = after[at + 1], after[at + 2]
    pairs = one * _CODES + two
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(np.isin(pairs, [ord(a) * _CODES + ord(b) for a, b in ("re", "ve", "ll")]), 3, 0))
    at, length = at[length > 0], length[length > 0]
    if len(at):
        mark = np.searchsorted(starts, at)
        ends[mark] = at + length
        starts[mark + 1] = at + length  # the letters after the apostrophe lose those of the contraction
        left = starts < ends
        starts, ends = starts[left], ends[left]
    return starts, ends


@functools.cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 32 bit planes or 4 byte planes, uncompressed."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, b]).tobytes() for b in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], count: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    packed = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes])
    bits = np.unpackbits(packed, axis=1, bitorder="little", count=count)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


_BLOCK = pa.schema(
    [
        ("chunk", pa.int64()),
        ("block", pa.int64()),
        ("n_ids", pa.int64()),
        ("mode", pa.string()),
        ("planes", pa.list_(pa.binary())),
        ("doc_id", pa.list_(pa.int64())),
        ("doc_row", pa.list_(pa.int64())),
        ("doc_ids_before", pa.list_(pa.int64())),
        ("doc_ids_here", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.bool_())),
    ]
)
_BLOCK_DDL = (
    "chunk long, block long, n_ids long, mode string, planes array<binary>, doc_id array<long>, doc_row array<long>, "
    "doc_ids_before array<long>, doc_ids_here array<long>, doc_ends array<boolean>"
)


def _block_rows(batches: Iterator[pa.RecordBatch], path: str, block_ids: int, mode: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Streams one chunk: holds at most a few blocks of ids at a time."""
    pack, encode = zstandard.ZstdCompressor(level=LEVEL), encoder(path).encode
    chunk, block, row, end = TaskContext.get().partitionId(), 0, 0, np.uint32(end_id).astype("<u4").tobytes()
    pending, docs, written = bytearray(), [], 0

    def flush(size: int) -> pa.RecordBatch:
        nonlocal block, written
        ids = np.frombuffer(bytes(pending[: size * 4]), dtype="<u4")
        del pending[: size * 4]
        here, rest, room = [], [], size
        for doc, at, before, left in docs:
            take = min(left, room)
            room -= take
            if take:
                here.append((doc, at, before, take, take == left))
            if take < left:
                rest.append((doc, at, before + take, left - take))
        docs[:] = rest
        planes = [pack.compress(p) for p in to_planes(ids, mode)]
        made = {"chunk": chunk, "block": block, "n_ids": size, "mode": mode, "planes": planes}
        made |= {name: [h[k] for h in here] for k, name in enumerate(("doc_id", "doc_row", "doc_ids_before", "doc_ids_here", "doc_ends"))}
        block += 1
        return pa.RecordBatch.from_pylist([made], schema=_BLOCK)

    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                pending += ids + end
                docs.append((doc, row, 0, len(ids) // 4 + 1))
                row += 1
            while len(pending) >= block_ids * 4:
                yield flush(block_ids)
    if pending:
        yield flush(len(pending) // 4)


def write(docs: DataFrame, path: str, vocabulary: str, block_ids: int = BLOCK_IDS, mode: str = "byte", end_id: int = END_ID) -> None:
    """Encode every row of ``docs`` (doc_id, text), append ``end_id`` and write blocks and chunk index under ``path``."""
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda it: _block_rows(it, vocabulary, block_ids, mode, end_id), _BLOCK_DDL).write.parquet(f"{path}/blocks")
    # one row a chunk, so the running total is over as many rows as there were partitions
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("chunk").agg(F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_blocks"))
    totals, before = [], 0
    for r in sizes.orderBy("chunk").toLocalIterator():
        totals.append((r.chunk, r.n_ids, r.n_blocks, before, block_ids))
        before += r.n_ids
    spark.createDataFrame(totals, "chunk long, n_ids long, n_blocks long, ids_before long, block_ids long").write.parquet(f"{path}/index")


def read_fragments(spark, path: str) -> DataFrame:
    """doc_id and ids of every document fragment: a document inside one block is one fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["chunk", "block", "doc_id", "doc_row", "ids_before", "n_ids", "first", "ends", "block_at", "ids"]
        for batch in batches:
            for b in batch.to_pylist():
                raw = from_planes([unpack.decompress(p) for p in b["planes"]], b["n_ids"], b["mode"]).tobytes()
                sizes = np.array(b["doc_ids_here"], dtype=np.int64)
                stops = np.cumsum(sizes)
                starts = stops - sizes
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["chunk"]] * n, pa.int64()),
                        pa.array([b["block"]] * n, pa.int64()),
                        pa.array(b["doc_id"], pa.int64()),
                        pa.array(b["doc_row"], pa.int64()),
                        pa.array(b["doc_ids_before"], pa.int64()),
                        pa.array(sizes),
                        pa.array([x == 0 for x in b["doc_ids_before"]], pa.bool_()),
                        pa.array(b["doc_ends"], pa.bool_()),
                        pa.array(starts),
                        pa.array([raw[s * 4 : e * 4] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()),
                    ],
                    names,
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(
        run, "chunk long, block long, doc_id long, doc_row long, ids_before long, n_ids long, first boolean, ends boolean, block_at long, ids binary"
    )


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files at ``path``."""
    index = spark.read.parquet(f"{path}/index").select("chunk", F.col("ids_before").alias("chunk_start"), "block_ids")
    found = read_fragments(spark, path).join(index, "chunk").withColumn("at", F.col("chunk_start") + F.col("block") * F.col("block_ids") + F.col("block_at"))
    whole = found.filter("first AND ends").select("chunk", "doc_id", "at", F.col("n_ids").alias("n_tokens"), "ids")
    parts = found.filter("NOT (first AND ends)")
    in_order = F.sort_array(F.collect_list(F.struct("ids_before", "ids")))
    joined = parts.groupBy("chunk", "doc_row", "doc_id").agg(
        F.min("at").alias("at"), F.sum("n_ids").alias("n_tokens"), F.unhex(F.array_join(F.transform(in_order, lambda p: F.hex(p["ids"])), "")).alias("ids")
    )
    every = whole.unionByName(joined.select("chunk", "doc_id", "at", "n_tokens", "ids"))
    return every.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, vocabulary: str, block_ids: int = BLOCK_IDS, mode: str = "byte") -> DataFrame:
    """Write ``docs`` to a new folder of the shared workspace, read the files back and sum up each document."""
    path = workspace.new_folder(docs.sparkSession, "token-planes")
    write(docs, path, vocabulary, block_ids, mode)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
