"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow string column.

Words are found on bytes, which is exact because every separator set used here is ASCII and no UTF-8
continuation byte is ASCII.  Word identity is a 64-bit hash: a polynomial over the bytes modulo 2**64 followed
by a mixing step.  Nothing here knows about Spark; Spark decides which batch arrives where.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = tuple(np.uint64(k) for k in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))

#: Fixed separator sets of the contracts.
SPACE_SEPARATED = np.ones(256, dtype=bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Bytes hashed at once; bounds the scratch arrays to about 100 MB whatever the batch size.
BLOCK_BYTES = 1 << 20


class Words(NamedTuple):
    """Words of consecutive documents; document i owns words ``bounds[i]:bounds[i + 1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    doc_starts: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Word places of the documents whose bytes lie between consecutive ``offsets`` of ``buf``."""
    inside = is_word[buf]
    before = np.zeros(len(buf), dtype=bool)
    after = np.zeros(len(buf), dtype=bool)
    if len(buf):
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[:-1]
        before[edges[edges < len(buf)]] = False
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets), offsets)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        made = []
        for base in (_R, _R_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def hash_words(words: Words, lower: bool) -> np.ndarray:
    """A 64-bit hash for each word, equal for equal bytes (after A-Z to a-z with ``lower``)."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    raw = _LOWER[words.buf] if lower else words.buf
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return mix((sums[words.ends] - sums[words.starts]) * inverse[words.starts])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words (of the concatenation; callers mask document edges)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n] * _K[0]
    for k in range(1, width):
        # the running mix makes every position count differently, for any width
        total = mix(total + np.uint64(k)) + hashes[k : k + n] * _K[k % len(_K)]
    return mix(total)


def windows_of(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows that lie inside one document."""
    all_windows = windows(hashes, width)
    whole = np.ones(len(all_windows), dtype=bool)
    for back in range(1, width):
        crossing = bounds[1:-1] - back
        crossing = crossing[(crossing >= 0) & (crossing < len(whole))]
        whole[crossing] = False
    at = np.flatnonzero(whole)
    return at, all_windows[at]
