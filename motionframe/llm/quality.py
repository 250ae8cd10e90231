"""Quality rules as weak supervision.

Text statistics are computed once per document.  Rules turn them into votes (1 good, 0 bad, -1 abstain); the
votes of all documents, gathered as pattern counts, train a label model, and a document is kept if its posterior
quality reaches ``least_quality`` and it does not fail the base rules.  That a rule abstains counts by how often it does so for good
and for poor text: good text hardly ever fails to look like prose.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows give repeated
results; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import label_model, wordhash, workspace

LEAST_QUALITY = 0.5
REPEAT_WINDOW = 5

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_digits", "n_closed_lines")

_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(b"#*$%&|<>")] = 1
_IS_UPPER = np.zeros(256, dtype=np.int64)
_IS_UPPER[0x41:0x5B] = 1
_IS_LETTER = _IS_UPPER.copy()
_IS_LETTER[0x61:0x7B] = 1
_IS_SHOUT = np.zeros(256, dtype=np.int64)
_IS_SHOUT[ord("!")] = 1
_IS_DIGIT = np.zeros(256, dtype=np.int64)
_IS_DIGIT[0x30:0x3A] = 1
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False
_CLOSERS = np.zeros(256, dtype=bool)
_CLOSERS[list(b".!?:;\"')")] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _later_repeats(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][ranked[1:] == ranked[:-1]]] = True
    return later


def text_statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each document of a block of UTF-8 bytes."""
    words = wordhash.split_words(buf, offsets, wordhash.SPACE_SEPARATED)
    hashes = wordhash.hash_words(words, lower=False)
    docs = len(offsets) - 1
    doc_salt = wordhash.mix(np.arange(1, docs + 1, dtype=np.uint64))

    in_word = np.zeros(len(buf) + 1, dtype=np.int64)
    np.add.at(in_word, words.starts, 1)
    np.add.at(in_word, words.ends, -1)
    in_word = np.cumsum(in_word[:-1])
    starts_char = (buf & 0xC0) != 0x80

    at, seen = wordhash.windows_of(hashes, words.bounds, REPEAT_WINDOW)
    owner = np.searchsorted(words.bounds, at, "right") - 1
    again = at[_repeats(seen ^ doc_salt[owner])] if len(at) else at
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    lines = wordhash.split_words(buf, offsets, _NOT_NEWLINE)
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_owner = np.searchsorted(lines.bounds, np.arange(len(lines.starts)), "right") - 1
    line_keys = wordhash.hash_words(lines, lower=False) ^ doc_salt[line_owner] if len(lines.starts) else np.zeros(0, dtype=np.uint64)
    duplicate = _later_repeats(line_keys) & worded
    closed = _CLOSERS[buf[lines.ends - 1]] & worded if len(lines.starts) else worded

    return {
        "n_words": np.diff(words.bounds),
        "word_chars": _per_doc((in_word > 0) & starts_char, offsets),
        "n_symbols": _per_doc(_IS_SYMBOL[buf], offsets),
        "n_dup_lines": _per_doc(duplicate, lines.bounds),
        "n_repeat_words": _per_doc(covered, words.bounds),
        "n_lines": _per_doc(worded, lines.bounds),
        "n_upper": _per_doc(_IS_UPPER[buf], offsets),
        "n_letters": _per_doc(_IS_LETTER[buf], offsets),
        "n_shouts": _per_doc(_IS_SHOUT[buf], offsets),
        "n_digits": _per_doc(_IS_DIGIT[buf], offsets),
        "n_closed_lines": _per_doc(closed, lines.bounds),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the text statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = wordhash.byte_column(batch.column(1))
            for first, stop in wordhash.blocks(offsets):
                found = text_statistics(buf[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), *(pa.array(found[k], pa.int64()) for k in _STATS)], ["doc_id", *_STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in _STATS))


def _when(condition: Column, vote: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), vote).otherwise(-1).cast("int")


def rules() -> dict[str, Column]:
    """Votes from the statistics: a rule says 0 (bad) or 1 (good) where it applies and else abstains with -1."""
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    symbols, shouts, upper, digits = share("n_symbols", "word_chars"), share("n_shouts", "n_words"), share("n_upper", "n_letters"), share("n_digits", "word_chars")
    repeats, dups, closed, length = share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("n_closed_lines", "n_lines"), share("word_chars", "n_words")
    return {
        "short": _when(F.col("n_words") < 10, 0),
        "symbols": _when(symbols > 0.1, 0),
        "shouting": _when(shouts > 0.3, 0),
        "capitals": _when((upper > 0.6) & (F.col("n_letters") >= 20), 0),
        "digits": _when(digits > 0.3, 0),
        "repetition": _when(repeats > 0.2, 0),
        "duplicate_lines": _when(dups > 0.3, 0),
        "odd_words": _when((length < 2.5) | (length > 20), 0),
        "prose": _when((closed > 0.6) & (shouts < 0.1) & (symbols < 0.05), 1),
        "varied": _when((F.col("n_words") >= 30) & (repeats < 0.05) & (dups < 0.05) & (symbols < 0.05) & (upper < 0.5), 1),
    }


def pattern_counts(votes: DataFrame, names: list[str]) -> dict[tuple[int, ...], int]:
    """Rows of each vote pattern: each rule has two outcomes, so at most ``2 ** len(names)`` rows reach the driver."""
    return {tuple(r[k] for k in names): r["n"] for r in votes.groupBy(*names).agg(F.count("*").alias("n")).collect()}


def classify(docs: DataFrame, least_quality: float = LEAST_QUALITY) -> DataFrame:
    """Statistics, base verdict, posterior quality and the final verdict of every document."""
    found = workspace.cut(statistics(docs))
    voted = rules()
    names = list(voted)
    cast = found.select("*", *(v.alias(f"vote_{k}") for k, v in voted.items()))
    votes = [f"vote_{k}" for k in names]
    counts = pattern_counts(cast, votes)
    model = label_model.fit(counts, len(names), silence_counts=True)
    table = found.sparkSession.createDataFrame([(*v, model.posterior(v)) for v in counts], ", ".join(f"{k} int" for k in votes) + ", quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = cast.join(F.broadcast(table), votes)  # a few hundred rows: a rule has two outcomes
    return scored.select("doc_id", *_STATS, failed.alias("base_failed"), (~failed & (F.col("quality") >= least_quality)).alias("kept"), F.round("quality", 6).alias("quality"))


def verdicts(docs: DataFrame) -> DataFrame:
    return classify(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
