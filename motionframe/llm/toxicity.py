"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other.  Each is a logistic regression over the presence of words and
word beginnings, and over the probabilities of the categories before it.  A later link is trained on
out-of-fold probabilities of the earlier ones, so it learns how far to trust them on unseen documents; when
documents are scored, the earlier links' own probabilities are fed in.

The fit uses at most ``FIT_ROWS`` labelled documents of the table, those with the smallest hashed ids, with all their words;
scoring reads every word of every document.

Edge cases: a null or empty text has no features and gets the chain's base rate; rows without a label, or whose
label is null, are not trained on; of repeated labels the largest counts; without rows of both classes a category
is constant (its share of positive rows, 0 without any rows); repeated rows are scored alike; columns besides
``doc_id`` and ``text`` are ignored by :func:`score` and passed on by :func:`reject`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import wordhash, workspace

FIT_ROWS = 4_000
FOLDS = 5
LEAST_DOCS = 3
MAX_FEATURES = 4_000
THRESHOLD = 0.5

#: Lengths in bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
_TABLE_BITS = 20


def categories() -> dict[str, Column]:
    """The chain over the columns of ``labels``: poor text first, then toxic text."""
    return {"low_quality": (1 - F.col("quality")).cast("int"), "toxic": F.col("toxic").cast("int")}


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and word beginning, repeats included."""
    words = wordhash.split_words(buf, offsets, wordhash.ALNUM_WORDS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    found, owners = [wordhash.hash_words(words, lower=True)], [owner]
    for length in BEGINNINGS:
        long_enough = words.ends - words.starts > length
        starts = words.starts[long_enough]
        found.append(wordhash.hash_words(words._replace(starts=starts, ends=starts + length), lower=True) ^ np.uint64(length))
        owners.append(owner[long_enough])
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Link:
    """One category's linear model: sorted feature hashes with weights, a bias, and weights of earlier categories."""

    bias: float
    chain: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self.possible = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.possible[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def score(self, docs: int, owner: np.ndarray, found: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of ``docs`` documents; a feature counts once a document."""
        total = self.bias + earlier @ self.chain
        if len(self.keys):
            maybe = self.possible[(found >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
            owner, found = owner[maybe], found[maybe]
            place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            real = self.keys[place] == found
            pairs = np.unique(owner[real] * np.int64(len(self.keys)) + place[real])
            total += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], docs)
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _chosen(owner: np.ndarray, found: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The features that tell the classes apart best: in enough documents, largest chi-square first."""
    keys, place = np.unique(found, return_inverse=True)
    n, positive = len(label), label.sum()
    seen = np.bincount(place, minlength=len(keys))
    with_label = np.bincount(place, label[owner].astype(float), len(keys))
    expected = seen * positive / n
    chi = (with_label - expected) ** 2 * n / np.maximum(seen * (1 - seen / n) * positive * (1 - positive / n), 1e-9)
    usable = np.flatnonzero((seen >= LEAST_DOCS) & (seen < n) & (chi > 10))
    best = usable[np.lexsort((keys[usable], -chi[usable]))[:MAX_FEATURES]]
    return np.sort(keys[best])


def fit_link(owner: np.ndarray, found: np.ndarray, label: np.ndarray, earlier: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Link:
    """Logistic regression by Adam on the whole sample; ``owner`` and ``found`` hold each pair once."""
    width = earlier.shape[1]
    if not 0 < label.sum() < len(label):
        share = float(label.mean()) if len(label) else 0.0
        return Link(-40.0 if share == 0 else 40.0, np.zeros(width))
    keys = _chosen(owner, found, label)
    place = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
    real = keys[place] == found if len(keys) else np.zeros(len(found), dtype=bool)
    rows, columns = owner[real], place[real]
    share = label.mean()
    weights = np.zeros(len(keys) + width + 1)
    weights[-1] = np.log(share / (1 - share))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        total = weights[-1] + earlier @ weights[len(keys) : -1] + np.bincount(rows, weights[columns], len(label))
        error = (_sigmoid(total) - label) / len(label)
        gradient = np.concatenate([np.bincount(columns, error[rows], len(keys)), earlier.T @ error, [error.sum()]])
        gradient[:-1] += ridge * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    return Link(float(weights[-1]), weights[len(keys) : -1].copy(), keys, weights[: len(keys)].copy())


def fit_chain(owner: np.ndarray, found: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Link]:
    """One link for each column of ``labels``; later links see out-of-fold probabilities of the earlier ones."""
    docs, width = labels.shape
    earlier, links = np.zeros((docs, 0)), []
    for k in range(width):
        links.append(fit_link(owner, found, labels[:, k], earlier))
        if k + 1 == width:
            break
        unseen = np.zeros(docs)
        for part in range(FOLDS):
            held = fold == part
            if not held.any():
                continue
            kept = ~held
            renumber = np.cumsum(kept) - 1
            mine = kept[owner]
            link = fit_link(renumber[owner[mine]], found[mine], labels[kept, k], earlier[kept])
            unseen[held] = link.score(docs, owner, found, earlier)[held]
        earlier = np.column_stack([earlier, unseen])
    return links


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = wordhash.byte_column(batch.column(1))
            for first, stop in wordhash.blocks(offsets):
                owner, found = features(buf[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
                order = np.lexsort((found, owner))
                owner, found = owner[order], found[order]
                new = np.ones(len(found), dtype=bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                owner, found = owner[new], found[new].view(np.int64)
                bounds = np.searchsorted(owner, np.arange(stop - first + 1))
                each = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), each], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<long>")


def fit(docs: DataFrame, labels: DataFrame, chain: dict[str, Column] | None = None, fit_rows: int = FIT_ROWS) -> list[Link]:
    """Fit the chain on at most ``fit_rows`` labelled rows of ``docs``."""
    chain = chain or categories()
    known = labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(f"is_{k}") for k, c in chain.items()))
    names = [f"is_{k}" for k in chain]
    once = known.na.drop(subset=names).groupBy("doc_id").agg(*(F.max(k).alias(k) for k in names))
    # only ids meet here, so that labels of documents that are not in this table do not use up the sample
    here = once.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    sample = workspace.cut(here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    # texts that share an id share its label; the limit holds the rows to the documented bound
    rows = _features_of(texts).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    made = rows.coalesce(1).mapInArrow(lambda batches: _fitted(batches, names), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit_chain(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros((0, len(names))), np.zeros(0, dtype=np.int64))


def _fitted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The chain fitted on the bounded sample (doc_id, features, labels), as one row; it is fitted in a task, not on the driver."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    listed = table.column("features").combine_chunks()
    found = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(table)), np.diff(listed.offsets.to_numpy()))
    wanted = np.column_stack([table.column(k).to_numpy().astype(float) for k in names])
    fold = table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)
    links = fit_chain(owner, found, wanted, (wordhash.mix(fold) % np.uint64(FOLDS)).astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(links)], pa.binary())], ["model"])


def _probabilities(links: list[Link], column: pa.Array) -> np.ndarray:
    buf, offsets = wordhash.byte_column(column)
    parts = []
    for first, stop in wordhash.blocks(offsets):
        owner, found = features(buf[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
        earlier = np.zeros((stop - first, 0))
        for link in links:
            earlier = np.column_stack([earlier, link.score(stop - first, owner, found, earlier)])
        parts.append(earlier)
    return np.concatenate(parts) if parts else np.zeros((0, len(links)))


def score(docs: DataFrame, links: list[Link], names: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category and whether the last one reaches ``threshold``, for every row."""
    names = names or list(categories())
    shared = docs.sparkSession.sparkContext.broadcast(links)  # at most MAX_FEATURES weights a link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.round(p[:, k], 6)) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)],
                ["doc_id", *(f"p_{k}" for k in names), f"is_{names[-1]}"],
            )

    schema = "doc_id long, " + ", ".join(f"p_{k} double" for k in names) + f", is_{names[-1]} boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def reject(docs: DataFrame, links: list[Link], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the last category's probability leaves below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(links)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(shared.value, batch.column(place))[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
