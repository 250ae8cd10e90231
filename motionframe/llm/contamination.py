"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' normalised words.  Training words are mapped to the items' vocabulary in
bulk; only runs of known words that are at least as long as the shortest window can hold a match, and only those
are streamed through the automaton, which tracks the longest suffix that occurs in some item.  A position whose
match length reaches the window length ends an occurrence of a window.

Edge cases: null texts have no words; an item without words has no window; repeated items and rows are treated
row by row; tables without rows give no hits; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm import wordhash, workspace

WINDOW = 10

#: Words of items put in one automaton.  A larger benchmark is worked off in several passes over the documents.
BLOCK_WORDS = 2_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences, with the items in which a state's strings end."""

    def __init__(self) -> None:
        self.length = [0]
        self.link = [-1]
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[set[int]] = [set()]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, parent: int, symbol: int, child: int) -> int:
        twin = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = twin
            parent = self.link[parent]
        return twin

    def add(self, sequence: list[int], item: int) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.ends[last].add(item)

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        made, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = made
            at = self.link[at]
        if at >= 0:
            child = self.next[at][symbol]
            self.link[made] = child if self.length[child] == self.length[at] + 1 else self._split(at, symbol, child)
        return made

    def finish(self) -> None:
        """Hand every state's items on to its suffixes, longest strings first."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        follow = self.next[state].get(symbol)
        return (0, 0) if follow is None else (follow, matched + 1)

    def ending_here(self, state: int, matched: int, length: int) -> int:
        """The state of the last ``length`` symbols of a match of ``matched`` symbols."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Items:
    """One block of test items, ready to be sent to the tasks."""

    def __init__(self, rows: list[tuple[str, str]], window: int) -> None:
        texts = pa.array([text for _, text in rows], pa.string())
        buf, offsets = wordhash.byte_column(texts)
        words = wordhash.split_words(buf, offsets, wordhash.ALNUM_WORDS)
        hashes = wordhash.hash_words(words, lower=True)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        self.ids = [item for item, _ in rows]
        self.window = window
        self.automaton = SuffixAutomaton()
        short: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for item in range(len(rows)):
            sequence = symbols[words.bounds[item] : words.bounds[item + 1]].tolist()
            if len(sequence) >= window:
                self.automaton.add(sequence, item)
            elif sequence:
                self.automaton.add(sequence, -1 - item)
                short.setdefault(len(sequence), []).append((tuple(sequence), item))
        self.automaton.finish()
        self.short: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for length, entries in short.items():
            for sequence, item in entries:
                self.short.setdefault(length, {}).setdefault(sequence, set()).add(item)
        self.lengths = sorted({window, *self.short} if any(e >= 0 for s in self.automaton.ends for e in s) else set(self.short))

    def scan(self, symbols: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans covered by windows, and the items whose windows occur, in one run of known words."""
        automaton, window, spans, found = self.automaton, self.window, [], set()
        state = matched = 0
        for at, symbol in enumerate(symbols):
            state, matched = automaton.step(state, matched, symbol)
            if matched >= window:
                items = [e for e in automaton.ends[automaton.ending_here(state, matched, window)] if e >= 0]
                if items:
                    spans.append((at - window + 1, at + 1))
                    found.update(items)
            for length, known in self.short.items():
                if matched >= length and (items := known.get(tuple(symbols[at - length + 1 : at + 1]))):
                    spans.append((at - length + 1, at + 1))
                    found.update(items)
        return spans, found


def _runs(known: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Runs of known words inside one document that are at least ``least`` long."""
    if not len(known):
        return
    breaks = np.zeros(len(known) + 1, dtype=bool)
    breaks[0] = breaks[-1] = True
    breaks[bounds] = True
    breaks[1:-1] |= known[1:] != known[:-1]
    edges = np.flatnonzero(breaks)
    lengths = np.diff(edges)
    for k in np.flatnonzero((lengths >= least) & known[edges[:-1]]):
        yield int(edges[k]), int(edges[k + 1])


def find_spans(items: Items, words: wordhash.Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
    """By document of ``words``: merged spans of hit words (counted from the document's first) and items."""
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[int]] = {}
    if not items.lengths or not len(words.starts):
        return spans, found
    hashes = wordhash.hash_words(words, lower=True)
    place = np.searchsorted(items.vocabulary, hashes)
    place[place == len(items.vocabulary)] = 0
    known = items.vocabulary[place] == hashes
    for start, end in _runs(known, words.bounds, items.lengths[0]):
        hits, which = items.scan(place[start:end].tolist())
        if not hits:
            continue
        doc = int(np.searchsorted(words.bounds, start, "right")) - 1
        shift = start - int(words.bounds[doc])
        spans.setdefault(doc, []).extend((a + shift, b + shift) for a, b in hits)
        found.setdefault(doc, set()).update(which)
    return {doc: merged(s) for doc, s in spans.items()}, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of a bounded size; rows stream to the driver and are held for one block only."""
    rows: list[tuple[str, str]] = []
    held = 0
    texts = benchmark.filter("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for row in texts.toLocalIterator():
        rows.append((row.item_id, row.text))
        held += len(row.text) // 2 + 1
        if held >= block_words:
            yield Items(rows, window)
            rows, held = [], 0
    if rows:
        yield Items(rows, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, spans (merged hit word ranges, with the byte range of each) and items to every row of ``docs``.

    The tasks hold one block of the benchmark at a time; between blocks the rows are written to the shared folder.

    ``docs`` needs a string column ``text``; every other column passes through.  Without ``keep_text`` the text
    comes back null, which saves the way back from Python.
    """
    span = "struct<first_word:long,last_word:long,byte_start:long,byte_end:long>"
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(f"array<{span}>").alias("spans"), F.array().cast("array<string>").alias("items"))
    context, shared = docs.sparkSession.sparkContext, None
    for block in item_blocks(benchmark, window, block_words):
        if shared is not None:  # the block before is done with, and its memory given back, before this one is sent
            out = workspace.cut(_scanned(out, shared, True))
            shared.destroy()
        shared = context.broadcast(block)
    return _scanned(out, shared or context.broadcast(Items([], window)), keep_text)


def _scanned(docs: DataFrame, shared, keep_text: bool) -> DataFrame:
    places = {name: docs.columns.index(name) for name in ("text", "n_words", "spans", "items")}
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            buf, offsets = wordhash.byte_column(batch.column(places["text"]))
            for first, stop in wordhash.blocks(offsets):
                part = batch.slice(first, stop - first)
                words = wordhash.split_words(buf[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], wordhash.ALNUM_WORDS)
                spans, found = find_spans(items, words)
                old_spans = part.column(places["spans"])
                old_items = part.column(places["items"])
                if spans:
                    new_spans, new_items = old_spans.to_pylist(), old_items.to_pylist()
                    for doc, hits in spans.items():
                        base, edge = int(words.bounds[doc]), int(words.doc_starts[doc])
                        both = merged([(s["first_word"], s["last_word"] + 1) for s in new_spans[doc]] + hits)
                        new_spans[doc] = [
                            {"first_word": a, "last_word": b - 1, "byte_start": int(words.starts[base + a]) - edge, "byte_end": int(words.ends[base + b - 1]) - edge}
                            for a, b in both
                        ]
                        new_items[doc] = sorted({*new_items[doc], *(items.ids[i] for i in found[doc])})
                    old_spans = pa.array(new_spans, old_spans.type)
                    old_items = pa.array(new_items, old_items.type)
                columns = list(part.columns)
                columns[places["n_words"]] = pa.array(np.diff(words.bounds), pa.int64())
                columns[places["spans"]], columns[places["items"]] = old_spans, old_items
                if not keep_text:
                    columns[places["text"]] = pa.nulls(part.num_rows, part.schema.field(places["text"]).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items, their digest, and whether it is contaminated."""
    found = matches(docs.select("doc_id", "text"), benchmark, window, keep_text=False).drop("text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with every hit span of more than ``max_span`` words cut out.

    A document whose hit words exceed ``max_coverage`` of its words is dropped.  Columns and rows are otherwise
    those of ``docs``, but ``n_chars``, if there, follows a new text; a null text stays null.
    """
    plain = workspace.plainly_named(docs, "text", "n_chars")
    found = matches(plain, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    kept = found.filter(hit <= F.col("n_words") * F.lit(max_coverage))
    raw = F.encode("text", "UTF-8")
    cut_at = F.filter("spans", lambda s: s["last_word"] - s["first_word"] + 1 > max_span)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut_at, lambda s: s["byte_end"]))
    starts = F.concat(F.transform(cut_at, lambda s: s["byte_start"]), F.array(F.octet_length("text").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "UTF-8"))
    text = F.when(F.size(cut_at) == 0, F.col("text")).otherwise(F.array_join(parts, ""))
    new = kept.withColumn("text", text)
    if "n_chars" in plain.columns:
        new = new.withColumn("n_chars", F.when(F.size(cut_at) == 0, F.col("n_chars")).otherwise(F.length("text")))
    return new.select(*plain.columns).toDF(*docs.columns)
