"""Fuzzy line deduplication by MinHash, in DataFrame operations.

A line's character shingles are the ``SHINGLE`` characters from each character on.  One hash a shingle gives
``BINS`` minima: the hash's top bits name the bin, and a bin without a shingle takes the minimum of the nearest bin
that has one, in the order of the exclusive or of their numbers.  So each value is the shingle nearest to one fixed
point, and two lines agree in it with a probability equal to their Jaccard similarity.  Bands of ``ROWS`` values
are bucket keys.  Lines that share a bucket are compared by the exact Jaccard similarity of their whole shingle
sets, until all pairs of different components have met.  Links of ``PERCENT`` or more are joined to components by
distributed union-find, exact repeats being one node from the start, and of each component the line that stands first
in the document of the smallest id is kept.

At a similarity of 0.8 two lines of more than 64 shingles meet in a bucket with probability 0.999; shorter lines, whose
bins are not all of their own, have a second set of bands for that.  Everything after that is exact.  A line is known by
a 128-bit hash of its text.

Edge cases: a null text has no lines and stays null; a line shorter than a shingle is its own one
shingle and so links with equal lines only; lines of blanks are left alone; rows are told apart by doc_id and text, so texts
that share a doc_id, or have none, lose only lines of their own, and rows equal in both keep the same lines; rows
without a doc_id come after all others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import buckets, workspace

SHINGLE = 9
#: A character that is no blank.
WORD = r"[^ \t-\r]"
#: Percent of the union that two linked lines share at least.
PERCENT = 80
#: Bins of the signature, a power of two, values a band, and bands of every line.
BINS, ROWS, BANDS = 64, 4, 12
#: Shingles below which a line has the second set of bands as well.
FEW = 64
#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1
_KEY = ["doc_id", "t1", "t2"]


def _encoded(line: Column) -> Column:
    """Four bytes a character, so that a shingle is cut out without walking through the line."""
    return F.encode(line, "UTF-32")


def _starts(encoded: Column) -> Column:
    """The characters at which the shingles of a line start; a shorter line is its own one shingle."""
    return F.sequence(F.lit(0), F.greatest(F.floor(F.length(encoded) / 4).cast("int") - SHINGLE, F.lit(0)))


def _hash_at(encoded: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(encoded, start * 4 + 1, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """The hashes of every character shingle of a line, with its repeats."""
    encoded = F.array(_encoded(line))
    return F.element_at(F.transform(encoded, lambda e: F.transform(_starts(e), lambda at: _hash_at(e, at))), 1)


def distinct_shingles(texts: DataFrame) -> DataFrame:
    """node, shingle of the lines (node, grams), told apart within the line: an aggregation over all of them costs four times as much."""
    return texts.select("node", F.explode(F.array_distinct(shingles(F.col("grams")))).alias("shingle"))


def lines(docs: DataFrame) -> DataFrame:
    """The keys of ``docs``, line_no, line and its 128-bit hash ``h1``, ``h2`` of the lines that hold a word."""
    split = docs.select(*_KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.filter(F.col("line").rlike(WORD)).select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def bands(bins: int = BINS, rows: int = ROWS) -> tuple[list[list[int]], list[list[int]]]:
    """The positions of the signature that make up each band: of every line, and of short lines besides."""
    step = bins // rows
    return [[i + step * r for r in range(rows)] for i in range(min(step, BANDS))], [[(rows * i + (step + step // 3) * r) % bins for r in range(rows)] for i in range(step)]


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, key (the smallest that has it), repeated, line of every distinct line."""
    place = F.xxhash64(*_KEY, "line_no")
    each = lines(docs).select("h1", "h2", F.struct(*_KEY).alias("key"), place.alias("place"), "line")
    found = each.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.min("place").alias("low"), F.max("place").alias("high"), F.min("line").alias("line"))
    return found.select("h1", "h2", "key", (F.col("low") != F.col("high")).alias("repeated"), "line")


def _filled(bins: int) -> Column:
    """The signature ``m``, its empty bins filled from the nearest bin that is not empty."""

    def fill(value: Column, at: Column) -> Column:
        return F.coalesce(value, *(F.get("m", at.bitwiseXOR(F.lit(q))) for q in range(1, bins)))

    return F.transform("m", fill)


def signatures(docs: DataFrame, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """node (a number of its own), h1, h2, key, repeated, bands of every distinct line.

    The lines lie by their hash already, so the minima over a line's shingles are taken where it is and none is shuffled.
    """
    named = distinct_lines(docs).select("h1", "h2", "key.*", "repeated", _encoded(F.col("line")).alias("encoded"))
    each = named.select("h1", "h2", *_KEY, "repeated", "encoded", F.explode(_starts(F.col("encoded"))).alias("at"))
    hashed = each.select("h1", "h2", *_KEY, "repeated", _hash_at(F.col("encoded"), F.col("at")).alias("x"))
    binned = hashed.withColumn("bin", F.shiftrightunsigned("x", 64 - (bins.bit_length() - 1)))
    # a filtered minimum costs one comparison where the bin is another
    minima = [F.expr(f"min(x) FILTER (WHERE bin = {k}L)").alias(f"m{k}") for k in range(bins)]
    signed = binned.groupBy("h1", "h2").agg(*(F.min(k).alias(k) for k in _KEY), F.max("repeated").alias("repeated"), F.count("*").alias("n"), *minima)
    some_empty = reduce(or_, (F.col(f"m{k}").isNull() for k in range(bins)))
    kept = ["h1", "h2", *_KEY, "repeated", "n"]
    packed = signed.select(*kept, some_empty.alias("some_empty"), F.array(*(f"m{k}" for k in range(bins))).alias("m"))
    full = packed.select(*kept, F.when(F.col("some_empty"), _filled(bins)).otherwise(F.col("m")).alias("m"))
    every, short = ([F.xxhash64(F.lit(f"{name}{b}"), *(F.get("m", F.lit(k)) for k in at)) for b, at in enumerate(layout)] for name, layout in zip("ab", bands(bins, rows)))
    keys = F.when(F.col("n") < FEW, F.array(*every, *short)).otherwise(F.array(*every))
    return full.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.struct(*_KEY).alias("key"), "repeated", keys.alias("bands"))


def candidates(signed: DataFrame) -> DataFrame:
    """bucket, node of the buckets that hold more than one line."""
    keys = signed.select(F.explode("bands").alias("bucket"), "node")
    shared = workspace.cut(keys.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket"))
    return workspace.cut(keys.join(workspace.sized(shared), "bucket"))


def _texts(docs: DataFrame, signed: DataFrame, rows: DataFrame) -> DataFrame:
    """node, grams (the line) of the nodes in ``rows``."""
    members = workspace.cut(signed.select("node", "h1", "h2").join(rows.select("node").distinct(), "node", "left_semi"))
    # the copies of a line are alike: one of them is enough
    found = lines(docs).select("h1", "h2", "line").join(workspace.sized(members), ["h1", "h2"])
    return workspace.cut(found.groupBy("node").agg(F.min("line").alias("grams")))


def components_of(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """node, component of the lines whose shingles' exact Jaccard similarity joins them; None without any."""
    rows = candidates(signed)
    texts = _texts(docs, signed, rows)
    sketched = workspace.cut(buckets.sketches(distinct_shingles(texts)))
    opened, labels = buckets.nearest(rows, texts, sketched, percent, shingles)
    if opened is None:
        return labels
    # small buckets as they are; those of large ones by the rare shingles that linked lines share
    labels = buckets.all_pairs(opened.filter(F.col("size") <= buckets.LEAF), texts, sketched, percent, labels, shingles)
    large = workspace.cut(opened.filter(F.col("size") > buckets.LEAF).select("node").distinct())
    if large.isEmpty():
        return labels
    rare = buckets.rare_shingles(distinct_shingles(texts.join(large, "node", "left_semi")), percent)
    return buckets.resolve(rare, texts, sketched, percent, labels, shingles)


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The key, removed (line numbers, ascending) and owners (the doc_ids that keep those lines) of texts that lose a line."""
    own = docs.select(*_keys(), "text")
    signed = workspace.cut(signatures(own))
    grouped = components_of(own, signed, percent)
    nodes = signed.select("node", "h1", "h2", "key", "repeated")
    nodes = nodes.withColumn("component", F.lit(None).cast("long")) if grouped is None else nodes.join(grouped, "node", "left")
    nodes = nodes.filter("repeated OR component IS NOT NULL")
    groups = workspace.cut(nodes.select("h1", "h2", F.coalesce("component", "node").alias("component"), "key"))
    owner = groups.groupBy("component").agg(F.min("key").alias("owner"))
    known = workspace.cut(groups.drop("key").join(owner, "component"))
    # a line that very many documents share is one row in ``known`` and a skewed key in this join
    places = lines(own).select(*_KEY, "line_no", "h1", "h2").join(workspace.sized(known), ["h1", "h2"])
    first = places.groupBy(*_KEY, "component", "owner").agg(F.sort_array(F.collect_set("line_no")).alias("at"))
    gone = F.when(F.struct(*_KEY) == F.col("owner"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))
    return (
        first.select(*_KEY, F.col("owner.doc_id").alias("owner"), gone.alias("gone"))
        .filter(F.size("gone") > 0)
        .groupBy(*_KEY)
        .agg(F.sort_array(F.flatten(F.collect_list("gone"))).alias("removed"), F.sort_array(F.collect_set("owner")).alias("owners"))
    )


def _keys() -> list[Column]:
    """The columns ``_KEY`` of a row: its doc_id and 128 bits of its text, never null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed and owners of every row."""
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    lost = repeated_lines(docs).select(*(F.col(c).alias(f"_{c}") for c in (*_KEY, "removed", "owners")))
    # the texts stay where they are: only their keys are joined
    own = docs.select("doc_id", n_lines.alias("n_lines"), *(k.alias(f"own_{n}") for k, n in zip(_keys(), _KEY)))
    both = own.join(lost, [F.col(f"own_{k}") == F.col(f"_{k}") for k in _KEY], "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("_owners", F.array().cast("array<bigint>")).alias("owners"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated lines; a document that is left without any word is dropped, others keep their columns.

    ``n_chars``, if there, follows the new text.
    """
    plain = workspace.plainly_named(docs, "doc_id", "text", "n_chars")
    lost = workspace.cut(repeated_lines(plain).select(*(F.col(c).alias(f"lost_{c}") for c in (*_KEY, "removed"))))
    both = plain.join(lost, [own == F.col(f"lost_{k}") for own, k in zip(_keys(), _KEY)], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, at: ~F.array_contains("lost_removed", at)), "\n")
    new = both.withColumn("text", F.when(F.col("lost_removed").isNull(), F.col("text")).otherwise(kept)).filter("lost_removed IS NULL OR text RLIKE '[^ \\t-\\r]'")
    if "n_chars" in plain.columns:
        new = new.withColumn("n_chars", F.when(F.col("lost_removed").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return new.select(*plain.columns).toDF(*docs.columns)
