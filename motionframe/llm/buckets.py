"""Components of points that share buckets, by comparing each bucket with pivots.

The points of a bucket are compared with pivots, never all with all.  A pivot's cell, the points near enough to
it, is one component and needs no pairs inside; a bucket whose points are all of one component is done, the others
lose their pivots and go on.  First every point is compared with one pivot, the one that it shares most buckets
with; then about ``FIRST_PIVOTS`` of each bucket are pivots, and eight times as many each further turn.  Every pair of points of different components that shares a bucket is compared in the end, so no link is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import components, workspace

#: Points up to which a bucket is not divided, and the pivots of a bucket in the first turn.
LEAF, FIRST_PIVOTS = 16, 4
#: The elements of a set, as an array of numbers that may hold repeats, from its ``grams``.
Elements = Callable[[Column], Column]
#: Bits of a sketch, in words of 64; sets of many more elements than bits have sketches that rule nothing out.
SKETCH_WORDS = 16


def open_rows(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` (bucket, node and others) of the buckets whose points are of several components, with component, low and size."""
    if labels is None:
        marked = rows.withColumn("component", F.col("node"))
    else:
        marked = rows.join(workspace.sized(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = marked.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("node").alias("low"), F.count("*").alias("size"))
    return workspace.cut(marked.join(ends.filter("a != b").select("bucket", "low", "size"), "bucket"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int, elements: Elements) -> DataFrame:
    """The pairs (a, b) whose sets share ``percent`` of their union or more; n_a and n_b are the sets' sizes.

    ``sets`` is node, grams; ``elements`` makes their elements where a pair is compared, so that what is stored and joined is smaller.
    """
    left, right = sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect(elements(F.col("of_a")), elements(F.col("of_b")))).cast("long")
    counted = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), shared.alias("shared"))
    return workspace.cut(counted.filter(F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * percent).select("a", "b"))


def sketches(each: DataFrame) -> DataFrame:
    """node, n, s0.. of the distinct shingles ``each`` (node, shingle): their number, and the parity of how many fall on each bit.

    Two sketches differ in no more bits than one set has shingles that the other has not.
    """
    bit = F.expr("shiftleft(1L, CAST(shingle & 63 AS INT))")
    spread = each.select("node", bit.alias("bit"), F.shiftrightunsigned("shingle", 6).bitwiseAND(SKETCH_WORDS - 1).alias("word"))
    words = [F.coalesce(F.expr(f"bit_xor(bit) FILTER (WHERE word = {k}L)"), F.lit(0).cast("long")).alias(f"s{k}") for k in range(SKETCH_WORDS)]
    return spread.groupBy("node").agg(F.count("*").alias("n"), *words)


def _may_link(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """a, b, n_a, n_b of the pairs whose sizes and sketches do not rule a link out: the sets' difference is ``100 - percent`` of ``100 + percent`` of both sizes at most."""
    left, right = (sketched.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in sketched.columns if c != "node")) for side in "ab")
    differ = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SKETCH_WORDS)), F.lit(0))
    near = (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "n_a", "n_b")


def nearest(rows: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int, elements: Elements) -> tuple[DataFrame | None, DataFrame | None]:
    """(what :func:`open_rows` leaves, labels) after every point met the lowest point of its buckets that it shares most of them with."""
    lows = rows.groupBy("bucket").agg(F.min("node").alias("low"))
    votes = rows.join(lows, "bucket").filter("node != low").groupBy("node", "low").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max_by("low", "votes").alias("low"))
    found = linked(_may_link(best.select(F.col("low").alias("a"), F.col("node").alias("b")), sketched, percent), sets, percent, elements)
    labels = None if found.isEmpty() else components.merged(None, found)
    opened = open_rows(rows, labels)
    return (None if opened.isEmpty() else opened), labels


def rare_shingles(each: DataFrame, percent: int) -> DataFrame:
    """bucket, node, n, rest: the rarest shingles of every node, of which two nodes that share ``percent`` of their union share one.

    ``each`` (node, shingle) has every node's distinct shingles.  In the order of their number of nodes, two linked sets share
    a shingle among the first ``n - ceil(percent * n) + 1`` of each; those that only one node has are passed over, and a node
    with more of them than that is linked with nothing.  ``rest`` counts the shingle and the node's shared ones after it: two sets
    share no more than the smaller ``rest`` at the first shingle that they share.
    """
    counts = each.groupBy("shingle").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    sizes = each.groupBy("node").agg(F.count("*").alias("n"))
    shared = each.join(counts, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nodes", "shingle"))).alias("shared"))
    least = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    first = F.size("shared") - least + 1
    kept = shared.join(sizes, "node").filter(first > 0).select("node", "n", F.size("shared").alias("size"), F.posexplode(F.slice("shared", F.lit(1), first)).alias("at", "of"))
    return kept.select(F.col("of.shingle").alias("bucket"), "node", "n", (F.col("size") - F.col("at")).cast("long").alias("rest"))


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, node) of one bucket of each set of nodes, known by a 128-bit hash; buckets of one node are left out."""
    sets = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    one = rows.groupBy("bucket").agg(F.count("*").alias("size"), *sets).filter("size > 1").groupBy("size", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    return rows.join(one.select("bucket"), "bucket", "left_semi")


def resolve(rows: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int, labels: DataFrame | None, elements: Elements) -> DataFrame | None:
    """node, component of the points (bucket, node, n, rest) that link with another; None if no two link."""
    rows = workspace.cut(distinct_buckets(rows))
    for turn in itertools.count():  # ends after about log8(size / FIRST_PIVOTS) turns
        opened = open_rows(rows, labels)
        if opened.isEmpty():
            return labels
        # eight times as many each turn: few while comparisons still join components, and few turns in the end
        by_hash = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("size")) < FIRST_PIVOTS * 8**turn
        is_pivot = by_hash | (F.col("node") == F.col("low"))
        pivots = opened.filter(is_pivot).select("bucket", F.col("node").alias("pivot"), F.col("component").alias("pivot_component"), F.col("n").alias("pivot_n"), F.col("rest").alias("pivot_rest"))
        enough = F.least("rest", "pivot_rest") * (100 + percent) >= (F.col("n") + F.col("pivot_n")) * percent
        each = opened.join(pivots, "bucket").filter((F.col("component") != F.col("pivot_component")) & enough)
        pairs = each.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        found = linked(_may_link(pairs, sketched, percent), sets, percent, elements)
        if not found.isEmpty():
            labels = components.merged(labels, found)
        # a pivot has met all points of its bucket
        rows = opened.filter(~is_pivot).select("bucket", "node", "n", "rest")


def all_pairs(opened: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int, labels: DataFrame | None, elements: Elements) -> DataFrame | None:
    """:func:`resolve` of small buckets (what :func:`open_rows` gives) at once: every two points of different components are compared."""
    small = opened.select("bucket", "node", "component")
    other = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("of_b"))
    pairs = small.join(other, "bucket").filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("of_b"))).select(F.col("node").alias("a"), "b").distinct()
    found = linked(_may_link(pairs, sketched, percent), sets, percent, elements)
    return labels if found.isEmpty() else components.merged(labels, found)
