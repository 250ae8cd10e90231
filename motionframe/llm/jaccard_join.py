"""Exact Jaccard join of documents on word n-grams, in the metric space of their shingle sets.

Documents with equal sets are one point.  Points that cannot have a neighbour are set aside first: a point that
links with another misses at most the share ``1 - similarity`` of its shingles there, so if more than that many of
its shingles below a hash bound occur in no other point, it is alone.

What is left is screened again by all shingles: one that no other point left has cannot be shared with a linked one.
Two texts far apart are at distance 1 from nearly every pivot, so the outermost division is by the rarest of the shingles:
two linked points share one of the first ``n - ceil(similarity * n) + 1`` in any one order of all shingles.
Inside each region, with ``r`` the radius of the join:

* pivots are chosen, and sizes and sketches bound the distances to them from below; a point that the bound allows within
  ``r`` of a pivot is measured exactly;
* a point within ``r`` of pivots lies in the Voronoi cell of the nearest one, whose points are one component;
* by the triangle inequality all points linked with one in a cell are within ``2 r`` of its pivot: the points beyond ``r``
  whose bound allows ``2 r`` are replicated to the cell, and are compared with those of its points whose distance to the
  pivot is less by at most ``r``, if they are not of its component by then;
* pivots and points in cells leave the region; what is left of it is divided again around new pivots, sixteen times as many each
  turn, until no region holds points of two components.  After the first turn pivots only meet what may link with them;
* in a region of ``LEAF`` points or fewer every two points of different components meet at once.

It is exact at every size, as any order of shingles and any choice of pivots gives all links between components.

Edge cases: a null or empty text has no shingles, its own doc_id as component and no links; with fewer words than
``WIDTH`` the whole sequence is the one shingle; rows without a doc_id get the component of their text, or null;
repeated rows, also of one doc_id with other texts, are judged each by their own text; an empty table gives an
empty result; columns besides ``doc_id`` and ``text`` are ignored by :func:`groups`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import buckets, components, wordhash, workspace

WIDTH = 4
#: Percent of the union that two linked documents share at least.
PERCENT = 85
#: The share of the hash range whose shingles decide whether a point may have a neighbour, over the share that a linked one may miss.
#: At 1 or less nearly every point with one shared shingle may have one.
SCREEN = 4 / 3
#: Points up to which all pairs of a region meet in one turn.
LEAF = 32
#: Bits of a point's sketch, in words of 64, and pivots of a larger region in the first turn and times as many each turn.
SKETCH_WORDS, FIRST_PIVOTS, MORE_PIVOTS = 8, 1, 16

_SKETCH = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.list_(pa.int64()))])


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): the distinct shingles of each document, ascending."""
    words = wordhash.split_words(buf, offsets, wordhash.SPACE_SEPARATED)
    hashes = wordhash.hash_words(words, lower=True)
    at, found = wordhash.windows_of(hashes, words.bounds, width)
    owner = np.searchsorted(words.bounds, at, "right") - 1
    sizes = np.diff(words.bounds)
    for short in range(1, width):
        few = np.flatnonzero(sizes == short)
        if len(few):
            whole = wordhash.windows(hashes, short)
            owner, found = np.concatenate([owner, few]), np.concatenate([found, whole[words.bounds[few]]])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[new], found[new]
    return np.searchsorted(owner, np.arange(len(offsets))), found


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        buf, offsets = wordhash.byte_column(batch.column(1))
        for first, stop in wordhash.blocks(offsets):
            yield batch.slice(first, stop - first), *shingle_sets(buf[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], width)


def _lowest(found: np.ndarray, bounds: np.ndarray, percent: int, bound: np.uint64) -> np.ndarray:
    """Which of each point's ascending shingles are below the bound, or among the first of its prefix."""
    sizes = np.diff(bounds)
    prefix = np.where(sizes > 0, sizes - (sizes * percent + 99) // 100 + 1, 0)
    return (found < bound) | (np.arange(len(found)) - np.repeat(bounds[:-1], sizes) < np.repeat(prefix, sizes))


def sketches(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, screen: float | None = None) -> DataFrame:
    """id (a number of the row), doc_id, t1 and t2 (128 bits of the text), n (shingles), h1 and h2 (a 128-bit sum over the set), low (the shingles below the hash bound, more if the prefix is longer)."""
    screen = (100 - percent) / 100 * SCREEN if screen is None else screen
    bound = np.uint64(min(int(screen * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, found in _blocks(batches, width):
            h1 = wordhash.mix(_sums(wordhash.mix(found), bounds) + np.diff(bounds).astype(np.uint64))
            h2 = wordhash.mix(_sums(wordhash.mix(found ^ np.uint64(0x5BD1E9955BD1E995)), bounds))
            is_low = _lowest(found, bounds, percent, bound)
            edges = np.concatenate([[0], np.cumsum(is_low)])[bounds].astype(np.int32)
            low = pa.ListArray.from_arrays(pa.array(edges), pa.array(found[is_low].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(bounds)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), low], schema=_SKETCH)

    made = _texts(docs).select("doc_id", "text", *_text_hashes()).mapInArrow(run, "doc_id long, t1 long, t2 long, n long, h1 long, h2 long, low array<long>")
    return made.select(F.monotonically_increasing_id().alias("id"), "*")


#: Stands for a null doc_id where texts are looked up.
_NO_ID = (1 << 63) - 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _least_shared(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100)"""
    return F.floor((n * percent + 99) / 100).cast("long")


def _screened(sketched: DataFrame, percent: int) -> DataFrame:
    """h1, h2 of the points that may have a neighbour, as far as the shingles below the hash bound tell."""
    sized = sketched.filter("n > 0").select("id", "h1", "h2", "n", F.size("low").alias("of"))
    # one row of each point; its sizes and hashes stay behind while shingles are counted
    points = workspace.cut(sized.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "n", "of"), "id").alias("at")).select("at.*", "h1", "h2"))
    shingles = sketched.select("id", "low").join(workspace.sized(points.select("id")), "id", "left_semi").select("id", F.explode("low").alias("shingle"))
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("points")).filter("points > 1")
    shared = shingles.join(counts.select("shingle"), "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
    # a linked point has all but n - least of them
    return points.join(shared, "id").filter(F.col("of") - F.col("shared") <= F.col("n") - _least_shared(F.col("n"), percent)).select("h1", "h2")


def _shingle_rows(points: DataFrame, width: int) -> DataFrame:
    """node, n, shingle: every distinct shingle of the points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, found in _blocks(batches, width):
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds).astype(np.int32)), sets], ["node", "n", "shingles"])

    return points.select("node", "text").mapInArrow(run, "node long, n int, shingles array<long>").select("node", "n", F.explode("shingles").alias("shingle"))


def _regions(points: DataFrame, width: int, percent: int) -> DataFrame:
    """bucket (a shingle), node of the points that may have a neighbour: the rarest of their shingles that other points have too."""
    shingles = _shingle_rows(points, width)
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("points")).filter("points > 1")
    order = F.struct("points", "shingle")
    shared = shingles.join(counts, "shingle").groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(order)).alias("shared"))
    # those in no other point come first in the order
    first = F.size("shared") - _least_shared(F.col("n"), percent) + 1
    return shared.filter(first > 0).select("node", F.explode(F.slice("shared", F.lit(1), first.cast("int"))).alias("at")).select(F.col("at.shingle").alias("bucket"), "node")


def _points(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """node, n, text, s0.. (a sketch) of the documents in ``chosen`` (node, h1, h2, doc_id, t1, t2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, found in _blocks(batches, width):
            # a word's bit is set if an odd number of shingles fall on it, so two sketches differ in no more bits than the sets
            at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * (64 * SKETCH_WORDS) + (wordhash.mix(found) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
            bits = np.bincount(at, minlength=(len(bounds) - 1) * 64 * SKETCH_WORDS) & 1
            words = np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), *(pa.array(words[:, k]) for k in range(SKETCH_WORDS))], ["node", "text", "n", *_SKETCHED])

    same = ["doc_id", "t1", "t2"]
    texts = _texts(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", *_text_hashes()).join(workspace.sized(chosen.select("node", *same)), same)
    return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, text string, n long, " + ", ".join(f"{c} long" for c in _SKETCHED))


_SKETCHED = [f"s{k}" for k in range(SKETCH_WORDS)]


def distances(pairs: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """a, b, shared, joined: the exact sizes of the intersection and the union of the pairs' shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for place in (2, 3):
                buf, offsets = wordhash.byte_column(batch.column(place))
                owners, shingles = [], []
                for first, stop in wordhash.blocks(offsets):
                    bounds, found = shingle_sets(buf[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], width)
                    owners.append(np.repeat(np.arange(first, stop), np.diff(bounds)))
                    shingles.append(found)
                sides.append((np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64), np.concatenate(shingles) if shingles else np.zeros(0, dtype=np.uint64)))
            owner, found = (np.concatenate([x, y]) for x, y in zip(*sides, strict=True))
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            twice = (owner[1:] == owner[:-1]) & (found[1:] == found[:-1])
            shared = np.bincount(owner[1:][twice], minlength=len(batch))
            joined = np.bincount(owner, minlength=len(batch)) - shared
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.astype(np.int64)), pa.array(joined.astype(np.int64))], ["a", "b", "shared", "joined"])

    pairs = workspace.cut(pairs.select("a", "b"))
    left, right = (points.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab")
    # few pairs go to the texts, so that only the texts of pairs are shuffled
    right = right.join(workspace.sized(pairs.select("b")), "b", "left_semi")
    return left.join(workspace.sized(pairs), "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, shared long, joined long")


def _differ() -> Column:
    """The fewest shingles that one of two points, named with _a and _b, has and the other has not, by their sketches."""
    return sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _SKETCHED), F.lit(0))


def _near(percent: int) -> Column:
    """Whether the sizes and sketches of two points, named with _a and _b, allow a similarity of ``percent``."""
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (_differ() * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _least_distance() -> Column:
    """The least distance that the sizes and sketches of two points, named with _a and _b, allow."""
    differ = F.greatest(_differ(), F.abs(F.col("n_a") - F.col("n_b")))
    return 2 * differ / (F.col("n_a") + F.col("n_b") + differ)


def _sketch_of(points: DataFrame, side: str, name: str) -> DataFrame:
    """The sketches of ``points`` with their node as ``name``."""
    return points.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *_SKETCHED)))


def _may_be_near(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a similarity of ``percent``."""
    return pairs.join(_sketch_of(points, "a", "a"), "a").join(_sketch_of(points, "b", "b"), "b").filter(_near(percent))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    return labels if links.isEmpty() else components.merged(labels, links)


def _component(labels: DataFrame | None, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of its column ``name`` as ``component_{name}``."""
    made = f"component_{name}"
    if labels is None:
        return df.withColumn(made, F.col(name))
    return df.join(workspace.sized(labels.select(F.col("node").alias(name), F.col("component").alias(made))), name, "left").withColumn(made, F.coalesce(made, name))


#: Turns in which pivots have cells; later ones have many pivots a region, which would each meet all that is within ``2 r`` of them.
CELL_TURNS = 1
#: So often a point meets the pivot that it shares most regions with before the regions are divided.
FIRST_MEETINGS = 1


def _one_pivot_each(opened: DataFrame, turn: int) -> DataFrame:
    """a, b: every point b and the one of its regions' pivots, the points of the least hash, that it shares most regions with."""
    # by component first, so that what is joined already gives one pivot to all its regions
    order = F.struct(F.xxhash64("component", F.lit(-1 - turn)), F.xxhash64("node", F.lit(-1 - turn)), "node")
    pivots = opened.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), order).alias("p"))
    shared = opened.join(pivots, "bucket").filter(F.col("component") != F.col("p.component")).groupBy("node", F.col("p.node").alias("pivot")).agg(F.count("*").alias("regions"))
    return shared.groupBy("node").agg(F.max_by("pivot", F.struct("regions", "pivot")).alias("a")).select("a", F.col("node").alias("b"))


def components_of(rows: DataFrame, points: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame | None:
    """node, component of the points (node, n, text and sketch) that link with another in a region (bucket, node); None if no two link."""
    labels, wide = None, max(2 * percent - 100, 0)
    sizes = points.select("node", "n", *_SKETCHED)
    sizes = workspace.cut(sizes)
    rows = workspace.cut(buckets.distinct_buckets(rows).select("bucket", "node"))
    # a large group of copies is in very many regions; first each point meets one pivot, so that most of the group is one component
    for turn in range(FIRST_MEETINGS):
        opened = buckets.open_rows(rows, labels)
        if opened.isEmpty():
            return labels
        met = _may_be_near(_one_pivot_each(opened, turn), sizes, percent).select("a", "b")
        labels = _merged(labels, workspace.cut(distances(met, points, width)).filter(F.col("shared") * 100 >= F.col("joined") * percent))
    for turn in itertools.count():  # ends, as pivots leave their regions and grow in number
        opened = buckets.open_rows(rows, labels)
        if opened.isEmpty():
            return labels
        # by one hash for all regions, so that regions with the same points choose the same pivots
        hashed = opened.withColumn("hash", F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 33))
        least = hashed.groupBy("bucket").agg(F.min("hash").alias("least"))
        chosen = (F.col("size") <= LEAF) | (F.col("hash") == F.col("least")) | (F.col("hash") * F.col("size") < F.lit(1 << 31) * (FIRST_PIVOTS * MORE_PIVOTS**turn - 1))
        pivots = workspace.cut(hashed.join(least, "bucket").filter(chosen).select("bucket", F.col("node").alias("pivot"), F.col("component").alias("of_pivot"), (F.col("size") > LEAF).alias("large")))
        # the sketches go along, so that pairs that they rule out are never made
        large = pivots.filter("large").drop("large")
        some_large = not large.isEmpty()
        with_cells = turn < CELL_TURNS and some_large
        of_pivots, of_points = pivots.join(_sketch_of(sizes, "a", "pivot"), "pivot"), opened.select("bucket", "node", "component").join(_sketch_of(sizes, "b", "node"), "node")
        apart = F.col("component") != F.col("of_pivot")
        other = F.when(F.col("large"), (F.col("node") != F.col("pivot")) if with_cells else apart).otherwise(apart & (F.col("pivot") < F.col("node")))
        meet = of_points.join(of_pivots, "bucket").filter(other & _near(percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        inner = F.col("shared") * 100 >= F.col("joined") * percent
        close = workspace.cut(distances(meet, points, width).filter(inner))
        labels = _merged(labels, close)
        if not some_large:
            return labels
        # pivots have met all that they can link with in their region
        gone = pivots.select("bucket", F.col("pivot").alias("node"))
        if with_cells:
            of_pivots = of_pivots.filter("large").drop("large")
            # the nearest pivot's cell; ties go to the smaller pivot
            far = (F.col("joined") - F.col("shared")) / F.col("joined")
            cells = workspace.cut(close.join(large.select(F.col("pivot").alias("a")).distinct(), "a", "left_semi").groupBy("b").agg(F.min(F.struct(far.alias("d"), "a")).alias("at")).select(F.col("b").alias("x"), F.col("at.a").alias("pivot"), F.col("at.d").alias("d_x")))
            # what is of the pivot's component by now needs no comparison with its cell
            around = _component(labels, of_pivots.join(cells.select("pivot").distinct(), "pivot", "left_semi").drop("of_pivot"), "pivot")
            outside = _component(labels, of_points.drop("component"), "node").join(around, "bucket").filter((F.col("component_node") != F.col("component_pivot")) & _near(wide))
            edge = outside.select("pivot", F.col("node").alias("y"), _least_distance().alias("d_y")).distinct().join(_sketch_of(sizes, "b", "y"), "y")
            # the slack is for rounding: a pair too many is measured exactly all the same
            window = F.col("d_y") - F.col("d_x") <= (100 - percent) / 100 + 1e-9
            across = cells.join(_sketch_of(sizes, "a", "x"), "x").join(edge, "pivot").filter(window & _near(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            labels = _merged(labels, workspace.cut(distances(across, points, width).filter(inner)))
            # and so have the points in the cell of a pivot of their region
            gone = gone.unionByName(large.drop("of_pivot").join(close.select(F.col("a").alias("pivot"), F.col("b").alias("node")).join(cells.select(F.col("x").alias("node"), "pivot"), ["node", "pivot"]), "pivot").select("bucket", "node"))
        rows = workspace.cut(opened.select("bucket", "node").join(gone, ["bucket", "node"], "left_anti"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that represent their group, with all their columns: those whose doc_id is its component.

    Rows without shingles or without a doc_id stay; rows equal in doc_id and text go or stay together.
    """
    plain = workspace.plainly_named(docs, "doc_id", "text")
    copies = _labelled(plain, width, percent).filter("component_id != doc_id").select(*(F.col(k).alias(f"copy_{k}") for k in ("doc_id", "t1", "t2"))).distinct()
    small = workspace.sized(workspace.cut(copies))
    same = [own == F.col(f"copy_{k}") for own, k in zip((plain["doc_id"].cast("long"), *_text_hashes()), ("doc_id", "t1", "t2"))]
    return plain.join(small, same, "left_anti").toDF(*docs.columns)


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id of every row."""
    sketched = workspace.cut(sketches(docs, width, percent))
    named = sketched.select("doc_id", "t1", "t2", "h1", "h2", "n")
    near = workspace.cut(_screened(sketched, percent))
    # one document of every point that may have a neighbour; a point of no doc_id has its text looked up by that
    first = named.join(workspace.sized(near), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "t1", "t2")).alias("at"))
    chosen = workspace.cut(first.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "at.*"))
    points = workspace.cut(_points(docs, chosen, width))
    labels = components_of(_regions(points, width, percent), points, width, percent)
    # the smallest doc_id of a point, then of its component
    of_point = named.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    own = named.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "h1", "h2")
    if labels is not None:
        linked = chosen.select("node", "h1", "h2").join(labels, "node")
        smallest = linked.join(of_point, ["h1", "h2"]).groupBy("component").agg(F.min("doc_id").alias("of_component"))
        ends = workspace.cut(linked.join(smallest, "component").select("h1", "h2", "of_component"))
        of_point = of_point.join(ends, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("of_component", "doc_id").alias("doc_id"))
    ids = of_point.select("h1", "h2", F.col("doc_id").alias("of_point"))
    rows = own.join(ids, ["h1", "h2"], "left")
    return rows.select("doc_id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of_point")).alias("component_id"))
