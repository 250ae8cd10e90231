"""Vector code compression: codebooks for the parts of vectors, made by Yinyang's form of Lloyd's iteration.

A component x becomes the integer floor(256 * x).  Vectors are cut into ``PARTS`` equal parts; each place has its own codebook of
``ENTRIES`` entries.  The entries of a codebook are clustered into ``GROUPS`` groups once.  Every part keeps, for each group, a lower
bound of its distance to the group's entries other than its own; when entries move, the bound falls by the furthest move in the
group, and a group whose bound still exceeds the exact distance to the part's own entry is not scanned.  Distances that floating
point cannot tell apart are compared again as integers, so ties go to the lower index.

Spark deals the vectors out once and never shuffles them: a pass maps each batch of vectors, with the codes and bounds of the pass
before, to new ones, and writes them with one row of sums a task.  The driver sees entries only, ``ENTRIES`` times the number of
components.

Edge cases: a vector that is null or holds a null, NaN or infinite component is dropped; so is one whose length differs from that
of the smallest kept vec_id.  Null vec_ids come last, rows of one vec_id in the order of their vectors.  Lengths that are no
multiple of ``PARTS`` are filled up with zeros.  Integers beyond ``LARGEST`` are set to it, so that sums of squares fit 64 bits; a
label whose errors add up beyond 64 bits has a null label_error.  Fewer vectors than ``ENTRIES`` make smaller codebooks; no vector
makes an empty result.  Equal rows stay separate rows.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm import workspace

PARTS = 16
ENTRIES = 64
GROUPS = 6
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26
#: Rows worked on at once; with bounds and distances about 2 KB each.
ROWS_AT_ONCE = 4096
#: What a bound is at most; lower than the truth only for distances no 32-bit number holds.
_MOST_BOUND = (1 << 31) - 1

_STATE_DDL = "vec_id long, label {label}, x array<int>, codes binary, bounds array<int>, sums array<long>, counts array<long>, scanned long"


def _root(squares: np.ndarray, up: bool = False) -> np.ndarray:
    """The whole part of square roots, or with ``up`` the next whole number; exact for 64-bit integers."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root + (root * root < squares) if up else root


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries as integers."""
    total = np.zeros((len(x), len(entries)), dtype=np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - entries[None, :, k]
        total += step * step
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (floating point, as good as exact for telling entries apart) and the nearest entry of every row.

    Rows in which another entry comes within the rounding error of the best are decided by integers.
    """
    a, b = x.astype(np.float64), entries.astype(np.float64)
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    rough = size - 2 * (a @ b.T)
    slack = size.max(1) * (8 * x.shape[1] + 16) * 2.0**-52
    close = rough <= (rough.min(1) + slack)[:, None]
    best = close.argmax(1)
    tied = np.flatnonzero(close.sum(1) > 1)
    if len(tied):
        exact = np.where(close[tied], _squares(x[tied], entries), np.iinfo(np.int64).max)
        best[tied] = exact.argmin(1)  # the first of equals
    return rough - slack[:, None], best


class Codebooks(NamedTuple):
    """Entries (place, entry, component), the group of each entry (place, entry), and how far each group moved last (place, group)."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group for every entry of every place, by a few rounds of Lloyd from evenly spaced entries; any grouping gives the same codes."""
    out = np.zeros(entries.shape[:2], dtype=np.int64)
    for place, own in enumerate(entries):
        centres = own[np.linspace(0, len(own) - 1, min(groups, len(own))).astype(int)].astype(np.float64)
        for _ in range(5):
            out[place] = ((own[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            for g in range(len(centres)):
                if (out[place] == g).any():
                    centres[g] = own[out[place] == g].mean(0)
    return out


def _whole_square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    step = x - entries
    return (step * step).sum(1)


def assign(x: np.ndarray, books: Codebooks, place: int, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code, squared distance and lower bounds by group of each part in ``x``, and how many distances were computed.

    Without ``own`` codes and ``bounds`` every group is scanned.  A group is passed over only if its bound is above the distance to
    the own entry, so that an equally near entry of a lower index is seen.
    """
    entries, of_group = books.entries[place], books.groups[place]
    n, n_groups = len(x), books.drift.shape[1]
    if own is None:
        own, low = np.zeros(n, dtype=np.int64), np.zeros((n, n_groups), dtype=np.int64)
    else:
        low = np.maximum(bounds.astype(np.int64) - books.drift[place], 0)
    mine = _whole_square(x, entries[own])
    open_ = low * low <= mine[:, None]
    best, best_square = own.copy(), mine.copy()
    seen = np.full((n, n_groups, 2), np.iinfo(np.int64).max)  # by group: the two least squared distances
    which = np.full((n, n_groups), -1, dtype=np.int64)
    computed = n
    for g in range(n_groups):
        members, rows = np.flatnonzero(of_group == g), np.flatnonzero(open_[:, g])
        if not len(members) or not len(rows):
            continue
        computed += len(members) * len(rows)
        part = x[rows]
        rough, first = nearest(part, entries[members])
        square = _whole_square(part, entries[members[first]])
        which[rows, g], seen[rows, g, 0] = members[first], square
        if len(members) > 1:
            rough[np.arange(len(rows)), first] = np.inf
            second = np.floor(np.maximum(rough.min(1), 0)).astype(np.int64)  # never above the truth
            seen[rows, g, 1] = np.maximum(second, 0)
        better = (square < best_square[rows]) | ((square == best_square[rows]) & (members[first] < best[rows]))
        best[rows[better]], best_square[rows[better]] = members[first][better], square[better]
    # a scanned group is bounded by its nearest entry, or by the second where the nearest is the part's own
    scanned = which >= 0
    lower = np.where(which == best[:, None], seen[:, :, 1], seen[:, :, 0])
    fresh = np.minimum(_root(np.minimum(lower, 1 << 62)), _MOST_BOUND)
    low = np.where(scanned, fresh, low)
    moved = np.flatnonzero((best != own) & ~scanned[np.arange(n), of_group[own]])
    if len(moved):  # its former entry is one of the group's others now
        g = of_group[own[moved]]
        low[moved, g] = np.minimum(low[moved, g], _root(mine[moved]))
    return best, best_square, np.minimum(low, _MOST_BOUND), computed


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    values = column.flatten()
    return np.asarray(values).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), dtype=np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def _passes(batches: Iterator[pa.RecordBatch], books: Codebooks, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with new codes and bounds, then one row of sums and counts by entry; or with ``last`` codes and errors."""
    places, entries, width = books.entries.shape
    n_groups = books.drift.shape[1]
    sums, counts, scanned, schema = np.zeros((places, entries, width), dtype=np.int64), np.zeros((places, entries), dtype=np.int64), 0, None
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            n = batch.num_rows
            x = _matrix(batch.column("x"), n)
            codes, bounds, error = np.zeros((n, places), dtype=np.uint8), np.zeros((n, places, n_groups), dtype=np.int32), np.zeros(n, dtype=np.int64)
            if not first:
                old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(n, places)
                low = _matrix(batch.column("bounds"), n).reshape(n, places, n_groups)
            for place in range(places):
                part = x[:, place * width : (place + 1) * width]
                own, square, new, computed = assign(part, books, place, None if first else old[:, place].astype(np.int64), None if first else low[:, place])
                codes[:, place], bounds[:, place], scanned = own, new, scanned + computed
                error += square
                if not last:
                    for k in range(width):  # a batch's sums stay below what a double holds
                        sums[place, :, k] += np.bincount(own, weights=part[:, k], minlength=entries).astype(np.int64)
                    counts[place] += np.bincount(own, minlength=entries)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])
                continue
            if schema is None:
                longs = pa.list_(pa.int64())
                schema = pa.schema([("vec_id", pa.int64()), ("label", batch.schema.field("label").type), ("x", pa.list_(pa.int32())), ("codes", pa.binary()), ("bounds", pa.list_(pa.int32())), ("sums", longs), ("counts", longs), ("scanned", pa.int64())])
            rows = [batch.column("vec_id"), batch.column("label"), _lists(x.astype(np.int32), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), _lists(bounds.reshape(n, -1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, longs), pa.nulls(n, longs), pa.nulls(n, pa.int64())], schema=schema)
    if schema is not None:
        yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"sums": sums.ravel().tolist(), "counts": counts.ravel().tolist(), "scanned": scanned}], schema=schema)


def _whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components x of the rows of ``vectors`` whose components are all numbers."""
    finite = "size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    # the product is limited before it becomes whole, as it may leave 64 bits
    whole = f"transform(embedding, v -> int(floor(least(greatest(double(v) * {SCALE}, -{LARGEST}D), {LARGEST}D))))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(finite).selectExpr("vec_id", "label", f"{whole} AS x")


def prepared(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, list[list[int]]]:
    """The rows that can be coded (vec_id, label, x), and x of the first ``entries`` of them; x is filled up to a multiple of ``parts``."""
    kept = _whole(vectors)
    smallest = lambda df: [list(r.x) for r in df.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()]
    seeds = smallest(kept)
    if not seeds:
        return kept, []
    length = len(seeds[0])
    kept = kept.filter(F.size("x") == length)
    if any(len(x) != length for x in seeds):
        seeds = smallest(kept)
    short = -length % parts
    if short:
        kept, seeds = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), short))), [x + [0] * short for x in seeds]
    return kept, seeds


def _totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums and counts by entry and the number of distances, added up over the tasks' rows in Spark."""
    rows = state.filter("sums IS NOT NULL")
    out = []
    for name in ("sums", "counts"):
        flat = np.zeros(int(np.prod(shape if name == "sums" else shape[:2])), dtype=np.int64)
        for r in rows.select(F.posexplode(name).alias("k", "v")).filter("v != 0").groupBy("k").agg(F.sum("v").alias("v")).collect():
            flat[r.k] = r.v
        out.append(flat)
    return out[0].reshape(shape), out[1].reshape(shape[:2]), rows.agg(F.sum("scanned")).first()[0] or 0


def _moved(books: Codebooks, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
    """Entries as the whole mean of their parts, unused ones as they were; a group's drift is that of its furthest entry, rounded up."""
    entries = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books.entries)
    step = entries - books.entries
    far = _root((step * step).sum(2), up=True)
    drift = np.zeros_like(books.drift)
    for place in range(len(far)):
        np.maximum.at(drift[place], books.groups[place], far[place])
    return Codebooks(entries, books.groups, drift)


class Coded(NamedTuple):
    """Rows (vec_id, label, code, error), the final entries (place, entry, component), and the distances computed in each pass but the last."""

    rows: DataFrame
    entries: np.ndarray
    computed: list[int]


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Train codebooks on all of ``vectors`` (vec_id, embedding, label) and code every one of them."""
    now, seeds = prepared(vectors, parts, entries)
    label = vectors.schema["label"].dataType.simpleString()
    out = f"vec_id long, label {label}, code string, error long"
    if not seeds:
        return Coded(vectors.sparkSession.createDataFrame([], out), np.zeros((parts, 0, 0), dtype=np.int64), [])
    start = np.array(seeds, dtype=np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    groups = grouped(start)
    books, computed = Codebooks(start, groups, np.zeros((parts, int(groups.max()) + 1), dtype=np.int64)), []
    for turn in range(rounds):
        state = workspace.cut(now.mapInArrow(lambda it, b=books, f=turn == 0: _passes(it, b, f, False), _STATE_DDL.format(label=label)))
        sums, counts, n = _totals(state, start.shape)
        computed.append(n)
        books = _moved(books, sums, counts)
        now = state.filter("sums IS NULL").drop("sums", "counts", "scanned")
    return Coded(now.mapInArrow(lambda it: _passes(it, books, rounds == 0, True), out), books.entries, computed)


def decode(codes: DataFrame, entries: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector, near the one that was coded, of every row of ``codes`` (vec_id, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(len(entries))
        for batch in batches:
            made = [(entries[places, np.frombuffer(bytes.fromhex(c), dtype=np.uint8)].ravel() / scale).tolist() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<float>")


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, the error added up over the label, and the digest of all codebooks."""
    coded = encode(vectors)
    rows = workspace.cut(coded.rows)
    by_label = workspace.cut(rows.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")))
    joined = rows.join(workspace.sized(by_label), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(coded.entries)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    text = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), width AS (SELECT max(len(x)) // {parts} AS w FROM kept),
split AS (
  SELECT vec_id, label, part, x[part * w + 1 : part * w + w] AS x FROM kept, width, unnest(range({parts})) AS t(part)
), book0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM split QUALIFY entry < {entries}
)"""
    for turn in range(rounds + 1):
        text += f""", near{turn} AS (
  SELECT vec_id, label, part, x, arg_min(entry, [d, entry]) AS entry, CAST(min(d) AS BIGINT) AS d
  FROM (SELECT s.*, b.entry, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k]))) AS BIGINT) AS d FROM split s JOIN book{turn} b USING (part))
  GROUP BY ALL
)"""
        if turn < rounds:
            text += f""", mean{turn} AS (
  SELECT part, entry, list(m ORDER BY k) AS c
  FROM (SELECT part, entry, k, (s - ((s % n) + n) % n) // n AS m FROM (SELECT part, entry, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM near{turn}, width, unnest(range(1, w + 1)) AS t(k) GROUP BY ALL))
  GROUP BY ALL
), book{turn + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{turn} b LEFT JOIN mean{turn} m USING (part, entry))"""
    return text + f""", digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""
