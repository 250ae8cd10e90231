"""Mixing sources to target weights.

Sources, in code-point order with null last, take the weights in turn and share ``SHARE`` times all words by weight.  A target
stops at ``MOST`` times its source's size, and what it leaves is shared again by weight among the others, until none is above.
A source's rate is its target over its size; each of its documents is emitted floor(rate) times and once more with probability
rate - floor(rate), drawn from a hash of seed, doc_id and text, so that reruns and retried tasks agree.

Sizes are aggregated on each partition first, so a source that holds most rows shuffles a row a partition.  The sources are
numbered by a range sort and the number of rows of each partition before; sharing again is an aggregation over sources a round.

Edge cases: a null text has size 0; sources that are null are one source; a source without words has target 0 and its documents
are not emitted; a null doc_id draws by its text alone; rows equal in id and text share their draw; an empty table gives an empty
mix; other columns pass, whatever their names (``mixed``), or are left out (``assigned``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm import workspace

WEIGHTS = (5, 2, 1)
#: Of all words, as numerator and denominator.
SHARE = (3, 2)
MOST = 2
SEED = "mix-1"
#: The draw has so many bits, all of which a double and a bigint hold.
DRAW_BITS = 52


def _draw(doc_id: F.Column, text: F.Column, seed: str) -> F.Column:
    """A number in [0, 2 ** DRAW_BITS), the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def numbered(keys: DataFrame, column: str) -> DataFrame:
    """``keys`` with ``rank``, the number of rows before each by ``column``, nulls last; rows must differ in it."""
    order = F.asc_nulls_last(column)
    # the id holds the partition above bit 33 and the row within it below
    placed = workspace.cut(keys.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").toLocalIterator():  # a row a partition
        offsets.append((row.part, before))
        before += row.n
    starts = keys.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.withColumn("part", part).join(workspace.sized(starts), "part").withColumn("rank", F.col("before") + F.col("place") % F.lit(1 << 33)).drop("part", "before", "place")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target (double) and capped of every source of ``sizes`` (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = workspace.cut(numbered(by_source, "source").withColumn("weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # a source without a stop gets weight * above / below; all numbers are whole, so nothing is rounded before the last division
    above, below, stopped = share[0] * total, share[1] * (sources.agg(F.sum("weight")).first()[0] or 1), -1
    while True:
        stops = F.lit(above).cast("decimal(38,0)") * F.col("weight") > F.lit(below).cast("decimal(38,0)") * most * F.col("source_size")
        now = sources.withColumn("capped", stops)
        found = now.agg(F.count_if("capped").alias("n"), F.sum(F.when(F.col("capped"), F.col("source_size"))).alias("size"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weight")).first()
        if found.n == stopped or not found.weight:
            break
        stopped, above, below = found.n, share[0] * total - share[1] * most * (found["size"] or 0), share[1] * found.weight
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.lit(above)).cast("double") / F.lit(below).cast("double"))
    return now.select("source", "source_size", target.alias("target"), "capped")


def _copies(draw: F.Column, most: int = MOST) -> F.Column:
    """How often a document of a source with ``source_size``, ``target`` and ``capped`` is emitted."""
    rate = F.col("target") / F.col("source_size")
    fraction = rate - F.floor(rate)
    drawn = F.floor(rate) + (draw < fraction * float(1 << DRAW_BITS)).cast("long")
    return F.when(F.col("source_size") == 0, 0).when(F.col("capped"), most).otherwise(F.least(drawn, F.lit(most))).cast("long")


def assigned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and copies (how often the mix holds it) of every row of ``docs`` (doc_id, text, source)."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = workspace.cut(docs.select("doc_id", "source", words.alias("size"), _draw(F.col("doc_id"), F.col("text"), seed).alias("draw")))
    found = workspace.cut(targets(sizes, weights, share, most))
    of_source = found.withColumnRenamed("source", "of_source")
    joined = sizes.join(workspace.sized(of_source, "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "size", "source_size", "target", _copies(F.col("draw"), most).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns as they were."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    found = workspace.cut(targets(docs.select("source", words.alias("size")), weights, share, most))
    rates = found.select(F.struct(F.col("source").alias("of"), "source_size", "target", "capped").alias("mix_source"))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", _draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    joined = kept.join(workspace.sized(rates, "mix_source.of"), F.col("source").eqNullSafe(F.col("mix_source.of"))).select("doc", "draw", "mix_source.*")
    times = joined.select("doc", _copies(F.col("draw"), most).alias("copies")).filter("copies > 0")
    return times.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc.*")


def report(docs: DataFrame) -> DataFrame:
    """The mix per document: the words that it takes, repeats counted."""
    return assigned(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS draw
  FROM documents
), sources AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)
), ordered AS (
  SELECT *, row_number() OVER w AS k, CAST(coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stopped,
    CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_weight, (SELECT sum(source_size) FROM sources)::BIGINT AS total
  FROM sources WINDOW w AS (ORDER BY source_size * 10 // weight, source NULLS LAST)
), level AS (  -- the first source, by size over weight, that the shared rest leaves below its stop, and the level there
  SELECT 3 * total - 2 * stopped AS above, 2 * left_weight AS below FROM ordered WHERE (3 * total - 2 * stopped) * weight <= 2 * left_weight * 2 * source_size ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN above * weight > below * 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * above AS DOUBLE) / CAST(below AS DOUBLE) END AS target,
    above * weight > below * 2 * source_size AS capped
  FROM sources, level
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  size * CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 2 ELSE least(2, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < (rate - floor(rate)) * 4503599627370496.0 THEN 1 ELSE 0 END) END AS taken
FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""
