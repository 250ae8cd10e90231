"""Building and checking the catalog: merging sources, difficulty, prerequisites, labels and work lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.sources import storage

#: Fixed values of the difficulty estimate.
AXIS_BONUS = {"lateral": 0.0, "sagittal": 0.5, "longitudinal": 0.5, "off_axis": 1.5}
ENTRY_BONUS = {"standing": 0.0, "running": 0.3, "one_leg": 0.8, "wall": 0.5, "edge": 0.3}
SHAPE_BONUS = {"tuck": 0.0, "pike": 0.3, "layout": 0.5, "open": 0.2}
FAMILY_BONUS = {"roll": -1.0, "vault": -0.5, "wall": 0.0, "bar": 0.5, "ground": -0.5, "kick": -0.3}


def _bonus(column: str, table: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), F.col(column)), F.lit(0.0))


def estimated_difficulty(physics: DataFrame) -> DataFrame:
    """Adds difficulty (1 to 10, one decimal) where it is missing."""
    score = 1 + (F.col("rotation") - 0.5) * 2 + F.col("twist") * 1.5 + _bonus("axis", AXIS_BONUS) + _bonus("entry", ENTRY_BONUS) + _bonus("shape", SHAPE_BONUS) + _bonus("family", FAMILY_BONUS)
    return physics.withColumn("difficulty", F.coalesce("difficulty", F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)), 1)))


def propagate_difficulty(tricks: DataFrame, edges: DataFrame, rounds: int = 20, subsequents: DataFrame | None = None) -> DataFrame:
    """id, difficulty: every trick at least half a point above its prerequisites, 10 at most, then prerequisites that are not below their subsequents lowered.

    ``edges`` has id and prerequisite; ``subsequents`` has id and subsequent, the inverse of ``edges`` where it is
    not given.  All tricks move at once in each round; a pass ends when none changes, or after ``rounds``.
    The state is checkpointed each round, so the plan does not grow with the rounds.
    """
    after = edges.select(F.col("prerequisite").alias("id"), F.col("id").alias("subsequent")) if subsequents is None else subsequents
    now = storage.cut(tricks.select("id", "difficulty"))
    own, bound = F.col("difficulty"), F.col("bound")
    raised = F.when(own <= bound, F.least(F.round(bound + 0.5, 1), F.lit(10.0)))
    # as in the reference, subsequents at 10 bound nothing and a difficulty may rise to the floor of 1
    lowered = F.when((bound < 10) & (own >= bound), F.round(F.greatest(bound - 0.5, F.lit(1.0)), 1))
    now = _settled(now, edges.select("id", F.col("prerequisite").alias("other")), F.max, raised, rounds)
    return _settled(now, after.select("id", F.col("subsequent").alias("other")), F.min, lowered, rounds)


def _settled(now: DataFrame, edges: DataFrame, extreme: Callable[[str], Column], moves: Column, rounds: int) -> DataFrame:
    """``now`` (id, difficulty) after rounds in which ``moves``, if not null, replaces a difficulty; bound is the extreme over its edges (id, other)."""
    for _ in range(rounds):
        bounds = edges.join(now.select(F.col("id").alias("other"), F.col("difficulty").alias("bound")), "other").groupBy("id").agg(extreme("bound").alias("bound"))
        moved = now.join(bounds, "id", "left").withColumn("moved", moves)
        changed = F.coalesce(F.col("moved") != F.col("difficulty"), F.lit(False))
        moved = storage.cut(moved.select("id", F.coalesce("moved", "difficulty").alias("difficulty"), changed.alias("changed")))
        now = moved.select("id", "difficulty")
        if moved.filter("changed").isEmpty():
            break
    return now


def prerequisite_violations(tricks: DataFrame, edges: DataFrame) -> DataFrame:
    """id, prerequisite of the edges whose prerequisite is harder than the trick."""
    own = tricks.select("id", F.col("difficulty").alias("own"))
    other = tricks.select(F.col("id").alias("prerequisite"), F.col("difficulty").alias("needed"))
    return edges.join(own, "id").join(other, "prerequisite").filter("needed > own").select("id", "prerequisite")


def merge_sources(sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """One row a key: each field from the first source that has it, and the number of sources."""
    every = [s.select(key, *fields).withColumn("priority", F.lit(p)) for p, s in enumerate(sources)]
    both = every[0]
    for s in every[1:]:
        both = both.unionByName(s)
    first = [F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("priority"))).alias(f) for f in fields]
    return both.groupBy(key).agg(*first, F.countDistinct("priority").alias("sources"))


def label_precedence(sources: list[DataFrame]) -> DataFrame:
    """item, label, source: the label of the first source that has the item."""
    both = None
    for p, s in enumerate(sources):
        one = s.select("item", "label", F.lit(p).cast("long").alias("source"))
        both = one if both is None else both.unionByName(one)
    order = Window.partitionBy("item").orderBy("source", "label")
    return both.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def usable_classes(labels: DataFrame, least: int = 3, without: str = "not_a_flip") -> DataFrame:
    """label, n of the classes with enough items."""
    return labels.filter(F.col("label") != without).groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def diverse_top(definitions: DataFrame, combo: list[str], importance: str, count: int, always: float = 10.0) -> DataFrame:
    """The ``count`` most important definitions among those that are the first of their combination or exceed ``always``."""
    order = Window.partitionBy(*combo).orderBy(F.col(importance).desc(), "id")
    kept = definitions.withColumn("nth", F.row_number().over(order)).filter((F.col("nth") == 1) | (F.col(importance) > always))
    return kept.orderBy(F.col(importance).desc(), "id").limit(count).drop("nth")


def first_of_class(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most ``n`` rows of each class, in order."""
    window = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(window).cast("long")).filter(F.col("nth") <= n)


def work_status(wanted: DataFrame, done: DataFrame, downloaded: DataFrame) -> DataFrame:
    """id, status: done, needs_extract or needs_download."""
    a, b = done.select("id", F.lit(True).alias("d")), downloaded.select("id", F.lit(True).alias("l"))
    return wanted.join(a, "id", "left").join(b, "id", "left").select("id", F.when(F.col("d"), "done").when(F.col("l"), "needs_extract").otherwise("needs_download").alias("status"))


def chunked(work: DataFrame, order: str, workers: int) -> DataFrame:
    """Adds worker: contiguous chunks of ``rows // workers + 1`` rows in order.

    Places come from per-range counts, so no task sees all rows.
    """
    ranged = storage.cut(work.repartitionByRange(order).withColumn("part", F.spark_partition_id())).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    total = work.agg(F.count("*").alias("total"))
    placed = ranged.join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    return placed.withColumn("worker", F.floor((F.col("before") + F.col("nth") - 1) / (F.floor(F.col("total") / workers) + 1)).cast("long")).drop("part", "nth", "before", "total")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, n, share of the truth's rows, accuracy over all."""
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    of_truth = counts.groupBy("truth").agg(F.sum("n").alias("of_truth"))
    overall = counts.agg(F.try_divide(F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return counts.join(of_truth, "truth").crossJoin(overall).select("truth", "guess", "n", (F.col("n") / F.col("of_truth")).alias("share"), "accuracy")
