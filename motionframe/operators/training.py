"""Training data from feature cells (run, idx, cell, value): fixed-size tensors, a seeded order, a split, and a perceptron on them."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators import features, matching
from motionframe.sources import storage

#: Frames of a tensor, the least probability of a detection, and the perceptron's hidden layers.
LENGTH, LEAST, HIDDEN = 64, 0.3, (256, 128)


def resampled(cells: DataFrame, length: int = LENGTH) -> DataFrame:
    """run, step, cell, value of each cell at ``length`` even places of its run, linear between known values and constant outside them.

    A step needs only the nearest known values on either side.  So each gap between two steps, and each place of a step, keeps its
    first and its last known value, and what is put in order is a few rows a step however long the run is.  The cells are read twice,
    so they are written once.
    """
    return _resampled(storage.cut(cells), length)


def _resampled(cells: DataFrame, length: int) -> DataFrame:
    gaps = max(length - 1, 1)
    ends = cells.groupBy("run").agg(F.max("idx").alias("last"))
    # place 2k is step k itself and 2k + 1 the frames between it and the next one
    spot = F.expr(f"CASE WHEN last = 0 THEN 0 ELSE 2 * ((idx * {gaps}) div last) + CASE WHEN (idx * {gaps}) % last = 0 THEN 0 ELSE 1 END END")
    known = cells.filter("value IS NOT NULL").join(ends, "run").withColumn("place", spot.cast("long"))
    of_place = known.groupBy("run", "cell", "last", "place").agg(F.min("idx").alias("first_at"), F.min_by("value", "idx").alias("first"), F.max("idx").alias("last_at"), F.max_by("value", "idx").alias("latest"))
    point = lambda at, value: F.struct(F.col(at).cast("double").alias("at"), F.col(value).alias("value"))
    found = storage.cut(of_place.select("run", "cell", "last", "place", F.lit(None).cast("long").alias("step"), point("first_at", "first").alias("opens"), point("last_at", "latest").alias("closes")))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))
    none = F.lit(None).cast(found.schema["opens"].dataType)
    asked = found.select("run", "cell", "last").distinct().withColumn("step", steps).select("run", "cell", "last", (2 * F.col("step")).alias("place"), "step", none.alias("opens"), none.alias("closes"))
    one = Window.partitionBy("run", "cell")
    # what follows is looked for backwards, as a frame that ends with the last row is gone through anew for every row
    onward, backward = one.orderBy("place", F.col("step").asc_nulls_first()), one.orderBy(F.col("place").desc(), F.col("step").desc_nulls_last())
    so_far = lambda column, order: F.last(column, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = found.unionByName(asked).withColumns({"left": so_far("closes", onward), "right": so_far("opens", backward)})
    at = F.col("step") * F.col("last") / gaps
    share = F.try_divide(at - F.col("left.at"), F.col("right.at") - F.col("left.at"))
    line = F.col("left.value") + share * (F.col("right.value") - F.col("left.value"))
    return placed.filter("step IS NOT NULL").select("run", "step", "cell", F.coalesce(line, "left.value", "right.value").alias("value"))


def tensors(cells: DataFrame, length: int = LENGTH, width: int = features.WIDTH) -> DataFrame:
    """run, flat, channels of every run: ``length`` frames of ``width`` cells one after the other, and the cells' courses one after the other.

    A cell that is never known in a run is 0 throughout.  A tensor has a fixed size, so a run's cells fit one row.
    """
    cells = storage.cut(cells)
    at = lambda major, minor, n: (F.col(major) * n + F.col(minor)).cast("int")
    each = _resampled(cells, length).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(at("step", "cell", width), "value"))).alias("m"))
    every = cells.select("run").distinct().join(each, "run", "left")
    value = lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))
    flat = F.transform(F.sequence(F.lit(0), F.lit(length * width - 1)), value)
    turned = F.transform(F.sequence(F.lit(0), F.lit(length * width - 1)), lambda k: F.element_at("flat", (k % length * width + F.floor(k / length) + 1).cast("int")))
    return every.select("run", flat.alias("flat")).select("run", "flat", turned.alias("channels"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``place``, 0, 1, ... in an order that depends on the seed and the keys alone; keys must differ."""
    return storage.numbered(rows.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), "_draw").drop("_draw")


def tail_split(placed: DataFrame, share: float = 0.2) -> DataFrame:
    """Adds held_out: whether a row is in the last ``share`` of the places."""
    n = placed.count()
    return placed.withColumn("held_out", F.col("place") >= n - int(n * share))


def train(examples: DataFrame, classes: int, hidden: tuple[int, ...] = HIDDEN, seed: int = 42, iterations: int = 100) -> MultilayerPerceptronClassificationModel:
    """A perceptron on ``examples`` (flat, label from 0), trained by Spark over the whole table."""
    ready = examples.select(array_to_vector("flat").alias("features"), F.col("label").cast("double").alias("label"))
    width = len(examples.select("flat").first().flat)
    return MultilayerPerceptronClassifier(layers=[width, *hidden, classes], seed=seed, maxIter=iterations, blockSize=128).fit(ready)


def predicted(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> DataFrame:
    """run, p (by class) of ``rows`` (run, flat)."""
    return model.transform(rows.select("run", array_to_vector("flat").alias("features"))).select("run", vector_to_array("probability").alias("p"))


def detected(predictions: DataFrame, classes: DataFrame, least: float = LEAST, k: int = 3) -> DataFrame:
    """run, rank, trick_id, confidence of the ``k`` surest classes of each run that reach ``least``, leaving out class 0; ``classes`` is label, class."""
    best = matching.top_probabilities(predictions.select(F.col("run").alias("id"), "p"), k)
    return best.filter(F.col("p") >= least).join(classes.select(F.col("class"), F.col("label").alias("trick_id")), "class").select(F.col("id").alias("run"), "rank", "trick_id", F.col("p").alias("confidence"))
