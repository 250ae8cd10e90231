"""Augmentation of feature cells (run, idx, cell, value), and the split of training data.

Random numbers are hashes of a seed and the cell's place, so they do not depend on partitioning or on retries.  All cells are
those of :mod:`motionframe.operators.features`; derivatives are made anew from what they derive from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import geometry as g
from motionframe.operators import features as f
from motionframe.sources import storage

#: Cells of the left side and of the right side among the angles, keypoints and limb ratios.
ANGLE_PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))
KEYPOINT_PAIRS = tuple((g.INDEX[k], g.INDEX[k.replace("left", "right")]) for k in g.KEYPOINTS if k.startswith("left"))


def _order() -> Window:
    return Window.partitionBy("run", "cell").orderBy("idx")


def uniform(seed: int, *at: str) -> Column:
    """A number in [0, 1) for every place."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *at), 11) / float(1 << 53)


def normal(seed: int, *at: str) -> Column:
    """A normally distributed number for every place."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *at))) * F.cos(2 * math.pi * uniform(seed + 1, *at))


def mirror_places() -> dict[int, tuple[int, float]]:
    """The cell and the sign that each of the 75 cells takes in a mirrored frame."""
    out = {k: (k, 1.0) for k in range(f.WIDTH)}
    for a, b in ANGLE_PAIRS:
        for start in (0, f.VELOCITY, f.ACCELERATION):
            out[start + a], out[start + b] = (start + b, 1.0), (start + a, 1.0)
    partner = dict(KEYPOINT_PAIRS) | {b: a for a, b in KEYPOINT_PAIRS}
    for k in range(17):
        other = partner.get(k, k)
        out[f.POSITION + 2 * k] = (f.POSITION + 2 * other, -1.0)
        out[f.POSITION + 2 * k + 1] = (f.POSITION + 2 * other + 1, 1.0)
    for k in range(0, 8, 2):
        out[f.RATIO + k], out[f.RATIO + k + 1] = (f.RATIO + k + 1, 1.0), (f.RATIO + k, 1.0)
    for cell in (f.TILT, f.TILT_VELOCITY, f.SYMMETRY):
        out[cell] = (cell, -1.0)
    return out


def mirrored(cells: DataFrame) -> DataFrame:
    """The cells with left and right exchanged."""
    places = mirror_places()
    to = F.element_at(F.array(*(F.lit(places[k][0]) for k in range(f.WIDTH))), (F.col("cell") + 1).cast("int"))
    sign = F.element_at(F.array(*(F.lit(places[k][1]) for k in range(f.WIDTH))), (F.col("cell") + 1).cast("int"))
    return cells.select("run", "idx", to.cast("long").alias("cell"), (F.col("value") * sign).alias("value"))


def _steps(of: DataFrame, fps: float, shift: int, wrap: bool = False) -> DataFrame:
    """run, idx, cell + shift and the change of every cell a second; null where the frame before does not have the cell."""
    change = F.col("value") - F.lag("value").over(_order())
    if wrap:
        change = F.pmod(change + 180, F.lit(360.0)) - 180
    follows = F.lag("idx").over(_order()) == F.col("idx") - 1
    return of.select("run", "idx", (F.col("cell") + shift).alias("cell"), F.when(follows, change * fps).alias("value"))


def with_derivatives(cells: DataFrame, fps: float = 30.0) -> DataFrame:
    """The cells with velocities and accelerations made anew for even frames: 0 at the first frame, and where a tilt or height is not known.

    An angle's velocity that is not known has no row, and its acceleration is 0.
    """
    derived = F.col("cell").between(f.VELOCITY, f.POSITION - 1) | F.col("cell").isin(f.TILT_VELOCITY, f.HEIGHT_VELOCITY) | (F.col("cell") >= f.ACCELERATION)
    base = cells.filter(~derived)
    frames = base.select("run", "idx").distinct()
    first = F.col("idx") == 0
    every = lambda cell_list: frames.withColumn("cell", F.explode(F.array(*(F.lit(c).cast("long") for c in cell_list))))
    known = _steps(base.filter(F.col("cell") < f.VELOCITY), fps, f.VELOCITY)
    velocity = every(range(f.VELOCITY, f.POSITION)).join(known, ["run", "idx", "cell"], "left").withColumn("value", F.when(first, 0.0).otherwise(F.col("value"))).filter("value IS NOT NULL")
    pushed = _steps(velocity, fps, f.ACCELERATION - f.VELOCITY)
    acceleration = every(range(f.ACCELERATION, f.WIDTH)).join(pushed, ["run", "idx", "cell"], "left").withColumn("value", F.when(F.col("idx") < 2, 0.0).otherwise(F.coalesce("value", F.lit(0.0))))
    tilt = _steps(base.filter(F.col("cell") == f.TILT), fps, 1, wrap=True)
    height = _steps(base.filter(F.col("cell") == f.HEIGHT), fps, 1)
    body = every([f.TILT_VELOCITY, f.HEIGHT_VELOCITY]).join(tilt.unionByName(height), ["run", "idx", "cell"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return base.unionByName(velocity).unionByName(acceleration).unionByName(body)


def stretched(cells: DataFrame, factor: float | Column, fps: float = 30.0) -> DataFrame:
    """Each run in ``frames / factor`` frames (4 at least), linear between the known values of each cell and constant outside them.

    ``factor`` may depend on the run.  Known and wanted places of a cell are sorted together, so nothing is joined by run.
    """
    each = cells.withColumn("factor", factor if isinstance(factor, Column) else F.lit(float(factor)))
    lengths = each.groupBy("run").agg((F.max("idx") + 1).alias("n"), F.first("factor").alias("factor")).withColumn("m", F.greatest(F.lit(4), F.floor(F.col("n") / F.col("factor"))).cast("long"))
    wanted = cells.select("run", "cell").distinct().join(lengths, "run").select("run", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("to"), (F.col("n") - 1).alias("last"), "m")
    asked = wanted.select("run", "cell", "to", (F.col("to") * F.col("last") / (F.col("m") - 1)).alias("at"), F.lit(None).cast("double").alias("value"))
    known = cells.select("run", "cell", F.lit(None).cast("long").alias("to"), F.col("idx").cast("double").alias("at"), "value")
    one = Window.partitionBy("run", "cell")
    before, after = (order.rowsBetween(Window.unboundedPreceding, 0) for order in (one.orderBy("at", F.col("to").asc_nulls_first()), one.orderBy(F.col("at").desc(), F.col("to").desc_nulls_last())))
    point = F.when(F.col("to").isNull(), F.struct("at", "value"))
    placed = known.unionByName(asked).withColumns(
        {"left": F.last(point, ignorenulls=True).over(before), "right": F.last(point, ignorenulls=True).over(after)}
    )
    share = F.try_divide(F.col("at") - F.col("left.at"), F.col("right.at") - F.col("left.at"))
    line = F.col("left.value") + share * (F.col("right.value") - F.col("left.value"))
    return with_derivatives(placed.filter("to IS NOT NULL").select("run", F.col("to").alias("idx"), "cell", F.coalesce(line, "left.value", "right.value").alias("value")), fps)


def perturbed(cells: DataFrame, deviation: float, smoothing: int, seed: int, fps: float = 30.0) -> DataFrame:
    """Angles and tilt with noise smoothed over frames, heights moved a little for each run, derivatives made anew."""
    moves = (F.col("cell") < f.VELOCITY) | (F.col("cell") == f.TILT)
    reach = _order().rowsBetween(-(smoothing // 2), (smoothing - 1) // 2)
    noise = F.sum(normal(seed, "run", "idx", "cell") * deviation).over(reach) / smoothing
    x = F.col("value") + F.col("noise")
    lifted = F.col("value") + normal(seed + 2, "run") * 0.1
    moved = F.when(F.col("cell") < f.VELOCITY, F.greatest(F.lit(0.0), F.least(F.lit(180.0), x))).when(F.col("cell") == f.TILT, F.pmod(x + 180, F.lit(360.0)) - 180).when(F.col("cell") == f.HEIGHT, lifted).otherwise(F.col("value"))
    return with_derivatives(cells.withColumn("noise", F.when(moves, noise)).select("run", "idx", "cell", moved.alias("value")), fps)


def reproportioned(cells: DataFrame, low: float, high: float, seed: int) -> DataFrame:
    """Limb ratios scaled for each run, the two sides of a limb nearly alike."""
    limb = F.floor((F.col("cell") - f.RATIO) / 2)
    scaled = cells.withColumn("limb", limb)
    scale = low + uniform(seed, "run", "limb") * (high - low) + (uniform(seed + 1, "run", "cell") - 0.5) * 0.04
    return scaled.withColumn("value", F.when(F.col("cell").between(f.RATIO, f.BODY - 1), F.col("value") * scale).otherwise(F.col("value"))).drop("limb")


def blurred(cells: DataFrame, deviation: float, seed: int) -> DataFrame:
    """Positions with independent noise."""
    return cells.withColumn("value", F.when(F.col("cell").between(f.POSITION, f.RATIO - 1), F.col("value") + normal(seed, "run", "idx", "cell") * deviation).otherwise(F.col("value")))


def occluded(cells: DataFrame, rate: float, seed: int) -> DataFrame:
    """The cells without the positions of a share of the keypoints of each frame, x and y together."""
    marked = cells.withColumn("point", F.floor((F.col("cell") - f.POSITION) / 2))
    gone = F.col("cell").between(f.POSITION, f.RATIO - 1) & (uniform(seed, "run", "idx", "point") < rate)
    return marked.filter(~gone).drop("point")


@dataclass(frozen=True)
class AugmentConfig:
    """How strong each change is, and how probable; the defaults are fixed values."""

    stretch: tuple[float, float] = (0.7, 1.3)
    stretch_chance: float = 0.8
    angle_deviation: float = 5.0
    angle_smoothing: int = 5
    angle_chance: float = 0.8
    proportions: tuple[float, float] = (0.85, 1.15)
    proportions_chance: float = 0.6
    position_deviation: float = 0.02
    position_chance: float = 0.8
    mirror_chance: float = 0.5
    dropout_rate: float = 0.05
    dropout_chance: float = 0.3
    fps: float = 30.0


#: Variants of one run at most; a variant's run number is the run's times this and its own.
VARIANTS = 1_000_000


def variants(cells: DataFrame, counts: DataFrame, seed: int, config: AugmentConfig | None = None) -> DataFrame:
    """cells of ``count`` variants of each run in ``counts`` (run, count), numbered run * ``VARIANTS`` + 0, 1, ...

    Each variant takes, by its own draws and in this order: stretching in time, noise on angles, other proportions, noise on positions,
    exchange of left and right, and loss of keypoints.  The same seed gives the same variants, however the rows lie.
    """
    config = config or AugmentConfig()
    copies = counts.filter("count > 0").select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("nth"))
    now = cells.join(copies, "run").select((F.col("run") * VARIANTS + F.col("nth")).alias("run"), "idx", "cell", "value")
    low, high = config.stretch
    factor = low + uniform(seed + 1, "run") * (high - low)
    steps = (
        (config.stretch_chance, lambda df: stretched(df, factor, config.fps)),
        (config.angle_chance, lambda df: perturbed(df, config.angle_deviation, config.angle_smoothing, seed + 20, config.fps)),
        (config.proportions_chance, lambda df: reproportioned(df, *config.proportions, seed + 30)),
        (config.position_chance, lambda df: blurred(df, config.position_deviation, seed + 40)),
        (config.mirror_chance, mirrored),
        (config.dropout_chance, lambda df: occluded(df, config.dropout_rate, seed + 60)),
    )
    for nth, (chance, change) in enumerate(steps):
        if chance <= 0:
            continue
        # the steps split the rows by run, so what is written once is not made again for either part
        now = storage.cut(now)
        drawn = uniform(seed + 100 + nth, "run") < chance
        changed = change(now.filter(drawn)).select("run", "idx", "cell", "value")
        now = changed if chance >= 1 else changed.unionByName(now.filter(~drawn))
    return now


def even_split(references: DataFrame, total: int) -> DataFrame:
    """id, count: ``total`` variants dealt evenly over the references, the first in order taking what is left over."""
    # one row a reference; their number is counted, and the places come from one window over ids
    n = references.count()
    if not n:
        return references.select("id", F.lit(0).cast("long").alias("count"))
    place = F.row_number().over(Window.orderBy("id")) - 1
    return references.select("id", (F.lit(total // n) + F.when(place < total % n, 1).otherwise(0)).cast("long").alias("count"))


def held_out(rows: DataFrame, seed: int, share: float) -> DataFrame:
    """Adds held_out: about that share of the ids, the same whatever else is in the table."""
    return rows.withColumn("held_out", uniform(seed, "id") < share)


def softmax(values: Column) -> Column:
    """The shares of an array of numbers after the exponential; the largest is taken off first."""
    top = F.array_max(values)
    exps = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, e: a + e))
