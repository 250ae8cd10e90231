"""Finding the turns of a run: smoothing its orientations, and cutting it at changes of its speed of rotation.

Frames are run, idx (0, 1, ... without gaps) and what each function names; windows run over the frames of a run or of a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators import describe, rotation
from motionframe.operators.intervals import within
from motionframe.operators.sequence import by_frame, by_frame_backward, islands, merge_intervals, smooth_zero_padded
from motionframe.sources.storage import cut

#: A kernel reaches so many widths to either side.
REACH = 4.0
_SEGMENT = ["run", "start_idx", "end_idx"]


def smoothed_orientations(frames: DataFrame, widths: DataFrame, widest: float = 3.0) -> DataFrame:
    """``frames`` (run, idx, ox, oy, oz, ...) with their orientations smoothed by a Gaussian of the run's width in frames.

    ``widths`` is run, sigma; runs with sigma 0 or none stay as they are, and sigma is at most ``widest``.  Of the two quaternions of
    an orientation the one nearer to that of the frame before is taken, which is the parity of the changes so far.  Beyond both ends
    the frames stand mirrored, the last one twice, as often as a short run needs.
    """
    order, reach = by_frame(), int(REACH * widest + 0.5)
    q = rotation.quaternions(frames.select("run", "idx", "ox", "oy", "oz"))
    turned = sum((F.col(f"q{a}") * F.lag(f"q{a}").over(order) for a in "wxyz"), F.lit(0.0)) < 0
    parity = F.sum(F.coalesce(turned, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2
    n = F.max("idx").over(Window.partitionBy("run")) + 1
    nearer = F.struct(*(F.when(F.col("odd") == 1, -F.col(f"q{a}")).otherwise(F.col(f"q{a}")).alias(a) for a in "wxyz"))
    signed = q.withColumns({"odd": parity, "n": n}).select("run", "idx", "n", nearer.alias("q"))
    # every place, within reach, that mirrors this frame: idx + 2kn and -1 - idx + 2kn
    around = f"sequence(cast(-ceil({reach} / (2 * n)) - 1 as bigint), cast(ceil({reach} / (2 * n)) + 1 as bigint))"
    images = f"filter(flatten(transform({around}, k -> array(idx + 2 * k * n, 2 * k * n - 1 - idx))), p -> p BETWEEN -{reach} AND n - 1 + {reach})"
    inner = f"idx >= {reach} AND idx < n - {reach}"
    placed = signed.withColumn("place", F.explode(F.expr(f"CASE WHEN {inner} THEN array(idx) ELSE {images} END")))
    near = Window.partitionBy("run").orderBy("place").rowsBetween(-reach, reach)
    ring = placed.withColumn("ring", F.collect_list("q").over(near)).filter("place BETWEEN 0 AND n - 1").select("run", F.col("place").alias("idx"), "ring")
    sigma = F.least("sigma", F.lit(widest))
    weight = lambda k: F.when(F.abs(k) <= F.floor(sigma * REACH + 0.5), F.exp(-0.5 * k * k / (sigma * sigma))).otherwise(0.0)
    # the sum of weights cancels when the mean is made a unit quaternion
    weights = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), weight)
    weighed = ring.join(widths.select("run", "sigma").filter("sigma > 0"), "run").withColumn("weights", weights)
    parts = {a: F.expr(f"aggregate(zip_with(ring, weights, (q, w) -> q.{a} * w), 0D, (s, x) -> s + x)") for a in "wxyz"}
    mean = weighed.select("run", "idx", *(c.alias(f"m{a}") for a, c in parts.items()))
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    # from the half angle's sine and cosine, whatever their common factor
    scale = F.when(size > 1e-12 * F.abs("mw"), 2 * F.atan2(size, F.abs("mw")) / size).otherwise(F.try_divide(F.lit(2.0), F.abs("mw"))) * F.when(F.col("mw") < 0, -1.0).otherwise(1.0)
    smooth = mean.select("run", "idx", *((F.col(f"m{a}") * scale).alias(f"s{a}") for a in "xyz"))
    joined = frames.join(smooth, ["run", "idx"], "left")
    return joined.withColumns({f"o{a}": F.coalesce(f"s{a}", f"o{a}") for a in "xyz"}).drop("sx", "sy", "sz")


@dataclass(frozen=True)
class TurnConfig:
    """Frames a second and the least rotation in degrees of a segment; lengths follow from the frames a second."""

    fps: float = 30.0
    least_degrees: float = 120.0

    def frames(self, seconds: float) -> int:
        return int(seconds * self.fps)


def _edges(flag: str) -> dict[str, Column]:
    """The first and last frame of the stretch of frames with ``flag`` that a frame is in; meaningless in other frames."""
    before, after = (order.rowsBetween(Window.unboundedPreceding, 0) for order in (by_frame(), by_frame_backward()))
    off = F.when(~F.col(flag), F.col("idx"))
    return {f"{flag}_from": F.coalesce(F.max(off).over(before) + 1, F.min("idx").over(before)), f"{flag}_to": F.coalesce(F.min(off).over(after) - 1, F.max("idx").over(after))}


def _stretches(frames: DataFrame, flag: Column, key: list[str]) -> DataFrame:
    """``key``, a, b: first and last frame of each stretch with ``flag`` within a key."""
    marked = frames.withColumn("flag", flag)
    numbered = marked.withColumn("place", F.col("idx") - F.row_number().over(Window.partitionBy(*key, "flag").orderBy("idx")))
    return numbered.filter("flag").groupBy(*key, "place").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).drop("place")


def _middles(stretches: DataFrame, least: int) -> DataFrame:
    """run, start_idx, end_idx, at: the middles of stretches that are long enough; one at the segment's end is a frame shorter."""
    ended = stretches.withColumn("b", F.when(F.col("b") < F.col("end_idx"), F.col("b") + 1).otherwise(F.col("b"))).filter(F.col("b") - F.col("a") >= least)
    return ended.select(*_SEGMENT, (F.col("start_idx") + F.floor((F.col("a") + F.col("b") - 2 * F.col("start_idx")) / 2)).cast("long").alias("at"))


def _spaced(points: DataFrame, apart: int) -> DataFrame:
    """Points from the first on, each more than ``apart`` frames after the one taken before it.

    A point that is far from its neighbour before is always taken, so only chains of near points are put together.
    """
    order = Window.partitionBy(*_SEGMENT).orderBy("at")
    fresh = F.coalesce((F.col("at") - F.lag("at").over(order) > apart).cast("int"), F.lit(1))
    chained = points.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sorted_ = F.sort_array(F.collect_list("at"))
    taken = lambda acc, x: F.when(x - F.element_at(acc, -1) > apart, F.concat(acc, F.array(x))).otherwise(acc)
    every = chained.groupBy(*_SEGMENT, "chain").agg(sorted_.alias("all"))
    return every.select(*_SEGMENT, F.explode(F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), taken)).alias("at"))


def _pieces(segments: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """run, start_idx, end_idx of the pieces of ``segments`` between their ``points``, if they are ``least`` frames long."""
    ends = segments.select(*_SEGMENT, F.explode(F.array("start_idx", "end_idx")).alias("at"))
    order = Window.partitionBy(*_SEGMENT).orderBy("at")
    edged = ends.unionByName(points.select(*_SEGMENT, "at")).withColumn("next", F.lead("at").over(order)).filter(F.col("next") - F.col("at") >= least)
    return edged.select("run", F.col("at").alias("start_idx"), F.col("next").alias("end_idx"))


def strong_regions(smooth: DataFrame, config: TurnConfig) -> DataFrame:
    """run, start_idx, end_idx, last: stretches above the low level that hold a frame above the high one, padded and merged.

    ``smooth`` is run, idx, smooth.  Stretches above the high level less than the gap apart are one; it grows at either end as far as
    the low level is exceeded there.
    """
    gap = config.frames(0.6)
    level = smooth.groupBy("run").agg(F.avg("smooth").alias("mean"), F.stddev_pop("smooth").alias("deviation"), F.max("idx").alias("last"))
    flagged = smooth.join(level, "run").select("run", "idx", "smooth", "last", (F.col("smooth") > F.greatest(F.col("mean") + F.col("deviation"), F.lit(8.0))).alias("active"), (F.col("smooth") > F.greatest(F.col("mean") * 0.5, F.lit(3.0))).alias("weak"))
    edged = flagged.withColumns(_edges("weak"))
    numbered = edged.withColumn("place", F.col("idx") - F.row_number().over(Window.partitionBy("run", "active").orderBy("idx")))
    strong = numbered.filter("active").groupBy("run", "place").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("weak_from").alias("weak_from"), F.max("weak_to").alias("weak_to"), F.max("last").alias("last")).drop("place")
    joined = merge_intervals(strong, "start_idx", "end_idx", gap, F.min("weak_from").alias("weak_from"), F.max("weak_to").alias("weak_to"), F.max("last").alias("last"))
    pad = config.frames(0.3)
    grown = joined.select("run", F.greatest(F.col("weak_from") - pad, F.lit(0)).alias("start_idx"), F.least(F.col("weak_to") + pad, F.col("last")).alias("end_idx"))
    return merge_intervals(grown.filter(F.col("end_idx") - F.col("start_idx") >= config.frames(0.3)), "start_idx", "end_idx", gap)


def split_at_valleys(segments: DataFrame, frames: DataFrame, config: TurnConfig) -> DataFrame:
    """``segments`` cut where the body is upright for a while, where long ones turn slowly, and, where still too long, at the slowest frames.

    ``frames`` is run, idx, tilt, smooth; segments do not overlap.
    """
    fps, least, pause = config.fps, config.frames(0.3), config.frames(0.1)
    length = F.col("end_idx") - F.col("start_idx")
    long = segments.filter(length >= 1.5 * fps)
    inside = cut(within(long, frames.select("run", "idx", "tilt", "smooth")))
    very = length > 3.0 * fps
    upright = cut(_middles(_stretches(inside, F.col("tilt") < F.when(very, 35).otherwise(20), _SEGMENT), pause))
    # slow stretches of long segments, unless a cut is near
    slow_level = inside.filter(very).groupBy(*_SEGMENT).agg(F.greatest(F.avg("smooth") * 0.3, F.lit(2.0)).alias("level"))
    slow = _middles(_stretches(inside.join(slow_level, _SEGMENT), F.col("smooth") < F.col("level"), _SEGMENT), pause)
    apart = config.frames(0.5)
    order = Window.partitionBy(*_SEGMENT).orderBy("at")
    both = upright.withColumn("cut", F.col("at")).unionByName(slow.withColumn("cut", F.lit(None).cast("long")))
    nearest = both.withColumns({"before": F.last("cut", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)), "after": F.last("cut", ignorenulls=True).over(Window.partitionBy(*_SEGMENT).orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0))})
    free = nearest.filter(F.col("cut").isNull() & F.coalesce(F.col("at") - F.col("before") > apart, F.lit(True)) & F.coalesce(F.col("after") - F.col("at") > apart, F.lit(True)))
    points = upright.unionByName(_spaced(free.select(*_SEGMENT, "at"), apart))
    pieces = cut(segments.filter(length < 1.5 * fps).select(*_SEGMENT).unionByName(_pieces(long, points, least)))
    # what is too long is cut near even places, at the slowest frame around each
    most = config.frames(3.5)
    over = pieces.filter(length > most).withColumn("cuts", F.floor(length / most).cast("long"))
    centre = over.select(*_SEGMENT, F.explode(F.sequence(F.lit(1).cast("long"), F.col("cuts"))).alias("k"), (F.floor(length / (F.col("cuts") + 1))).alias("chunk"))
    around = centre.select(*_SEGMENT, "k", (F.col("start_idx") + F.greatest(F.lit(0), F.col("k") * F.col("chunk") - apart)).cast("long").alias("low"), (F.col("start_idx") + F.least(length + 1, F.col("k") * F.col("chunk") + apart) - 1).cast("long").alias("high"))
    slowest = within(around, frames.select("run", "idx", "smooth"), "low", "high").groupBy(*_SEGMENT, "k").agg(F.min(F.struct("smooth", "idx"))["idx"].alias("at"))
    return pieces.filter(length <= most).unionByName(_pieces(over, slowest.select(*_SEGMENT, "at"), least))


def hysteresis_segments(tracked: DataFrame, config: TurnConfig | None = None) -> DataFrame:
    """run, start_idx, end_idx of the turns of every run of ``tracked`` (:func:`rotation.tracking`); a run under 10 frames is one.

    Stretches of fast rotation, with what is around them, are cut at valleys and kept if they turn far and fast enough.  The smoothed
    frames are written once, as every step reads them.
    """
    config = config or TurnConfig()
    smooth = cut(tracked.select("run", "idx", "tilt", "tilt_cumulative", "twist_cumulative", smooth_zero_padded("rate", max(3, config.frames(0.1))).alias("smooth"), F.max("idx").over(Window.partitionBy("run")).alias("last")))
    whole = smooth.filter("last < 9 AND idx = last").select("run", F.lit(0).cast("long").alias("start_idx"), F.col("last").alias("end_idx"))
    longer = smooth.filter("last >= 9").drop("last")
    parts = split_at_valleys(cut(strong_regions(longer.select("run", "idx", "smooth"), config)), longer, config)
    kept = describe.plausible(parts, longer.withColumnRenamed("smooth", "rate"), config.fps, config.least_degrees)
    return whole.unionByName(kept.select(*_SEGMENT))


def body_intensity(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """run, idx, intensity of keypoint frames: 0.6 times the turning of the head about the trunk and 0.4 times its rise, smoothed, by their largest."""
    order = by_frame()
    trunk = lambda a: sum((F.col(f"{a}{i}") for i in (5, 6, 11, 12)), F.lit(0.0)) / 4
    placed = frames.select("run", "idx", trunk("y").alias("trunk_y"), F.atan2(F.col("y0") - trunk("y"), F.col("x0") - trunk("x")).alias("angle"))
    turn = F.abs(F.col("angle") - F.lag("angle").over(order))
    moved = placed.select("run", "idx", F.coalesce(F.least(turn, 2 * F.pi() - turn), F.lit(0.0)).alias("turn"), F.coalesce(F.abs(F.col("trunk_y") - F.lag("trunk_y").over(order)), F.lit(0.0)).alias("rise"))
    kernel = max(3, int(fps * 0.1))
    raw = moved.select("run", "idx", (smooth_zero_padded("turn", kernel) * 0.6 + smooth_zero_padded("rise", kernel) * 0.4).alias("raw"))
    top = raw.groupBy("run").agg((F.max("raw") + 1e-8).alias("top"))
    return raw.join(top, "run").select("run", "idx", (F.col("raw") / F.col("top")).alias("intensity"))


def intensity_segments(intensity: DataFrame, fps: float = 30.0, gap_s: float = 0.5) -> DataFrame:
    """run, start_idx, end_idx: stretches of intensity above its mean by half a deviation, joined over gaps, padded, and halved if too long."""
    gap, pad, least, most = int(gap_s * fps), int(0.15 * fps), int(0.3 * fps), int(4.0 * fps)
    level = intensity.groupBy("run").agg((F.avg("intensity") + 0.5 * F.stddev_pop("intensity")).alias("level"), F.max("idx").alias("last"))
    flagged = intensity.join(level, "run").select("run", "idx", "last", F.col("intensity").alias("smooth"), (F.col("intensity") > F.col("level")).alias("active"))
    joined = merge_intervals(islands(flagged), "start_idx", "end_idx", gap).join(level.select("run", "last"), "run")
    # a stretch ends with the frame after its last active one
    end = F.when(F.col("end_idx") == F.col("last"), F.col("last")).otherwise(F.least(F.col("last"), F.col("end_idx") + 1 + pad))
    padded = joined.select("run", F.greatest(F.lit(0), F.col("start_idx") - pad).alias("start_idx"), end.alias("end_idx"))
    merged = merge_intervals(padded.filter((F.col("end_idx") - F.col("start_idx")).between(least, most)), "start_idx", "end_idx", gap)
    middle = F.floor((F.col("start_idx") + F.col("end_idx")) / 2).cast("long")
    halves = F.when(F.col("end_idx") - F.col("start_idx") > most, F.array(F.struct(F.col("start_idx").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("end_idx").alias("e")))).otherwise(F.array(F.struct(F.col("start_idx").alias("s"), F.col("end_idx").alias("e"))))
    return merged.select("run", F.explode(halves).alias("h")).select("run", F.col("h.s").alias("start_idx"), F.col("h.e").alias("end_idx"))
