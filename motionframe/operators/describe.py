"""What a segment of rotation frames is: plausibility, axis, direction, shape and entry, as a signature for the matcher.

Frames are run, idx, t_ms, the orientation (ox, oy, oz), the place (tx, ty, tz) and joint magnitudes j0.. in degrees; segments
are run, start_idx, end_idx.  Every step is a window or an aggregation over the frames of a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import geometry as g
from motionframe.operators import matching, rotation
from motionframe.operators.intervals import within
from motionframe.operators.sequence import by_frame
from motionframe.sources import storage

_SEGMENT = ["run", "start_idx", "end_idx"]


def frames_of(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames of every segment, with start_idx and end_idx; overlapping segments each have their own rows."""
    return within(segments.select(*_SEGMENT), frames)


def plausible(segments: DataFrame, tracked: DataFrame, fps: float = 30.0, least_degrees: float = 120.0) -> DataFrame:
    """The segments that turn far and fast enough for their length."""
    inside = frames_of(segments, tracked)
    of = inside.groupBy(*_SEGMENT).agg(
        F.abs(F.max_by("tilt_cumulative", "idx") - F.min_by("tilt_cumulative", "idx")).alias("turned"),
        F.abs(F.max_by("twist_cumulative", "idx") - F.min_by("twist_cumulative", "idx")).alias("twisted"),
        F.max("rate").alias("peak"),
        F.max("tilt").alias("max_tilt"),
    )
    seconds = (F.col("end_idx") - F.col("start_idx")) / fps
    short = (seconds < 0.5) & (F.col("turned") < 200)
    low = (seconds < 0.8) & (F.col("max_tilt") < 60) & (F.col("turned") < 180)
    kept = of.filter((F.col("turned") + F.col("twisted") * 0.7 >= least_degrees) & (F.col("peak") >= 8.0) & ~short & ~low)
    return kept.select(*_SEGMENT)


def smoothing_width(frames: DataFrame) -> DataFrame:
    """run, sigma: how wide to smooth a run's orientations, by how much they jitter."""
    order = by_frame()
    steps = [F.col(f"o{a}") - F.lag(f"o{a}").over(order) for a in "xyz"]
    jitter = frames.select("run", F.sqrt(steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]).alias("jitter")).groupBy("run").agg(F.median("jitter").alias("jitter"))
    return jitter.select("run", F.when(F.col("jitter") > 0.15, 3.0).when(F.col("jitter") > 0.08, 2.0).otherwise(1.5).alias("sigma"))


def swing_and_twist(frames: DataFrame) -> DataFrame:
    """run, idx, swing, twist in degrees of every orientation about the body's long axis (y); both 0 for half turns across it."""
    q = rotation.quaternions(frames)
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    norm = F.sqrt(y * y + w * w)
    cy, cw = y / norm, w / norm
    # swing: this rotation times the inverse of the twist (0, cy, 0, cw)
    sw, sx, sz = w * cw + y * cy, x * cw + z * cy, z * cw - x * cy
    size = F.sqrt(sx * sx + sz * sz)
    flip = F.when(sw < 0, -1.0).otherwise(1.0)
    along = F.when(size > 1e-6, flip * sx / size)
    sign = F.when(F.abs(along) > 0.3, F.signum(along)).otherwise(1.0)
    swing = F.degrees(2 * F.atan2(size, F.abs(sw))) * sign
    twist = F.degrees(2 * F.atan2(F.abs(cy), F.abs(cw))) * F.signum(y)
    known = norm >= 1e-10
    return q.select("run", "idx", F.when(known, swing).otherwise(0.0).alias("swing"), F.when(known, twist).otherwise(0.0).alias("twist"))


def turned_vectors(frames: DataFrame) -> DataFrame:
    """Adds the body's right and forward axes (rx, ry, rz and fx, fy, fz) to :func:`rotation.quaternions`."""
    q = rotation.quaternions(frames)
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    right = {"rx": 1 - 2 * (y * y + z * z), "ry": 2 * (x * y + w * z), "rz": 2 * (x * z - w * y)}
    forward = {"fx": 2 * (x * z + w * y), "fy": 2 * (y * z - w * x), "fz": 1 - 2 * (x * x + y * y)}
    return q.withColumns(right | forward)


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _fields(at: str, names: str) -> list[Column]:
    return [F.col(f"{at}.{n}{a}") for n in names for a in "xyz"]


def _basis() -> Column:
    return F.struct(*(f"{n}{a}" for n in "urf" for a in "xyz"))


def flip_axis(segments: DataFrame, turned: DataFrame) -> DataFrame:
    """run, start_idx, end_idx, axis: lateral or sagittal, from the frame whose tilt is nearest to 45 degrees, the first of equals.

    ``turned`` is :func:`turned_vectors` with the tilt.
    """
    inside = frames_of(segments, turned).withColumn("basis", _basis())
    ends = inside.groupBy(*_SEGMENT).agg(F.min_by("basis", "idx").alias("s"), F.min_by("basis", F.struct(F.abs(F.col("tilt") - 45), "idx")).alias("m"))
    cross = _cross(_fields("s", "u"), _fields("m", "u"))
    size = F.sqrt(_dot(cross, cross))
    across, ahead = F.abs(_dot(cross, _fields("s", "r"))), F.abs(_dot(cross, _fields("s", "f")))
    return ends.select(*_SEGMENT, F.when(size > 0.1, F.when(across > ahead, "lateral").otherwise("sagittal")).otherwise("lateral").alias("axis"))


def direction(segments: DataFrame, turned: DataFrame) -> DataFrame:
    """run, start_idx, end_idx, direction: which way the head goes once the tilt has grown by 25 degrees; backward where nothing shows it.

    The reference frame is the most upright of the first 30 percent, the first of equals.
    """
    inside = frames_of(segments, turned).withColumn("basis", _basis())
    early = F.floor((F.col("end_idx") - F.col("start_idx") + 1) * 0.3)
    at_start = (F.col("idx") - F.col("start_idx") < early) | (F.col("idx") == F.col("start_idx"))
    upright = inside.filter(at_start).groupBy(*_SEGMENT).agg(F.min(F.struct("tilt", "idx")).alias("least"), F.min_by("basis", F.struct("tilt", "idx")).alias("r"))
    later = inside.join(upright, _SEGMENT).filter((F.col("idx") > F.col("least.idx")) & (F.col("tilt") - F.col("least.tilt") > 25) & (F.col("tilt") < 90))
    cross = _cross(_fields("r", "u"), _fields("basis", "u"))
    shown = later.select(*_SEGMENT, "idx", F.sqrt(_dot(cross, cross)).alias("size"), _dot(cross, _fields("r", "r")).alias("across"), _dot(cross, _fields("r", "f")).alias("ahead")).filter("size >= 0.01")
    first = shown.groupBy(*_SEGMENT).agg(F.min_by(F.struct("across", "ahead"), "idx").alias("c"))
    led = F.when(F.abs("c.across") > F.abs("c.ahead"), F.col("c.across")).otherwise(F.col("c.ahead"))
    inverted = inside.groupBy(*_SEGMENT).agg((F.max("tilt") > 120).alias("inverted"))
    found = segments.select(*_SEGMENT).join(inverted, _SEGMENT).join(first, _SEGMENT, "left")
    return found.select(*_SEGMENT, F.when(F.col("inverted") & (led > 0), "forward").otherwise("backward").alias("direction"))


def shape(segments: DataFrame, tracked: DataFrame) -> DataFrame:
    """run, start_idx, end_idx, shape from the knees and hips of every second frame of the highest tilt; tuck where none is high."""
    inside = frames_of(segments, tracked)
    level = inside.groupBy(*_SEGMENT).agg(F.greatest(F.percentile("tilt", 0.7), F.lit(30.0)).alias("level"))
    order = Window.partitionBy(*_SEGMENT).orderBy("idx")
    high = inside.join(level, _SEGMENT).filter(F.col("tilt") > F.col("level")).withColumn("nth", F.row_number().over(order)).filter("nth % 2 = 1")
    means = high.groupBy(*_SEGMENT).agg(F.avg(F.greatest("j3", "j4")).alias("knee"), F.avg(F.greatest("j0", "j1")).alias("hip"))
    knee, hip = F.col("knee"), F.col("hip")
    named = F.when(knee.isNull(), "tuck").when((knee > 45) & (hip > 30), "tuck").when((knee < 35) & (hip > 30), "pike").when((knee < 45) & (hip < 25), "layout").when((knee + hip) / 2 > 40, "tuck").otherwise("layout")
    return segments.select(*_SEGMENT).join(means, _SEGMENT, "left").select(*_SEGMENT, named.alias("shape"))


def entry(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """run, start_idx, end_idx, entry: running by the speed over the ten frames before, wall by the height gained, else standing."""
    order = by_frame()
    stepped = frames.withColumn("step", F.sqrt((F.col("tx") - F.lag("tx").over(order)) * (F.col("tx") - F.lag("tx").over(order)) + (F.col("tz") - F.lag("tz").over(order)) * (F.col("tz") - F.lag("tz").over(order))))
    near = within(segments.select(*_SEGMENT, (F.col("start_idx") - 15).alias("from_idx")), stepped, "from_idx", "start_idx")
    before = F.col("start_idx") - F.col("idx")
    of = near.groupBy(*_SEGMENT).agg(
        F.avg(F.when(before.between(1, 9), F.col("step"))).alias("speed"),
        F.count_if(before.between(1, 10)).alias("steps"),
        F.avg(F.when(before >= 1, F.col("ty"))).alias("height"),
        F.count_if(before >= 1).alias("heights"),
        F.max(F.when(before == 0, F.col("ty"))).alias("now"),
    )
    # of ten frames before, the first has no step of its own among them
    running = (F.col("steps") > 3) & (F.col("speed") > 0.05)
    wall = (F.col("heights") > 3) & (F.col("now") - F.col("height") > 0.3)
    return of.select(*_SEGMENT, F.when(F.col("start_idx") < 5, "standing").when(running, "running").when(wall, "wall").otherwise("standing").alias("entry"))


def physics(segments: DataFrame, frames: DataFrame, tracked: DataFrame) -> DataFrame:
    """Everything that tells what was turned in each segment: flips and twists (snapped, raw and in degrees), axis and its angle, direction, shape, entry.

    ``frames`` has orientations, places and joints, ``tracked`` is :func:`rotation.tracking` of them.  The twist is what is left of the
    turning along the body's axis once the solid angle that the axis swept is taken off.  A turn with twist is off axis if the tilt in its
    faster half of frames is middling and never near the vertical.
    """
    keys = storage.cut(segments.select(*_SEGMENT))
    shown = rotation.swept(tracked.select("run", "idx", "ux", "uy", "uz", "tilt", "tilt_cumulative", "twist_cumulative", "rate")).drop("ux", "uy", "uz")
    # every part reads the frames with all that is known of them, so they are put together once
    whole = storage.cut(turned_vectors(frames).join(shown, ["run", "idx"]))
    inside = frames_of(keys, whole.select("run", "idx", "tilt", "tilt_cumulative", "twist_cumulative", "rate", "swept"))
    of = inside.groupBy(*_SEGMENT).agg(
        (F.max_by("tilt_cumulative", "idx") - F.min_by("tilt_cumulative", "idx")).alias("flip_deg"),
        F.abs(F.max_by("twist_cumulative", "idx") - F.min_by("twist_cumulative", "idx")).alias("twist_deg_raw"),
        F.abs(F.degrees(F.sum(F.when(F.col("idx") > F.col("start_idx"), F.col("swept")).otherwise(0.0)))).alias("phase_deg"),
        F.max("tilt").alias("max_tilt"),
        F.greatest(F.median("rate"), F.lit(5.0)).alias("level"),
        F.avg("tilt").alias("any_mean"),
        F.median("tilt").alias("any_median"),
    )
    fast = inside.join(of.select(*_SEGMENT, "level"), _SEGMENT).filter(F.col("rate") > F.col("level")).groupBy(*_SEGMENT).agg(F.avg("tilt").alias("peak_mean"), F.median("tilt").alias("peak_median"))
    named = of.join(fast, _SEGMENT, "left")
    for part in (flip_axis(keys, whole).withColumnRenamed("axis", "flip_axis"), direction(keys, whole), shape(keys, whole), entry(keys, whole)):
        named = named.join(part, _SEGMENT)
    counted = named.withColumn("twist_deg", F.greatest(F.lit(0.0), F.col("twist_deg_raw") - F.col("phase_deg"))).withColumns({"flip_raw": F.col("flip_deg") / 360, "twist_raw": F.col("twist_deg") / 360, "inverted": F.col("max_tilt") > 120})
    middle, mean = F.coalesce("peak_median", "any_median"), F.coalesce("peak_mean", "any_mean")
    spin = (F.col("flip_raw") < 0.2) & (F.col("twist_raw") > 0.5)
    cork = F.col("inverted") & (F.col("twist_raw") > 0.3) & (middle > 30) & (middle < 80) & (F.col("max_tilt") < 155)
    plain = F.col("inverted") & (F.col("twist_raw") < 0.3)
    snapped = lambda c: F.round(F.expr(g.snap_to_half(c)), 1)
    return counted.select(
        *_SEGMENT,
        snapped("flip_raw").alias("flips"),
        snapped("twist_raw").alias("twists"),
        F.round("flip_raw", 2).alias("flips_raw"),
        F.round("twist_raw", 2).alias("twists_raw"),
        *(F.round(c, 1).alias(c) for c in ("flip_deg", "twist_deg", "twist_deg_raw", "phase_deg", "max_tilt")),
        F.when(spin, "longitudinal").when(plain, F.col("flip_axis")).when(cork, "off_axis").otherwise("lateral").alias("axis"),
        F.round(F.when(spin, 0.0).when(~plain & cork, mean).otherwise(90.0), 1).alias("axis_angle"),
        "direction",
        "shape",
        "entry",
        "inverted",
    )


def axis_class(x: Column, y: Column, z: Column) -> Column:
    """The named axis that a rotation vector follows, tried in the order lateral, sagittal, longitudinal."""
    norm = F.sqrt(x * x + y * y + z * z)
    share = lambda c: F.when(norm > 0, F.abs(c) / norm).otherwise(0.0)
    return F.when(share(x) > 0.6, "lateral").when(share(z) > 0.6, "sagittal").when(share(y) > 0.6, "longitudinal").otherwise("off_axis")


def signatures(described: DataFrame, frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Rows for the matcher of segments described by axis, direction, flips, twists, shape and entry."""
    inside = frames_of(described, frames).groupBy(*_SEGMENT).agg((F.max("ty") - F.min("ty")).alias("height"))
    part = lambda k: F.coalesce(*(F.when(F.col("axis") == name, F.lit(float(v[k]))) for name, v in matching.AXIS_VECTORS.items() if name != "off_axis"), F.lit((0.7071067811865476, 0.7071067811865476, 0.0)[k]))
    sign = F.when(F.col("direction") == "backward", 1.0).otherwise(-1.0)
    return described.join(inside, _SEGMENT).select(
        *_SEGMENT,
        *(part(k).alias(f"a{a}") for k, a in enumerate("xyz")),
        (F.col("flips") * 360.0 * sign).alias("flip_deg"),
        (F.col("twists") * 360.0).alias("twist_deg"),
        F.col("direction").alias("sig_direction"),
        F.col("shape").alias("sig_shape"),
        F.col("entry").alias("sig_entry"),
        "height",
        ((F.col("end_idx") - F.col("start_idx")) / fps).alias("seconds"),
        (F.col("start_idx") * 1000.0 / fps).alias("start_ms"),
        (F.col("end_idx") * 1000.0 / fps).alias("end_ms"),
    )


def band_names() -> str:
    """SQL text of the names that a segment's rotation allows, best first, over rot, flips, twists, twist_rate, side, direction and shape.

    The bands, their order and names are fixed values.
    """
    high = "(twist_rate > 0.015 OR twists >= 0.8)"
    single = f"CASE WHEN {high} AND flips >= 0.7 THEN CASE WHEN twists >= 1.5 THEN array('Double Full') ELSE array('Back Full') END WHEN side THEN array('Side Flip') WHEN direction = 'backward' THEN CASE WHEN shape = 'layout' THEN array('Back Layout') ELSE array('Back Flip') END ELSE array('Front Flip') END"
    half = f"CASE WHEN {high} THEN array('B-Twist', 'Raiz') WHEN side THEN array('Aerial') WHEN direction = 'backward' THEN array('Macaco', 'Krok') ELSE array('Front Half', 'Krok') END"
    more = f"CASE WHEN {high} THEN array('Raiz Pop Full', 'Cork') ELSE array('Castaway') END"
    double = f"CASE WHEN {high} THEN array('Double Full', 'Double Cork') ELSE array('Double Back') END"
    triple = f"CASE WHEN {high} THEN array('Triple Full') ELSE array('Triple Back') END"
    return (
        f"CASE WHEN rot < 90 THEN array('Transition/Setup') WHEN rot > 250 AND rot < 500 THEN {single} WHEN rot > 120 AND rot <= 250 THEN {half} "
        f"WHEN rot > 500 AND rot < 680 THEN {more} WHEN rot > 680 AND rot < 850 THEN {double} WHEN rot >= 850 THEN {triple} "
        f"WHEN rot >= 90 AND rot <= 120 THEN array('Wall Flip', 'Roundoff') ELSE array('Unknown') END"
    )


def band_candidates(segments: DataFrame) -> DataFrame:
    """Adds candidates, the names of :func:`band_names`."""
    return segments.withColumn("candidates", F.expr(band_names()))
