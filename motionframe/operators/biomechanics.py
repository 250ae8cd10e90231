"""From body meshes to flips, jumps and entries: a row a frame, then a row a segment.

Frames are run, idx (0, 1, ...), t_ms, the orientation (ox, oy, oz), the place (tx, ty, tz with y upwards), joint magnitudes j0.. to
j18 in degrees, and left_ankle and right_ankle, their heights, null where the joints' places are not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.operators import rotation
from motionframe.operators.intervals import within
from motionframe.operators.sequence import by_frame

#: Metres above the ground from which the lower ankle is in the air; the body's centre counts from twice as much.
AIRBORNE = 0.15
#: So many frames at a run's start show the ground, and so many at a segment's start the entry.
FIRST = 10
#: Metres a second.
RUNNING, REBOUND_BEFORE, REBOUND_AFTER = 1.5, 0.5, 0.3
_SEGMENT = ["run", "start_idx", "end_idx"]


def joint_means() -> dict[str, Column]:
    """Mean magnitudes of the body's bends, by name."""
    parts = {"knee": (3, 4), "hip": (0, 1), "spine": (2, 5, 8), "shoulder": (15, 16), "elbow": (17, 18)}
    return {name: sum((F.col(f"j{k}") for k in of), F.lit(0.0)) / len(of) for name, of in parts.items()}


def frame_turns(frames: DataFrame) -> DataFrame:
    """run, idx, flip, twist (degrees) and axis (ax, ay, az) of the rotation from each frame to the next, about and along the body's up axis.

    All are 0 at a run's first frame; the axis is 0 where nothing turns.
    """
    order = by_frame()
    q = rotation.quaternions(frames).select("run", "idx", *(f"q{a}" for a in "wxyz"), *(F.lag(f"q{a}").over(order).alias(f"p{a}") for a in "wxyz"), *(F.lag(f"u{a}").over(order).alias(f"b{a}") for a in "xyz"))
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    pw, px, py, pz = (F.col(f"p{a}") for a in "wxyz")
    step = {"dw": w * pw + x * px + y * py + z * pz, "dx": x * pw - w * px + z * py - y * pz, "dy": y * pw - w * py + x * pz - z * px, "dz": z * pw - w * pz + y * px - x * py}
    moved = q.withColumns(step).withColumn("along", F.col("dx") * F.col("bx") + F.col("dy") * F.col("by") + F.col("dz") * F.col("bz"))
    size = F.sqrt(F.col("along") * F.col("along") + F.col("dw") * F.col("dw"))
    turned = moved.withColumns({"norm": size, "cw": F.try_divide(F.col("dw"), size), "cy": F.try_divide(F.col("along"), size)})
    dw, cw, cy = F.col("dw"), F.col("cw"), F.col("cy")
    # what is left of the step once the turn along the body's axis is undone
    swing = {
        "sw": dw * cw + cy * F.col("along"),
        "sx": cw * F.col("dx") - dw * cy * F.col("bx") - cy * (F.col("dy") * F.col("bz") - F.col("dz") * F.col("by")),
        "sy": cw * F.col("dy") - dw * cy * F.col("by") - cy * (F.col("dz") * F.col("bx") - F.col("dx") * F.col("bz")),
        "sz": cw * F.col("dz") - dw * cy * F.col("bz") - cy * (F.col("dx") * F.col("by") - F.col("dy") * F.col("bx")),
    }
    across = turned.withColumns(swing).withColumns({"side": F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")), "whole": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))})
    side, whole, known = F.col("side"), F.col("whole"), F.col("norm") >= 1e-10
    lateral = F.when(F.col("sw") < 0, -1.0).otherwise(1.0) * F.try_divide(F.col("sx"), side)
    sign = F.when((2 * F.atan2(side, F.abs("sw")) > 1e-6) & (F.abs(lateral) > 0.3), F.signum(lateral)).otherwise(1.0)
    flip = F.degrees(2 * F.atan2(side, F.abs("sw"))) * sign
    twist = F.degrees(2 * F.atan2(F.abs(cy), F.abs(cw))) * F.signum("along")
    unit = F.when(2 * F.atan2(whole, F.abs(dw)) > 1e-6, F.when(dw < 0, -1.0).otherwise(1.0) / whole)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return across.select("run", "idx", zero(F.when(known, flip)).alias("flip"), zero(F.when(known, twist)).alias("twist"), *(zero(F.col(f"d{a}") * unit).alias(f"a{a}") for a in "xyz"))


def biomechanics(frames: DataFrame, fps: float = 30.0, ground: float | None = None) -> DataFrame:
    """A row a frame: accumulated flip and twist, axis, bends, velocity (metres a second), height of the centre and whether it is airborne.

    The ground of a run is the lowest ankle of its first frames, or centre where the ankles are not known, unless ``ground`` is given.
    """
    order = by_frame()
    ankle = F.least("left_ankle", "right_ankle")
    if ground is None:
        lowest = frames.filter(F.col("idx") < FIRST).groupBy("run").agg(F.min(F.when(F.col("left_ankle").isNull() | F.col("right_ankle").isNull(), F.col("ty")).otherwise(ankle)).alias("ground"))
        levelled = frames.join(lowest, "run")
    else:
        levelled = frames.withColumn("ground", F.lit(float(ground)))
    height = F.col("ty") - F.col("ground")
    airborne = F.when(F.col("left_ankle").isNull() | F.col("right_ankle").isNull(), height > AIRBORNE * 2).otherwise(ankle - F.col("ground") > AIRBORNE)
    speed = {f"v{a}": F.coalesce((F.col(f"t{a}") - F.lag(f"t{a}").over(order)) * fps, F.lit(0.0)) for a in "xyz"}
    shown = levelled.select("run", "idx", "t_ms", *(c.alias(k) for k, c in joint_means().items()), *(c.alias(k) for k, c in speed.items()), height.alias("height"), airborne.alias("airborne"))
    so_far = order.rowsBetween(rotation.UP, 0)
    return shown.join(frame_turns(frames), ["run", "idx"]).withColumns({"flip": F.sum("flip").over(so_far), "twist": F.sum("twist").over(so_far)})


def _first_entry() -> list[Column]:
    """Aggregates that tell how a segment begins: its first frame in the air among the first ``FIRST``, and the speeds there and two before."""
    early = F.when(F.col("airborne") & (F.col("idx") < F.col("start_idx") + FIRST), F.col("idx"))
    return [F.min(early).alias("takeoff"), F.min_by(F.struct("vx", "vy", "vz", "bvx", "bvy", "bvz"), early).alias("e")]


def _entry() -> Column:
    at = F.col("takeoff") - F.col("start_idx")
    now, before = [F.col(f"e.v{a}") for a in "xyz"], [F.col(f"e.bv{a}") for a in "xyz"]
    speed, came = F.sqrt(now[0] * now[0] + now[2] * now[2]), F.sqrt(before[0] * before[0] + before[2] * before[2])
    turned = sum((a * b for a, b in zip(now, before, strict=True)), F.lit(0.0)) < 0
    return F.when(at.isNull() | (at == 0), "standing").when(speed > RUNNING, "running").when((at >= 2) & (came > REBOUND_BEFORE) & (speed > REBOUND_AFTER) & turned, "wall").otherwise("standing")


def _with_earlier_speed(body: DataFrame) -> DataFrame:
    return body.withColumns({f"bv{a}": F.lag(f"v{a}", 2).over(by_frame()) for a in "xyz"})


def entries(segments: DataFrame, body: DataFrame) -> DataFrame:
    """run, start_idx, end_idx, entry of every segment with frames: running by the speed at takeoff, wall if it turned back just before, else standing."""
    of = within(segments.select(*_SEGMENT), _with_earlier_speed(body)).groupBy(*_SEGMENT).agg(*_first_entry())
    return of.select(*_SEGMENT, _entry().alias("entry"))


def signatures(segments: DataFrame, body: DataFrame) -> DataFrame:
    """What each segment is, from :func:`biomechanics`: axis and bends over its airborne frames, or all if there is none, and totals over all.

    A segment that does not end after it starts, or has no frames, gets the defaults: nothing turns, forward, layout, standing.
    """
    air = lambda c: F.coalesce(F.avg(F.when(F.col("airborne"), c)), F.avg(c))
    turns = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az") > 0.01
    in_air = lambda c: F.when(F.max("airborne"), F.avg(F.when(F.col("airborne") & turns, c))).otherwise(F.avg(F.when(turns, c)))
    inside = within(segments.select(*_SEGMENT).filter("end_idx > start_idx"), _with_earlier_speed(body))
    of = inside.groupBy(*_SEGMENT).agg(
        (F.max_by("flip", "idx") - F.min_by("flip", "idx")).alias("flip_deg"),
        (F.max_by("twist", "idx") - F.min_by("twist", "idx")).alias("twist_deg"),
        *(in_air(F.col(f"a{a}")).alias(f"m{a}") for a in "xyz"),
        *(air(F.col(k)).alias(k) for k in ("knee", "hip", "shoulder")),
        F.max("height").alias("peak_height"),
        ((F.max_by("t_ms", "idx") - F.min_by("t_ms", "idx")) / 1000).alias("seconds"),
        *_first_entry(),
    )
    norm = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    shaped = rotation.soft_shapes(of.withColumn("entry", _entry()), F.col("knee"), F.col("hip"), F.col("shoulder"))
    made = shaped.select(
        *_SEGMENT,
        *(F.when(norm > 1e-6, F.col(f"m{a}") / norm).otherwise(d).alias(f"a{a}") for a, d in (("x", 1.0), ("y", 0.0), ("z", 0.0))),
        "flip_deg",
        "twist_deg",
        F.when(F.col("flip_deg") > 0, "backward").otherwise("forward").alias("direction"),
        "shape",
        "knee",
        "hip",
        "entry",
        "peak_height",
        "seconds",
    )
    whole = segments.select(*_SEGMENT).join(made, _SEGMENT, "left")
    defaults = {"ax": 1.0, "ay": 0.0, "az": 0.0, "flip_deg": 0.0, "twist_deg": 0.0, "direction": "forward", "shape": "layout", "knee": 180.0, "hip": 180.0, "entry": "standing", "peak_height": 0.0, "seconds": 0.0}
    return whole.select(*_SEGMENT, *(F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()))
