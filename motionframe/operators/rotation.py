"""Gravity-referenced rotation from axis-angle orientations, as quaternion columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import geometry as g
from motionframe.operators.sequence import by_frame

UP = Window.unboundedPreceding


def quaternions(frames: DataFrame) -> DataFrame:
    """Adds the unit quaternion (qw, qx, qy, qz) of the orientation and the body's up axis (ux, uy, uz)."""
    theta = F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") + F.col("oz") * F.col("oz"))
    factor = F.when(theta > 1e-12, F.sin(theta / 2) / theta).otherwise(0.5)
    turned = frames.withColumns({"qw": F.cos(theta / 2), **{f"q{a}": F.col(f"o{a}") * factor for a in "xyz"}})
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    return turned.withColumns({"ux": 2 * (x * y - w * z), "uy": 1 - 2 * (x * x + z * z), "uz": 2 * (y * z + w * x)})


def tracking(frames: DataFrame) -> DataFrame:
    """run, idx, t_ms, ux, uy, uz, tilt, tilt_cumulative, twist_cumulative, rate (degrees a frame)."""
    order = by_frame()
    q = quaternions(frames).withColumns({f"p{a}": F.lag(f"q{a}").over(order) for a in "wxyz"} | {f"b{a}": F.lag(f"u{a}").over(order) for a in "xyz"})
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    pw, px, py, pz = (F.col(f"p{a}") for a in "wxyz")
    # this frame's rotation times the inverse of the last one's
    dw = w * pw + x * px + y * py + z * pz
    dx, dy, dz = x * pw - w * px + z * py - y * pz, y * pw - w * py + x * pz - z * px, z * pw - w * pz + y * px - x * py
    moved = q.withColumns({"dw": dw, "dx": dx, "dy": dy, "dz": dz})
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    rate = F.degrees(2 * F.atan2(size, F.abs("dw")))
    along = F.when(size > 0, F.when(F.col("dw") < 0, -1.0).otherwise(1.0) * (F.col("dx") * F.col("bx") + F.col("dy") * F.col("by") + F.col("dz") * F.col("bz")) / size)
    tilt = F.degrees(F.acos(F.expr(g.clip("uy", "-1e0", "1e0"))))
    shown = moved.select("run", "idx", "t_ms", "ux", "uy", "uz", tilt.alias("tilt"), F.coalesce(rate, F.lit(0.0)).alias("rate"), F.coalesce(along, F.lit(0.0)).alias("along"))
    so_far = order.rowsBetween(UP, 0)
    return shown.withColumn("step", F.coalesce(F.abs(F.col("tilt") - F.lag("tilt").over(order)), F.lit(0.0))).select(
        "run",
        "idx",
        "t_ms",
        "ux",
        "uy",
        "uz",
        "tilt",
        F.sum("step").over(so_far).alias("tilt_cumulative"),
        F.sum(F.when(F.col("rate") > 0.01, F.col("along") * F.col("rate")).otherwise(0.0)).over(so_far).alias("twist_cumulative"),
        "rate",
    )


def swept(tracked: DataFrame) -> DataFrame:
    """Adds swept: the solid angle between the body's up axis in the frame before, in this one, and the vertical; 0 at the first frame."""
    order = by_frame()
    v = tracked.withColumns({f"b{a}": F.lag(f"u{a}").over(order) for a in "xyz"})
    cross = F.col("bz") * F.col("ux") - F.col("bx") * F.col("uz")
    below = 1 + F.col("by") + F.col("uy") + F.col("bx") * F.col("ux") + F.col("by") * F.col("uy") + F.col("bz") * F.col("uz")
    part = F.when(F.abs(below) > 1e-10, 2 * F.atan2(cross, below)).otherwise(0.0)
    return v.withColumn("swept", F.coalesce(part, F.lit(0.0))).drop("bx", "by", "bz")


def geometric_phase(tracked: DataFrame) -> DataFrame:
    """run, phase: the solid angle in degrees that the body's up axis sweeps around the vertical."""
    return swept(tracked).groupBy("run").agg(F.degrees(F.sum("swept")).alias("phase"))


def inversion_crossings(tracked: DataFrame, level: float = 90.0) -> DataFrame:
    """run, crossings in either direction, rising crossings, whether the tilt ever exceeds 100 degrees."""
    before = F.lag("tilt").over(by_frame())
    marked = tracked.select("run", "tilt", ((F.col("tilt") > level) != (before > level)).alias("crossed"), ((F.col("tilt") > level) & (before <= level)).alias("risen"))
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias
    return marked.groupBy("run").agg(count("crossed")("crossings"), count("risen")("rising"), F.bool_or(F.col("tilt") > 100).alias("inverted"))


def physics(tracked: DataFrame) -> DataFrame:
    """run, flips, twists (snapped to halves), their raw degrees, the largest tilt and the rotation axis of each run."""
    turned = tracked.groupBy("run").agg(
        (F.max_by("tilt_cumulative", "idx") - F.min_by("tilt_cumulative", "idx")).alias("flip_deg"),
        F.abs(F.max_by("twist_cumulative", "idx") - F.min_by("twist_cumulative", "idx")).alias("twist_raw"),
        F.max("tilt").alias("max_tilt"),
        F.greatest(F.median("rate"), F.lit(5.0)).alias("level"),
    )
    peak = tracked.join(turned.select("run", "level"), "run").filter(F.col("rate") > F.col("level")).groupBy("run").agg(F.median("tilt").alias("peak_tilt"))
    every = tracked.groupBy("run").agg(F.median("tilt").alias("any_tilt"))
    both = turned.join(geometric_phase(tracked), "run").join(every, "run").join(peak, "run", "left")
    counted = both.withColumns({"flip_raw": F.col("flip_deg") / 360, "twist_deg": F.greatest(F.lit(0.0), F.col("twist_raw") - F.abs("phase"))}).withColumn("twist_count", F.col("twist_deg") / 360)
    middle = F.coalesce("peak_tilt", "any_tilt")
    axis = (
        F.when((F.col("flip_raw") < 0.2) & (F.col("twist_count") > 0.5), "longitudinal")
        .when((F.col("max_tilt") > 120) & (F.col("twist_count") > 0.3) & (middle > 30) & (middle < 80) & (F.col("max_tilt") < 155), "off_axis")
        .otherwise("lateral")
    )
    return counted.select(
        "run",
        F.round(F.expr(g.snap_to_half("flip_raw")), 1).alias("flips"),
        F.round(F.expr(g.snap_to_half("twist_count")), 1).alias("twists"),
        "flip_deg",
        "twist_deg",
        "max_tilt",
        (F.col("max_tilt") > 120).alias("inverted"),
        axis.alias("axis"),
    )


def _least(a: Column, b: float) -> Column:
    return F.least(a, F.lit(b))


def soft_shapes(df: DataFrame, knee: Column, hip: Column, shoulder: Column) -> DataFrame:
    """Adds soft scores of tuck, pike, layout and open from the bends in degrees, and the largest one's name."""
    tuck = F.when((knee > 70) & (hip > 50), _least((knee - 70) / 50 * (hip - 50) / 50, 1.0)).when((knee > 55) & (hip > 40), 0.3).otherwise(0.0)
    pike = F.when((knee < 50) & (hip > 50), _least((50 - knee) / 50 * (hip - 50) / 50, 1.0)).otherwise(0.0)
    base = F.when((knee < 50) & (hip < 40), _least((50 - knee) / 50 * (40 - hip) / 40, 1.0)).otherwise(0.0)
    opened = F.when(shoulder > 40, base * _least((shoulder - 40) / 60, 1.0)).otherwise(0.0)
    layout = F.when(shoulder > 40, base * (1 - opened)).otherwise(base)
    raw = df.withColumns({"tuck": tuck, "pike": pike, "layout": layout, "open": opened})
    total = F.col("tuck") + F.col("pike") + F.col("layout") + F.col("open")
    shares = raw.withColumns({k: F.when(total > 0, F.col(k) / total).otherwise(1.0 if k == "layout" else 0.0) for k in ("tuck", "pike", "layout", "open")})
    most = F.greatest("tuck", "pike", "layout", "open")
    return shares.withColumn("shape", F.when(F.col("tuck") == most, "tuck").when(F.col("pike") == most, "pike").when(F.col("layout") == most, "layout").otherwise("open"))


def shape_scores(frames: DataFrame) -> DataFrame:
    """run, idx, soft scores of tuck, pike, layout and open from the joint magnitudes, and the largest one's name."""
    means = {"knee": ("j3", "j4"), "hip": ("j0", "j1"), "shoulder": ("j15", "j16")}
    knee, hip, shoulder = (((F.col(a) + F.col(b)) / 2) for a, b in means.values())
    return soft_shapes(frames, knee, hip, shoulder).select("run", "idx", "tuck", "pike", "layout", "open", "shape")
