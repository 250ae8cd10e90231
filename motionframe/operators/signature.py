"""View-invariant motion signatures of keypoint sequences, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import geometry as g

_AT = g.INDEX
#: Pairs of joints whose distance is a feature, and limbs whose angle with the body axis is one.
DISTANCES = (
    ("left_wrist", "left_hip"), ("right_wrist", "right_hip"), ("left_ankle", "left_hip"), ("right_ankle", "right_hip"), ("left_wrist", "left_ankle"),
    ("right_wrist", "right_ankle"), ("left_wrist", "right_wrist"), ("left_ankle", "right_ankle"), ("nose", "left_hip"), ("nose", "right_hip"),
)
LIMBS = (
    ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"), ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("left_hip", "left_knee"), ("left_knee", "left_ankle"), ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
    ("left_shoulder", "left_hip"), ("right_shoulder", "right_hip"), ("left_shoulder", "right_shoulder"), ("left_hip", "right_hip"),
)
EXTREMITIES = ("left_wrist", "right_wrist", "left_ankle", "right_ankle")
PI = "3.141592653589793e0"
LENGTH = 60


def _far(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def _between(a: str, b: str) -> str:
    return _far(f"x{_AT[a]}", f"y{_AT[a]}", f"x{_AT[b]}", f"y{_AT[b]}")


def axis_columns() -> dict[str, str]:
    """Vector from the hips' to the shoulders' middle, its length, and the torso unit, over x0.., y0..."""
    shoulders, hips = ("left_shoulder", "right_shoulder"), ("left_hip", "right_hip")
    mid = {f"{p}{a}": g.midpoint(joints, a) for p, joints in (("s", shoulders), ("h", hips)) for a in "xy"}
    length = _far(mid["sx"], mid["sy"], mid["hx"], mid["hy"])
    return {"axis_x": f"({mid['sx']} - {mid['hx']})", "axis_y": f"({mid['sy']} - {mid['hy']})", "axis_length": length, "unit": f"greatest({length}, 1e0)", "mid_x": f"(({mid['sx']} + {mid['hx']}) / 2e0)", "mid_y": f"(({mid['sy']} + {mid['hy']}) / 2e0)", "hip_y": mid["hy"], "shoulder_y": mid["sy"]}


def feature_columns() -> list[str]:
    """The 26 features of a frame over x0.., y0.. and the columns of :func:`axis_columns`."""
    out = [f"{_between(a, b)} / unit" for a, b in DISTANCES]
    for a, b in LIMBS:
        dx, dy, size = f"(x{_AT[b]} - x{_AT[a]})", f"(y{_AT[b]} - y{_AT[a]})", _between(a, b)
        cosine = f"(({dx} * axis_x + {dy} * axis_y) / ({size} * axis_length))"
        out.append(f"CASE WHEN {size} > 0 AND axis_length > 0 THEN acos({g.clip(cosine, '-1e0', '1e0')}) / {PI} ELSE 0.5e0 END")
    reach = [_far(f"x{_AT[j]}", f"y{_AT[j]}", "mid_x", "mid_y") for j in EXTREMITIES]
    out.append("(" + " + ".join(f"{r} / unit" for r in reach) + ") / 4e0")
    ends = (*EXTREMITIES, "nose")
    out.append("greatest(" + ", ".join(f"{_between(a, b)} / unit" for i, a in enumerate(ends) for b in ends[i + 1 :]) + ")")
    arms = [f"{_between(f'{s}_wrist', f'{s}_shoulder')} / unit" for s in ("left", "right")]
    legs = [f"{_between(f'{s}_ankle', f'{s}_hip')} / unit" for s in ("left", "right")]
    out.append(f"1e0 - (abs({arms[0]} - {arms[1]}) + abs({legs[0]} - {legs[1]})) / 2e0")
    out.append(f"CASE WHEN axis_length > 0 THEN atan2(axis_x, -axis_y) / {PI} ELSE 0e0 END")
    return out


def axis_angle() -> str:
    """Degrees of the body axis from upright, 0 to 180."""
    return f"abs({g.DEGREES} * atan2(axis_x, -axis_y))"


def features(poses: DataFrame) -> DataFrame:
    """run, idx, axis_angle, hip_y, shoulder_y and the features f0.. of every frame; poses without a keypoint have null features."""
    based = poses.select("*", *(F.expr(e).alias(k) for k, e in axis_columns().items()))
    return based.select("run", "idx", "t_ms", "hip_y", "shoulder_y", F.expr(axis_angle()).alias("axis_angle"), *(F.expr(e).alias(f"f{k}") for k, e in enumerate(feature_columns())))


def facts(framed: DataFrame, fps: float = 30.0) -> DataFrame:
    """run, seconds, height, speed, inverted, inversions of each run of :func:`features`."""
    order = Window.partitionBy("run").orderBy("idx")
    before = F.lag("axis_angle").over(order)
    marked = framed.select("run", "hip_y", "shoulder_y", "axis_angle", F.abs(F.col("axis_angle") - before).alias("turn"), ((F.col("axis_angle") > 90) & ~(F.coalesce(before, F.lit(0.0)) > 90)).alias("risen"))
    torso = F.greatest(F.median(F.abs(F.col("shoulder_y") - F.col("hip_y"))), F.lit(1.0))
    return marked.groupBy("run").agg(
        (F.count("*") / fps).alias("seconds"),
        ((F.max("hip_y") - F.min("hip_y")) / torso).alias("height"),
        F.coalesce(F.avg("turn"), F.lit(0.0)).alias("speed"),
        F.bool_or(F.col("axis_angle") > 100).alias("inverted"),
        F.count_if("risen").alias("inversions"),
    )


def trajectories(framed: DataFrame, length: int = LENGTH) -> DataFrame:
    """run, step, feature, value: every feature at ``length`` even places of each run, by linear interpolation."""
    width = len(feature_columns())
    ends = framed.groupBy("run").agg(F.max("idx").alias("last"))
    wanted = ends.select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("step"), "last")
    place = F.col("step") * F.col("last") / (length - 1)
    wanted = wanted.withColumn("at", place).withColumns({"left": F.floor("at").cast("long"), "right": F.ceil("at").cast("long")})
    cells = framed.select("run", "idx", F.array(*(f"f{k}" for k in range(width))).alias("f"))
    left, right = cells.select("run", F.col("idx").alias("left"), F.col("f").alias("a")), cells.select("run", F.col("idx").alias("right"), F.col("f").alias("b"))
    both = wanted.join(left, ["run", "left"]).join(right, ["run", "right"])
    line = F.zip_with("a", "b", lambda x, y: x + (F.col("at") - F.col("left")) * (y - x))
    return both.select("run", "step", F.posexplode(line).alias("feature", "value")).select("run", "step", F.col("feature").cast("long").alias("feature"), "value")


def distances(queries: DataFrame, references: DataFrame) -> DataFrame:
    """query, reference, distance of trajectories: 0.6 of the mean squared difference and 0.4 of how little the velocities agree."""
    order = Window.partitionBy("run", "feature").orderBy("step")
    moving = lambda t, run, v: t.select(F.col("run").alias(run), "step", "feature", F.col("value").alias(v), (F.col("value") - F.lag("value").over(order)).alias(f"d{v}"))
    both = moving(queries, "query", "q").join(moving(references, "reference", "r"), ["step", "feature"])
    parts = both.groupBy("query", "reference").agg(
        F.avg((F.col("q") - F.col("r")) * (F.col("q") - F.col("r"))).alias("mse"),
        F.coalesce(F.sum(F.col("dq") * F.col("dr")), F.lit(0.0)).alias("dot"),
        F.sqrt(F.coalesce(F.sum(F.col("dq") * F.col("dq")), F.lit(0.0))).alias("nq"),
        F.sqrt(F.coalesce(F.sum(F.col("dr") * F.col("dr")), F.lit(0.0))).alias("nr"),
    )
    alike = F.when((F.col("nq") > 0) & (F.col("nr") > 0), F.col("dot") / (F.col("nq") * F.col("nr"))).otherwise(0.0)
    return parts.select("query", "reference", (F.col("mse") * 0.6 + (1 - alike) * 0.4).alias("distance"))


def _alike(a: str, b: str, floor: float):
    return F.least(a, b) / F.greatest(F.col(a), F.col(b), F.lit(floor))


def matches(measured: DataFrame, of_query: DataFrame, of_reference: DataFrame) -> DataFrame:
    """query, reference, distance, confidence, bonus: distances scaled within the query, with a bonus for like facts."""
    within = Window.partitionBy("query")
    low, high = F.min("distance").over(within), F.max("distance").over(within)
    scaled = measured.withColumn("near", F.greatest(F.lit(0.0), 1 - (F.col("distance") - low) / F.greatest(high - low, F.lit(0.01))))
    facts_of = lambda t, key, p: t.select(F.col("run").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("seconds", "height", "speed", "inverted", "inversions")))
    both = scaled.join(facts_of(of_query, "query", "q"), "query").join(facts_of(of_reference, "reference", "r"), "reference")
    bonus = (
        0.1 * _alike("q_seconds", "r_seconds", 0.1)
        + F.when(F.col("q_inverted") == F.col("r_inverted"), 0.15).otherwise(0.0)
        + F.when(F.col("q_inversions") == F.col("r_inversions"), 0.1).otherwise(0.0)
        + 0.1 * _alike("q_speed", "r_speed", 0.01)
        + 0.05 * _alike("q_height", "r_height", 0.01)
    )
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("near") * 0.7 + bonus * 0.6))
    return both.select("query", "reference", "distance", confidence.alias("confidence"), bonus.alias("bonus"))
