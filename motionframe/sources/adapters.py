"""Adapters from general tables to the shapes of the motion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_MS = 100.0 / 3.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch_ms(column: str):
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) div 1000")


def signal_frames(events: DataFrame) -> DataFrame:
    """run, idx, t_ms, v: every user's events as one signal in the order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("run"), (F.row_number().over(order) - 1).cast("long").alias("idx"), _epoch_ms("ts").alias("t_ms"), F.col("value").alias("v"))


def _indexed(embeddings: DataFrame) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    return embeddings.select(F.col("label").cast("long").alias("run"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "embedding").withColumn("t_ms", F.col("idx") * FRAME_MS)


def _value(i: int):
    return F.col("embedding")[i].cast("double")


def pose_frames(embeddings: DataFrame, confidence_scale: float = 4.0) -> DataFrame:
    """run, idx, t_ms and the flat keypoint columns x0.., y0.., c0..; one row a frame."""
    points = [c for i in range(17) for c in (_value(2 * i).alias(f"x{i}"), _value(2 * i + 1).alias(f"y{i}"), (F.abs(_value(34 + i)) * confidence_scale).alias(f"c{i}"))]
    return _indexed(embeddings).select("run", "idx", "t_ms", *points)


def rotation_frames(embeddings: DataFrame, scale: float = 4.0) -> DataFrame:
    """run, idx, t_ms, orientation (ox, oy, oz), place (tx, ty, tz) and the magnitudes in degrees of 19 body joints."""
    cell = lambda i: _value(i) if i < 64 else F.lit(0.0)
    joints = [F.degrees(F.sqrt(sum((cell(6 + 3 * j + k) * cell(6 + 3 * j + k) for k in range(3)), F.lit(0.0)))).alias(f"j{j}") for j in range(19)]
    return _indexed(embeddings).select(
        "run", "idx", "t_ms", *((_value(k) * scale).alias(f"o{a}") for k, a in enumerate("xyz")), *(_value(3 + k).alias(f"t{a}") for k, a in enumerate("xyz")), *joints
    )


def ankles(embeddings: DataFrame) -> DataFrame:
    """run, idx, left_ankle, right_ankle: heights about a metre below the body's centre; every fourth frame has none."""
    height = lambda i: F.when(F.col("idx") % 4 != 3, _value(4) - 1 + _value(i)).alias
    return _indexed(embeddings).select("run", "idx", height(60)("left_ankle"), height(61)("right_ankle"))


def person_boxes(events: DataFrame) -> DataFrame:
    """run, idx, x0, y0, x1, y1, width, height: a box for each frame of the signal but every third, and but those of the first five whose value is under 5."""
    v, at = F.col("v"), F.col("idx")
    seen = (at % 3 != 0) & ((at >= 5) | (v >= 5))
    corner = lambda c: F.when(seen, c)
    left, top = v * 12.0, v * 7.0
    return signal_frames(events).select(
        "run", "idx", corner(left).alias("x0"), corner(top).alias("y0"), corner(left + 60 + at % 7 * 40).alias("x1"), corner(top + 90 + at % 5 * 50).alias("y1"), F.lit(1280.0).alias("width"), F.lit(720.0).alias("height")
    )


def detections(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """run, detection_id, trick_id, confidence, start_ms, end_ms."""
    sold = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(part, lineitem.l_partkey == part.p_partkey)
    return sold.select(
        F.col("o_custkey").alias("run"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("detection_id"),
        F.col("p_brand").alias("trick_id"),
        (1 - 5 * F.col("l_discount")).alias("confidence"),
        _epoch_ms("l_shipdate").alias("start_ms"),
        (_epoch_ms("l_shipdate") + (F.col("l_quantity") * 20 * 86_400_000).cast("long")).alias("end_ms"),
    )


#: Fixed values of the physics catalog, by key modulo their number.
AXES = ("lateral", "sagittal", "longitudinal", "off_axis")
DIRECTIONS = ("backward", "forward")
SHAPES = ("tuck", "pike", "layout", "open")
ENTRIES = ("standing", "running", "wall")
CONTEXTS = ("ground", "wall", "bar_or_rail")


def _pick(values: tuple[str, ...], divisor: int):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(F.col("p_partkey") / divisor) % len(values) + 1).cast("int"))


def physics_catalog(part: DataFrame) -> DataFrame:
    """trick_id, name, flips, twists, axis, direction, shape, entry, context, score."""
    return part.select(
        F.col("p_partkey").alias("trick_id"),
        F.col("p_name").alias("name"),
        ((F.col("p_partkey") % 7) / 2).alias("flips"),
        ((F.col("p_partkey") % 5) / 2).alias("twists"),
        _pick(AXES, 1).alias("axis"),
        _pick(DIRECTIONS, 4).alias("direction"),
        _pick(SHAPES, 8).alias("shape"),
        _pick(ENTRIES, 3).alias("entry"),
        _pick(CONTEXTS, 5).alias("context"),
        (F.floor(F.col("p_retailprice") / 20) / 10).alias("score"),
    )


def movement_names(part: DataFrame) -> DataFrame:
    """id, name: names put together from movement words, by key; the words cycle through all that the parser knows."""
    words = ["double", "full", "back", "cork", "720", "side", "flip", "wall", "half", "gainer", "Triple", "layout", "cheat", "front", "arabian", "pike", "kong", "roll", "full", "B-Twist", "webster", "540", "corkscrew", "raiz", "handspring", "twist"]
    listed = F.array(*(F.lit(w) for w in words))
    at = lambda f: F.element_at(listed, (f % len(words) + 1).cast("int"))
    key = F.col("p_partkey")
    return part.select(key.alias("id"), F.concat_ws(" ", at(key), at(F.floor(key / 26) + key * 3), at(F.floor(key / 7) + 5), at(key * key)).alias("name"))


#: Words of names that several sources write in several ways.
WRITTEN = ("back", "Flip", "back-flip", "backflip", "hand", "spring", "Handspring", "side", "swing", "full", "twist", "fulltwist", "roundoff", "ROUND", "off", "a")


def source_names(part: DataFrame) -> DataFrame:
    """source, pos, name, alias: four sources by key; those of the first have aliases, but for every third."""
    listed = F.array(*(F.lit(w) for w in WRITTEN))
    key = F.col("p_partkey")
    at = lambda f: F.element_at(listed, (f % len(WRITTEN) + 1).cast("int"))
    name, alias = F.concat_ws(" ", at(key * 7), at(F.floor(key / 5) * 3 + key)), F.concat_ws("_", at(key + 3), at(key * key))
    return part.select((key % 4).alias("source"), key.alias("pos"), F.when(key % 4 == 2, F.upper(name)).otherwise(name).alias("name"), F.when((key % 4 == 0) & (key % 3 != 0), alias).alias("alias"))
