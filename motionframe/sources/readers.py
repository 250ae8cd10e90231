"""Readers of catalogs, label files and lists, with declared schemas: inference would take counts for longs and maps for structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe.functions import names

#: One trick of a rule catalog.
RULE_SCHEMA = """trick_id string, category string, tags array<string>, difficulty double, detection_method string,
phases array<struct<name: string, duration_range_ms: array<int>,
  angle_rules: array<struct<joint: string, min: double, max: double, description: string>>,
  velocity_rules: array<struct<joint: string, axis: string, direction: string, min_speed: double>>,
  trajectory: struct<rotation_axis: string, rotation_direction: string, min_rotation_degrees: double>>>,
composable_with array<string>, names map<string,string>,
primitives struct<rotation_sagittal: string, rotation_sagittal_count: int, rotation_lateral: string, twist_count: int, takeoff: string, landing: string, obstacle_interaction: boolean>"""
#: A physics catalog: categories by name, each with a context and its tricks.
PHYSICS_SCHEMA = """categories map<string, struct<context: string, tricks: array<struct<name: string, score: double, flip: double, twist: double, direction: string, axis: string,
aliases: array<string>, takeoff: string, entry: string, hand_contact: string, kick: boolean, type: string>>>>"""
_LABEL = "struct<file: string, trick_id: string, class: string, start_ms: double, end_ms: double>"
LABEL_SCHEMA = f"samples array<{_LABEL}>, labels array<{_LABEL}>, file string, trick_id string, class string, start_ms double, end_ms double"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def rule_catalog(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    """The tricks in ``folder/language``, of English if there is no such folder, none if neither is there.

    Missing lists are empty and a missing method is angle_threshold; trajectory and primitives stay null.
    """
    found = next((f"{folder}/{code}" for code in (language, "en") if _exists(spark, f"{folder}/{code}")), None)
    if found is None:
        return spark.createDataFrame([], RULE_SCHEMA)
    read = spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(f"{found}/*.json")
    texts = F.array().cast("array<string>")
    return read.withColumns({"tags": F.coalesce("tags", texts), "composable_with": F.coalesce("composable_with", texts), "detection_method": F.coalesce("detection_method", F.lit("angle_threshold"))})


def physics_catalog(spark: SparkSession, path: str) -> DataFrame:
    """trick_id, name, category, flips, twists, axis, direction, shape, entry, context, score, aliases and more of every trick; of one id the last counts."""
    read = spark.read.schema(PHYSICS_SCHEMA).option("multiLine", True).json(path)
    each = read.select(F.explode("categories").alias("category", "c")).select("category", "c.context", F.posexplode("c.tricks").alias("pos", "t"))
    return physics_rows(each)


def physics_rows(each: DataFrame) -> DataFrame:
    """The same of rows category, context, pos, t (one trick)."""
    known = lambda c, values, other: F.when(c.isin(*values), c).otherwise(other)
    context = known(F.col("context"), ("ground", "wall", "bar_or_rail", "obstacle"), "ground")
    takeoff: Column = F.col("t.takeoff")
    entry = F.when(takeoff == "one_leg", "one_leg").when(takeoff.isin("running_forward", "gainer"), "running").when(context == "wall", "wall").otherwise("standing")
    direction = F.when(F.col("t.direction") == "side", "left").otherwise(known(F.col("t.direction"), ("forward", "backward"), "backward"))
    zero = F.lit(0.0)
    rows = each.select(
        names.slug(F.col("t.name")).alias("trick_id"),
        F.col("t.name").alias("name"),
        "category",
        "pos",
        F.coalesce("t.flip", zero).alias("flips"),
        F.coalesce("t.twist", zero).alias("twists"),
        known(F.col("t.axis"), ("lateral", "sagittal", "longitudinal", "off_axis"), "lateral").alias("axis"),
        direction.alias("direction"),
        F.lit("tuck").alias("shape"),
        entry.alias("entry"),
        context.alias("context"),
        F.coalesce("t.score", zero).alias("score"),
        F.coalesce("t.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.col("t.hand_contact").alias("hand_contact"),
        takeoff.alias("takeoff"),
        F.coalesce("t.kick", F.lit(False)).alias("kick"),
    )
    last = Window.partitionBy("trick_id").orderBy(F.col("category").desc(), F.col("pos").desc())
    return rows.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth", "pos")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """file, trick_id, start_ms, end_ms of a label file in any of its three shapes: samples, labels, or a list of them."""
    return label_rows(spark.read.schema(LABEL_SCHEMA).option("multiLine", True).json(path))


def label_rows(read: DataFrame) -> DataFrame:
    """The same of rows in ``LABEL_SCHEMA``; a trick_id that is missing or empty is taken from class."""
    nested = read.select(F.explode(F.coalesce("samples", "labels")).alias("l")).select("l.*")
    flat = read.filter("samples IS NULL AND labels IS NULL").select("file", "trick_id", "class", "start_ms", "end_ms")
    both = nested.unionByName(flat)
    return both.select("file", F.coalesce(F.when(F.col("trick_id") != "", F.col("trick_id")), F.col("class"), F.lit("")).alias("trick_id"), "start_ms", "end_ms")


def labelled_list(spark: SparkSession, path: str, wanted: list[str], schema: str = "label string, youtube_id string, time_start int, time_end int, split string") -> DataFrame:
    """The rows of a CSV list with a header whose label is among ``wanted``."""
    return spark.read.schema(schema).option("header", True).csv(path).filter(F.col("label").isin(*wanted))


def best_person(people: DataFrame) -> DataFrame:
    """run, idx, person: the person of each frame whose keypoints are surest on average; ``people`` has run, idx, person, c (array)."""
    mean = F.try_divide(F.aggregate("c", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), F.size("c"))
    return people.withColumn("mean", mean).groupBy("run", "idx").agg(F.max_by("person", F.struct("mean", -F.col("person"))).alias("person"))


def largest_box(boxes: DataFrame) -> DataFrame:
    """run, idx, box of the largest area in each frame, the first of equals; boxes are x0, y0, x1, y1 with a number ``box``."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.withColumn("area", area).groupBy("run", "idx").agg(F.max_by("box", F.struct("area", -F.col("box"))).alias("box"))


def unit_coordinates(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pixels as shares of the frame; of one of 1280 by 720 where its size is not known and a coordinate exceeds 1."""
    pixels = (x > 1) | (y > 1)
    fixed = lambda v, size: F.when(pixels, v / size).otherwise(v)
    return F.coalesce(x / width, fixed(x, 1280.0)), F.coalesce(y / height, fixed(y, 720.0))


def padded_joints(flat: Column, joints: int = 23) -> Column:
    """An array of 63 numbers as 21 joints of three, with zeros up to ``joints``."""
    split = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.slice(flat, j * 3 + 1, 3))
    return F.concat(split, F.array_repeat(F.array_repeat(F.lit(0.0), 3), joints - 21))
