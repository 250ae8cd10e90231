"""Registered queries of entities, attributes, documents' schema, label logs, strategies and fusion by name; SQL in :mod:`motionframe.plans.catalog_sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe import further_queries
from motionframe.functions import names
from motionframe.operators import entities, etl, kinematics, matching, schema_rules, strategies, turns
from motionframe.sources import adapters, label_log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
FPS = 10.0
JOINTS = ["left_knee", "right_knee", "left_shoulder", "spine"]


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _read(spark, d, name):
    return adapters.read(spark, d, name)


@_query
def ordered_entities(spark, d):
    return entities.resolved(adapters.source_names(_read(spark, d, "part")))


@_query
def entity_names(spark, d):
    shown = entities.displayed(ordered_entities(spark, d), titled=2)
    records = F.array_join(F.transform(F.map_entries("records"), lambda r: F.concat(r["key"].cast("string"), F.lit(":"), r["value"].cast("string"))), ",")
    return shown.select("canonical", "display_name", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"), records.alias("records"))


@_query
def explicit_fields(spark, d):
    words = adapters.movement_names(_read(spark, d, "part")).select("id", names.tokens(F.col("name")).alias("words"))
    return words.select("id", *(c.alias(k) for k, c in names.explicit(F.col("words")).items()))


@_query
def merged_attributes(spark, d):
    part = _read(spark, d, "part")
    words = ["Flip", "Twist", "Wall", "Bar", "Roll", "Vault", "Ground", "Kick"]
    at = lambda f: F.element_at(F.array(*(F.lit(w) for w in words)), (f % len(words) + 1).cast("int"))
    kinds = part.select(F.col("p_partkey").alias("id"), F.concat_ws("/", at(F.col("p_partkey")), at(F.floor(F.col("p_partkey") / 8) + 3)).alias("kind"))
    rows = adapters.movement_names(part).join(further_queries._texts(spark, d), "id").join(kinds, "id")
    hints = [etl.description_hints(F.col("text")), etl.type_hints(F.col("kind"))]
    return entities.with_attributes(rows, "id", F.col("name"), hints)


#: Fragments of made documents, by key: trick_id, category, difficulty, method, phases and names.
FRAGMENTS = (
    ('"trick_id": "back_flip"', '"trick_id": "Back"', '"trick_id": 7', '"other": 1'),
    ('"category": "flip"', '"category": "vault"', '"category": "jump"'),
    ('"difficulty": 4', '"difficulty": 10.5', '"difficulty": -1', '"difficulty": "7"', '"difficulty": 9.75'),
    ('"detection_method": "angle_threshold"', '"detection_method": "guess"'),
    ('"phases": [{"name": "takeoff", "duration_range_ms": [100, 200]}]', '"phases": []', '"phases": [{"name": "fly", "duration_range_ms": [1]}, {"angle_rules": []}]', '"phases": "none"'),
    ('"names": {"en": "x"}', '"names": {"fr": 1}', '"names": {"en": "x", "de": null}'),
)


@_query
def schema_violations(spark, d):
    key = F.col("p_partkey")
    parts = []
    step = 1
    for choices in FRAGMENTS:
        parts.append(F.element_at(F.array(*(F.lit(c) for c in choices)), (F.floor(key / step) % len(choices) + 1).cast("int")))
        step *= 2
    text = F.when(key % 97 == 0, F.lit("{")).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return schema_rules.violations(_read(spark, d, "part").select(key.alias("id"), text.alias("text")), schema_rules.TRICK_SCHEMA)


def _edits(spark, d):
    key = F.col("event_id")
    action = F.when(key % 5 == 4, "done").when(key % 3 == 0, "delete").otherwise("add")
    return _read(spark, d, "events").select(key.alias("seq"), F.concat(F.lit("clip"), (F.col("user_id") % 40).cast("string")).alias("file"), action.alias("action"), (F.floor(F.col("value")) % 30).alias("nth"), F.col("event_type").alias("trick_id"), F.when(key % 2 == 0, key * 10).alias("start_ms"), F.when(key % 7 != 0, key * 10 + 500).alias("end_ms"))


@_query
def replayed_labels(spark, d):
    return label_log.replayed(_edits(spark, d))


@_query
def done_files(spark, d):
    return label_log.done_files(_edits(spark, d))


@_query
def added_tricks(spark, d):
    part = _read(spark, d, "part")
    key = F.col("p_partkey")
    requests = part.select(key.alias("seq"), F.concat(F.lit(" "), F.when(key % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit("-"), (key % 30).cast("string")).alias("id"), F.when(key % 11 != 0, F.col("p_name")).alias("name"), F.when(key % 4 != 0, F.concat(F.lit("Kind "), (key % 3).cast("string"))).alias("category"))
    known = part.filter("p_size > 45").select(label_log.trick_key(F.concat("p_brand", F.lit(" "), (key % 30).cast("string"))).alias("id")).distinct()
    return label_log.added_tricks(requests, known)


@_query
def relabel_queue(spark, d):
    samples = _read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("clip"), F.col("c_custkey").cast("string")).alias("original"), F.col("c_mktsegment").alias("class"))
    relabels = _read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("clip"), (F.col("o_custkey") * 2).cast("string")).alias("original"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("label"))
    return label_log.work_queue(samples, relabels, ("BUILDING", "MACHINERY", "AUTOMOBILE"))


def _windows(spark, d):
    """Segments of the even runs; the others are left without."""
    poses = adapters.pose_frames(_read(spark, d, "embeddings"))
    segments = turns.intensity_segments(turns.body_intensity(poses, FPS), FPS).filter("run % 2 = 0")
    return segments, kinematics.joint_angles(poses)


def _methods(spark):
    return further_queries._rules(spark).withColumn("method", F.when(F.col("trick_id") == "reach", "unheard_of").otherwise("angle_threshold"))


@_query
def trick_windows(spark, d):
    segments, frames = _windows(spark, d)
    return strategies.trick_windows(segments, frames, _methods(spark).select("trick_id").distinct())


@_query
def strategy_detections(spark, d):
    segments, frames = _windows(spark, d)
    found = strategies.detections(segments, frames, JOINTS, strategies.packed_tricks(_methods(spark), JOINTS))
    return found.withColumn("confidence", F.round("confidence", 6))


@_query
def fused_by_name(spark, d):
    lines = _read(spark, d, "lineitem")
    part = _read(spark, d, "part").filter("p_partkey <= 60").select(F.concat(F.lit("trick_"), F.col("p_partkey").cast("string")).alias("trick_id"), F.concat(F.lit("Trick-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("pos"))
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("sig_id"), (F.col("l_partkey") % 90 + 1).alias("k")).agg(F.round(F.max("l_quantity") / 50, 4).alias("confidence"))
    physics = side("A").filter("k <= 60").select("sig_id", F.concat(F.lit("trick_"), F.col("k").cast("string")).alias("trick_id"), F.concat(F.lit("Trick-"), F.col("k").cast("string")).alias("name"), "confidence")
    # several spellings of one name, some of which the catalog knows
    number = F.col("k").cast("string")
    spelled = F.when(F.col("k") % 3 == 0, F.concat(F.lit("TRICK "), (F.col("k") % 45 + 1).cast("string"))).when(F.col("k") % 3 == 1, F.concat(F.lit("trick-"), number)).otherwise(F.concat(F.lit("New Trick "), (F.col("k") % 7).cast("string")))
    motion = side("R").select("sig_id", F.col("k").alias("nth"), spelled.alias("name"), "confidence")
    facts = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("sig_id"), ((F.col("s_suppkey") % 5) / 2).alias("flips"), ((F.col("s_suppkey") % 3) / 2).alias("twists"), (F.col("s_suppkey") % 2 == 0).alias("inverted"))
    return matching.fused_by_name(physics, motion, facts, part)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
