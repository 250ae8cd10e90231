"""Further registered queries: rules, feature vectors, signatures, descriptions of segments, catalog building, readers and sinks.

Their SQL is in :mod:`motionframe.plans.further_sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe.operators import augment, catalog, describe, etl, features, kinematics, rotation, rules, signature, trajectory
from motionframe.sources import adapters, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _poses(spark, d):
    return adapters.pose_frames(adapters.read(spark, d, "embeddings"))


def _turns(spark, d):
    return adapters.rotation_frames(adapters.read(spark, d, "embeddings"))


#: A small rule catalog: trick_id, phase_no, min_ms, max_ms, joint, low, high.
RULES = [
    ("squat", 0, 60.0, 200.0, "left_knee", 20.0, 120.0),
    ("squat", 0, 60.0, 200.0, "spine", 10.0, 110.0),
    ("squat", 1, 100.0, 300.0, "left_knee", 60.0, 180.0),
    ("reach", 0, 30.0, 150.0, "left_shoulder", 0.0, 60.0),
    ("reach", 1, 100.0, 100.0, None, None, None),
    ("reach", 2, 30.0, 200.0, "left_shoulder", 90.0, 180.0),
    ("still", 0, 400.0, 500.0, "right_knee", 90.0, 90.0),
]


def _rules(spark):
    return spark.createDataFrame(RULES, "trick_id string, phase_no long, min_ms double, max_ms double, joint string, low double, high double")


def _angles(spark, d):
    frames = kinematics.joint_angles(_poses(spark, d))
    return frames, rules.angle_rows(frames, ["left_knee", "right_knee", "left_shoulder", "spine"])


@_query
def rule_score(spark, d):
    return _rounded(rules.rule_scores(_angles(spark, d)[1], _rules(spark)).select("run", "idx", "trick_id", "phase_no", "joint", "score"), 5)


@_query
def phase_match(spark, d):
    return _rounded(rules.phase_matches(*_angles(spark, d), _rules(spark)), 6)


@_query
def classify(spark, d):
    return _rounded(rules.classified(*_angles(spark, d), _rules(spark), _poses(spark, d)), 5)


# feature vectors and signatures


@_query
def feature_cells(spark, d):
    return _rounded(features.normalised(features.frame_rows(_poses(spark, d))))


@_query
def warp_vectors(spark, d):
    vectors = features.for_warping(features.vectors(features.frame_rows(_poses(spark, d))))
    return _rounded(vectors.select("run", "idx", F.posexplode("vec").alias("cell", "value")).select("run", "idx", F.col("cell").cast("long").alias("cell"), "value"), 3)


@_query
def signature_features(spark, d):
    return _rounded(signature.features(_poses(spark, d)).select("run", "idx", *(f"f{k}" for k in range(26))))


@_query
def signature_facts(spark, d):
    return _rounded(signature.facts(signature.features(_poses(spark, d))))


@_query
def signature_match(spark, d):
    framed = signature.features(_poses(spark, d))
    curves, facts = signature.trajectories(framed), signature.facts(framed)
    return _rounded(signature.matches(signature.distances(curves, curves), facts, facts).select("query", "reference", "distance", "confidence", "bonus"), 3)


@_query
def dtw_match(spark, d):
    framed = signature.trajectories(signature.features(_poses(spark, d)), 24)
    lines = framed.groupBy("run", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda c: c["value"]).alias("f"))
    whole = lines.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "f"))), lambda c: c["f"]).alias("t"))
    runs = whole.withColumnRenamed("t", "trajectory")
    return _rounded(trajectory.best_by_warping(runs, runs, scale=8.0, other_runs=True), 6)


@_query
def mirrored_cells(spark, d):
    return _rounded(augment.mirrored(features.frame_rows(_poses(spark, d))), 3)


@_query
def even_split(spark, d):
    return augment.even_split(adapters.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 1037)


# segments of rotation


def _stretches(frames):
    """Consecutive stretches of 20 frames."""
    start = F.floor(F.col("idx") / 20) * 20
    return frames.groupBy("run", start.alias("start_idx")).agg(F.max("idx").alias("end_idx"))


@_query
def swing_twist(spark, d):
    return _rounded(describe.swing_and_twist(_turns(spark, d)), 3)


@_query
def smoothing_width(spark, d):
    return describe.smoothing_width(_turns(spark, d))


@_query
def plausible_segments(spark, d):
    frames = _turns(spark, d)
    return describe.plausible(_stretches(frames), rotation.tracking(frames))


@_query
def segment_axis(spark, d):
    frames = _turns(spark, d)
    tilted = describe.turned_vectors(frames).join(rotation.tracking(frames).select("run", "idx", "tilt"), ["run", "idx"])
    return describe.flip_axis(_stretches(frames), tilted)


@_query
def segment_direction(spark, d):
    frames = _turns(spark, d)
    tilted = describe.turned_vectors(frames).join(rotation.tracking(frames).select("run", "idx", "tilt"), ["run", "idx"])
    return describe.direction(_stretches(frames), tilted)


@_query
def segment_shape(spark, d):
    frames = _turns(spark, d)
    tilted = frames.join(rotation.tracking(frames).select("run", "idx", "tilt"), ["run", "idx"])
    return describe.shape(_stretches(frames), tilted)


@_query
def segment_entry(spark, d):
    frames = _turns(spark, d)
    return describe.entry(_stretches(frames), frames)


@_query
def axis_classes(spark, d):
    return _turns(spark, d).select("run", "idx", describe.axis_class(F.col("ox"), F.col("oy"), F.col("oz")).alias("axis"))


@_query
def segment_signatures(spark, d):
    frames = _turns(spark, d)
    stretches = _stretches(frames)
    place = F.floor(F.col("start_idx") / 20).cast("long")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (place % len(values) + 1).cast("int"))
    described = stretches.withColumns({"axis": pick(adapters.AXES), "direction": pick(adapters.DIRECTIONS), "shape": pick(adapters.SHAPES), "entry": pick(adapters.ENTRIES), "flips": (place % 4) / 2, "twists": (place % 3) / 2})
    return _rounded(describe.signatures(described, frames))


@_query
def band_candidates(spark, d):
    part = adapters.read(spark, d, "part")
    key = F.col("p_partkey")
    rows = part.select(key.alias("id"), ((key * 37) % 1000).cast("double").alias("rot"), ((key % 7) / 2).alias("flips"), ((key % 5) / 2).alias("twists"), ((key % 11) / 500).alias("twist_rate"), (key % 3 == 0).alias("side"), F.when(key % 2 == 0, "backward").otherwise("forward").alias("direction"), F.when(key % 4 == 0, "layout").otherwise("tuck").alias("shape"))
    return describe.band_candidates(rows).select("id", F.array_join("candidates", "/").alias("candidates"))


# building the catalog


def _texts(spark, d):
    words = ["Double", "back flip", "half twist", "tucked", "360", "corkscrew", "straight", "twisting", "front flip", "quad", "open", "lateral", "full twist", "720", "piked", "forward"]
    at = lambda f: F.element_at(F.array(*(F.lit(w) for w in words)), (f % len(words) + 1).cast("int"))
    key = F.col("p_partkey")
    return adapters.read(spark, d, "part").select(key.alias("id"), F.concat_ws(" ", F.lit("A"), at(key), F.lit("with a long run up and"), at(F.floor(key / 16) + key * 5)).alias("text"))


@_query
def description_hints(spark, d):
    return _texts(spark, d).select("id", *(c.alias(k) for k, c in etl.description_hints(F.col("text")).items()))


@_query
def type_hints(spark, d):
    words = ["Flip", "Twist", "Wall", "Bar", "Roll", "Vault", "Ground", "Kick"]
    at = lambda f: F.element_at(F.array(*(F.lit(w) for w in words)), (f % len(words) + 1).cast("int"))
    key = F.col("p_partkey")
    rows = adapters.read(spark, d, "part").select(key.alias("id"), F.concat_ws("/", at(key), at(F.floor(key / 8) + 3)).alias("kind"))
    return rows.select("id", *(c.alias(k) for k, c in etl.type_hints(F.col("kind")).items()))


@_query
def unify_difficulty(spark, d):
    key = F.col("p_partkey")
    letter = F.element_at(F.array(*(F.lit(x) for x in "ABCDE")), (key % 5 + 1).cast("int"))
    return adapters.read(spark, d, "part").select(key.alias("id"), etl.unified_difficulty(F.when(key % 3 != 0, key % 10 + 1), F.when(key % 4 != 0, letter)).alias("difficulty"))


@_query
def strict_slug(spark, d):
    return adapters.read(spark, d, "part").select("p_partkey", etl.strict_slug(F.concat(F.lit("-"), "p_name", F.lit(" ("), F.col("p_brand"), F.lit(")!"))).alias("slug"))


@_query
def localised_names(spark, d):
    part = adapters.read(spark, d, "part")
    listed = F.create_map(F.lit("en"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), F.lit("fr"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")))
    return part.select("p_partkey", etl.localised(listed, F.col("p_brand"), "fr").alias("name"))


@_query
def resolve_names(spark, d):
    part = adapters.read(spark, d, "part")
    known = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("trick_id"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 50).cast("string")).alias("name"))
    wanted = part.select(F.upper(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 60).cast("string"))).alias("name")).distinct()
    return etl.resolved_names(wanted, known)


@_query
def mapping_join(spark, d):
    part, customer, supplier = (adapters.read(spark, d, t) for t in ("part", "customer", "supplier"))
    items = part.select(F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("pos"))
    index = customer.select(F.concat(F.lit("Item "), (F.col("c_custkey") % 400).cast("string")).alias("name"), F.concat(F.lit("u"), (F.floor(F.col("c_custkey") / 2)).cast("string")).alias("url"), F.col("c_custkey").alias("pos"))
    manual = supplier.select(F.concat(F.lit("item "), (F.col("s_suppkey") * 3).cast("string")).alias("name"), F.when(F.col("s_suppkey") % 5 == 0, "NO MATCH").otherwise(F.concat(F.lit("ITEM "), F.col("s_suppkey").cast("string"))).alias("target"))
    return etl.mapped(items, index, manual)


@_query
def prerequisite_names(spark, d):
    part = adapters.read(spark, d, "part")
    ids = F.array((F.floor(F.col("p_partkey") / 2)).cast("long"), (F.floor(F.col("p_partkey") / 3)).cast("long"), F.lit(-1).cast("long"))
    tricks = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), ids.alias("prerequisite_ids"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("basics"))).alias("prerequisites"))
    return etl.prerequisites_by_id(tricks).select("id", F.array_join("prerequisites", "|").alias("prerequisites"))


@_query
def keep_first(spark, d):
    part = adapters.read(spark, d, "part")
    return etl.keep_first(part.select("p_partkey", "p_brand", "p_size"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")), ["p_partkey"])


@_query
def entity_resolution(spark, d):
    part = adapters.read(spark, d, "part")
    of = lambda keep, made: part.filter(keep).select(made.alias("name"))
    number = lambda m: (F.col("p_partkey") % m).cast("string")
    return etl.entities([of("p_partkey % 2 = 0", F.concat(F.lit("back flip "), number(40))), of("p_partkey % 3 = 0", F.concat(F.lit("Backflip "), number(90))), of("p_partkey % 5 = 0", F.concat(F.lit("Back-Flip "), number(150)))])


@_query
def collected_texts(spark, d):
    talks = adapters.read(spark, d, "conversations").select("conv_id", F.col("role").alias("source"), "text")
    return etl.collected_texts(talks, "conv_id").select("conv_id", F.size("descriptions").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("descriptions")), ",").alias("sources"))


def _definitions(spark, d):
    return adapters.physics_catalog(adapters.read(spark, d, "part"))


@_query
def property_encoding(spark, d):
    return etl.encoded(_definitions(spark, d), adapters.AXES, adapters.DIRECTIONS, adapters.SHAPES, adapters.ENTRIES)


@_query
def head_resolution(spark, d):
    labels = property_encoding(spark, d).withColumn("pos", F.col("trick_id"))
    value = lambda k: F.round(F.abs(F.col("embedding")[k].cast("double")), 4)
    sizes = dict(zip(etl.HEADS, (4, 2, 6, 4, 3, 5)))
    heads = [c for k, (h, n) in enumerate(sizes.items()) for c in ((F.floor(value(k) * 1000) % n).alias(h), F.least(value(k + 6) * 4, F.lit(1.0)).alias(f"p_{h}"))]
    predictions = adapters.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), value(20).alias("no_trick"), (value(21) * 2).alias("is_trick"), *heads)
    return _rounded(etl.resolve_heads(predictions, labels), 5)


@_query
def sorted_classes(spark, d):
    return etl.sorted_classes(adapters.read(spark, d, "orders").select(F.col("o_orderpriority").alias("label")), "5-LOW")


@_query
def catalog_difference(spark, d):
    part = adapters.read(spark, d, "part")
    of = lambda keep: part.filter(keep).select("p_brand", "p_size")
    return etl.catalog_differences(of("p_partkey % 2 = 0"), of("p_partkey % 3 = 0")).groupBy("side", "p_brand", "p_size").agg(F.count("*").alias("n"))


@_query
def download_plan(spark, d):
    part = adapters.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("sources"), (F.col("p_size") / 5).alias("difficulty"))
    return etl.download_plan(part, 40)


@_query
def grouped_clips(spark, d):
    lines = adapters.read(spark, d, "lineitem")
    clips = lines.select((F.col("l_partkey") % 97).alias("trick_id"), F.concat(F.lit("clips/"), F.col("l_shipmode") if "l_shipmode" in lines.columns else F.col("l_returnflag"), F.lit("_"), (F.col("l_suppkey") % 9).cast("string"), F.lit(".mp4")).alias("path"))
    return etl.grouped_clips(clips).select("trick_id", F.array_join("clips", ",").alias("clips"))


@_query
def mean_curves(spark, d):
    lines = adapters.read(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("trick_id"), (F.col("l_orderkey") % 16).alias("step"), F.col("l_quantity").cast("double").alias("value"))
    return _rounded(etl.mean_curves(lines), 5)


@_query
def violation_rate(spark, d):
    part = adapters.read(spark, d, "part")
    tricks = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 5.0).alias("difficulty"))
    edges = part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("prerequisite")).filter("prerequisite > 0")
    return _rounded(etl.violation_rate(edges, catalog.prerequisite_violations(tricks, edges)), 6)


# readers and sinks


@_query
def best_person(spark, d):
    vectors = adapters.read(spark, d, "embeddings")
    people = vectors.select(F.col("label").cast("long").alias("run"), F.floor(F.col("vec_id") / 3).alias("idx"), F.col("vec_id").alias("person"), F.transform(F.slice("embedding", 1, 17), lambda x: F.abs(x.cast("double"))).alias("c"))
    return readers.best_person(people)


@_query
def largest_box(spark, d):
    lines = adapters.read(spark, d, "lineitem")
    x = (F.col("l_suppkey") % 50).cast("double")
    boxes = lines.select((F.col("l_orderkey") % 100).alias("run"), F.floor(F.col("l_orderkey") / 100).alias("idx"), F.col("l_linenumber").cast("long").alias("box"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + F.col("l_quantity")).alias("x1"), (F.col("l_partkey") % 9).cast("double").alias("y1"))
    return readers.largest_box(boxes.groupBy("run", "idx", "box").agg(*(F.max(c).alias(c) for c in ("x0", "y0", "x1", "y1"))))


@_query
def unit_coordinates(spark, d):
    part = adapters.read(spark, d, "part")
    x, y = readers.unit_coordinates(F.col("p_size") * 20.0, F.col("p_size") / 100.0, F.when(F.col("p_partkey") % 2 == 0, 1920.0), F.when(F.col("p_partkey") % 2 == 0, 1080.0))
    return part.select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _found(spark, d):
    return adapters.detections(*(adapters.read(spark, d, t) for t in ("orders", "lineitem", "part")))


@_query
def top_flag(spark, d):
    found = _found(spark, d)
    order = Window.partitionBy("run").orderBy(F.col("confidence").desc(), "detection_id", "trick_id")
    top = found.withColumn("nth", F.row_number().over(order)).filter("nth <= 3")
    return sinks.with_top_flag(found, top).select("run", "detection_id", "is_top3")


@_query
def audit_log(spark, d):
    found = _found(spark, d).filter("confidence >= 0.9").withColumn("start_ms", F.col("start_ms") % 3_600_000_000)
    totals = found.groupBy("run").agg(F.count("*").cast("double").alias("total"))
    return sinks.audit_entries(found, totals).select("run", "nth", "kind", F.substring("message", 1, 5).alias("head"))


@_query
def run_report(spark, d):
    found = _found(spark, d)
    runs = adapters.read(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    return sinks.run_report(runs, found).select("run", F.size(F.from_json("report", "run long, detections array<struct<detection_id: long>>")["detections"]).cast("long").alias("n"))


@_query
def training_manifest(spark, d):
    made = sinks.manifest(adapters.read(spark, d, "orders").select(F.col("o_orderpriority").alias("label")))
    return made.select(F.array_join("classes", "|").alias("classes"), F.element_at("class_counts", "5-LOW").alias("low"), "samples")


@_query
def reference_names(spark, d):
    lines = adapters.read(spark, d, "lineitem").select(F.col("l_partkey").alias("trick_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    return sinks.with_reference_names(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'")).select("trick_id", "id", "ref")


@_query
def label_log(spark, d):
    events = adapters.read(spark, d, "events")
    action = F.when(F.col("event_id") % 3 == 0, "delete").otherwise("add")
    log = events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("file"), F.col("event_type").alias("trick_id"), (F.floor(F.col("value")) % 4).alias("start_ms"), action.alias("action"))
    return sinks.labels_of(log)


@_query
def latest_status(spark, d):
    orders = adapters.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return sinks.latest(orders, ["run"], "seq")


@_query
def insert_absent(spark, d):
    part = adapters.read(spark, d, "part")
    wanted = part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 100).cast("string")).alias("file"))
    return sinks.absent(wanted, part.filter("p_partkey % 7 = 0").select(F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 100).cast("string")).alias("file")), "file")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
