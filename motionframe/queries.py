"""The registered queries over the motion operators; their SQL is in :mod:`motionframe.plans.sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe import catalog_queries, further_queries, turn_queries
from motionframe.functions import names
from motionframe.operators import catalog, kinematics, matching, rotation, scoring, sequence
from motionframe.plans import catalog_sql, further_sql, sql, turn_sql
from motionframe.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _signal(spark, d):
    return adapters.signal_frames(adapters.read(spark, d, "events"))


def _poses(spark, d):
    return adapters.pose_frames(adapters.read(spark, d, "embeddings"))


def _tracked(spark, d):
    return rotation.tracking(adapters.rotation_frames(adapters.read(spark, d, "embeddings")))


def _detections(spark, d):
    return adapters.detections(*(adapters.read(spark, d, t) for t in ("orders", "lineitem", "part")))


def _catalog(spark, d):
    return adapters.physics_catalog(adapters.read(spark, d, "part"))


def _difficulty(spark, d):
    return adapters.read(spark, d, "part").groupBy(F.col("p_brand").alias("trick_id")).agg((F.max("p_size") / 5.0).alias("difficulty"))


# sequences


@_query
def velocity(spark, d):
    return _rounded(sequence.velocity(_signal(spark, d)).select("run", "idx", "velocity"), 6)


@_query
def smooth_shrink(spark, d):
    return _rounded(sequence.smoothed_signal(_signal(spark, d), sequence.SegmentConfig()).select("run", "idx", "smooth"), 6)


@_query
def smooth_zero_pad(spark, d):
    return _rounded(_signal(spark, d).select("run", "idx", sequence.smooth_zero_padded("v", 4).alias("smooth")))


@_query
def adaptive_threshold(spark, d):
    config = sequence.SegmentConfig()
    return _rounded(sequence.adaptive_threshold(sequence.smoothed_signal(_signal(spark, d), config), config.factor), 6)


@_query
def islands(spark, d):
    found = sequence.islands(sequence.active_frames(_signal(spark, d), sequence.SegmentConfig()))
    return found.select("run", "start_idx", "end_idx", F.round("peak", 6).alias("peak"))


@_query
def pad_islands(spark, d):
    return sequence.padded_islands(sequence.active_frames(_signal(spark, d), sequence.SegmentConfig()))


@_query
def segments(spark, d):
    """The active intervals of every run, from the raw signal to merged, filtered segments."""
    found = sequence.segments(_signal(spark, d))
    return found.select("run", "start_idx", "end_idx", "start_ms", "end_ms", F.round("peak", 6).alias("peak"))


@_query
def sequence_windows(spark, d):
    speeds = sequence.smoothed_signal(_signal(spark, d), sequence.SegmentConfig())
    level = sequence.adaptive_threshold(speeds, 2.0)
    return sequence.frame_windows(speeds.join(level, "run").withColumn("active", F.col("smooth") >= F.col("threshold")))


@_query
def best_segment(spark, d):
    return sequence.best_segment(sequence.segments(_signal(spark, d))).select("run", "start_idx", "end_idx")


@_query
def airtime_segments(spark, d):
    hour = sequence.HOUR_MS
    return sequence.airtime_segments(_signal(spark, d), "v", 3 * hour, hour, 2 * hour, 96 * hour)


@_query
def resample_linear(spark, d):
    body = kinematics.body_frame(_poses(spark, d)).select("run", "idx", "tilt")
    return _rounded(sequence.resample(body, "tilt", 60))


@_query
def forward_fill(spark, d):
    return _rounded(sequence.forward_fill(kinematics.body_frame(_poses(spark, d)).select("run", "idx", "torso"), "torso"))


@_query
def frame_sampler(spark, d):
    return sequence.sampled_frames(_poses(spark, d))


# poses


@_query
def joint_angles(spark, d):
    return _rounded(kinematics.joint_angles(_poses(spark, d)).drop("t_ms"), 4)


@_query
def com_torso_tilt(spark, d):
    return _rounded(kinematics.body_frame(_poses(spark, d)).drop("t_ms"))


@_query
def limb_ratios(spark, d):
    return _rounded(kinematics.limb_ratios(_poses(spark, d)))


@_query
def relative_positions(spark, d):
    return _rounded(kinematics.relative_positions(_poses(spark, d)))


@_query
def joint_intensity(spark, d):
    angles = kinematics.joint_angles(_poses(spark, d))
    return _rounded(sequence.joint_intensity(angles, ["left_hip", "right_hip", "spine"]).select("run", "idx", "intensity"), 3)


@_query
def temporal_features(spark, d):
    return _rounded(kinematics.temporal_features(kinematics.body_frame(_poses(spark, d))).drop("t_ms"), 4)


@_query
def normalise_features(spark, d):
    return _rounded(kinematics.normalised(kinematics.temporal_features(kinematics.body_frame(_poses(spark, d)))))


# rotation


@_query
def rotation_tracking(spark, d):
    return _rounded(_tracked(spark, d).select("run", "idx", "tilt", "tilt_cumulative", "twist_cumulative", "rate"), 4)


@_query
def geometric_phase(spark, d):
    return _rounded(rotation.geometric_phase(_tracked(spark, d)), 4)


@_query
def inversion_crossings(spark, d):
    return rotation.inversion_crossings(_tracked(spark, d))


@_query
def rotation_physics(spark, d):
    return _rounded(rotation.physics(_tracked(spark, d)), 3)


@_query
def shape_scores(spark, d):
    return _rounded(rotation.shape_scores(adapters.rotation_frames(adapters.read(spark, d, "embeddings"))))


# matching and scoring


def _signatures(spark, d):
    """One signature a frame: the orientation as axis, its size as flip, the place as twist."""
    frames = adapters.rotation_frames(adapters.read(spark, d, "embeddings"))
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))
    return frames.select(
        (F.col("run") * 100_000 + F.col("idx")).alias("sig_id"),
        *(F.col(f"o{a}").alias(f"a{a}") for a in "xyz"),
        (F.col("ox") * 360).alias("flip_deg"),
        (F.col("tx") * 1440).alias("twist_deg"),
        pick(adapters.DIRECTIONS, F.col("idx")).alias("sig_direction"),
        pick(adapters.SHAPES, F.col("idx")).alias("sig_shape"),
        pick(adapters.ENTRIES, F.col("idx")).alias("sig_entry"),
    )


@_query
def physics_match_topk(spark, d):
    return matching.best_matches(_signatures(spark, d), _catalog(spark, d))


@_query
def context_match(spark, d):
    return matching.best_matches(_signatures(spark, d), _catalog(spark, d), k=3, context="wall")


@_query
def hybrid_fusion(spark, d):
    lines = adapters.read(spark, d, "lineitem")
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("sig_id"), (F.col("l_partkey") % 50).alias("trick_id")).agg(F.round(F.max("l_quantity") / 50, 4).alias("confidence"))
    facts = adapters.read(spark, d, "supplier").select(F.col("s_suppkey").alias("sig_id"), ((F.col("s_suppkey") % 5) / 2).alias("flips"), ((F.col("s_suppkey") % 3) / 2).alias("twists"), (F.col("s_suppkey") % 2 == 0).alias("inverted"))
    return matching.hybrid_fusion(side("A"), side("R"), facts)


@_query
def ensemble_combine(spark, d):
    lines = adapters.read(spark, d, "lineitem")
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("run"), (F.col("l_partkey") % 50).alias("trick_id")).agg((F.max("l_quantity") / 50).alias("confidence"))
    return _rounded(matching.ensemble(side("A"), side("R")), 6)


@_query
def signature_minmax_confidence(spark, d):
    pairs = adapters.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query"), (F.col("l_partkey") % 100).alias("reference")).agg(F.min("l_extendedprice").alias("distance"))
    return _rounded(matching.relative_similarity(pairs), 6)


@_query
def rotation_bands(spark, d):
    frames = adapters.rotation_frames(adapters.read(spark, d, "embeddings")).withColumn("deg", F.col("ox") * 720)
    return matching.rotation_band(frames, "deg").groupBy("band").agg(F.count("*").alias("n"))


@_query
def top_labels(spark, d):
    vectors = adapters.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    return _rounded(matching.top_probabilities(vectors), 6)


@_query
def kp_quality_range_join(spark, d):
    poses = _poses(spark, d)
    spans = poses.select((F.col("run") * 100_000 + F.col("idx")).alias("detection_id"), "run", F.col("idx").alias("start_idx"), (F.col("idx") + 9).alias("end_idx"))
    return _rounded(scoring.keypoint_quality(spans, poses), 6)


@_query
def multi_factor_confidence(spark, d):
    lines = adapters.read(spark, d, "lineitem")
    coverage = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 10)
    found = scoring.multi_factor(1 - 5 * F.col("l_discount"), F.col("l_quantity") / 50, coverage, F.when(F.col("l_linenumber") % 2 == 0, F.lit(0.5)))
    return lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(found, 6).alias("confidence"))


@_query
def nms_greedy(spark, d):
    return scoring.suppress_overlaps(_detections(spark, d)).select("run", "detection_id")


@_query
def score_top3(spark, d):
    return _rounded(scoring.top_scored(_detections(spark, d), _difficulty(spark, d)), 3)


@_query
def repeat_rule(spark, d):
    return scoring.first_of_each(_detections(spark, d)).select("run", "trick_id", "detection_id")


@_query
def competition_score(spark, d):
    axis = F.when(F.col("detection_id") % 4 == 0, "off_axis").otherwise("lateral")
    scores = _difficulty(spark, d).select("trick_id", F.col("difficulty").alias("score"))
    return scoring.competition(_detections(spark, d).withColumn("axis", axis), scores)


# catalog


def _named(spark, d):
    return adapters.movement_names(adapters.read(spark, d, "part"))


@_query
def parse_names(spark, d):
    words = _named(spark, d).withColumn("words", names.tokens(F.col("name")))
    return words.select("id", *(c.alias(k) for k, c in names.parse(F.col("words")).items()))


@_query
def name_slug(spark, d):
    part = adapters.read(spark, d, "part")
    return part.select("p_partkey", names.slug(F.concat("p_name", F.lit(" (B-"), F.col("p_size").cast("string"), F.lit(")"))).alias("slug"))


@_query
def name_variants(spark, d):
    return adapters.read(spark, d, "part").select("p_partkey", F.explode(names.variants(F.col("p_name"))).alias("variant"))


@_query
def priority_merge(spark, d):
    c, s = adapters.read(spark, d, "customer"), adapters.read(spark, d, "supplier")
    first = s.select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("kind"))
    second = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return catalog.merge_sources([first, second], "key", ["name", "kind"])


def _label_sources(spark, d):
    o = adapters.read(spark, d, "orders")
    source = lambda keep, label: o.filter(keep).select(F.col("o_orderkey").alias("item"), label.alias("label"))
    return [
        source(F.col("o_orderkey") % 7 == 0, F.lit("not_a_flip")),
        source(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")),
        source(F.col("o_orderkey") >= 0, F.col("o_orderstatus")),
    ]


@_query
def label_precedence(spark, d):
    return catalog.label_precedence(_label_sources(spark, d))


@_query
def class_counts_filter(spark, d):
    return catalog.usable_classes(catalog.label_precedence(_label_sources(spark, d)))


@_query
def anti_join_plan(spark, d):
    c, o = adapters.read(spark, d, "customer"), adapters.read(spark, d, "orders").filter("o_orderstatus = 'P'")
    idle = c.join(o, c.c_custkey == o.o_custkey, "left_anti")
    return idle.select("c_custkey", "c_mktsegment")


@_query
def work_status(spark, d):
    c, o = adapters.read(spark, d, "customer"), adapters.read(spark, d, "orders")
    of = lambda status: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id")).distinct()
    return catalog.work_status(c.select(F.col("c_custkey").alias("id")), of("F"), of("O"))


@_query
def chunk_worklist(spark, d):
    return catalog.chunked(adapters.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", 7)


@_query
def diverse_topn(spark, d):
    items = _catalog(spark, d).withColumnRenamed("trick_id", "id")
    return catalog.diverse_top(items, ["flips", "twists", "axis", "direction"], "score", 50).select("id", "score")


@_query
def per_class_limit(spark, d):
    return catalog.first_of_class(adapters.read(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 5)


@_query
def combo_overlap(spark, d):
    items = _catalog(spark, d)
    of = lambda context: items.filter(F.col("context") == context).select("flips", "twists", "axis", "direction", "shape")
    a, b = of("ground"), of("wall")
    sets = {"both": a.intersect(b), "only_ground": a.subtract(b), "only_wall": b.subtract(a)}
    out = None
    for name, rows in sets.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _graph(spark, d):
    part = adapters.read(spark, d, "part")
    tricks = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 5.0).alias("difficulty"))
    edges = part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("prerequisite"))
    return tricks, edges.filter("prerequisite > 0")


@_query
def prereq_violations(spark, d):
    return catalog.prerequisite_violations(*_graph(spark, d))


@_query
def difficulty_fixpoint(spark, d):
    return _rounded(catalog.propagate_difficulty(*_graph(spark, d)), 1)


@_query
def difficulty_estimate(spark, d):
    parsed = parse_names(spark, d).withColumn("difficulty", F.when(F.col("id") % 4 == 0, (F.col("id") % 9 + 1).cast("double")))
    return catalog.estimated_difficulty(parsed).select("id", "difficulty")


@_query
def confusion_matrix(spark, d):
    return _rounded(catalog.confusion(adapters.read(spark, d, "labels"), "quality", "toxic").select(F.col("truth").cast("long").alias("truth"), F.col("guess").cast("long").alias("guess"), "n", "share", "accuracy"), 6)


@_query
def coverage_counts(spark, d):
    merged = priority_merge(spark, d)
    return merged.groupBy("sources").agg(F.count("*").alias("n"))


# surface


@_query
def run_lookup_json(spark, d):
    events = adapters.read(spark, d, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query
def override_text(spark, d):
    o = adapters.read(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_orderkey", F.format_string("Judge override: order %d set from %s to %s", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("message"))


@_query
def submissions_by_status(spark, d):
    o = adapters.read(spark, d, "orders").filter("o_orderstatus = 'P'")
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return o.withColumn("nth", F.row_number().over(order).cast("long")).select("o_custkey", "nth", "o_orderkey")


@_query
def html_fields(spark, d):
    pages = adapters.read(spark, d, "pages")
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count(html, F.lit(r'<a href="')).cast("long").alias("links"),
    )


@_query
def conversation_log(spark, d):
    c = adapters.read(spark, d, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), F.coalesce(x["role"], F.lit("")))), ",").alias("log"))


def queries() -> dict[str, Query]:
    return _QUERIES | further_queries.queries() | turn_queries.queries() | catalog_queries.queries()


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | further_sql.oracle_sql(further_queries.RULES) | turn_sql.oracle_sql() | catalog_sql.oracle_sql()
