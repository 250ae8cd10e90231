"""Matching of measured signatures with a catalog of definitions, and fusion of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators import etl
from motionframe.sources import storage

#: Fixed values of the weighted distance.
WEIGHTS = {"axis": 0.20, "rotation": 0.30, "twist": 0.25, "shape": 0.05, "entry": 0.05, "direction": 0.15}
ROTATION_TOLERANCE, TWIST_TOLERANCE, AXIS_TOLERANCE = 180.0, 180.0, 45.0
#: Axis vectors (right, up, forward) before normalisation.
AXIS_VECTORS = {"lateral": (1.0, 0.0, 0.0), "sagittal": (0.0, 0.0, 1.0), "longitudinal": (0.0, 1.0, 0.0), "off_axis": (0.7, 0.3, 0.7)}

#: What a definition's confidence depends on.
PHYSICS = ["flips", "twists", "axis", "direction", "shape", "entry"]
#: Combinations up to which they are broadcast; they are counted first.
BROADCAST_COMBINATIONS = 200_000


def _axis_part(component: int) -> Column:
    out = F.lit(None).cast("double")
    for name, vector in AXIS_VECTORS.items():
        norm = sum(c * c for c in vector) ** 0.5
        out = F.when(F.col("axis") == name, vector[component] / norm).otherwise(out)
    return out


def _apart(a: str, b: str, near: tuple[str, str]) -> Column:
    """0 if equal, 0.3 for the two near values, 0.5 otherwise."""
    pair = F.col(a).isin(*near) & F.col(b).isin(*near)
    return F.when(F.col(a) == F.col(b), 0.0).when(pair, 0.3).otherwise(0.5)


def distances(signatures: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every signature (sig_id, ax, ay, az, flip_deg, twist_deg, sig_direction, sig_shape, sig_entry) with every definition and its confidence."""
    norm = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    unit = F.when(norm > 1e-6, norm).otherwise(1.0)
    # what depends on one side only is computed before the sides meet
    measured = signatures.withColumns({f"unit_{a}": F.col(f"a{a}") / unit for a in "xyz"})
    both = measured.crossJoin(catalog.withColumns({f"axis_{a}": _axis_part(k) for k, a in enumerate("xyz")}))
    cosine = F.least(F.abs(sum((F.col(f"unit_{a}") * F.col(f"axis_{a}") for a in "xyz"), F.lit(0.0))), F.lit(1.0))
    off = lambda measured, expected, tolerance: F.least(F.abs(F.abs(measured) / 360 - expected) * 360 / tolerance, F.lit(1.0))
    parts = {
        "axis": F.least(F.degrees(F.acos(cosine)) / AXIS_TOLERANCE, F.lit(1.0)),
        "rotation": off(F.col("flip_deg"), F.col("flips"), ROTATION_TOLERANCE),
        "twist": off(F.col("twist_deg"), F.col("twists"), TWIST_TOLERANCE),
        "shape": _apart("sig_shape", "shape", ("tuck", "pike")),
        "entry": _apart("sig_entry", "entry", ("standing", "running")),
        "direction": F.when(F.col("axis") == "sagittal", 0.0).when(F.col("sig_direction") == F.col("direction"), 0.0).otherwise(1.0),
    }
    total = sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    named = [f"{side}_{a}" for side in ("unit", "axis") for a in "xyz"]
    return both.withColumn("confidence", F.greatest(F.round(1 - total, 9), F.lit(0.0))).drop(*named)


def top_matches(scored: DataFrame, k: int = 5, least: float = 0.1, context: str | None = None) -> DataFrame:
    """sig_id, rank, trick_id, confidence of the ``k`` best; ties go to the lower score, then to the name."""
    kept = scored.filter(F.col("confidence") >= least)
    if context is not None:
        kept = kept.filter(F.col("context") == context)
    order = Window.partitionBy("sig_id").orderBy(F.col("confidence").desc(), "score", "name", "trick_id")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("sig_id", "rank", "trick_id", "confidence")


def combinations(catalog: DataFrame, k: int) -> DataFrame:
    """Every distinct combination of ``PHYSICS`` with members, its first ``k`` definitions by score, name and id."""
    order = Window.partitionBy(*PHYSICS).orderBy("score", "name", "trick_id")
    first = catalog.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return first.groupBy(*PHYSICS).agg(F.array_sort(F.collect_list(F.struct("place", "score", "name", "trick_id"))).alias("members"))


def best_matches(signatures: DataFrame, catalog: DataFrame, k: int = 5, least: float = 0.1, context: str | None = None) -> DataFrame:
    """:func:`top_matches` of :func:`distances`, but signatures meet combinations, whose number does not grow with the catalog.

    Definitions of one combination have one confidence, so the ``k`` best are among the first ``k`` of the ``k``
    combinations whose first definitions are best.
    """
    kept = catalog if context is None else catalog.filter(F.col("context") == context)
    # the pairs carry the combination's first definition by number; its members join the few that are left
    found = storage.cut(combinations(kept, k).withColumn("place", F.row_number().over(Window.orderBy(*(F.element_at("members", 1)[c] for c in ("score", "name", "trick_id"))))))
    slim = found.select(*PHYSICS, "place")
    scored = distances(signatures, F.broadcast(slim) if slim.count() <= BROADCAST_COMBINATIONS else slim).filter(F.col("confidence") >= least).select("sig_id", "confidence", "place")
    order = Window.partitionBy("sig_id").orderBy(F.col("confidence").desc(), "place")
    best = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).join(found.select("place", "members"), "place")
    return top_matches(best.select("sig_id", "confidence", F.explode("members").alias("m")).select("sig_id", "confidence", "m.score", "m.name", "m.trick_id"), k, least)


def hybrid_fusion(physics: DataFrame, motion: DataFrame, facts: DataFrame) -> DataFrame:
    """sig_id, trick_id, confidence: candidates of either matcher, weighted by how complex the movement is."""
    both = physics.select("sig_id", "trick_id", F.col("confidence").alias("p")).join(motion.select("sig_id", "trick_id", F.col("confidence").alias("m")), ["sig_id", "trick_id"], "full_outer")
    known = both.join(facts, "sig_id").withColumns({"p": F.coalesce("p", F.lit(0.0)), "m": F.coalesce("m", F.lit(0.0))})
    share = F.when((F.col("flips") >= 1.5) | (F.col("twists") >= 1.5), 0.25).when(~F.col("inverted"), 0.3).otherwise(0.4)
    bonus = F.when((F.col("p") > 0.3) & (F.col("m") > 0.3), 0.15).otherwise(0.0)
    return known.select("sig_id", "trick_id", F.round(F.least(share * F.col("p") + (1 - share) * F.col("m") + bonus, F.lit(1.0)), 3).alias("confidence"))


def fused_by_name(physics: DataFrame, motion: DataFrame, facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """sig_id, trick_id, name, p, m, confidence: candidates of a matcher that knows ids (sig_id, trick_id, name, confidence) and of one that
    knows names (sig_id, nth, name, confidence).

    A name is resolved in ``catalog`` (trick_id, name, pos) by slug, else by lower-case name.  Of matches that resolve to one id the last
    counts; a name that does not gets its slug with underlines for spaces as id, where the surest counts, and raises one already there.
    """
    known = etl.resolved_names(motion.select("name").distinct(), catalog)
    found = motion.join(known, "name", "left").withColumns({"own": F.coalesce("trick_id", F.regexp_replace(F.lower("name"), " ", "_")), "is_known": F.col("trick_id").isNotNull()}).drop("trick_id")
    last = found.withColumn("from_nth", F.max(F.when(F.col("is_known"), F.col("nth"))).over(Window.partitionBy("sig_id", "own")))
    counted = last.filter(F.col("from_nth").isNull() | (F.col("nth") >= F.col("from_nth"))).groupBy("sig_id", "own").agg(F.max("confidence").alias("m"))
    named = found.groupBy("sig_id", "own").agg(F.min_by("name", "nth").alias("motion_name")).join(counted, ["sig_id", "own"]).withColumnRenamed("own", "trick_id")
    names_ = physics.select("sig_id", "trick_id", F.col("name").alias("physics_name")).join(named.select("sig_id", "trick_id", "motion_name"), ["sig_id", "trick_id"], "full_outer")
    both = physics.select("sig_id", "trick_id", F.col("confidence").alias("p")).join(named.select("sig_id", "trick_id", "m"), ["sig_id", "trick_id"], "full_outer")
    fused = hybrid_fusion(both.filter("p IS NOT NULL").select("sig_id", "trick_id", F.col("p").alias("confidence")), both.filter("m IS NOT NULL").select("sig_id", "trick_id", F.col("m").alias("confidence")), facts)
    return fused.join(both, ["sig_id", "trick_id"]).join(names_, ["sig_id", "trick_id"]).select("sig_id", "trick_id", F.coalesce("physics_name", "motion_name").alias("name"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("m", F.lit(0.0)).alias("m"), "confidence")


def ensemble(first: DataFrame, second: DataFrame, weight: float = 0.6) -> DataFrame:
    """run, trick_id, confidence: weighted mean of two strategies, or the one that is there."""
    a, b = first.withColumnRenamed("confidence", "a"), second.withColumnRenamed("confidence", "b")
    both = a.join(b, ["run", "trick_id"], "full_outer")
    mean = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(weight * F.col("a") + (1 - weight) * F.col("b"))
    return both.select("run", "trick_id", mean.alias("confidence"))


def relative_similarity(distances: DataFrame) -> DataFrame:
    """query, reference, similarity: distances scaled within each query, 1 for the nearest."""
    of_query = Window.partitionBy("query")
    low, high = F.min("distance").over(of_query), F.max("distance").over(of_query)
    return distances.select("query", "reference", F.when(high > low, 1 - (F.col("distance") - low) / (high - low)).otherwise(1.0).alias("similarity"))


def rotation_band(frames: DataFrame, degrees: str) -> DataFrame:
    """Adds a coarse class by rotation bands, the first that fits."""
    x = F.abs(F.col(degrees))
    return frames.withColumn("band", F.when(x < 90, "none").when(x < 270, "half").when(x < 450, "single").when(x < 810, "double").otherwise("multiple"))


def top_probabilities(vectors: DataFrame, k: int = 3, skip: int = 0) -> DataFrame:
    """id, rank, class, p of the ``k`` largest entries of the array ``p``, leaving out the class ``skip``."""
    each = vectors.select("id", F.posexplode("p").alias("class", "p")).filter(F.col("class") != skip)
    order = Window.partitionBy("id").orderBy(F.col("p").desc(), "class")
    return each.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("id", "rank", F.col("class").cast("long").alias("class"), "p")
