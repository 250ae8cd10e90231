"""Building the catalog from several sources: hints from texts, names and types, resolution of names, attributes, label encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions import names

#: Patterns of a description, tried in order.
DIRECTION_HINTS = ((r"\bbackward\b", "backward"), (r"\bback\s?flip", "backward"), (r"\bforward\b", "forward"), (r"\bfront\s?flip", "forward"), (r"\bside\s?flip", "left"), (r"\blateral\b", "left"))
SHAPE_HINTS = ((r"\btuck(ed)?\b", "tuck"), (r"\bpiked?\b", "pike"), (r"\blayout\b", "layout"), (r"\bstraight\b", "layout"), (r"\bopen\b", "open"), (r"\bstraddled?\b", "open"))
COUNT_WORDS = (("double", 2.0), ("triple", 3.0), ("quad", 4.0), ("quadruple", 4.0))
DEGREE_WORDS = (("180", 0.5), ("360", 1.0), ("540", 1.5), ("720", 2.0), ("900", 2.5), ("1080", 3.0), ("1260", 3.5), ("1440", 4.0))
TWIST_HINTS = (("double twist", 2.0), ("triple twist", 3.0), ("full twist", 1.0), ("half twist", 0.5), ("full", 1.0))
#: Difficulty classes on the scale of 1 to 10, and hints of a category or a type.
CLASS_DIFFICULTY = {"A": 2.0, "B": 4.0, "C": 7.0, "D": 9.0}
CATEGORY_AXIS = {"vertical-kicks": "longitudinal", "spin-kicks": "longitudinal", "twists": "longitudinal"}
CATEGORY_DIRECTION = {"backward-tricks": "backward", "forward-tricks": "forward"}
CATEGORY_FAMILY = {"vertical-kicks": "kick", "spin-kicks": "kick", "ground-moves": "ground", "transitions": "transition"}
TYPE_AXIS = {"kick": "longitudinal", "flip": "lateral", "twist": "longitudinal", "invert/flip": "lateral"}
TYPE_FAMILY = {"kick": "kick", "flip": "flip", "invert": "ground", "invert/kick": "kick", "invert/flip": "flip"}
#: Bins of the encoded counts.
ROTATION_BINS, TWIST_BINS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0), (0.0, 0.5, 1.0, 2.0, 3.0)


def _first_hint(text: Column, hints: tuple[tuple[str, object], ...]) -> Column:
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(value)) for pattern, value in hints))


def description_hints(text: Column) -> dict[str, Column]:
    """direction, shape, rotation, twist and axis that a description suggests; null where it does not.

    Multiples count as rotations only where no "twist" is near the word's first place, as far as 5 characters before and 10 after.
    """
    low = F.lower(text)

    def counted(word: str, value: float) -> Column:
        at = F.instr(low, word)
        near = F.substring(low, F.greatest(at - 5, F.lit(1)), F.lit(len(word) + 10) + F.least(at - 1, F.lit(5)))
        return F.when(low.rlike(rf"\b{word}\b") & ~F.contains(near, F.lit("twist")), F.lit(value))

    rotation = F.coalesce(*(counted(*c) for c in COUNT_WORDS), *(F.when(low.rlike(rf"\b{w}\b"), F.lit(v)) for w, v in DEGREE_WORDS))
    twist = F.coalesce(*(F.when(F.contains(low, F.lit(phrase)), F.lit(v)) for phrase, v in sorted(TWIST_HINTS, key=lambda h: -len(h[0]))))
    axis = F.when(low.rlike(r"\bcork(screw)?\b"), "off_axis").when(low.rlike(r"\btwist(ing)?\b") & ~F.contains(low, F.lit("flip")), "longitudinal").when(low.rlike(r"\bflip(ping)?\b"), "lateral")
    return {"direction": _first_hint(low, DIRECTION_HINTS), "shape": _first_hint(low, SHAPE_HINTS), "rotation": rotation, "twist": twist, "axis": axis}


def type_hints(kind: Column) -> dict[str, Column]:
    """axis, rotation, twist, family and entry of a type such as "Wall/Flip/Twist"."""
    parts = F.transform(F.split(F.lower(kind), "/"), lambda p: F.trim(p))
    has = lambda word: F.array_contains(parts, word)
    return {
        "axis": F.when(has("flip"), "lateral").when(has("twist"), "longitudinal"),
        "rotation": F.when(has("flip"), 1.0),
        "twist": F.when(has("twist"), 1.0),
        # the last of the parts that name a family decides
        "family": F.when(has("ground"), "ground").when(has("vault"), "vault").when(has("bar"), "bar").when(has("roll"), "roll"),
        "entry": F.when(has("vault"), "running").when(has("bar"), "edge").when(has("wall"), "wall"),
    }


def looked_up(key: Column, table: dict[str, object]) -> Column:
    """The value of ``key`` in a fixed table, null where it has none."""
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()))


def unified_difficulty(level: Column, letter: Column) -> Column:
    """Mean of the level and of the class on one scale, to one decimal; null without either."""
    of_class = looked_up(letter, CLASS_DIFFICULTY)
    return F.round(F.when(level.isNull(), of_class).when(of_class.isNull(), level.cast("double")).otherwise((level + of_class) / 2), 1)


def merged_attribute(*by_priority: Column) -> Column:
    """The first known value; what the name itself says comes first, then hints, the strongest first."""
    return F.coalesce(*by_priority)


def strict_slug(name: Column) -> Column:
    """Lower case with everything but letters and digits as single underlines, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def localised(translations: Column, fallback: Column, language: str) -> Column:
    """The name in ``language``, else the English one, else ``fallback``."""
    return F.coalesce(F.element_at(translations, language), F.element_at(translations, "en"), fallback)


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of every key, in order; unlike with ``dropDuplicates`` it is known which."""
    window = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_key", "_nth")


def resolved_names(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """name, trick_id: by equal slug, else by equal lower-case name, the first in catalog order (``pos``)."""
    by_slug = catalog.groupBy(names.slug(F.col("name")).alias("slug")).agg(F.min_by("trick_id", "pos").alias("of_slug"))
    by_name = catalog.groupBy(F.lower("name").alias("low")).agg(F.min_by("trick_id", "pos").alias("of_name"))
    both = wanted.withColumns({"slug": names.slug(F.col("name")), "low": F.lower("name")}).join(by_slug, "slug", "left").join(by_name, "low", "left")
    return both.select("name", F.coalesce("of_slug", "of_name").alias("trick_id"))


def mapped(items: DataFrame, index: DataFrame, manual: DataFrame) -> DataFrame:
    """name, url: by the manual name (not "NO MATCH"), else by the own one; of equal index names the last counts, of equal urls the first item (``pos``)."""
    by_name = index.filter("url IS NOT NULL AND trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("low")).agg(F.max_by("url", "pos").alias("url"))
    chosen = manual.filter("target <> 'NO MATCH'").select("name", F.lower("target").alias("low_target"))
    one, two = by_name.select(F.col("low").alias("low_target"), F.col("url").alias("of_target")), by_name.select(F.col("low").alias("low_name"), F.col("url").alias("of_name"))
    found = items.withColumn("low_name", F.lower("name")).join(chosen, "name", "left").join(one, "low_target", "left").join(two, "low_name", "left")
    known = found.select("name", "pos", F.coalesce("of_target", "of_name").alias("url")).filter("url IS NOT NULL")
    return keep_first(known, F.col("url"), ["pos"]).select("name", "url")


def prerequisites_by_id(tricks: DataFrame) -> DataFrame:
    """id, prerequisites: sorted distinct names of the ids in prerequisite_ids that are known, and those listed already."""
    each = tricks.select("id", F.explode("prerequisite_ids").alias("other")).join(tricks.select(F.col("id").alias("other"), "name"), "other")
    found = each.groupBy("id").agg(F.collect_set("name").alias("found"))
    empty = F.array().cast("array<string>")
    return tricks.select("id", F.col("prerequisites").alias("own")).join(found, "id", "left").select("id", F.array_sort(F.array_union(F.coalesce("own", empty), F.coalesce("found", empty))).alias("prerequisites"))


def entities(sources: list[DataFrame]) -> DataFrame:
    """source, name, entity of rows (name) from sources in the order of their priority; the entity is the name that came first.

    A name joins the entity that one of its variants belongs to: variants of earlier names that founded an entity, the one
    of the lowest source and, in it, of the first name; otherwise it founds one.  Names that join add no variants.
    """
    known, out = None, None
    for priority, rows in enumerate(sources):
        own = rows.select("name").distinct().withColumn("variant", F.explode(names.variants(F.col("name"))))
        if known is None:
            joined = own.select("name", F.lit(None).cast("string").alias("entity")).distinct()
        else:
            joined = own.join(known, "variant", "left").groupBy("name").agg(F.min(F.when(F.col("entity").isNotNull(), F.struct("of", "entity"))).alias("first")).select("name", F.col("first.entity").alias("entity"))
        # names of one source that share a variant are one entity, that of the first name
        fresh = own.join(joined.filter("entity IS NULL").select("name"), "name")
        lead = fresh.groupBy("variant").agg(F.min("name").alias("lead"))
        led = fresh.join(lead, "variant").groupBy("name").agg(F.min("lead").alias("lead"))
        named = joined.join(led, "name", "left").select("name", F.coalesce("entity", "lead", "name").alias("entity"))
        found = fresh.join(led, "name").filter("name = lead").select("variant", F.col("name").alias("entity"), F.lit(priority).alias("of")).distinct()
        known = found if known is None else known.unionByName(found)
        one = named.select(F.lit(priority).cast("long").alias("source"), "name", "entity")
        out = one if out is None else out.unionByName(one)
    return out


def collected_texts(rows: DataFrame, key: str) -> DataFrame:
    """key, descriptions: a map from source to text, without empty texts; of several the first in order."""
    known = rows.filter("text IS NOT NULL AND trim(text) <> ''").groupBy(key, "source").agg(F.min("text").alias("text"))
    every = rows.select(key).distinct()
    mapped_ = known.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "text")))).alias("descriptions"))
    return every.join(mapped_, key, "left").select(key, F.coalesce("descriptions", F.create_map().cast("map<string,string>")).alias("descriptions"))


def nearest_bin(value: Column, bins: tuple[float, ...]) -> Column:
    """The number of the nearest bin, the first of equals."""
    off = F.array(*(F.abs(value - b) for b in bins))
    return F.array_position(off, F.array_min(off)) - 1


def encoded(definitions: DataFrame, axes: tuple[str, ...], directions: tuple[str, ...], shapes: tuple[str, ...], entries: tuple[str, ...]) -> DataFrame:
    """trick_id and the class numbers of the six property heads."""
    place = lambda c, values: (F.array_position(F.array(*(F.lit(v) for v in values)), F.col(c)) - 1).alias(c)
    return definitions.select("trick_id", place("axis", axes), place("direction", directions), nearest_bin(F.col("flips"), ROTATION_BINS).alias("rotation"), place("shape", shapes), place("entry", entries), nearest_bin(F.col("twists"), TWIST_BINS).alias("twist"))


HEADS = ("axis", "direction", "rotation", "shape", "entry", "twist")


def resolve_heads(predictions: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """id, trick_id, confidence of property predictions (id, no_trick, is_trick and a class and p_ of every head).

    The trick whose properties agree with the surest heads, the first by ``pos`` of equals; "no_trick" where that is likelier and
    "uncertain" where the heads' geometric mean is below ``least``.
    """
    table = labels.select("trick_id", "pos", *(F.col(h).alias(f"l_{h}") for h in HEADS))
    # tricks of the same properties have the same score: the first of each combination stands for them
    first = table.groupBy(*(f"l_{h}" for h in HEADS)).agg(F.min(F.struct("pos", "trick_id")).alias("t"))
    score = sum((F.when(F.col(h) == F.col(f"l_{h}"), F.col(f"p_{h}")).otherwise(0.0) for h in HEADS), F.lit(0.0))
    # the combinations of six heads are bounded by their class counts
    both = predictions.filter("is_trick >= no_trick").crossJoin(F.broadcast(first)).select("id", F.round(score, 9).alias("score"), F.col("t").alias("t"))
    best = both.groupBy("id").agg(F.max_by("t", F.struct("score", -F.col("t.pos"))).alias("t"))
    mean = F.pow(F.lit(1.0), F.lit(1.0))
    for h in HEADS:
        mean = mean * F.col(f"p_{h}")
    sure = F.pow(mean, F.lit(1.0 / len(HEADS)))
    named = predictions.join(best, "id", "left")
    trick = F.when(F.col("no_trick") > F.col("is_trick"), "no_trick").when(sure < least, "uncertain").otherwise(F.col("t.trick_id").cast("string"))
    return named.select("id", trick.alias("trick_id"), F.when(F.col("no_trick") > F.col("is_trick"), F.col("no_trick")).otherwise(sure).alias("confidence"))


def sorted_classes(labels: DataFrame, first: str | None = None) -> DataFrame:
    """label, class: numbers of the distinct labels in order, ``first`` being 0 if it is there."""
    every = labels.select("label").distinct()
    front = F.col("label") != F.lit(first) if first is not None else F.lit(True)
    # as many rows as there are classes
    return every.withColumn("class", (F.row_number().over(Window.orderBy(front, "label")) - 1).cast("long"))


def catalog_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side and the rows that only one of two catalogs has, repeats counted; none if they are equal."""
    columns = a.columns
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def download_plan(tricks: DataFrame, count: int) -> DataFrame:
    """The ``count`` tricks of the most sources, easier ones first."""
    return tricks.orderBy(F.col("sources").desc(), "difficulty", "id").limit(count)


def grouped_clips(clips: DataFrame) -> DataFrame:
    """trick_id, clips: the distinct stems of each trick's files, sorted."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return clips.groupBy("trick_id").agg(F.sort_array(F.collect_set(stem)).alias("clips"))


def mean_curves(steps: DataFrame) -> DataFrame:
    """trick_id, step, mean, deviation: of the resampled curves of each trick's clips, the deviation kept above zero."""
    return steps.groupBy("trick_id", "step").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") + 1e-6).alias("deviation"))


def violation_rate(edges: DataFrame, violations: DataFrame) -> DataFrame:
    """edges, violations, rate of prerequisites harder than their trick; rate 0 without edges."""
    counts = edges.agg(F.count("*").alias("edges")).crossJoin(violations.agg(F.count("*").alias("violations")))
    return counts.withColumn("rate", F.coalesce(F.try_divide("violations", "edges"), F.lit(0.0)))
