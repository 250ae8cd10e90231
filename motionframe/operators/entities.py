"""One catalog row for each movement that several sources name: resolution of names in order, and attributes by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.functions import names
from motionframe.sources.storage import cut


def _follow(pointers: DataFrame) -> DataFrame:
    """``pointers`` (at, to) with ``to`` moved to the end of its chain; an end points to itself.  Each turn doubles what is followed."""
    while True:
        ahead = pointers.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
        moved = cut(pointers.join(ahead, "to").select("at", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("at", "to")
        pointers = moved.select("at", "to")


def resolved(rows: DataFrame) -> DataFrame:
    """source, pos, name, canonical, leads of every row of ``rows`` (source, pos, name, alias), taken in the order of source and pos.

    A row whose name has a variant that was claimed before joins the entity that claimed it first; otherwise it leads a new entity,
    named by its normal form, and claims all its variants.  A row's alias, if not empty, claims for the row's entity what is still
    free.  Whether a row leads depends on the rows before it that share a variant: of the rows still open, those that are the first
    for all their variants lead, and those that share one with an earlier leader, or with an earlier alias, join.  Both are read off
    the least places of each variant, so no pairs of rows are formed, and turns repeat until none is open.

    Rows of one name share their variants, so only the first of them can lead, and all others join what it leads or joins; of the rows
    with one alias only the first claims.  So variants are made, and turns are taken, for different names and aliases alone.

    Edge cases: a null name counts as empty; names without letters or digits share the empty form; equal places are not allowed.
    """
    placed = rows.select(F.col("source").cast("long").alias("source"), F.col("pos").cast("long").alias("pos"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("alias", F.lit("")).alias("alias"))
    at = F.struct("source", "pos").alias("at")
    # the least place within a source first, as numbers are put together while they are read
    by_pair = cut(placed.groupBy("name", "alias", "source").agg(F.min("pos").alias("pos")))
    heads = cut(by_pair.groupBy("name").agg(F.min(at).alias("at")))
    aliased_rows = cut(by_pair.filter("alias <> ''").groupBy("alias").agg(F.min(F.struct(at, "name")).alias("m")).select("alias", "m.at", "m.name"))
    own = cut(heads.select("at", F.explode(names.all_variants(F.col("name"))).alias("variant")))
    of_alias = cut(aliased_rows.select("at", F.explode(names.all_variants(F.col("alias"))).alias("variant")))
    aliased = of_alias.groupBy("variant").agg(F.min("at").alias("alias_at"))
    taken = own.join(aliased, "variant").filter("alias_at < at").select("at").distinct()
    leads = None
    open_ = cut(heads.select("at").join(taken, "at", "left_anti"))
    while not open_.isEmpty():
        here = own.join(open_, "at")
        first = here.groupBy("variant").agg(F.min("at").alias("first"))
        state = here.join(first, "variant")
        if leads is not None:
            led = own.join(leads, "at").groupBy("variant").agg(F.min("at").alias("led"))
            state = state.join(led, "variant", "left").groupBy("at").agg(F.bool_or(F.coalesce(F.col("led") < F.col("at"), F.lit(False))).alias("joins"), F.bool_and(F.col("first") == F.col("at")).alias("is_first"))
        else:
            state = state.groupBy("at").agg(F.lit(False).alias("joins"), F.bool_and(F.col("first") == F.col("at")).alias("is_first"))
        decided = cut(state)
        fresh = decided.filter("NOT joins AND is_first").select("at")
        leads = cut(fresh if leads is None else leads.unionByName(fresh))
        open_ = decided.filter("NOT joins AND NOT is_first").select("at")
    if leads is None:
        return rows.sparkSession.createDataFrame([], "source long, pos long, name string, canonical string, leads boolean")
    # what claimed each variant first: a leader's name, or an alias, whose row may have joined another
    claims = own.join(leads, "at").unionByName(of_alias).groupBy("variant").agg(F.min("at").alias("claim"))
    joins = own.join(leads, "at", "left_anti").join(claims, "variant").filter("claim < at").groupBy("at").agg(F.min("claim").alias("to"))
    # a row that only its alias brings in goes where the first row of its name goes
    others = aliased_rows.join(heads.select("name", F.col("at").alias("to")), "name").filter("at <> to").select("at", "to").distinct()
    ends = _follow(cut(joins.unionByName(leads.select("at", F.col("at").alias("to"))).unionByName(others)))
    canonical = heads.join(leads, "at").select(F.col("at").alias("to"), names.normal(F.col("name")).alias("canonical"))
    of_name = cut(heads.join(ends, "at").join(canonical, "to").select("name", "to", "canonical"))
    return placed.join(of_name, "name").select("source", "pos", "name", "canonical", ((F.col("to.source") == F.col("source")) & (F.col("to.pos") == F.col("pos"))).alias("leads"))


def displayed(found: DataFrame, titled: int | None = None) -> DataFrame:
    """canonical, display_name, sources (ascending) and records, the place of each source's last row, of every entity in :func:`resolved`.

    The display name is the last one of the first source but the last source, whose names are shown only where they lead; source
    ``titled`` writes in capitals and is shown in title case.
    """
    last = found.agg(F.max("source")).first()[0]
    by_source = found.groupBy("canonical", "source").agg(F.max("pos").alias("pos"), F.max_by("name", "pos").alias("name"), F.max(F.when(F.col("leads"), F.trim("name"))).alias("lead"))
    shown = F.when(F.col("source") == F.lit(last), F.col("lead")).when(F.col("source") == F.lit(titled), names.title(F.col("name"))).otherwise(F.col("name"))
    return by_source.groupBy("canonical").agg(
        F.min_by(shown, "source").alias("display_name"),
        F.sort_array(F.collect_list("source")).alias("sources"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "pos")))).alias("records"),
    )


FIELDS = ("rotation", "twist", "axis", "direction", "shape", "entry", "family")


def merged_attributes(name: Column, hints: list[dict[str, Column]]) -> dict[str, Column]:
    """The seven fields of a movement: what its name says outright, else the strongest hint, else what its name implies.

    ``hints`` are in the order of strength, the strongest first; each holds some of the fields, null where it has none.
    """
    return _merged(names.tokens(name), hints)


def _merged(words: Column, hints: list[dict[str, Column]]) -> dict[str, Column]:
    parsed, said = names.parse(words), names.explicit(words)
    return {f: F.when(said[f], parsed[f]).otherwise(F.coalesce(*(h[f] for h in hints if f in h), parsed[f])) for f in FIELDS}


def with_attributes(rows: DataFrame, key: str, name: Column, hints: list[dict[str, Column]]) -> DataFrame:
    """``key`` and the :func:`merged_attributes` of every row.

    A name's words, what it says and what the hints say are made once for each different name and for each row's hints, one after the
    other: written out in full every field would split and read the name anew for each of its uses.  Rows are dealt out first, as a small
    file would be a single task.
    """
    hinted = rows.repartition(key).select(key, name.alias("_name"), *(c.alias(f"_{n}_{f}") for n, h in enumerate(hints) for f, c in h.items()))
    words = hinted.select("_name").distinct().withColumn("_words", names.tokens(F.col("_name")))
    parsed, said = names.parse(F.col("_words")), names.explicit(F.col("_words"))
    read = words.select("_name", *(parsed[f].alias(f"_parsed_{f}") for f in FIELDS), *(said[f].alias(f"_said_{f}") for f in FIELDS))
    both = hinted.join(read, hinted["_name"].eqNullSafe(read["_name"]), "left")
    chosen = lambda f: F.coalesce(*(F.col(f"_{n}_{f}") for n, h in enumerate(hints) if f in h), F.col(f"_parsed_{f}"))
    return both.select(key, *(F.when(F.col(f"_said_{f}"), F.col(f"_parsed_{f}")).otherwise(chosen(f)).alias(f) for f in FIELDS))
