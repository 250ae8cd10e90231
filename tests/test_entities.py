import random
import re

import pytest
from pyspark.sql import functions as F

from motionframe.functions import names
from motionframe.operators import entities


def normal(name):
    return " ".join(re.sub("[^a-z0-9 ]", "", re.sub("[-_]", " ", name.lower())).split(" ")).strip() if name else ""


def form(name):
    return re.sub(" +", " ", normal(name)).strip()


def variants(name):
    norm = form(name)
    words = norm.split()
    out = {norm, " ".join(names.COMPOUNDS.get(w, w) for w in words)}
    out |= {" ".join([*words[:i], words[i] + words[i + 1], *words[i + 2 :]]) for i in range(len(words) - 1)}
    for one, two in names.COMPOUNDS.items():
        out |= {norm.replace(two, one)} if two in norm else set()
        out |= {norm.replace(one, two)} if one in norm else set()
    return out


def fold(rows):
    """Rows in order, each joining the entity that claimed one of its variants first."""
    claimed, out = {}, []
    for when, (source, pos, name, alias) in enumerate(sorted(rows, key=lambda r: r[:2])):
        own = variants(name)
        found = min((claimed[v] for v in own if v in claimed), default=None)
        entity = found[1] if found else form(name)
        if not found:
            for v in own:
                claimed[v] = (when, entity)
        for v in variants(alias) if alias else ():
            claimed.setdefault(v, (when, entity))
        out.append((source, pos, name or "", entity, not found))
    return sorted(out)


WORDS = ["back", "flip", "backflip", "Hand-Spring", "handspring", "full", "twist", "fulltwist", "side", "swing", "Side_swing", "round", "off", "roundoff", "kick", "a", "b", "ab"]


@pytest.mark.parametrize("seed", range(2))
def test_names_join_as_in_a_sequential_fold(spark, seed):
    rng = random.Random(seed)
    made = lambda: rng.choice([None, "", "!?"]) if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))
    rows = [(s, p, made(), made() if s == 0 and rng.random() < 0.5 else None) for s in range(4) for p in range(60)]
    frame = spark.createDataFrame(rows, "source long, pos long, name string, alias string")
    got = sorted(tuple(r) for r in entities.resolved(frame).collect())
    assert got == fold(rows)
    assert len({r[3] for r in got}) > 20 and sum(not r[4] for r in got) > 60


def test_chain_of_aliases_and_late_leaders(spark):
    rows = [(0, 0, "one", "two"), (0, 1, "two", "three"), (0, 2, "three", "four"), (1, 0, "Four!", None), (1, 1, "side swing", None), (1, 2, "sideswing now", None), (2, 0, "SIDESWING", None), (3, 0, " five ", None)]
    found = entities.resolved(spark.createDataFrame(rows, "source long, pos long, name string, alias string"))
    got = {(r.source, r.pos): r.canonical for r in found.collect()}
    assert [got[k] for k in ((0, 0), (0, 1), (0, 2), (1, 0))] == ["one"] * 4 and got[2, 0] == "side swing"
    shown = {r.canonical: (r.display_name, r.sources, r.records) for r in entities.displayed(found, titled=2).collect()}
    assert shown["one"] == ("three", [0, 1], {0: 2, 1: 0}) and shown["five"] == ("five", [3], {3: 0}) and shown["side swing"][0] == "side swing"
    none = entities.resolved(spark.createDataFrame([], "source long, pos long, name string, alias string"))
    assert none.collect() == []


def test_variants_and_titles(spark):
    texts = ["Back-Flip", "handspring  full_twist", "swing through a", "", "B-TWIST don't", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "name string").select("name", names.all_variants(F.col("name")).alias("v"), names.title(F.col("name")).alias("t")).collect()
    for r in rows:
        assert set(r.v) == variants(r.name) and len(r.v) == len(set(r.v)) and r.t == r.name.title()


def test_what_a_name_says_outright(spark):
    cases = {
        "Double Full": {"rotation", "twist", "axis", "shape"},
        "Back Tuck": {"direction", "axis", "shape"},
        "Gainer": {"rotation", "twist", "axis", "direction", "entry"},
        "Swipe": set(),
        "Cheat 720": {"rotation", "twist", "axis", "direction"},
        "Wall Flip": {"rotation", "twist", "axis", "entry"},
        "540 spin half": {"rotation", "twist", "axis"},
        "Full": {"twist"},
    }
    rows = spark.createDataFrame([(n,) for n in cases], "name string").select("name", *(c.alias(k) for k, c in names.explicit(names.tokens(F.col("name"))).items())).collect()
    assert {r.name: {k for k, v in r.asDict().items() if v is True} for r in rows} == {n: want | {"family"} for n, want in cases.items()}


def test_hints_rank_under_what_the_name_says(spark):
    strong, weak = {"direction": F.lit(None).cast("string"), "shape": F.lit("open")}, {"direction": F.lit("forward"), "shape": F.lit("pike"), "entry": F.lit("wall")}
    row = lambda name: spark.createDataFrame([(name,)], "name string").select(*(c.alias(k) for k, c in entities.merged_attributes(F.col("name"), [strong, weak]).items())).first()
    plain = row("Swipe")
    assert (plain.direction, plain["shape"], plain.entry, plain.axis) == ("forward", "open", "wall", "lateral")
    locked = row("Back Tuck")
    assert (locked.direction, locked["shape"], locked.entry) == ("backward", "tuck", "wall")


def test_copies_of_names_neither_make_variants_nor_take_turns(spark, monkeypatch):
    rng = random.Random(9)
    some = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 3))) for _ in range(25)]
    rows = [(s, p, rng.choice(some), rng.choice(some) if s == 0 and rng.random() < 0.3 else None) for s in range(4) for p in range(700)]
    sizes = []
    kept = entities.cut

    def counted(df):
        out = kept(df)
        if "variant" in out.columns or out.columns == ["at", "joins", "is_first"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(entities, "cut", counted)
    got = sorted(tuple(r) for r in entities.resolved(spark.createDataFrame(rows, "source long, pos long, name string, alias string")).collect())
    assert got == fold(rows)
    assert sizes and max(sizes) <= sum(len(variants(n)) for n in set(some))


def test_attributes_of_rows_equal_those_of_single_names(spark):
    rng = random.Random(6)
    known = [*names.ROTATIONS, *names.AXES, *names.DIRECTIONS, *names.ENTRIES, *names.SHAPES, *names.SPECIALS, "full", "swipe", "Wall-Flip"]
    rows = [(i, None if i % 50 == 7 else " ".join(rng.choice(known) for _ in range(i % 5)), rng.choice([None, "open", "pike"]), rng.choice([None, "wall"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, name string, s string, e string")
    hints = [{"shape": F.col("s"), "direction": F.lit(None).cast("string")}, {"entry": F.col("e"), "direction": F.lit("forward")}]
    one = frame.select("id", *(c.alias(k) for k, c in entities.merged_attributes(F.col("name"), hints).items()))
    whole = entities.with_attributes(frame, "id", F.col("name"), hints)
    assert whole.columns == one.columns and sorted(map(str, whole.collect())) == sorted(map(str, one.collect()))
    # a name is split into words in one place of the plan
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
