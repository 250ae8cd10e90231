"""Names of movements: slugs, variants, and physics parsed from the tokens of a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the name parser: tokens and what they stand for.
ROTATIONS = {"180": 0.5, "270": 0.75, "360": 1.0, "450": 1.25, "540": 1.5, "630": 1.75, "720": 2.0, "810": 2.25, "900": 2.5, "1080": 3.0, "1260": 3.5, "1440": 4.0, "1620": 4.5, "1800": 5.0, "half": 0.5, "double": 2.0, "triple": 3.0, "quad": 4.0}
DIRECTIONS = {"front": "forward", "forward": "forward", "frog": "forward", "back": "backward", "backward": "backward", "side": "left", "lateral": "left"}
AXES = {"cork": "off_axis", "corkscrew": "off_axis", "flip": "lateral", "tuck": "lateral", "pike": "lateral", "layout": "lateral", "spin": "longitudinal", "twist": "longitudinal", "side": "sagittal", "aerial": "sagittal"}
ENTRIES = {"wall": "wall", "two-step": "wall", "2-step": "wall", "running": "running", "punch": "running", "standing": "standing", "webster": "one_leg", "one-leg": "one_leg", "bar": "edge", "swing": "edge", "flyaway": "edge", "lache": "edge", "kong": "running", "dash": "running", "speed": "running", "drop": "edge", "dismount": "edge"}
SHAPES = {"tuck": "tuck", "pike": "pike", "layout": "layout", "whip": "layout", "open": "open", "straddle": "open"}
SPIN_PREFIXES = ("backside", "cheat", "pop", "swing", "skip", "vanish", "wrap")
SPECIALS = {
    "gainer": {"direction": "backward", "entry": "running", "axis": "lateral", "rotation": 1.0},
    "webster": {"direction": "forward", "entry": "one_leg", "axis": "lateral", "rotation": 1.0},
    "castaway": {"direction": "backward", "axis": "off_axis", "rotation": 1.5, "twist": 0.5},
    "arabian": {"direction": "forward", "axis": "lateral", "twist": 0.5},
    "pimp": {"direction": "backward", "axis": "lateral"},
    "raiz": {"direction": "backward", "axis": "off_axis", "rotation": 0.5, "twist": 0.5},
    "b-twist": {"direction": "left", "axis": "longitudinal", "twist": 1.0, "rotation": 0.0},
    "gaet": {"direction": "left", "axis": "sagittal"},
    "palm": {"entry": "wall"},
    "dive": {"direction": "forward"},
    "macaco": {"direction": "backward", "entry": "standing", "axis": "lateral"},
    "krok": {"direction": "forward", "axis": "lateral", "rotation": 0.5},
    "cody": {"direction": "backward", "entry": "edge", "axis": "lateral"},
    "devil": {"axis": "off_axis"},
}
FAMILIES = (
    ("vault", ("vault", "kong", "dash", "speed", "monkey", "reverse", "kash", "thief", "lazy"), ()),
    ("bar", ("flyaway", "lache", "swing", "dismount", "hang", "stall"), ()),
    ("wall", ("wall", "palm", "tic-tac", "tunnel"), ("flip", "cork", "corkscrew")),
    ("roll", ("roll", "bomb"), ("flip", "cork", "gainer")),
    ("ground", ("handstand", "cartwheel", "roundoff", "handspring", "macaco"), ()),
)
TWIST_WORDS = ("flip", "gainer", "webster", "front", "back", "cork", "corkscrew", "arabian", "pimp")
NO_SPIN_WORDS = ("flip", "gainer", "webster", "cork", "corkscrew")
MULTIPLIERS = ("double", "triple", "quad")
#: Words of a name that tell a flip, besides the special words.
FLIP_WORDS = ("flip", "cork", "corkscrew", "gainer", "webster", "arabian", "raiz", "aerial", "cartwheel", "handspring", "roundoff")
#: Compound words and how they are written apart.
COMPOUNDS = {
    "backflip": "back flip",
    "frontflip": "front flip",
    "sideflip": "side flip",
    "kickflip": "kick flip",
    "handspring": "hand spring",
    "handstand": "hand stand",
    "roundoff": "round off",
    "cartwheel": "cart wheel",
    "corkscrew": "cork screw",
    "butterfly": "butter fly",
    "snapuswipe": "snapu swipe",
    "backswing": "back swing",
    "frontswing": "front swing",
    "sideswing": "side swing",
    "fulltwist": "full twist",
    "doubleleg": "double leg",
    "masterscoot": "master scoot",
    "moonkick": "moon kick",
    "flashkick": "flash kick",
    "jackknife": "jack knife",
    "touchdown": "touch down",
    "swingthrough": "swing through",
    "swingthru": "swing thru",
}


def slug(name: Column) -> Column:
    """Lower case, parentheses dropped, spaces and hyphens as underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[()]", ""), "[ -]", "_")


def tokens(name: Column) -> Column:
    """Lower-cased words; hyphens separate words too."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), "-", " "), " "), lambda t: t != "")


def variants(name: Column) -> Column:
    """The normal form of a name and every form with two neighbouring words joined, sorted."""
    words = tokens(F.regexp_replace(name, "[^A-Za-z0-9 -]", ""))
    joins = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.slice(words, F.lit(1), i - 1), F.concat(F.element_at(words, i), F.coalesce(F.get(words, i), F.lit(""))), F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1)))),
    )
    every = F.when(F.size(words) > 1, F.concat(F.array(F.concat_ws(" ", words)), joins)).otherwise(F.array(F.concat_ws(" ", words)))
    return F.array_sort(F.array_distinct(every))


def normal(name: Column) -> Column:
    """Lower case, hyphens and underlines as spaces, nothing but letters, digits and single spaces."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(name), "[-_]", " "), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def all_variants(name: Column) -> Column:
    """The normal form, each with two neighbouring words joined, with all compounds apart, and with each compound joined or apart."""
    form = normal(name)
    words = F.filter(F.split(form, " "), lambda t: t != "")
    count = F.size(words)
    joins = F.transform(
        F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws(" ", F.slice(words, F.lit(1), i - 1), F.concat(F.element_at(words, i), F.element_at(words, i + 1)), F.slice(words, i + 2, F.greatest(count, F.lit(1)))),
    )
    apart = F.array_join(F.transform(words, lambda t: F.coalesce(F.element_at(_table(COMPOUNDS), t), t)), " ")
    each = [F.when(F.contains(form, F.lit(a)), F.replace(form, F.lit(a), F.lit(b))) for one, two in COMPOUNDS.items() for a, b in ((two, one), (one, two))]
    return F.array_distinct(F.concat(F.array(form, apart), joins, F.array_compact(F.array(*each))))


def title(name: Column) -> Column:
    """Letters in lower case but for those that no letter precedes."""
    chars = F.split(name, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("[A-Za-z]"), F.lower(c)).otherwise(F.upper(c))), "")


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for item in values.items() for x in item))


def _last(words: Column, table: dict[str, str], default: Column) -> Column:
    """What the last word in the table stands for."""
    known = F.filter(words, lambda t: t.isin(*table))
    return F.when(F.size(known) > 0, F.element_at(_table(table), F.element_at(known, -1))).otherwise(default)


def _special(words: Column, field: str, default: Column) -> Column:
    """The override of the last listed special word in the name."""
    out = default
    for word, changes in SPECIALS.items():
        if field in changes:
            out = F.when(F.array_contains(words, word), F.lit(changes[field])).otherwise(out)
    return out


def _any(words: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(t) for t in of)))


def parse(words: Column) -> dict[str, Column]:
    """rotation, twist, axis, direction, shape, entry and family of a name's words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: F.when(F.get(words, i + 1) == "full", F.get(words, i)))
    multiplied = F.get(F.filter(pairs, lambda t: t.isin(*MULTIPLIERS)), F.lit(0))
    start = F.struct(_special(words, "rotation", F.lit(1.0)).alias("count"), F.lit(False).alias("set"))

    def step(state: Column, word: Column) -> Column:
        value = F.element_at(_table(ROTATIONS), word)
        count = (
            F.when(word.isin(*MULTIPLIERS), F.when(state["set"], state["count"] * value).otherwise(value))
            .when((word == "half") & ~state["set"], F.lit(0.5))
            .when(word.rlike("^[0-9]+$"), value)
            .otherwise(state["count"])
        )
        return F.struct(count.alias("count"), (state["set"] | word.isin(*MULTIPLIERS) | (word == "half") | word.rlike("^[0-9]+$")).alias("set"))

    counted = F.aggregate(F.filter(words, lambda t: t.isin(*ROTATIONS)), start, step)["count"]
    rotation = F.when(multiplied.isNotNull(), F.lit(1.0)).otherwise(counted)
    fulls = F.size(F.filter(words, lambda t: t == "full")).cast("double")
    twist = _special(words, "twist", F.lit(0.0))
    twist = F.when(multiplied.isNotNull(), F.element_at(_table(ROTATIONS), multiplied)).when((fulls > 0) & (_any(words, TWIST_WORDS) | (rotation >= 1)), F.greatest(twist, fulls)).otherwise(twist)
    half = F.array_position(words, "half") - 1
    twist = F.when((half >= 0) & (rotation >= 1) & (half > F.floor(F.size(words) / 2)), F.greatest(twist, F.lit(0.5))).otherwise(twist)
    spin = F.coalesce(F.get(words, F.lit(0)).isin(*SPIN_PREFIXES), F.lit(False)) & ~_any(words, NO_SPIN_WORDS)
    twist = F.when(spin, 0.0).otherwise(twist)
    twist = F.when(_any(words, ("cork", "corkscrew")) & (twist == 0), 1.0).otherwise(twist)
    axis = F.when(multiplied.isNotNull(), "lateral").otherwise(_last(words, AXES, _special(words, "axis", F.lit("lateral"))))
    family = F.lit("flip")
    for name, marks, unless in reversed(FAMILIES):
        family = F.when(_any(words, marks) & (~_any(words, unless) if unless else F.lit(True)), name).otherwise(family)
    return {
        "rotation": rotation,
        "twist": twist,
        "axis": F.when(spin, "longitudinal").otherwise(axis),
        "direction": F.when(spin, "left").otherwise(_last(words, DIRECTIONS, _special(words, "direction", F.lit("backward")))),
        "shape": F.when(multiplied.isNotNull(), "layout").otherwise(_last(words, SHAPES, F.lit("tuck"))),
        "entry": F.when(F.array_contains(words, "wall"), "wall").otherwise(_last(words, ENTRIES, _special(words, "entry", F.lit("standing")))),
        "family": family,
    }


def explicit(words: Column) -> dict[str, Column]:
    """Which of the fields of :func:`parse` the name says outright, so that no hint changes them."""
    parsed = parse(words)
    pairs = F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: (F.get(words, i + 1) == "full") & F.get(words, i).isin(*MULTIPLIERS))
    multiplied = F.exists(pairs, lambda t: F.coalesce(t, F.lit(False)))
    flip = _any(words, FLIP_WORDS) | _any(words, tuple(SPECIALS))
    spin = F.coalesce(F.get(words, F.lit(0)).isin(*SPIN_PREFIXES), F.lit(False)) & ~_any(words, NO_SPIN_WORDS)
    special = lambda field: _any(words, tuple(w for w, changes in SPECIALS.items() if field in changes))
    half = F.array_position(words, "half") - 1
    full = F.array_contains(words, "full") & (_any(words, TWIST_WORDS) | (parsed["rotation"] >= 1))
    return {
        "rotation": _any(words, tuple(ROTATIONS)) | flip,
        "twist": flip | multiplied | full | spin | ((half >= 0) & (parsed["rotation"] >= 1) & (half > F.floor(F.size(words) / 2))),
        "axis": flip | multiplied | spin | _any(words, tuple(AXES)),
        "direction": special("direction") | spin | _any(words, tuple(DIRECTIONS)),
        "shape": multiplied | _any(words, tuple(SHAPES)),
        "entry": special("entry") | _any(words, tuple(ENTRIES)),
        "family": F.lit(True),
    }
