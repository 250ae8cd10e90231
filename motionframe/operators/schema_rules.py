"""A JSON schema as SQL predicates: one row for every place of a document that breaks a rule.

A schema is a dictionary as in its file.  Known rules: type, enum, pattern, minimum, maximum, minItems, maxItems, required, properties,
items and additionalProperties (a schema, or false).  A rule on a kind of value does not apply to others, so a value of the wrong type
breaks that rule alone.  Other keys, such as descriptions, are passed over.
"""

from __future__ import annotations

import json
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_KINDS = {"string": ("STRING",), "number": _NUMBERS, "integer": _NUMBERS, "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
_NONE = "cast(array() AS array<struct<path: string, rule: string>>)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(bound: str, *types: str) -> str:
    """Whether a variant, bound with its kind, is of one of the JSON types."""
    kinds = ", ".join(_quoted(k) for t in types for k in _KINDS[t])
    fits = f"{bound}.kind IN ({kinds})"
    if "integer" in types and "number" not in types:  # 2.0 is one, 2.5 is not
        fits = f"({fits} AND coalesce(CASE WHEN {bound}.kind IN ('DECIMAL', 'DOUBLE', 'FLOAT') THEN try_variant_get({bound}.v, '$', 'double') % 1 = 0 END, true))"
    return fits


def _member(value: str, name: str) -> str:
    return f"try_variant_get({value}, {_quoted('$[' + chr(34) + name + chr(34) + ']')}, 'variant')"


def _broken(schema: dict, value: str, path: str, names: count) -> str:
    """SQL of the array of broken rules of a value that is there; ``path`` is SQL too.

    The value is bound to a name with its kind, so that either is found once, not once for every rule.
    """
    bound = f"b{next(names)}"
    text = _rules(schema, bound, path, names)
    if text == _NONE:
        return _NONE
    kind = f"regexp_extract(schema_of_variant({value}), '^[A-Z]+', 0)"
    return f"flatten(transform(array(named_struct('v', {value}, 'kind', {kind})), {bound} -> {text}))"


def _rules(schema: dict, bound: str, path: str, names: count) -> str:
    single, nested = [], []
    value = f"{bound}.v"
    rule = lambda fails, name: single.append(f"CASE WHEN {fails} THEN named_struct('path', {path}, 'rule', '{name}') END")
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        rule(f"NOT {_kind(bound, *types)}", "type")
    if "enum" in schema:
        rule(f"to_json({value}) NOT IN ({', '.join(_quoted(json.dumps(x, ensure_ascii=False)) for x in schema['enum'])})", "enum")
    if "pattern" in schema:
        rule(f"{_kind(bound, 'string')} AND NOT try_variant_get({value}, '$', 'string') RLIKE {_quoted(schema['pattern'])}", "pattern")
    for name, sign in (("minimum", "<"), ("maximum", ">")):
        if name in schema:
            rule(f"{_kind(bound, 'number')} AND try_variant_get({value}, '$', 'double') {sign} {float(schema[name])!r}D", name)
    items = f"try_cast({value} AS array<variant>)"
    for name, sign in (("minItems", "<"), ("maxItems", ">")):
        if name in schema:
            rule(f"{_kind(bound, 'array')} AND size({items}) {sign} {int(schema[name])}", name)
    for name in schema.get("required", ()):
        single.append(f"CASE WHEN {_kind(bound, 'object')} AND {_member(value, name)} IS NULL THEN named_struct('path', concat({path}, {_quoted('.' + name)}), 'rule', 'required') END")
    for name, inner in schema.get("properties", {}).items():
        # a member is bound before it is looked into; one that is missing is left out
        m = f"m{next(names)}"
        text = _broken(inner, m, f"concat({path}, {_quoted('.' + name)})", names)
        if text != _NONE:
            nested.append(f"CASE WHEN {_kind(bound, 'object')} THEN flatten(transform(filter(array({_member(value, name)}), {m} -> {m} IS NOT NULL), {m} -> {text})) ELSE {_NONE} END")
    if isinstance(schema.get("items"), dict):
        x, i = f"x{next(names)}", f"i{next(names)}"
        text = _broken(schema["items"], x, f"concat({path}, '[', {i}, ']')", names)
        if text != _NONE:
            nested.append(f"CASE WHEN {_kind(bound, 'array')} THEN flatten(transform({items}, ({x}, {i}) -> {text})) ELSE {_NONE} END")
    other = schema.get("additionalProperties", True)
    if other is not True:
        e = f"e{next(names)}"
        text = f"array(named_struct('path', concat({path}, '.', {e}.key), 'rule', 'additionalProperties'))" if other is False else _broken(other, f"{e}.value", f"concat({path}, '.', {e}.key)", names)
        known = ", ".join(_quoted(k) for k in schema.get("properties", {})) or "''"
        if text != _NONE:
            entries = f"filter(map_entries(try_cast({value} AS map<string, variant>)), {e} -> NOT {e}.key IN ({known}))"
            nested.append(f"CASE WHEN {_kind(bound, 'object')} THEN flatten(transform({entries}, {e} -> {text})) ELSE {_NONE} END")
    if single:
        nested.insert(0, f"array_compact(array({', '.join(single)}))")
    return f"concat({', '.join(nested)})" if len(nested) > 1 else nested[0] if nested else _NONE


def violations(documents: DataFrame, schema: dict) -> DataFrame:
    """id, path, rule of every rule that a document of ``documents`` (id, text) breaks; ``$`` is the whole document.

    A text that is null or no JSON breaks the rule ``json``.  A missing required member is told at the place where it would be.
    Documents are dealt out first: the work on each is large, and a file of a few megabytes would be a single task.
    """
    parsed = documents.select("id", "text").repartition("id", "text").select("id", F.try_parse_json("text").alias("doc"))
    found = F.expr(f"CASE WHEN doc IS NULL THEN array(named_struct('path', '$', 'rule', 'json')) ELSE {_broken(schema, 'doc', _quoted('$'), count())} END")
    return parsed.select("id", F.explode(found).alias("v")).select("id", "v.path", "v.rule")


#: The schema of a rule catalog's tricks.
_TEXT, _TEXTS, _COUNT = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer", "minimum": 0}


def _one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


TRICK_SCHEMA = {
    "type": "object",
    "required": ["trick_id", "category", "difficulty", "detection_method", "phases", "names"],
    "properties": {
        "trick_id": {"type": "string", "pattern": "^[a-z][a-z0-9_]*$"},
        "category": _one_of("flip", "vault", "twist", "combo", "spin", "precision"),
        "tags": _TEXTS,
        "difficulty": {"type": "number", "minimum": 0.0, "maximum": 10.0},
        "detection_method": _one_of("angle_threshold", "temporal_model"),
        "phases": {
            "type": "array",
            "minItems": 1,
            "items": {
                "type": "object",
                "required": ["name"],
                "properties": {
                    "name": _one_of("approach", "takeoff", "execution", "landing", "recovery"),
                    "duration_range_ms": {"type": "array", "items": _COUNT, "minItems": 2, "maxItems": 2},
                    "angle_rules": {"type": "array", "items": {"type": "object", "required": ["joint", "min", "max"], "properties": {"joint": _TEXT, "min": {"type": "number"}, "max": {"type": "number"}, "description": _TEXT}}},
                    "velocity_rules": {
                        "type": "array",
                        "items": {"type": "object", "required": ["joint", "axis", "direction", "min_speed"], "properties": {"joint": _TEXT, "axis": _one_of("vertical", "horizontal", "angular"), "direction": _TEXT, "min_speed": {"type": "number", "minimum": 0}}},
                    },
                    "trajectory": {"type": "object", "properties": {"rotation_axis": _one_of("lateral", "longitudinal", "sagittal"), "rotation_direction": _one_of("forward", "backward", "clockwise", "counterclockwise"), "min_rotation_degrees": {"type": "number", "minimum": 0}}},
                },
            },
        },
        "composable_with": _TEXTS,
        "names": {"type": "object", "required": ["en"], "additionalProperties": _TEXT},
        "primitives": {
            "type": "object",
            "required": ["rotation_sagittal", "rotation_sagittal_count", "rotation_lateral", "twist_count", "takeoff", "landing", "obstacle_interaction"],
            "properties": {
                "rotation_sagittal": _one_of("forward", "backward", "none"),
                "rotation_sagittal_count": _COUNT,
                "rotation_lateral": _one_of("left", "right", "none"),
                "twist_count": _COUNT,
                "takeoff": _one_of("two_feet", "one_foot", "hands", "wall", "edge"),
                "landing": _one_of("two_feet", "one_foot", "hands", "other"),
                "obstacle_interaction": {"type": "boolean"},
            },
        },
    },
}
