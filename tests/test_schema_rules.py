import itertools
import json

import pytest

from motionframe.operators import schema_rules

GOOD = {
    "trick_id": "back_flip",
    "category": "flip",
    "difficulty": 4,
    "detection_method": "angle_threshold",
    "phases": [{"name": "takeoff", "duration_range_ms": [100, 300], "angle_rules": [{"joint": "knee", "min": 1.5, "max": 90}]}],
    "names": {"en": "Back flip", "fr": "Salto"},
}


def broken(spark, schema, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return sorted(tuple(r) for r in schema_rules.violations(rows, schema).collect())


def test_a_trick_and_its_faults(spark):
    faults = [
        ({}, []),
        ({"trick_id": "Back"}, [("$.trick_id", "pattern")]),
        ({"trick_id": 7}, [("$.trick_id", "type")]),
        ({"category": "jump"}, [("$.category", "enum")]),
        ({"difficulty": 10.5}, [("$.difficulty", "maximum")]),
        ({"difficulty": -1}, [("$.difficulty", "minimum")]),
        ({"difficulty": "hard"}, [("$.difficulty", "type")]),
        ({"difficulty": None}, [("$.difficulty", "type")]),
        ({"phases": []}, [("$.phases", "minItems")]),
        ({"phases": [{"name": "takeoff"}, {"duration_range_ms": [1, 2.5, -3]}]}, [("$.phases[1].duration_range_ms", "maxItems"), ("$.phases[1].duration_range_ms[1]", "type"), ("$.phases[1].duration_range_ms[2]", "minimum"), ("$.phases[1].name", "required")]),
        ({"phases": [{"name": "flying", "angle_rules": [{"joint": 1, "min": "a"}]}]}, [("$.phases[0].angle_rules[0].joint", "type"), ("$.phases[0].angle_rules[0].max", "required"), ("$.phases[0].angle_rules[0].min", "type"), ("$.phases[0].name", "enum")]),
        ({"names": {"fr": 3}}, [("$.names.en", "required"), ("$.names.fr", "type")]),
        ({"tags": ["a", 1]}, [("$.tags[1]", "type")]),
        ({"phases": "none"}, [("$.phases", "type")]),
        ({"extra": {"anything": []}}, []),
    ]
    texts = [json.dumps(GOOD | change) for change, _ in faults]
    want = sorted((k, *v) for k, (_, vs) in enumerate(faults) for v in vs)
    assert broken(spark, schema_rules.TRICK_SCHEMA, *texts) == want


def test_what_is_no_document(spark):
    assert broken(spark, schema_rules.TRICK_SCHEMA, None, "{", "[1]", "{}") == [(0, "$", "json"), (1, "$", "json"), (2, "$", "type")] + [(3, f"$.{k}", "required") for k in sorted(schema_rules.TRICK_SCHEMA["required"])]


@pytest.mark.parametrize(("schema", "value", "rules"), [
    ({"type": "integer"}, 2.0, []),
    ({"type": "integer"}, 2.5, ["type"]),
    ({"type": "integer"}, 1e30, []),
    ({"type": ["string", "null"]}, None, []),
    ({"type": ["string", "null"]}, 1, ["type"]),
    ({"type": "boolean"}, True, []),
    ({"enum": [1, "é", None]}, "é", []),
    ({"enum": [1, "é", None]}, "e", ["enum"]),
    ({"pattern": "it's \\d"}, "it's 4", []),
    ({"pattern": "it's \\d"}, "it's", ["pattern"]),
    ({"pattern": "a"}, 5, []),
    ({"maximum": 3}, 4, ["maximum"]),
    ({"maximum": 3}, "4", []),
    ({"minItems": 2}, [1], ["minItems"]),
    ({"required": ["a b"], "properties": {"a b": {}}}, {"a b": None}, []),
    ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "b": 2}, ["additionalProperties"]),
    ({}, {"a": [1]}, []),
])
def test_each_rule(spark, schema, value, rules):
    assert [r for _, _, r in broken(spark, schema, json.dumps(value))] == rules


def test_the_kind_of_each_value_is_asked_once():
    def values(schema):
        other = schema.get("additionalProperties")
        inner = [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else []), *([other] if isinstance(other, dict) else [])]
        return 1 + sum(values(x) for x in inner)

    text = schema_rules._broken(schema_rules.TRICK_SCHEMA, "doc", "'$'", itertools.count())
    assert text.count("schema_of_variant(") <= values(schema_rules.TRICK_SCHEMA)
