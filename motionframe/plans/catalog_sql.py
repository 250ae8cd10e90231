"""DuckDB SQL that gives the rows of the queries of entities, attributes, schema, label logs, strategies and fusion by name."""

from __future__ import annotations

from motionframe import further_queries
from motionframe.catalog_queries import FRAGMENTS
from motionframe.functions import names
from motionframe.plans import turn_sql
from motionframe.plans.further_sql import _TYPE_WORDS, _hints_sql, _rules_sql
from motionframe.plans.sql import POSE, SIDES, _parsed, _pick
from motionframe.sources import adapters


def _form(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-_]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def _variants(f: str) -> str:
    """The list of variants of a normal form, by rewriting it as text."""
    words = f"string_split({f}, ' ')"
    apart = f"array_to_string(list_transform({words}, lambda t: CASE t {' '.join(f'WHEN {one!r} THEN {two!r}' for one, two in names.COMPOUNDS.items())} ELSE t END), ' ')"
    joins = f"list_transform(range(1, len({words})), lambda i: array_to_string(list_concat(list_concat({words}[1 : i - 1], [{words}[i] || {words}[i + 1]]), {words}[i + 2 :]), ' '))"
    each = ", ".join(f"CASE WHEN contains({f}, '{a}') THEN replace({f}, '{a}', '{b}') END" for one, two in names.COMPOUNDS.items() for a, b in ((two, one), (one, two)))
    return f"list_distinct(list_concat(list_concat([{f}, {apart}], {joins}), list_filter([{each}], lambda v: v IS NOT NULL)))"


def _entities() -> str:
    at = lambda f: _pick(adapters.WRITTEN, f)
    name = f"concat_ws(' ', {at('p_partkey * 7')}, {at('p_partkey // 5 * 3 + p_partkey')})"
    alias = f"concat_ws('_', {at('p_partkey + 3')}, {at('p_partkey * p_partkey')})"
    return f"""src AS (SELECT p_partkey % 4 AS source, p_partkey AS pos, CASE WHEN p_partkey % 4 = 2 THEN upper({name}) ELSE {name} END AS name, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 0 THEN {alias} END AS alias FROM part),
nrm AS (SELECT *, {_form('name')} AS f, {_form('alias')} AS g, row_number() OVER (ORDER BY source, pos) AS rn FROM src),
var AS (SELECT rn, source, pos, name, f, {_variants('f')} AS own, CASE WHEN g IS NULL THEN [] ELSE {_variants('g')} END AS also FROM nrm),
fold AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS canonical, false AS leads, CAST([] AS STRUCT(v VARCHAR, e VARCHAR)[]) AS claims
  UNION ALL SELECT rn, canonical, leads, list_concat(mid, list_transform(list_filter(also, lambda v: len(list_filter(mid, lambda c: c.v = v)) = 0), lambda v: {{'v': v, 'e': canonical}}))
  FROM (SELECT rn, also, canonical, leads, CASE WHEN leads THEN list_concat(claims, list_transform(own, lambda v: {{'v': v, 'e': canonical}})) ELSE claims END AS mid
    FROM (SELECT v.rn, own, also, claims, coalesce(hit[1].e, f) AS canonical, len(hit) = 0 AS leads FROM (SELECT v.*, claims, list_filter(claims, lambda c: list_contains(own, c.v)) AS hit FROM fold JOIN var v ON v.rn = fold.rn + 1) v))),
res AS (SELECT source, pos, name, canonical, leads FROM fold JOIN var USING (rn))"""


def _explicit() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    has = lambda words: f"list_has_any(w, {listed(words)})"
    special = lambda field: has([w for w, c in names.SPECIALS.items() if field in c])
    flip = has([*names.FLIP_WORDS, *names.SPECIALS])
    return f"""exp AS (SELECT id, {has(names.ROTATIONS)} OR {flip} AS rotation,
  {flip} OR m IS NOT NULL OR spin OR list_contains(w, 'full') AND ({has(names.TWIST_WORDS)} OR rotation >= 1) OR list_contains(w, 'half') AND rotation >= 1 AND list_position(w, 'half') - 1 > len(w) // 2 AS twist,
  {flip} OR m IS NOT NULL OR spin OR {has(names.AXES)} AS axis, {special('direction')} OR spin OR {has(names.DIRECTIONS)} AS direction, m IS NOT NULL OR {has(names.SHAPES)} AS shape, {special('entry')} OR {has(names.ENTRIES)} AS entry, true AS family FROM hal)"""


def _merged() -> str:
    kind = f"[lower({_pick(_TYPE_WORDS, 'p_partkey')}), lower({_pick(_TYPE_WORDS, 'p_partkey // 8 + 3')})]"
    field = lambda f, *hints: f"CASE WHEN e.{f} THEN p.{f} ELSE coalesce({', '.join([*hints, f'p.{f}'])}) END AS {f}"
    has = lambda w: f"list_contains(k, '{w}')"
    return f"""WITH {_parsed()}, {_explicit()}, des AS ({_hints_sql()}), knd AS (SELECT p_partkey AS id, {kind} AS k FROM part),
typ AS (SELECT id, CASE WHEN {has('flip')} THEN 'lateral' WHEN {has('twist')} THEN 'longitudinal' END AS axis, CASE WHEN {has('flip')} THEN 1e0 END AS rotation, CASE WHEN {has('twist')} THEN 1e0 END AS twist,
  CASE WHEN {has('vault')} THEN 'running' WHEN {has('bar')} THEN 'edge' WHEN {has('wall')} THEN 'wall' END AS entry FROM knd)
SELECT p.id, {field('rotation', 'd.rotation', 't.rotation')}, {field('twist', 'd.twist', 't.twist')}, {field('axis', 'd.axis', 't.axis')}, {field('direction', 'd.direction')}, {field('shape', 'd.shape')}, {field('entry', 't.entry')}, p.family
FROM par p JOIN exp e USING (id) JOIN des d USING (id) JOIN typ t USING (id)"""


def _schema() -> str:
    parts = ", ".join("list_extract([" + ", ".join("'" + c + "'" for c in choices) + f"], CAST(p_partkey // {2**k} % {len(choices)} + 1 AS INTEGER))" for k, choices in enumerate(FRAGMENTS))
    check = lambda path, rule, fails: f"SELECT id, '{path}' AS path, '{rule}' AS rule FROM doc WHERE {fails}"
    kind = lambda path: f"json_type(j, '{path}')"
    text = lambda path: f"json_extract_string(j, '{path}')"
    number = f"{kind('$.difficulty')} IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
    inside = lambda path, rule, fails: f"SELECT id, format('{path}', k), '{rule}' FROM pha WHERE {fails}"
    checks = [
        check("$.trick_id", "required", f"{kind('$.trick_id')} IS NULL"),
        check("$.trick_id", "type", f"{kind('$.trick_id')} <> 'VARCHAR'"),
        check("$.trick_id", "pattern", f"{kind('$.trick_id')} = 'VARCHAR' AND NOT regexp_matches({text('$.trick_id')}, '^[a-z][a-z0-9_]*$')"),
        check("$.category", "enum", f"{text('$.category')} NOT IN ('flip', 'vault', 'twist', 'combo', 'spin', 'precision')"),
        check("$.difficulty", "type", f"NOT {number}"),
        check("$.difficulty", "minimum", f"{number} AND CAST({text('$.difficulty')} AS DOUBLE) < 0"),
        check("$.difficulty", "maximum", f"{number} AND CAST({text('$.difficulty')} AS DOUBLE) > 10"),
        check("$.detection_method", "enum", f"{text('$.detection_method')} NOT IN ('angle_threshold', 'temporal_model')"),
        check("$.phases", "type", f"{kind('$.phases')} <> 'ARRAY'"),
        check("$.phases", "minItems", f"{kind('$.phases')} = 'ARRAY' AND json_array_length(j, '$.phases') = 0"),
        inside("$.phases[{}].name", "required", "json_type(p, '$.name') IS NULL"),
        inside("$.phases[{}].name", "enum", "json_extract_string(p, '$.name') NOT IN ('approach', 'takeoff', 'execution', 'landing', 'recovery')"),
        inside("$.phases[{}].duration_range_ms", "minItems", "json_array_length(p, '$.duration_range_ms') < 2"),
        check("$.names.en", "required", f"{kind('$.names.en')} IS NULL"),
        "SELECT id, '$.names.' || k, 'type' FROM (SELECT id, j, unnest(json_keys(j, '$.names')) AS k FROM doc) WHERE json_type(j, '$.names.' || k) <> 'VARCHAR'",
    ]
    return f"""WITH txt AS (SELECT p_partkey AS id, '{{' || concat_ws(', ', {parts}) || '}}' AS t FROM part), doc AS (SELECT id, CAST(t AS JSON) AS j FROM txt WHERE id % 97 <> 0),
pha AS (SELECT id, k, json_extract(j, '$.phases[' || k || ']') AS p FROM doc, unnest(range(CASE WHEN {kind('$.phases')} = 'ARRAY' THEN CAST(json_array_length(j, '$.phases') AS BIGINT) ELSE 0 END)) AS u(k))
SELECT id, '$' AS path, 'json' AS rule FROM txt WHERE id % 97 = 0 UNION ALL """ + " UNION ALL ".join(checks)


_EDITS = "edi AS (SELECT event_id AS seq, 'clip' || user_id % 40 AS file, CASE WHEN event_id % 5 = 4 THEN 'done' WHEN event_id % 3 = 0 THEN 'delete' ELSE 'add' END AS action, CAST(floor(value) AS BIGINT) % 30 AS nth, event_type AS trick_id, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS start_ms, CASE WHEN event_id % 7 <> 0 THEN event_id * 10 + 500 END AS end_ms FROM events)"


def _windowed(rules: str) -> str:
    """The rules' SQL over windows as if they were runs."""
    intensity = turn_sql.oracle_sql()["intensity_segments"].removeprefix(f"WITH {POSE}, ")
    head, _, tail = intensity.rpartition(" SELECT run, start_idx, CASE WHEN")
    return f"""{POSE.replace('pose AS (', 'pose_all AS (')}, {head.replace(' FROM pose)', ' FROM pose_all)')}, sgm AS (SELECT run, start_idx, CASE WHEN{tail}),
all_ AS (SELECT run, min(idx) AS a, max(idx) AS b FROM pose_all GROUP BY run), win AS (SELECT a.run, coalesce(s.start_idx, a.a) AS start_idx, coalesce(s.end_idx, a.b) AS end_idx FROM all_ a LEFT JOIN sgm s ON s.run = a.run AND s.run % 2 = 0),
pose AS (SELECT p.* REPLACE (p.run * 1000000 + start_idx * 1000 + end_idx AS run, idx - start_idx AS idx) FROM pose_all p JOIN win w ON w.run = p.run AND idx BETWEEN start_idx AND end_idx)""" + rules.removeprefix(POSE)


def oracle_sql() -> dict[str, str]:
    title = "array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches({x}[i - 1], '[A-Za-z]') THEN lower({x}[i]) ELSE upper({x}[i]) END), '')"
    last = lambda source, x: f"max_by({x}, pos) FILTER (WHERE source = {source})"
    record = " , ".join(f"CASE WHEN count(*) FILTER (WHERE source = {s}) > 0 THEN '{s}:' || max(pos) FILTER (WHERE source = {s}) END" for s in range(4))
    key = lambda x: f"translate(lower(trim({x})), ' -', '__')"
    windowed = _windowed(_rules_sql(further_queries.RULES))
    return {
        "ordered_entities": f"WITH RECURSIVE {_entities()} SELECT source, pos, name, canonical, leads FROM res",
        "entity_names": f"""WITH RECURSIVE {_entities()} SELECT canonical, coalesce({last(0, 'name')}, {last(1, 'name')}, {last(2, title.format(x='name'))}, max(trim(name)) FILTER (WHERE leads)) AS display_name,
  string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources, concat_ws(',', {record}) AS records FROM res GROUP BY canonical""",
        "explicit_fields": f"WITH {_parsed()}, {_explicit()} SELECT * FROM exp",
        "merged_attributes": _merged(),
        "schema_violations": _schema(),
        "replayed_labels": f"""WITH {_EDITS}, fil AS (SELECT file, list_reduce(list_concat([CAST([] AS STRUCT(a VARCHAR, n BIGINT, t VARCHAR, s BIGINT, e BIGINT)[])], list([{{'a': action, 'n': nth, 't': trick_id, 's': coalesce(start_ms, 0), 'e': end_ms}}] ORDER BY seq)),
  lambda acc, y: CASE WHEN y[1].a = 'add' THEN list_concat(acc, y) WHEN y[1].n < len(acc) THEN list_concat(acc[1 : y[1].n], acc[y[1].n + 2 :]) ELSE acc END) AS l FROM edi WHERE action <> 'done' GROUP BY file)
SELECT file, k - 1 AS nth, l[k].t AS trick_id, l[k].s AS start_ms, l[k].e AS end_ms FROM fil, unnest(range(1, len(l) + 1)) AS u(k)""",
        "done_files": f"WITH {_EDITS} SELECT file, min(seq) AS seq FROM edi WHERE action = 'done' GROUP BY file",
        "added_tricks": f"""WITH req AS (SELECT p_partkey AS seq, {key("' ' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END || '-' || p_partkey % 30")} AS id, CASE WHEN p_partkey % 11 <> 0 THEN trim(p_name) END AS name, CASE WHEN p_partkey % 4 <> 0 THEN 'kind ' || p_partkey % 3 ELSE 'other' END AS category FROM part)
SELECT id, name, category FROM req WHERE name <> '' AND id NOT IN (SELECT {key("p_brand || ' ' || p_partkey % 30")} FROM part WHERE p_size > 45) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1""",
        "relabel_queue": "WITH r AS (SELECT o_custkey * 2 AS c, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS label FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey AS pos, 'clip' || c_custkey AS original, c_mktsegment AS class, label, c IS NOT NULL AS done FROM customer LEFT JOIN r ON c = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
        "trick_windows": f"WITH {windowed} SELECT run, start_idx, end_idx, trick_id FROM win, (SELECT DISTINCT trick_id FROM rule)",
        "strategy_detections": f"WITH {windowed} SELECT w.run, w.start_idx, w.end_idx, trick_id, 'angle_threshold' AS strategy, round(confidence, 6) AS confidence, w.start_idx + m.start_idx AS first_idx, w.start_idx + m.end_idx AS last_idx FROM mat m JOIN win w ON m.run = w.run * 1000000 + w.start_idx * 1000 + w.end_idx",
        "fused_by_name": f"""WITH {SIDES.replace('l_partkey % 50', 'l_partkey % 90 + 1')}, phy AS (SELECT run AS sig_id, 'trick_' || trick_id AS id, 'Trick-' || trick_id AS name, round(c, 4) AS p FROM a WHERE trick_id <= 60),
mot AS (SELECT run AS sig_id, trick_id AS nth, CASE trick_id % 3 WHEN 0 THEN 'TRICK ' || (trick_id % 45 + 1) WHEN 1 THEN 'trick-' || trick_id ELSE 'New Trick ' || trick_id % 7 END AS name, CASE trick_id % 3 WHEN 0 THEN trick_id % 45 + 1 WHEN 1 THEN trick_id END AS k, round(c, 4) AS m FROM r),
own AS (SELECT *, CASE WHEN k <= 60 THEN 'trick_' || k ELSE replace(lower(name), ' ', '_') END AS id, coalesce(k <= 60, false) AS known FROM mot),
fin AS (SELECT sig_id, id, min_by(name, nth) AS name, CASE WHEN bool_or(known) THEN max_by(m, nth) FILTER (WHERE known) ELSE max(m) END AS m FROM own GROUP BY sig_id, id),
bth AS (SELECT coalesce(p.sig_id, f.sig_id) AS sig_id, coalesce(p.id, f.id) AS trick_id, coalesce(p.name, f.name) AS name, coalesce(p, 0e0) AS p, coalesce(m, 0e0) AS m FROM phy p FULL JOIN fin f ON f.sig_id = p.sig_id AND f.id = p.id),
wei AS (SELECT *, CASE WHEN sig_id % 5 >= 3 THEN 0.25e0 WHEN sig_id % 2 <> 0 THEN 0.3e0 ELSE 0.4e0 END AS w FROM bth JOIN supplier ON s_suppkey = sig_id)
SELECT sig_id, trick_id, name, p, m, round(least(w * p + (1 - w) * m + CASE WHEN p > 0.3 AND m > 0.3 THEN 0.15e0 ELSE 0e0 END, 1e0), 3) AS confidence FROM wei""",
    }
