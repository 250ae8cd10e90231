"""DuckDB SQL that gives the rows of the further queries."""

from __future__ import annotations

from motionframe.functions import geometry as g
from motionframe.operators import augment, describe, etl, features, signature
from motionframe.plans.sql import DETECTIONS, INDEXED, POSE, ROT, TEMPORAL, TRACK, _pick
from motionframe.sources import adapters


def _values(rows, names: str) -> str:
    cell = lambda x: "NULL" if x is None else repr(x) + ("e0" if isinstance(x, float) else "")
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


def _rules_sql(rules) -> str:
    joints = ("left_knee", "right_knee", "left_shoulder", "spine")
    angles = g.joint_angles()
    return f"""{POSE}, ang AS (SELECT run, idx, t_ms, {', '.join(f'{angles[j]} AS {j}' for j in joints)} FROM pose),
lng AS ({' UNION ALL '.join(f"SELECT run, idx, '{j}' AS joint, {j} AS angle FROM ang WHERE {j} IS NOT NULL" for j in joints)}),
rule AS {_values(rules, "trick_id, phase_no, min_ms, max_ms, joint, low, high")},
sco AS (SELECT run, idx, trick_id, phase_no, l.joint, low, high, CASE WHEN angle BETWEEN low AND high THEN CASE WHEN high > low THEN greatest(0e0, 1e0 - abs(angle - (low + high) / 2e0) / ((high - low) / 2e0) * 0.5e0) ELSE 1e0 END ELSE 0e0 END AS score FROM lng l JOIN rule r ON r.joint = l.joint),
fps AS (SELECT run, CASE WHEN dt > 0 THEN 1000e0 / dt ELSE 30e0 END AS fps, last FROM (SELECT run, min(t_ms) FILTER (WHERE idx = 1) - min(t_ms) FILTER (WHERE idx = 0) AS dt, max(idx) AS last FROM ang GROUP BY run)),
ph AS (SELECT run, last, trick_id, phase_no, n, greatest(1, CAST(floor(lo / 1000e0 * fps) AS BIGINT)) AS a, greatest(greatest(1, CAST(floor(lo / 1000e0 * fps) AS BIGINT)), CAST(floor(hi / 1000e0 * fps) AS BIGINT)) AS b
  FROM fps, (SELECT trick_id, phase_no, min(min_ms) AS lo, min(max_ms) AS hi, count(joint) AS n FROM rule GROUP BY ALL)),
spans AS (SELECT p.*, s AS start, e AS stop FROM ph p, unnest(range(last + 1)) AS t(s), unnest(range(s + a - 1, least(s + b, last + 1))) AS u(e)),
best AS (SELECT x.run, x.trick_id, x.phase_no, start, stop, joint, low, high, max(score) AS score FROM spans x JOIN sco USING (run, trick_id, phase_no) WHERE sco.idx BETWEEN start AND stop GROUP BY ALL),
conf AS (SELECT run, trick_id, phase_no, start, stop, least(round(sum(score) / n, 9), 1e0) AS c FROM best JOIN ph USING (run, trick_id, phase_no) GROUP BY run, trick_id, phase_no, start, stop, n),
ends AS (SELECT run, trick_id, phase_no, start, stop, c FROM conf WHERE c >= 0.5 QUALIFY row_number() OVER (PARTITION BY run, trick_id, phase_no, start ORDER BY c DESC, stop) = 1
  UNION ALL SELECT run, trick_id, phase_no, s, s + a - 1, 1e0 FROM ph, unnest(range(last + 1)) AS t(s) WHERE n = 0 AND s + a - 1 <= last),
len AS (SELECT trick_id, max(phase_no) + 1 AS phases FROM rule GROUP BY trick_id),
p0 AS (SELECT run, trick_id, start AS first, stop, c AS total, phases FROM ends JOIN len USING (trick_id) WHERE phase_no = 0),
p1 AS (SELECT * FROM p0 WHERE phases <= 1 UNION ALL SELECT p.run, p.trick_id, first, e.stop, total + c, phases FROM p0 p JOIN ends e ON e.run = p.run AND e.trick_id = p.trick_id AND e.phase_no = 1 AND e.start = p.stop + 1 WHERE phases > 1),
p2 AS (SELECT * FROM p1 WHERE phases <= 2 UNION ALL SELECT p.run, p.trick_id, first, e.stop, total + c, phases FROM p1 p JOIN ends e ON e.run = p.run AND e.trick_id = p.trick_id AND e.phase_no = 2 AND e.start = p.stop + 1 WHERE phases > 2),
mat AS (SELECT run, trick_id, round(total / phases, 9) AS confidence, first AS start_idx, stop AS end_idx FROM p2 WHERE round(total / phases, 9) >= 0.5 QUALIFY row_number() OVER (PARTITION BY run, trick_id ORDER BY round(total / phases, 9) DESC, first) = 1)"""


def _cells() -> str:
    angles = g.joint_angles()
    names = features.ANGLES
    listed = lambda p: "[" + ", ".join(f"{p}{j}" for j in names) + "]"
    com = {a: g.centre_of_mass(a) for a in "xy"}
    points = ", ".join(f"CASE WHEN c{i} >= 0.3 THEN ({a}{i} - ({com[a]})) / ({g.torso_length()}) END" for i in range(17) for a in "xy")
    unnest = lambda source, column, n, at: f"SELECT run, idx, {at} + i - 1 AS cell, {column}[i] AS value FROM {source}, unnest(range(1, {n + 1})) AS t(i)"
    return f"""{TEMPORAL},
ang AS (SELECT run, idx, t_ms, {', '.join(f'{angles[j]} AS {j}' for j in names)} FROM pose),
vel AS (SELECT *, sec, {', '.join(f'CASE WHEN sec IS NULL OR sec <= 0 THEN 0e0 ELSE ({j} - lag({j}) OVER w) / sec END AS v_{j}' for j in names)} FROM (SELECT *, (t_ms - lag(t_ms) OVER (PARTITION BY run ORDER BY idx)) / 1000e0 AS sec FROM ang) WINDOW w AS (PARTITION BY run ORDER BY idx)),
acc AS (SELECT *, {', '.join(f'CASE WHEN idx < 2 THEN 0e0 ELSE coalesce((v_{j} - lag(v_{j}) OVER w) / CASE WHEN sec > 0 THEN sec ELSE 1e0 / 30e0 END, 0e0) END AS a_{j}' for j in names)} FROM vel WINDOW w AS (PARTITION BY run ORDER BY idx)),
arr AS (SELECT run, idx, {listed("")} AS a, {listed("v_")} AS v, {listed("a_")} AS q FROM acc),
six AS (SELECT f.run, f.idx, [f.tilt, coalesce(tilt_velocity, 0e0), height, height_velocity, rotation, symmetry] AS b FROM feat f JOIN body USING (run, idx)),
rat AS (SELECT run, idx, [{', '.join(g.limb_ratio(k) for k in g.LIMBS)}] AS r, [{points}] AS p FROM pose),
raw AS ({unnest("arr", "a", 9, 0)} UNION ALL {unnest("arr", "v", 9, 9)} UNION ALL {unnest("rat", "p", 34, 18)} UNION ALL {unnest("rat", "r", 8, 52)} UNION ALL {unnest("six", "b", 6, 60)} UNION ALL {unnest("arr", "q", 9, 66)}),
cells AS (SELECT * FROM raw WHERE value IS NOT NULL)"""


def _clipped(most: str) -> str:
    return f"greatest(-{most}, least({most}, value)) / {most}"


def _signature() -> str:
    return f"""{POSE}, based AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in signature.axis_columns().items())} FROM pose),
sig AS (SELECT run, idx, hip_y, shoulder_y, {signature.axis_angle()} AS axis_angle, {', '.join(f'{e} AS f{k}' for k, e in enumerate(signature.feature_columns()))} FROM based)"""


FACTS = """mk AS (SELECT *, abs(axis_angle - lag(axis_angle) OVER w) AS turn, axis_angle > 90 AND NOT coalesce(lag(axis_angle) OVER w, 0e0) > 90 AS risen FROM sig WINDOW w AS (PARTITION BY run ORDER BY idx)),
fac AS (SELECT run, count(*) / 30e0 AS seconds, (max(hip_y) - min(hip_y)) / greatest(median(abs(shoulder_y - hip_y)), 1e0) AS height, coalesce(avg(turn), 0e0) AS speed, bool_or(axis_angle > 100) AS inverted, count(*) FILTER (WHERE risen) AS inversions FROM mk GROUP BY run)"""


def _like(a: str, floor: str) -> str:
    return f"least(q.{a}, r.{a}) / greatest(q.{a}, r.{a}, {floor})"


def _description(rest: str) -> str:
    return f"""{TRACK},
basis AS (SELECT q.run, q.idx, q.ux, q.uy, q.uz, 1e0 - 2e0 * (qy * qy + qz * qz) AS rx, 2e0 * (qx * qy + qw * qz) AS ry, 2e0 * (qx * qz - qw * qy) AS rz, 2e0 * (qx * qz + qw * qy) AS fx, 2e0 * (qy * qz - qw * qx) AS fy, 1e0 - 2e0 * (qx * qx + qy * qy) AS fz, t.tilt FROM up q JOIN trk t USING (run, idx)),
seg AS (SELECT run, idx // 20 * 20 AS start_idx, max(idx) AS end_idx FROM rot GROUP BY run, idx // 20 * 20), {rest}"""


_CROSS = "({a}.uy * {b}.uz - {a}.uz * {b}.uy) AS cx, ({a}.uz * {b}.ux - {a}.ux * {b}.uz) AS cy, ({a}.ux * {b}.uy - {a}.uy * {b}.ux) AS cz"


def _hint(hints) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(low, '{pattern}') THEN '{value}'" for pattern, value in hints) + " END"


def _table(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" + ("e0" if isinstance(v, float) else "") for k, v in table.items()) + " END"


_TEXT_WORDS = ("Double", "back flip", "half twist", "tucked", "360", "corkscrew", "straight", "twisting", "front flip", "quad", "open", "lateral", "full twist", "720", "piked", "forward")
_TYPE_WORDS = ("Flip", "Twist", "Wall", "Bar", "Roll", "Vault", "Ground", "Kick")


def _hints_sql() -> str:
    word = lambda w: f"regexp_matches(low, '\\b{w}\\b') AND NOT contains(substring(low, greatest(instr(low, '{w}') - 5, 1), {len(w) + 10} + least(instr(low, '{w}') - 1, 5)), 'twist')"
    counts = " ".join(f"WHEN {word(w)} THEN {v}e0" for w, v in etl.COUNT_WORDS) + " " + " ".join(f"WHEN regexp_matches(low, '\\b{w}\\b') THEN {v}e0" for w, v in etl.DEGREE_WORDS)
    twists = " ".join(f"WHEN contains(low, '{p}') THEN {v}e0" for p, v in sorted(etl.TWIST_HINTS, key=lambda h: -len(h[0])))
    return f"""WITH t AS (SELECT p_partkey AS id, lower(concat_ws(' ', 'A', {_pick(_TEXT_WORDS, 'p_partkey')}, 'with a long run up and', {_pick(_TEXT_WORDS, 'p_partkey // 16 + p_partkey * 5')})) AS low FROM part)
SELECT id, {_hint(etl.DIRECTION_HINTS)} AS direction, {_hint(etl.SHAPE_HINTS)} AS shape, CASE {counts} END AS rotation, CASE {twists} END AS twist,
  CASE WHEN regexp_matches(low, '\\bcork(screw)?\\b') THEN 'off_axis' WHEN regexp_matches(low, '\\btwist(ing)?\\b') AND NOT contains(low, 'flip') THEN 'longitudinal' WHEN regexp_matches(low, '\\bflip(ping)?\\b') THEN 'lateral' END AS axis FROM t"""


def _bin(value: str, bins) -> str:
    off = "[" + ", ".join(f"abs({value} - {b}e0)" for b in bins) + "]"
    return f"list_position({off}, list_min({off})) - 1"


ENCODED = f"""enc AS (SELECT p_partkey AS trick_id, p_partkey % 4 AS axis, (p_partkey // 4) % 2 AS direction, {_bin('((p_partkey % 7) / 2e0)', etl.ROTATION_BINS)} AS rotation, (p_partkey // 8) % 4 AS shape, (p_partkey // 3) % 3 AS entry, {_bin('((p_partkey % 5) / 2e0)', etl.TWIST_BINS)} AS twist FROM part)"""


def _entities_sql() -> str:
    # every made name has two words and a number, so its variants are itself in lower case and with neighbours joined
    source = lambda p, keep, made: f"SELECT DISTINCT {p} AS source, {made} AS name FROM part WHERE {keep}"
    return f"""WITH src AS ({source(0, 'p_partkey % 2 = 0', "'back flip ' || p_partkey % 40")} UNION ALL {source(1, 'p_partkey % 3 = 0', "'Backflip ' || p_partkey % 90")} UNION ALL {source(2, 'p_partkey % 5 = 0', "'Back-Flip ' || p_partkey % 150")}),
num AS (SELECT *, regexp_extract(name, '([0-9]+)$', 1) AS n FROM src), lead AS (SELECT n, first(name ORDER BY source, name) AS entity FROM num GROUP BY n)
SELECT CAST(source AS BIGINT) AS source, name, entity FROM num JOIN lead USING (n)"""


def oracle_sql(rules) -> dict[str, str]:
    matched = _rules_sql(rules)
    curve = f"""ends AS (SELECT run, max(idx) AS last FROM sig GROUP BY run), want AS (SELECT run, s AS step, s * last / 59e0 AS pos FROM ends, unnest(range(60)) AS t(s)),
vec AS (SELECT run, idx, [{', '.join(f'f{k}' for k in range(26))}] AS f FROM sig),
cur AS (SELECT w.run, step, k - 1 AS feature, a.f[k] + (pos - a.idx) * (b.f[k] - a.f[k]) AS value FROM want w JOIN vec a ON a.run = w.run AND a.idx = CAST(floor(pos) AS BIGINT) JOIN vec b ON b.run = w.run AND b.idx = CAST(ceil(pos) AS BIGINT), unnest(range(1, 27)) AS t(k)),
mov AS (SELECT *, value - lag(value) OVER (PARTITION BY run, feature ORDER BY step) AS d FROM cur),
dis AS (SELECT q.run AS query, r.run AS reference, avg((q.value - r.value) * (q.value - r.value)) * 0.6e0 + (1e0 - CASE WHEN sqrt(sum(q.d * q.d)) > 0 AND sqrt(sum(r.d * r.d)) > 0 THEN sum(q.d * r.d) / (sqrt(sum(q.d * q.d)) * sqrt(sum(r.d * r.d))) ELSE 0e0 END) * 0.4e0 AS distance FROM mov q JOIN mov r ON r.step = q.step AND r.feature = q.feature GROUP BY ALL)"""
    bonus = f"0.1e0 * {_like('seconds', '0.1e0')} + CASE WHEN q.inverted = r.inverted THEN 0.15e0 ELSE 0e0 END + CASE WHEN q.inversions = r.inversions THEN 0.1e0 ELSE 0e0 END + 0.1e0 * {_like('speed', '0.01e0')} + 0.05e0 * {_like('height', '0.01e0')}"
    inside = "ins AS (SELECT s.start_idx, s.end_idx, b.* FROM seg s JOIN basis b ON b.run = s.run AND b.idx BETWEEN s.start_idx AND s.end_idx)"
    on = "USING (run, start_idx, end_idx)"
    scaled = f"CASE WHEN cell < 9 THEN value / 180e0 WHEN cell < 18 THEN {_clipped('1000e0')} WHEN cell < 60 THEN value WHEN cell = 60 THEN value / 180e0 WHEN cell = 61 THEN {_clipped('2000e0')} WHEN cell = 62 THEN value / 5e0 WHEN cell = 63 THEN {_clipped('20e0')} WHEN cell = 64 THEN value / 1080e0 WHEN cell = 65 THEN value ELSE {_clipped('50000e0')} END"
    low = "regexp_replace(regexp_replace(lower({x}), '[()]', '', 'g'), '[ -]', '_', 'g')"
    heads = dict(zip(etl.HEADS, (4, 2, 6, 4, 3, 5)))
    value = lambda k: f"round(abs(CAST(embedding[{k + 1}] AS DOUBLE)), 4)"
    predicted = ", ".join(f"CAST(floor({value(k)} * 1000) AS BIGINT) % {n} AS {h}, least({value(k + 6)} * 4, 1e0) AS p_{h}" for k, (h, n) in enumerate(heads.items()))
    agree = " + ".join(f"CASE WHEN p.{h} = e.{h} THEN p_{h} ELSE 0e0 END" for h in heads)
    mean = f"pow({' * '.join(f'p_{h}' for h in heads)}, 1e0 / 6e0)"
    stretch = "seg AS (SELECT run, idx // 20 * 20 AS start_idx, max(idx) AS end_idx FROM rot GROUP BY run, idx // 20 * 20)"
    at = lambda values: _pick(values, "start_idx // 20")
    places = augment.mirror_places()
    listed = lambda side: "[" + ", ".join(f"{places[k][side]}" + ("e0" if side else "") for k in range(75)) + "]"
    return {
        "rule_score": f"WITH {matched} SELECT run, idx, trick_id, phase_no, joint, round(score, 5) AS score FROM sco",
        "phase_match": f"WITH {matched} SELECT run, trick_id, round(confidence, 6) AS confidence, start_idx, end_idx FROM mat",
        "classify": f"WITH {matched}, mea AS (SELECT run, idx, ({' + '.join(f'c{i}' for i in range(17))}) / 17e0 AS mean FROM pose), qua AS (SELECT m.run, m.trick_id, coalesce(avg(mean), 0e0) AS q FROM mat m LEFT JOIN mea ON mea.run = m.run AND mea.idx BETWEEN start_idx AND end_idx GROUP BY ALL), ref AS (SELECT m.run, m.trick_id, round(least((0.4e0 * confidence + 0.2e0 * q) / (0.4e0 + 0.2e0), 1e0), 6) AS confidence, start_idx, end_idx FROM mat m JOIN qua USING (run, trick_id)) SELECT run, trick_id, round(confidence, 5) AS confidence, start_idx, end_idx FROM ref WHERE confidence >= 0.5",
        "feature_cells": f"WITH {_cells()} SELECT run, idx, cell, round({scaled}, 4) AS value FROM cells",
        "warp_vectors": f"WITH {_cells()} SELECT f.run, f.idx, cell, round(coalesce(CASE WHEN value IS NULL THEN 0e0 WHEN cell < 9 THEN value / 180e0 WHEN cell < 18 THEN {_clipped('1000e0')} ELSE value END, 0e0), 3) AS value FROM (SELECT run, idx, k AS cell FROM pose, unnest(range(75)) AS t(k)) f LEFT JOIN cells c USING (run, idx, cell)",
        "mirrored_cells": f"WITH {_cells()} SELECT run, idx, CAST({listed(0)}[cell + 1] AS BIGINT) AS cell, round(value * {listed(1)}[cell + 1], 3) AS value FROM cells",
        "even_split": "SELECT s_suppkey AS id, 1037 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY s_suppkey) <= 1037 % count(*) OVER () THEN 1 ELSE 0 END AS count FROM supplier",
        "signature_features": f"WITH {_signature()} SELECT run, idx, {', '.join(f'round(f{k}, 4) AS f{k}' for k in range(26))} FROM sig",
        "signature_facts": f"WITH {_signature()}, {FACTS} SELECT run, round(seconds, 4) AS seconds, round(height, 4) AS height, round(speed, 4) AS speed, inverted, inversions FROM fac",
        "signature_match": f"WITH {_signature()}, {FACTS}, {curve}, sca AS (SELECT *, greatest(0e0, 1e0 - (distance - min(distance) OVER w) / greatest(max(distance) OVER w - min(distance) OVER w, 0.01e0)) AS near FROM dis WINDOW w AS (PARTITION BY query)), bon AS (SELECT query, reference, distance, near, {bonus} AS bonus FROM sca s JOIN fac q ON q.run = s.query JOIN fac r ON r.run = s.reference) SELECT query, reference, round(distance, 3) AS distance, round(least(1e0, greatest(0e0, near * 0.7e0 + bonus * 0.6e0)), 3) AS confidence, round(bonus, 3) AS bonus FROM bon",
        "dtw_match": f"""WITH RECURSIVE {_signature()}, ends AS (SELECT run, max(idx) AS last FROM sig GROUP BY run), want AS (SELECT run, s AS step, s * last / 23e0 AS pos FROM ends, unnest(range(24)) AS t(s)),
vec AS (SELECT run, idx, [{', '.join(f'f{k}' for k in range(26))}] AS f FROM sig),
cur AS (SELECT w.run, step, list_transform(range(1, 27), lambda k: a.f[k] + (pos - a.idx) * (b.f[k] - a.f[k])) AS f FROM want w JOIN vec a ON a.run = w.run AND a.idx = CAST(floor(pos) AS BIGINT) JOIN vec b ON b.run = w.run AND b.idx = CAST(ceil(pos) AS BIGINT)),
far AS (SELECT q.run AS query, r.run AS reference, q.step AS i, list(list_distance(q.f, r.f) ORDER BY r.step) AS c FROM cur q JOIN cur r ON r.run <> q.run GROUP BY ALL),
mat AS (SELECT query, reference, list(c ORDER BY i) AS c FROM far GROUP BY query, reference),
dia AS (SELECT query, reference, c, 1 AS d, list_transform(range(25), lambda i: CASE WHEN i = 0 THEN 0e0 ELSE 'inf'::DOUBLE END) AS before, list_transform(range(25), lambda i: 'inf'::DOUBLE) AS last FROM mat
  UNION ALL SELECT query, reference, c, d + 1, last, list_transform(range(25), lambda i: CASE WHEN i >= 1 AND d + 1 - i BETWEEN 1 AND 24 AND abs(2 * i - d - 1) <= 4 THEN c[i][d + 1 - i] + least(last[i], last[i + 1], before[i]) ELSE 'inf'::DOUBLE END) FROM dia WHERE d < 48),
con AS (SELECT query, reference, greatest(0e0, 1e0 - last[25] / 24e0 / 8e0) AS confidence FROM dia WHERE d = 48)
SELECT query, reference, round(confidence, 6) AS confidence FROM con WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY confidence DESC, reference) = 1""",
        "swing_twist": f"""WITH {TRACK}, n AS (SELECT run, idx, qw, qx, qy, qz, sqrt(qy * qy + qw * qw) AS n FROM quat), s AS (SELECT *, qw * qw / n + qy * qy / n AS sw, qx * qw / n + qz * qy / n AS sx, qz * qw / n - qx * qy / n AS sz FROM n),
z AS (SELECT *, sqrt(sx * sx + sz * sz) AS size, CASE WHEN sqrt(sx * sx + sz * sz) > 1e-6 THEN CASE WHEN sw < 0 THEN -1e0 ELSE 1e0 END * sx / sqrt(sx * sx + sz * sz) END AS along FROM s)
SELECT run, idx, round(CASE WHEN n >= 1e-10 THEN degrees(2e0 * atan2(size, abs(sw))) * CASE WHEN abs(along) > 0.3 THEN sign(along) ELSE 1 END ELSE 0e0 END, 3) AS swing, round(CASE WHEN n >= 1e-10 THEN degrees(2e0 * atan2(abs(qy / n), abs(qw / n))) * sign(qy) ELSE 0e0 END, 3) AS twist FROM z""",
        "smoothing_width": f"WITH {ROT}, j AS (SELECT run, sqrt((ox - lag(ox) OVER w) * (ox - lag(ox) OVER w) + (oy - lag(oy) OVER w) * (oy - lag(oy) OVER w) + (oz - lag(oz) OVER w) * (oz - lag(oz) OVER w)) AS j FROM rot WINDOW w AS (PARTITION BY run ORDER BY idx)) SELECT run, CASE WHEN median(j) > 0.15 THEN 3e0 WHEN median(j) > 0.08 THEN 2e0 ELSE 1.5e0 END AS sigma FROM j GROUP BY run",
        "plausible_segments": f"WITH {TRACK}, {stretch}, g AS (SELECT s.run, start_idx, end_idx, abs(max_by(tilt_cumulative, idx) - min_by(tilt_cumulative, idx)) AS turned, abs(max_by(twist_cumulative, idx) - min_by(twist_cumulative, idx)) AS twisted, max(rate) AS peak, max(tilt) AS most FROM seg s JOIN trk t ON t.run = s.run AND t.idx BETWEEN start_idx AND end_idx GROUP BY ALL) SELECT run, start_idx, end_idx FROM g WHERE turned + twisted * 0.7e0 >= 120 AND peak >= 8 AND NOT ((end_idx - start_idx) / 30e0 < 0.5 AND turned < 200) AND NOT ((end_idx - start_idx) / 30e0 < 0.8 AND most < 60 AND turned < 180)",
        "segment_axis": f"WITH {_description(inside)}, st AS (SELECT * FROM ins WHERE idx = start_idx), mi AS (SELECT * FROM ins QUALIFY row_number() OVER (PARTITION BY run, start_idx ORDER BY abs(tilt - 45e0), idx) = 1), cr AS (SELECT st.*, {_CROSS.format(a='st', b='mi')} FROM st JOIN mi {on}) SELECT run, start_idx, end_idx, CASE WHEN sqrt(cx * cx + cy * cy + cz * cz) > 0.1 AND abs(cx * rx + cy * ry + cz * rz) <= abs(cx * fx + cy * fy + cz * fz) THEN 'sagittal' ELSE 'lateral' END AS axis FROM cr",
        "segment_direction": f"""WITH {_description(inside)}, rf AS (SELECT * FROM ins WHERE idx - start_idx < floor((end_idx - start_idx + 1) * 0.3e0) OR idx = start_idx QUALIFY row_number() OVER (PARTITION BY run, start_idx ORDER BY tilt, idx) = 1),
la AS (SELECT rf.run, rf.start_idx, rf.end_idx, b.idx, rf.rx, rf.ry, rf.rz, rf.fx, rf.fy, rf.fz, {_CROSS.format(a='rf', b='b')} FROM rf JOIN ins b ON b.run = rf.run AND b.start_idx = rf.start_idx AND b.idx > rf.idx WHERE b.tilt - rf.tilt > 25 AND b.tilt < 90),
fi AS (SELECT *, cx * rx + cy * ry + cz * rz AS across, cx * fx + cy * fy + cz * fz AS ahead FROM la WHERE sqrt(cx * cx + cy * cy + cz * cz) >= 0.01 QUALIFY row_number() OVER (PARTITION BY run, start_idx ORDER BY idx) = 1),
iv AS (SELECT run, start_idx, end_idx, max(tilt) > 120 AS inverted FROM ins GROUP BY ALL)
SELECT run, start_idx, end_idx, CASE WHEN inverted AND CASE WHEN abs(across) > abs(ahead) THEN across ELSE ahead END > 0 THEN 'forward' ELSE 'backward' END AS direction FROM iv LEFT JOIN fi {on}""",
        "segment_shape": f"""WITH {_description(inside)}, lv AS (SELECT run, start_idx, end_idx, greatest(quantile_cont(tilt, 0.7), 30e0) AS level FROM ins GROUP BY ALL),
hi AS (SELECT i.run, i.start_idx, i.end_idx, greatest(j3, j4) AS k, greatest(j0, j1) AS h FROM ins i JOIN lv {on} JOIN rot r ON r.run = i.run AND r.idx = i.idx WHERE tilt > level QUALIFY row_number() OVER (PARTITION BY i.run, i.start_idx ORDER BY i.idx) % 2 = 1),
me AS (SELECT run, start_idx, end_idx, avg(k) AS k, avg(h) AS h FROM hi GROUP BY ALL)
SELECT run, start_idx, end_idx, CASE WHEN k IS NULL OR k > 45 AND h > 30 THEN 'tuck' WHEN k < 35 AND h > 30 THEN 'pike' WHEN k < 45 AND h < 25 THEN 'layout' WHEN (k + h) / 2 > 40 THEN 'tuck' ELSE 'layout' END AS shape FROM seg LEFT JOIN me {on}""",
        "segment_entry": f"""WITH {ROT}, {stretch}, st AS (SELECT *, sqrt((tx - lag(tx) OVER w) * (tx - lag(tx) OVER w) + (tz - lag(tz) OVER w) * (tz - lag(tz) OVER w)) AS step FROM rot WINDOW w AS (PARTITION BY run ORDER BY idx)),
nr AS (SELECT s.run, start_idx, end_idx, avg(step) FILTER (WHERE start_idx - idx BETWEEN 1 AND 9) AS speed, count(*) FILTER (WHERE start_idx - idx BETWEEN 1 AND 10) AS steps, avg(ty) FILTER (WHERE idx < start_idx) AS height, count(*) FILTER (WHERE idx < start_idx) AS heights, max(ty) FILTER (WHERE idx = start_idx) AS now FROM seg s JOIN st ON st.run = s.run AND idx BETWEEN start_idx - 15 AND start_idx GROUP BY ALL)
SELECT run, start_idx, end_idx, CASE WHEN start_idx < 5 THEN 'standing' WHEN steps > 3 AND speed > 0.05 THEN 'running' WHEN heights > 3 AND now - height > 0.3 THEN 'wall' ELSE 'standing' END AS entry FROM nr""",
        "axis_classes": f"WITH {ROT}, n AS (SELECT *, sqrt(ox * ox + oy * oy + oz * oz) AS n FROM rot) SELECT run, idx, CASE WHEN n > 0 AND abs(ox) / n > 0.6 THEN 'lateral' WHEN n > 0 AND abs(oz) / n > 0.6 THEN 'sagittal' WHEN n > 0 AND abs(oy) / n > 0.6 THEN 'longitudinal' ELSE 'off_axis' END AS axis FROM n",
        "segment_signatures": f"""WITH {ROT}, {stretch}, des AS (SELECT *, {at(adapters.AXES)} AS axis, {at(adapters.DIRECTIONS)} AS direction, {at(adapters.SHAPES)} AS shape, {at(adapters.ENTRIES)} AS entry, (start_idx // 20 % 4) / 2e0 AS flips, (start_idx // 20 % 3) / 2e0 AS twists FROM seg),
hei AS (SELECT d.run, start_idx, end_idx, max(ty) - min(ty) AS height FROM des d JOIN rot r ON r.run = d.run AND idx BETWEEN start_idx AND end_idx GROUP BY ALL)
SELECT run, start_idx, end_idx, round(CASE axis WHEN 'lateral' THEN 1e0 WHEN 'off_axis' THEN sqrt(0.5e0) ELSE 0e0 END, 4) AS ax, round(CASE axis WHEN 'longitudinal' THEN 1e0 WHEN 'off_axis' THEN sqrt(0.5e0) ELSE 0e0 END, 4) AS ay, CASE axis WHEN 'sagittal' THEN 1e0 ELSE 0e0 END AS az,
  flips * 360e0 * CASE direction WHEN 'backward' THEN 1e0 ELSE -1e0 END AS flip_deg, twists * 360e0 AS twist_deg, direction AS sig_direction, shape AS sig_shape, entry AS sig_entry, round(height, 4) AS height, round((end_idx - start_idx) / 30e0, 4) AS seconds, round(start_idx * 1000e0 / 30e0, 4) AS start_ms, round(end_idx * 1000e0 / 30e0, 4) AS end_ms FROM des JOIN hei {on}""",
        "band_candidates": f"WITH s AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 1000 AS DOUBLE) AS rot, (p_partkey % 7) / 2e0 AS flips, (p_partkey % 5) / 2e0 AS twists, (p_partkey % 11) / 500e0 AS twist_rate, p_partkey % 3 = 0 AS side, CASE WHEN p_partkey % 2 = 0 THEN 'backward' ELSE 'forward' END AS direction, CASE WHEN p_partkey % 4 = 0 THEN 'layout' ELSE 'tuck' END AS shape FROM part) SELECT id, array_to_string({describe.band_names().replace('array(', 'list_value(')}, '/') AS candidates FROM s",
        "description_hints": _hints_sql(),
        "type_hints": f"WITH t AS (SELECT p_partkey AS id, [lower({_pick(_TYPE_WORDS, 'p_partkey')}), lower({_pick(_TYPE_WORDS, 'p_partkey // 8 + 3')})] AS k FROM part) SELECT id, CASE WHEN list_contains(k, 'flip') THEN 'lateral' WHEN list_contains(k, 'twist') THEN 'longitudinal' END AS axis, CASE WHEN list_contains(k, 'flip') THEN 1e0 END AS rotation, CASE WHEN list_contains(k, 'twist') THEN 1e0 END AS twist, CASE WHEN list_contains(k, 'ground') THEN 'ground' WHEN list_contains(k, 'vault') THEN 'vault' WHEN list_contains(k, 'bar') THEN 'bar' WHEN list_contains(k, 'roll') THEN 'roll' END AS family, CASE WHEN list_contains(k, 'vault') THEN 'running' WHEN list_contains(k, 'bar') THEN 'edge' WHEN list_contains(k, 'wall') THEN 'wall' END AS entry FROM t",
        "unify_difficulty": f"WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 10 + 1 AS DOUBLE) END AS level, CASE WHEN p_partkey % 4 <> 0 THEN {_table(_pick(tuple('ABCDE'), 'p_partkey'), etl.CLASS_DIFFICULTY)} END AS c FROM part) SELECT id, round(CASE WHEN level IS NULL THEN c WHEN c IS NULL THEN level ELSE (level + c) / 2 END, 1) AS difficulty FROM t",
        "strict_slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower('-' || p_name || ' (' || p_brand || ')!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part",
        "localised_names": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) WHEN p_partkey % 3 <> 0 THEN p_name ELSE p_brand END AS name FROM part",
        "resolve_names": f"WITH k AS (SELECT p_partkey AS id, p_name || '-' || p_partkey % 50 AS name FROM part WHERE p_partkey % 2 = 0), w AS (SELECT DISTINCT upper(p_name || ' ' || p_partkey % 60) AS name FROM part), s AS (SELECT {low.format(x='name')} AS slug, min(id) AS id FROM k GROUP BY 1), n AS (SELECT lower(name) AS low, min(id) AS id FROM k GROUP BY 1) SELECT w.name, coalesce(s.id, n.id) AS trick_id FROM w LEFT JOIN s ON s.slug = {low.format(x='w.name')} LEFT JOIN n ON n.low = lower(w.name)",
        "mapping_join": "WITH i AS (SELECT 'item ' || p_partkey AS name, p_partkey AS pos FROM part), x AS (SELECT 'item ' || c_custkey % 400 AS low, max_by('u' || c_custkey // 2, c_custkey) AS url FROM customer GROUP BY 1), m AS (SELECT 'item ' || s_suppkey * 3 AS name, 'item ' || s_suppkey AS target FROM supplier WHERE s_suppkey % 5 <> 0) SELECT name, url FROM (SELECT i.name, i.pos, coalesce(a.url, b.url) AS url FROM i LEFT JOIN m ON m.name = i.name LEFT JOIN x a ON a.low = m.target LEFT JOIN x b ON b.low = lower(i.name)) WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1",
        "prerequisite_names": "WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name FROM part), e AS (SELECT p_partkey AS id, p_partkey // 2 AS other FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part), f AS (SELECT e.id, t.name FROM e JOIN t ON t.id = e.other UNION SELECT p_partkey, 'basics' FROM part WHERE p_partkey % 4 = 0) SELECT t.id, coalesce(string_agg(DISTINCT f.name, '|' ORDER BY f.name), '') AS prerequisites FROM t LEFT JOIN f ON f.id = t.id GROUP BY t.id",
        "keep_first": "SELECT p_partkey, p_brand, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1",
        "entity_resolution": _entities_sql(),
        "collected_texts": "WITH r AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT DISTINCT conv_id, role FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND role IS NOT NULL) SELECT r.conv_id, count(k.role) AS n, coalesce(string_agg(k.role, ',' ORDER BY k.role), '') AS sources FROM r LEFT JOIN k USING (conv_id) GROUP BY r.conv_id",
        "property_encoding": f"WITH {ENCODED} SELECT * FROM enc",
        "head_resolution": f"WITH {ENCODED}, e AS (SELECT {', '.join(heads)}, min(trick_id) AS trick_id FROM enc GROUP BY {', '.join(heads)}), p AS (SELECT vec_id AS id, {value(20)} AS no_trick, {value(21)} * 2 AS is_trick, {predicted} FROM embeddings), b AS (SELECT p.id, e.trick_id FROM p, e WHERE is_trick >= no_trick QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round({agree}, 9) DESC, e.trick_id) = 1) SELECT p.id, CASE WHEN no_trick > is_trick THEN 'no_trick' WHEN {mean} < 0.3 THEN 'uncertain' ELSE CAST(b.trick_id AS VARCHAR) END AS trick_id, round(CASE WHEN no_trick > is_trick THEN no_trick ELSE {mean} END, 5) AS confidence FROM p LEFT JOIN b ON b.id = p.id",
        "sorted_classes": "SELECT label, row_number() OVER (ORDER BY label <> '5-LOW', label) - 1 AS class FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)",
        "catalog_difference": "WITH a AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 3 = 0) SELECT 'left' AS side, p_brand, p_size, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'right', p_brand, p_size, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL",
        "download_plan": "SELECT p_partkey AS id, p_partkey % 6 AS sources, p_size / 5 AS difficulty FROM part ORDER BY sources DESC, difficulty, id LIMIT 40",
        "grouped_clips": "SELECT l_partkey % 97 AS trick_id, string_agg(DISTINCT l_returnflag || '_' || l_suppkey % 9, ',' ORDER BY l_returnflag || '_' || l_suppkey % 9) AS clips FROM lineitem GROUP BY 1",
        "mean_curves": "SELECT l_partkey % 20 AS trick_id, l_orderkey % 16 AS step, round(avg(l_quantity), 5) AS mean, round(stddev_pop(l_quantity) + 1e-6, 5) AS deviation FROM lineitem GROUP BY ALL",
        "violation_rate": "WITH e AS (SELECT a.p_size AS own, b.p_size AS needed FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey // 3 WHERE a.p_partkey // 3 > 0) SELECT count(*) AS edges, count(*) FILTER (WHERE needed > own) AS violations, round(count(*) FILTER (WHERE needed > own) / count(*), 6) AS rate FROM e",
        "best_person": "WITH p AS (SELECT CAST(label AS BIGINT) AS run, vec_id // 3 AS idx, vec_id AS person, list_sum(list_transform(embedding[1:17], lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings) SELECT run, idx, person FROM p QUALIFY row_number() OVER (PARTITION BY run, idx ORDER BY m DESC, person) = 1",
        "largest_box": "WITH b AS (SELECT l_orderkey % 100 AS run, l_orderkey // 100 AS idx, CAST(l_linenumber AS BIGINT) AS box, max(l_suppkey % 50) AS x0, max(l_suppkey % 50 + l_quantity) AS x1, max(l_partkey % 9) AS y1 FROM lineitem GROUP BY ALL) SELECT run, idx, box FROM b QUALIFY row_number() OVER (PARTITION BY run, idx ORDER BY (x1 - x0) * y1 DESC, box) = 1",
        "unit_coordinates": "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN p_size * 20e0 / 1920 WHEN p_size * 20e0 > 1 OR p_size / 100e0 > 1 THEN p_size * 20e0 / 1280 ELSE p_size * 20e0 END, 6) AS x, round(CASE WHEN p_partkey % 2 = 0 THEN p_size / 100e0 / 1080 WHEN p_size * 20e0 > 1 OR p_size / 100e0 > 1 THEN p_size / 100e0 / 720 ELSE p_size / 100e0 END, 6) AS y FROM part",
        "top_flag": f"WITH {DETECTIONS}, t AS (SELECT DISTINCT run, trick_id FROM (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY run ORDER BY confidence DESC, detection_id, trick_id) <= 3)) SELECT run, detection_id, (run, trick_id) IN (SELECT (run, trick_id) FROM t) AS is_top3 FROM det",
        "audit_log": f"WITH {DETECTIONS}, f AS (SELECT run, detection_id, start_ms % 3600000000 AS ms FROM det WHERE confidence >= 0.9), a AS (SELECT run, 'detection' AS kind, ms, detection_id, format('{{:02d}}:{{:02d}}', ms // 1000 // 60, ms // 1000 % 60) AS m FROM f UNION ALL SELECT run, 'score', NULL, NULL, 'total' FROM f GROUP BY run) SELECT run, row_number() OVER (PARTITION BY run ORDER BY ms NULLS LAST, detection_id) AS nth, kind, m[1:5] AS head FROM a",
        "run_report": f"WITH {DETECTIONS} SELECT c_custkey AS run, count(detection_id) AS n FROM customer LEFT JOIN det ON det.run = c_custkey GROUP BY c_custkey",
        "training_manifest": "SELECT string_agg(label, '|' ORDER BY label) AS classes, max(n) FILTER (WHERE label = '5-LOW') AS low, CAST(sum(n) AS BIGINT) AS samples FROM (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1)",
        "reference_names": "WITH h AS (SELECT l_partkey, count(*) AS had FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT r.l_partkey AS trick_id, l_orderkey * 8 + l_linenumber AS id, format('ref_{:03d}', row_number() OVER (PARTITION BY r.l_partkey ORDER BY l_orderkey * 8 + l_linenumber) + coalesce(had, 0)) AS ref FROM lineitem r LEFT JOIN h ON h.l_partkey = r.l_partkey WHERE l_returnflag = 'R'",
        "label_log": "WITH e AS (SELECT event_id, user_id % 40 AS file, event_type AS trick_id, CAST(floor(value) AS BIGINT) % 4 AS start_ms FROM events) SELECT file, trick_id, start_ms FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file, trick_id, start_ms ORDER BY event_id DESC) = 1) WHERE event_id % 3 <> 0",
        "latest_status": "SELECT o_custkey AS run, o_orderkey AS seq, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
        "insert_absent": "WITH w AS (SELECT p_partkey AS id, p_brand || '-' || p_partkey % 100 AS file FROM part) SELECT id, file FROM w WHERE file NOT IN (SELECT file FROM w WHERE id % 7 = 0) QUALIFY row_number() OVER (PARTITION BY file ORDER BY id) = 1",
    }
