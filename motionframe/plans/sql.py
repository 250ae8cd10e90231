"""DuckDB SQL that gives the rows of the registered queries, written over the same tables."""

from __future__ import annotations

from motionframe.functions import geometry as g
from motionframe.functions import names
from motionframe.operators import catalog, matching
from motionframe.sources import adapters

HOUR = 3_600_000

SIGNAL = "sig AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) // 1000 AS t_ms, value AS v FROM events)"
SPEED = f"""{SIGNAL},
vel AS (SELECT run, idx, t_ms, CASE WHEN lag(t_ms) OVER w IS NULL OR t_ms <= lag(t_ms) OVER w THEN 0e0 ELSE (v - lag(v) OVER w) / ((t_ms - lag(t_ms) OVER w) / 1000e0) END AS velocity FROM sig WINDOW w AS (PARTITION BY run ORDER BY idx)),
smo AS (SELECT run, idx, t_ms, avg(abs(velocity)) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM vel)"""
ACTIVE = f"""{SPEED},
thr AS (SELECT run, coalesce(1.5e0 * median(smooth) FILTER (WHERE smooth > 0), 0e0) AS threshold FROM smo GROUP BY run),
act AS (SELECT s.*, threshold > 0 AND smooth >= threshold AS active,
  min(idx) OVER (PARTITION BY run ORDER BY t_ms RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING) AS pad_from,
  max(idx) OVER (PARTITION BY run ORDER BY t_ms RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING) AS pad_to
  FROM smo s JOIN thr USING (run)),
num AS (SELECT *, idx - row_number() OVER (PARTITION BY run, active ORDER BY idx) AS place FROM act),
isl AS (SELECT run, min(idx) AS start_idx, max(idx) AS end_idx, max(smooth) AS peak FROM num WHERE active GROUP BY run, place),
pad AS (SELECT run, min(pad_from) AS start_idx, max(pad_to) AS end_idx FROM num WHERE active GROUP BY run, place)"""


def merged(source: str, start: str, end: str, gap: int, name: str) -> str:
    return f"""{name}_f AS (SELECT *, CASE WHEN max({end}) OVER w IS NULL OR {start} - max({end}) OVER w > {gap} THEN 1 ELSE 0 END AS fresh FROM {source} WINDOW w AS (PARTITION BY run ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_p AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING) AS part FROM {name}_f),
{name} AS (SELECT run, min({start}) AS {start}, max({end}) AS {end} FROM {name}_p GROUP BY run, part)"""


SEGMENTS = f"""{ACTIVE},
tim AS (SELECT p.run, a.t_ms AS start_ms, b.t_ms AS end_ms FROM pad p JOIN act a ON a.run = p.run AND a.idx = p.start_idx JOIN act b ON b.run = p.run AND b.idx = p.end_idx),
{merged("tim", "start_ms", "end_ms", HOUR * 3 // 2, "mer")},
seg AS (SELECT m.run, m.start_ms, m.end_ms, min(idx) AS start_idx, max(idx) AS end_idx, max(smooth) AS peak FROM mer m JOIN act a ON a.run = m.run AND a.t_ms BETWEEN m.start_ms AND m.end_ms
  WHERE m.end_ms - m.start_ms BETWEEN {2 * HOUR} AND {48 * HOUR} GROUP BY ALL)"""

INDEXED = f"emb AS (SELECT CAST(label AS BIGINT) AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * {adapters.FRAME_MS!r}e0 AS t_ms, embedding AS e FROM embeddings)"
POSE = f"{INDEXED}, pose AS (SELECT run, idx, t_ms, " + ", ".join(f"CAST(e[{2 * i + 1}] AS DOUBLE) AS x{i}, CAST(e[{2 * i + 2}] AS DOUBLE) AS y{i}, abs(CAST(e[{35 + i}] AS DOUBLE)) * 4e0 AS c{i}" for i in range(17)) + " FROM emb)"
BODY = f"{POSE}, body AS (SELECT run, idx, t_ms, {g.centre_of_mass('x')} AS com_x, {g.centre_of_mass('y')} AS com_y, {g.torso_length()} AS torso, {g.body_tilt()} AS tilt, CASE WHEN {g.seen(('left_shoulder', 'right_shoulder'))} THEN (y6 - y5) / ({g.torso_length()}) END AS symmetry FROM pose)"
TEMPORAL = f"""{BODY},
unit AS (SELECT run, coalesce(median(torso), 1e0) AS unit FROM body GROUP BY run),
tmp AS (SELECT b.run, idx, t_ms, tilt, coalesce(CASE WHEN t_ms > lag(t_ms) OVER w THEN (t_ms - lag(t_ms) OVER w) / 1000e0 END, 1e0 / 30e0) AS seconds, -(com_y - first_value(com_y) OVER w) / unit AS height,
  {g.wrap("(tilt - lag(tilt) OVER w)")} AS turn, lag(idx) OVER w IS NULL AS start FROM body b JOIN unit USING (run) WINDOW w AS (PARTITION BY b.run ORDER BY idx)),
feat AS (SELECT run, idx, tilt, CASE WHEN start THEN 0e0 ELSE turn / seconds END AS tilt_velocity, sum(coalesce(turn, 0e0)) OVER w AS rotation, height,
  CASE WHEN start THEN 0e0 ELSE (height - lag(height) OVER w) / seconds END AS height_velocity FROM tmp WINDOW w AS (PARTITION BY run ORDER BY idx))"""
ROT = f"{INDEXED}, rot AS (SELECT run, idx, t_ms, " + ", ".join(f"CAST(e[{k + 1}] AS DOUBLE) * 4e0 AS o{a}, CAST(e[{k + 4}] AS DOUBLE) AS t{a}" for k, a in enumerate("xyz")) + ", " + ", ".join(
    f"degrees(sqrt({' + '.join(f'CAST(e[{7 + 3 * j + k}] AS DOUBLE) * CAST(e[{7 + 3 * j + k}] AS DOUBLE)' if 6 + 3 * j + k < 64 else '0e0' for k in range(3))})) AS j{j}" for j in range(19)
) + " FROM emb)"
TRACK = f"""{ROT},
quat AS (SELECT *, cos(th / 2e0) AS qw, ox * f AS qx, oy * f AS qy, oz * f AS qz FROM (SELECT *, CASE WHEN th > 1e-12 THEN sin(th / 2e0) / th ELSE 0.5e0 END AS f FROM (SELECT *, sqrt(ox * ox + oy * oy + oz * oz) AS th FROM rot))),
up AS (SELECT *, 2e0 * (qx * qy - qw * qz) AS ux, 1e0 - 2e0 * (qx * qx + qz * qz) AS uy, 2e0 * (qy * qz + qw * qx) AS uz FROM quat),
pre AS (SELECT *, lag(qw) OVER w AS pw, lag(qx) OVER w AS px, lag(qy) OVER w AS py, lag(qz) OVER w AS pz, lag(ux) OVER w AS bx, lag(uy) OVER w AS by_, lag(uz) OVER w AS bz FROM up WINDOW w AS (PARTITION BY run ORDER BY idx)),
del AS (SELECT *, qw * pw + qx * px + qy * py + qz * pz AS dw, qx * pw - qw * px + qz * py - qy * pz AS dx, qy * pw - qw * py + qx * pz - qz * px AS dy, qz * pw - qw * pz + qy * px - qx * py AS dz FROM pre),
rat AS (SELECT run, idx, ux, uy, uz, bx, by_, bz, degrees(acos({g.clip("uy", "-1e0", "1e0")})) AS tilt, coalesce(degrees(2e0 * atan2(sqrt(dx * dx + dy * dy + dz * dz), abs(dw))), 0e0) AS rate,
  coalesce(CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) > 0 THEN (CASE WHEN dw < 0 THEN -1e0 ELSE 1e0 END) * (dx * bx + dy * by_ + dz * bz) / sqrt(dx * dx + dy * dy + dz * dz) END, 0e0) AS along FROM del),
stp AS (SELECT *, coalesce(abs(tilt - lag(tilt) OVER (PARTITION BY run ORDER BY idx)), 0e0) AS step FROM rat),
trk AS (SELECT *, sum(step) OVER w AS tilt_cumulative, sum(CASE WHEN rate > 0.01 THEN along * rate ELSE 0e0 END) OVER w AS twist_cumulative FROM stp WINDOW w AS (PARTITION BY run ORDER BY idx)),
pha AS (SELECT run, degrees(sum(coalesce(CASE WHEN abs(d) > 1e-10 THEN 2e0 * atan2(bz * ux - bx * uz, d) ELSE 0e0 END, 0e0))) AS phase FROM (SELECT *, 1e0 + by_ + uy + bx * ux + by_ * uy + bz * uz AS d FROM trk) GROUP BY run)"""


def _pick(values: tuple[str, ...], x: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({x}) % {len(values)} + 1 AS INTEGER))"


CATALOG = f"""cat AS (SELECT p_partkey AS trick_id, p_name AS name, (p_partkey % 7) / 2e0 AS flips, (p_partkey % 5) / 2e0 AS twists, {_pick(adapters.AXES, "p_partkey")} AS axis, {_pick(adapters.DIRECTIONS, "p_partkey // 4")} AS direction,
  {_pick(adapters.SHAPES, "p_partkey // 8")} AS shape, {_pick(adapters.ENTRIES, "p_partkey // 3")} AS entry, {_pick(adapters.CONTEXTS, "p_partkey // 5")} AS context, floor(p_retailprice / 20) / 10 AS score FROM part)"""


def _axis(component: int) -> str:
    return "CASE axis " + " ".join(f"WHEN '{k}' THEN {v[component] / sum(c * c for c in v) ** 0.5!r}::DOUBLE" for k, v in matching.AXIS_VECTORS.items()) + " END"


def _near(a: str, b: str, x: str, y: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0e0 WHEN {a} IN ('{x}', '{y}') AND {b} IN ('{x}', '{y}') THEN 0.3e0 ELSE 0.5e0 END"


_W = matching.WEIGHTS
SCORED = f"""{ROT}, {CATALOG},
sigs AS (SELECT run * 100000 + idx AS sig_id, ox AS ax, oy AS ay, oz AS az, ox * 360e0 AS flip_deg, tx * 1440e0 AS twist_deg, {_pick(adapters.DIRECTIONS, "idx")} AS sd, {_pick(adapters.SHAPES, "idx")} AS ss, {_pick(adapters.ENTRIES, "idx")} AS se FROM rot),
nrm AS (SELECT *, CASE WHEN sqrt(ax * ax + ay * ay + az * az) > 1e-6 THEN sqrt(ax * ax + ay * ay + az * az) ELSE 1e0 END AS u FROM sigs),
sco AS (SELECT sig_id, trick_id, name, context, score, greatest(round(1e0 - ({_W["axis"]}e0 * least(degrees(acos(least(abs(0e0 + ax / u * {_axis(0)} + ay / u * {_axis(1)} + az / u * {_axis(2)}), 1e0))) / 45e0, 1e0)
  + {_W["rotation"]}e0 * least(abs(abs(flip_deg) / 360e0 - flips) * 360e0 / 180e0, 1e0) + {_W["twist"]}e0 * least(abs(abs(twist_deg) / 360e0 - twists) * 360e0 / 180e0, 1e0)
  + {_W["shape"]}e0 * {_near("ss", "shape", "tuck", "pike")} + {_W["entry"]}e0 * {_near("se", "entry", "standing", "running")}
  + {_W["direction"]}e0 * CASE WHEN axis = 'sagittal' OR sd = direction THEN 0e0 ELSE 1e0 END), 9), 0e0) AS confidence FROM nrm, cat)"""


def _top(k: int, where: str) -> str:
    return f"WITH {SCORED} SELECT sig_id, rank, trick_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY confidence DESC, score, name, trick_id) AS rank FROM sco WHERE confidence >= 0.1 AND {where}) WHERE rank <= {k}"


DETECTIONS = "det AS (SELECT o_custkey AS run, l_orderkey * 8 + l_linenumber AS detection_id, p_brand AS trick_id, 1 - 5 * l_discount AS confidence, epoch_us(l_shipdate) // 1000 AS start_ms, epoch_us(l_shipdate) // 1000 + CAST(l_quantity * 20 * 86400000 AS BIGINT) AS end_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
NMS = """items AS (SELECT run, trick_id, list({'c': -confidence, 'id': detection_id, 's': start_ms, 'e': end_ms} ORDER BY -confidence, detection_id) AS items FROM det {where} GROUP BY run, trick_id),
kept AS (SELECT run, trick_id, unnest(list_reduce(list_transform(items, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k:
  greatest(least(k.e, y[1].e) - greatest(k.s, y[1].s), 0) > 0.5e0 * ((k.e - k.s) + (y[1].e - y[1].s) - greatest(least(k.e, y[1].e) - greatest(k.s, y[1].s), 0)))) > 0 THEN acc ELSE list_concat(acc, y) END)) AS k FROM items)"""
DIFFICULTY = "dif AS (SELECT p_brand AS trick_id, max(p_size) / 5e0 AS difficulty FROM part GROUP BY p_brand)"
SIDES = """a AS (SELECT l_suppkey AS run, l_partkey % 50 AS trick_id, max(l_quantity) / 50 AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), r AS (SELECT l_suppkey AS run, l_partkey % 50 AS trick_id, max(l_quantity) / 50 AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"""
LABELS = """src AS (SELECT o_orderkey AS item, 'not_a_flip' AS label, 0 AS source FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, o_orderpriority, 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 2 FROM orders),
lab AS (SELECT item, label, CAST(source AS BIGINT) AS source FROM src QUALIFY row_number() OVER (PARTITION BY item ORDER BY source, label) = 1)"""
MERGED = """mrg AS (SELECT key, coalesce(max(sn), max(cn)) AS name, max(ck) AS kind, CAST(count(DISTINCT p) AS BIGINT) AS sources FROM (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS sn, NULL AS cn, NULL AS ck, 0 AS p FROM supplier UNION ALL SELECT c_custkey, NULL, c_name, c_mktsegment, 1 FROM customer) GROUP BY key)"""

_WORDS = ("double", "full", "back", "cork", "720", "side", "flip", "wall", "half", "gainer", "Triple", "layout", "cheat", "front", "arabian", "pike", "kong", "roll", "full", "B-Twist", "webster", "540", "corkscrew", "raiz", "handspring", "twist")


def _case(x: str, table: dict, otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v!r}" + ("e0" if isinstance(v, float) else "") for k, v in table.items()) + f" ELSE {otherwise} END"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _special(field: str, default: str) -> str:
    for word, changes in names.SPECIALS.items():
        if field in changes:
            value = changes[field]
            default = f"CASE WHEN list_contains(w, '{word}') THEN {value!r}{'e0' if isinstance(value, float) else ''} ELSE {default} END"
    return default


def _last(table: dict, default: str) -> str:
    known = f"list_filter(w, lambda t: list_contains({_listed(table)}, t))"
    return f"CASE WHEN len({known}) > 0 THEN {_case(f'({known})[-1]', table, 'NULL')} ELSE {default} END"


def _parsed() -> str:
    at = lambda f: _pick(_WORDS, f)
    name = f"concat_ws(' ', {at('p_partkey')}, {at('p_partkey // 26 + p_partkey * 3')}, {at('p_partkey // 7 + 5')}, {at('p_partkey * p_partkey')})"
    step = f"{{'count': CASE WHEN y.t IN ('double', 'triple', 'quad') THEN CASE WHEN s.set THEN s.count * y.count ELSE y.count END WHEN y.t = 'half' AND NOT s.set THEN 0.5e0 WHEN regexp_full_match(y.t, '[0-9]+') THEN y.count ELSE s.count END, 'set': true, 't': ''}}"
    turns = f"list_transform(list_filter(w, lambda t: list_contains({_listed(names.ROTATIONS)}, t)), lambda t: {{'count': {_case('t', names.ROTATIONS, '0e0')}, 'set': false, 't': t}})"
    family = "'flip'"
    for label, marks, unless in reversed(names.FAMILIES):
        family = f"CASE WHEN list_has_any(w, {_listed(marks)})" + (f" AND NOT list_has_any(w, {_listed(unless)})" if unless else "") + f" THEN '{label}' ELSE {family} END"
    return f"""nam AS (SELECT p_partkey AS id, {name} AS name FROM part),
wrd AS (SELECT id, list_filter(string_split(replace(lower(name), '-', ' '), ' '), lambda t: t <> '') AS w FROM nam),
mul AS (SELECT *, list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i + 1] = 'full' THEN w[i] END), lambda t: t IN ('double', 'triple', 'quad'))[1] AS m FROM wrd),
rota AS (SELECT *, CASE WHEN m IS NOT NULL THEN 1e0 ELSE list_reduce(list_concat([{{'count': {_special("rotation", "1e0")}, 'set': false, 't': ''}}], {turns}), lambda s, y: {step}).count END AS rotation FROM mul),
twi AS (SELECT *, CASE WHEN m IS NOT NULL THEN {_case("m", names.ROTATIONS, "0e0")} WHEN f > 0 AND (list_has_any(w, {_listed(names.TWIST_WORDS)}) OR rotation >= 1) THEN greatest(t0, f) ELSE t0 END AS t1 FROM (SELECT *, CAST(len(list_filter(w, lambda t: t = 'full')) AS DOUBLE) AS f, {_special("twist", "0e0")} AS t0 FROM rota)),
hal AS (SELECT *, CASE WHEN list_contains(w, 'half') AND rotation >= 1 AND list_position(w, 'half') - 1 > len(w) // 2 THEN greatest(t1, 0.5e0) ELSE t1 END AS t2, list_contains({_listed(names.SPIN_PREFIXES)}, w[1]) AND NOT list_has_any(w, {_listed(names.NO_SPIN_WORDS)}) AS spin FROM twi),
par AS (SELECT id, rotation, CASE WHEN list_has_any(w, ['cork', 'corkscrew']) AND (CASE WHEN spin THEN 0e0 ELSE t2 END) = 0 THEN 1e0 WHEN spin THEN 0e0 ELSE t2 END AS twist,
  CASE WHEN spin THEN 'longitudinal' WHEN m IS NOT NULL THEN 'lateral' ELSE {_last(names.AXES, _special("axis", "'lateral'"))} END AS axis,
  CASE WHEN spin THEN 'left' ELSE {_last(names.DIRECTIONS, _special("direction", "'backward'"))} END AS direction,
  CASE WHEN m IS NOT NULL THEN 'layout' ELSE {_last(names.SHAPES, "'tuck'")} END AS shape,
  CASE WHEN list_contains(w, 'wall') THEN 'wall' ELSE {_last(names.ENTRIES, _special("entry", "'standing'"))} END AS entry, {family} AS family FROM hal)"""


def _bonus(column: str, table: dict[str, float]) -> str:
    return _case(column, table, "0e0")


def oracle_sql() -> dict[str, str]:
    segment = "start_idx, end_idx"
    shape = """WITH {rot}, raw AS (SELECT run, idx, (j3 + j4) / 2 AS kn, (j0 + j1) / 2 AS hi, (j15 + j16) / 2 AS sh FROM rot),
sc AS (SELECT run, idx, CASE WHEN kn > 70 AND hi > 50 THEN least((kn - 70) / 50 * (hi - 50) / 50, 1e0) WHEN kn > 55 AND hi > 40 THEN 0.3e0 ELSE 0e0 END AS tuck, CASE WHEN kn < 50 AND hi > 50 THEN least((50 - kn) / 50 * (hi - 50) / 50, 1e0) ELSE 0e0 END AS pike,
  CASE WHEN kn < 50 AND hi < 40 THEN least((50 - kn) / 50 * (40 - hi) / 40, 1e0) ELSE 0e0 END AS base, sh FROM raw),
op AS (SELECT *, CASE WHEN sh > 40 THEN base * least((sh - 40) / 60, 1e0) ELSE 0e0 END AS open FROM sc),
la AS (SELECT *, CASE WHEN sh > 40 THEN base * (1 - open) ELSE base END AS layout FROM op),
no AS (SELECT run, idx, CASE WHEN tuck + pike + layout + open > 0 THEN tuck / (tuck + pike + layout + open) ELSE 0e0 END AS tuck, CASE WHEN tuck + pike + layout + open > 0 THEN pike / (tuck + pike + layout + open) ELSE 0e0 END AS pike,
  CASE WHEN tuck + pike + layout + open > 0 THEN layout / (tuck + pike + layout + open) ELSE 1e0 END AS layout, CASE WHEN tuck + pike + layout + open > 0 THEN open / (tuck + pike + layout + open) ELSE 0e0 END AS open FROM la)
SELECT run, idx, round(tuck, 5) AS tuck, round(pike, 5) AS pike, round(layout, 5) AS layout, round(open, 5) AS open,
  CASE greatest(tuck, pike, layout, open) WHEN tuck THEN 'tuck' WHEN pike THEN 'pike' WHEN layout THEN 'layout' ELSE 'open' END AS shape FROM no""".format(rot=ROT)
    com = {a: g.centre_of_mass(a) for a in "xy"}
    cells = ", ".join(f"CASE WHEN c{i} >= 0.3 THEN ({a}{i} - ({com[a]})) / ({g.torso_length()}) END" for i in range(17) for a in "xy")
    moves = {j: f"abs({j} - lag({j}) OVER w)" for j in ("left_hip", "right_hip", "spine")}
    known = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in moves.values())
    angles = g.joint_angles()
    return {
        "velocity": f"WITH {SPEED} SELECT run, idx, round(velocity, 6) AS velocity FROM vel",
        "smooth_shrink": f"WITH {SPEED} SELECT run, idx, round(smooth, 6) AS smooth FROM smo",
        "smooth_zero_pad": f"WITH {SIGNAL} SELECT run, idx, round(sum(v) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 5) AS smooth FROM sig",
        "adaptive_threshold": f"WITH {ACTIVE} SELECT run, round(threshold, 6) AS threshold FROM thr",
        "islands": f"WITH {ACTIVE} SELECT run, {segment}, round(peak, 6) AS peak FROM isl",
        "pad_islands": f"WITH {ACTIVE} SELECT run, {segment} FROM pad",
        "segments": f"WITH {SEGMENTS} SELECT run, {segment}, start_ms, end_ms, round(peak, 6) AS peak FROM seg",
        "best_segment": f"WITH {SEGMENTS} SELECT run, {segment} FROM seg QUALIFY row_number() OVER (PARTITION BY run ORDER BY peak DESC, start_idx) = 1",
        "sequence_windows": f"""WITH {SPEED}, lev AS (SELECT run, coalesce(2e0 * median(smooth) FILTER (WHERE smooth > 0), 0e0) AS threshold, max(idx) AS last FROM smo GROUP BY run),
fl AS (SELECT s.*, smooth >= threshold AS active, last FROM smo s JOIN lev USING (run)), nn AS (SELECT *, idx - row_number() OVER (PARTITION BY run, active ORDER BY idx) AS place FROM fl),
ii AS (SELECT run, greatest(min(idx) - 3, 0) AS start_idx, least(max(idx) + 3, max(last)) AS end_idx FROM nn WHERE active GROUP BY run, place), {merged("ii", "start_idx", "end_idx", 5, "mm")},
kk AS (SELECT * FROM mm WHERE end_idx - start_idx + 1 >= 8) SELECT * FROM kk UNION ALL SELECT run, 0, last FROM lev WHERE run NOT IN (SELECT run FROM kk)""",
        "airtime_segments": f"""WITH {SIGNAL}, lev AS (SELECT run, avg(v) + stddev_pop(v) AS level FROM sig GROUP BY run), fl AS (SELECT s.*, v > level AS active FROM sig s JOIN lev USING (run)),
nn AS (SELECT *, idx - row_number() OVER (PARTITION BY run, active ORDER BY idx) AS place FROM fl), ii AS (SELECT run, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM nn WHERE active GROUP BY run, place), {merged("ii", "start_ms", "end_ms", 3 * HOUR, "mm")}
SELECT run, start_ms - {HOUR} AS start_ms, end_ms + {HOUR} AS end_ms FROM mm WHERE end_ms - start_ms + {2 * HOUR} BETWEEN {2 * HOUR} AND {96 * HOUR}""",
        "resample_linear": f"""WITH {BODY}, ends AS (SELECT run, max(idx) AS last FROM body GROUP BY run), want AS (SELECT run, s AS step, s * last / 59e0 AS pos FROM ends, unnest(range(60)) AS t(s)),
k AS (SELECT run, idx, tilt FROM body WHERE tilt IS NOT NULL),
lft AS (SELECT w.run, step, max(k.idx) AS li FROM want w LEFT JOIN k ON k.run = w.run AND k.idx <= pos GROUP BY w.run, step), rgt AS (SELECT w.run, step, min(k.idx) AS ri FROM want w LEFT JOIN k ON k.run = w.run AND k.idx >= pos GROUP BY w.run, step)
SELECT w.run, w.step, round(CASE WHEN li IS NULL THEN b.tilt WHEN ri IS NULL OR li = ri THEN a.tilt ELSE a.tilt + (pos - li) / (ri - li) * (b.tilt - a.tilt) END, 5) AS tilt
FROM want w JOIN lft ON lft.run = w.run AND lft.step = w.step JOIN rgt ON rgt.run = w.run AND rgt.step = w.step LEFT JOIN k a ON a.run = w.run AND a.idx = li LEFT JOIN k b ON b.run = w.run AND b.idx = ri""",
        "forward_fill": f"WITH {BODY} SELECT run, idx, round(coalesce(last_value(torso IGNORE NULLS) OVER (PARTITION BY run ORDER BY idx ROWS UNBOUNDED PRECEDING), 0e0), 5) AS torso FROM body",
        "frame_sampler": f"WITH {INDEXED}, ends AS (SELECT run, max(idx) AS last FROM emb GROUP BY run) SELECT run, s AS sample, CASE WHEN last + 1 >= 16 THEN s * last // 15 ELSE least(s, last) END AS idx FROM ends, unnest(range(16)) AS t(s)",
        "joint_angles": f"WITH {POSE} SELECT run, idx, {', '.join(f'round({e}, 4) AS {k}' for k, e in angles.items())} FROM pose",
        "com_torso_tilt": f"WITH {BODY} SELECT run, idx, {', '.join(f'round({k}, 5) AS {k}' for k in ('com_x', 'com_y', 'torso', 'tilt', 'symmetry'))} FROM body",
        "limb_ratios": f"WITH {POSE} SELECT run, idx, {', '.join(f'round({g.limb_ratio(k)}, 5) AS {k}' for k in g.LIMBS)} FROM pose",
        "relative_positions": f"WITH {POSE}, r AS (SELECT run, idx, [{cells}] AS rel FROM pose) SELECT run, idx, i - 1 AS cell, round(rel[i], 5) AS value FROM r, unnest(range(1, 35)) AS t(i) WHERE rel[i] IS NOT NULL",
        "joint_intensity": f"WITH {POSE}, ang AS (SELECT run, idx, t_ms, {', '.join(f'{angles[j]} AS {j}' for j in moves)} FROM pose) SELECT run, idx, round(CASE WHEN lag(t_ms) OVER w IS NULL OR ({known}) = 0 THEN 0e0 ELSE ({' + '.join(f'coalesce({m}, 0e0)' for m in moves.values())}) / ((t_ms - lag(t_ms) OVER w) / 1000e0) / ({known}) END, 3) AS intensity FROM ang WINDOW w AS (PARTITION BY run ORDER BY idx)",
        "temporal_features": f"WITH {TEMPORAL} SELECT run, idx, {', '.join(f'round({k}, 4) AS {k}' for k in ('tilt', 'tilt_velocity', 'rotation', 'height', 'height_velocity'))} FROM feat",
        "normalise_features": f"WITH {TEMPORAL} SELECT run, idx, round(tilt / 180, 5) AS tilt, round(greatest(-2000e0, least(2000e0, tilt_velocity)) / 2000 + 0 * tilt_velocity, 5) AS tilt_velocity, round(rotation / 1080, 5) AS rotation, round(height / 5, 5) AS height, round(greatest(-20e0, least(20e0, height_velocity)) / 20, 5) AS height_velocity FROM feat",
        "rotation_tracking": f"WITH {TRACK} SELECT run, idx, {', '.join(f'round({k}, 4) AS {k}' for k in ('tilt', 'tilt_cumulative', 'twist_cumulative', 'rate'))} FROM trk",
        "geometric_phase": f"WITH {TRACK} SELECT run, round(phase, 4) AS phase FROM pha",
        "inversion_crossings": f"WITH {TRACK}, b AS (SELECT run, tilt, lag(tilt) OVER (PARTITION BY run ORDER BY idx) AS p FROM trk) SELECT run, CAST(count(*) FILTER (WHERE (tilt > 90) <> (p > 90)) AS BIGINT) AS crossings, CAST(count(*) FILTER (WHERE tilt > 90 AND p <= 90) AS BIGINT) AS rising, bool_or(tilt > 100) AS inverted FROM b GROUP BY run",
        "rotation_physics": f"""WITH {TRACK}, agg AS (SELECT run, max_by(tilt_cumulative, idx) - min_by(tilt_cumulative, idx) AS flip_deg, abs(max_by(twist_cumulative, idx) - min_by(twist_cumulative, idx)) AS raw, max(tilt) AS max_tilt, greatest(median(rate), 5e0) AS level, median(tilt) AS any_tilt FROM trk GROUP BY run),
pk AS (SELECT t.run, median(tilt) AS peak_tilt FROM trk t JOIN agg USING (run) WHERE rate > level GROUP BY t.run), bb AS (SELECT a.*, greatest(0e0, raw - abs(phase)) AS twist_deg, coalesce(peak_tilt, any_tilt) AS mid FROM agg a JOIN pha USING (run) LEFT JOIN pk USING (run)),
cc AS (SELECT *, flip_deg / 360 AS fr, twist_deg / 360 AS tc FROM bb)
SELECT run, round(round({g.snap_to_half("fr")}, 1), 3) AS flips, round(round({g.snap_to_half("tc")}, 1), 3) AS twists, round(flip_deg, 3) AS flip_deg, round(twist_deg, 3) AS twist_deg, round(max_tilt, 3) AS max_tilt, max_tilt > 120 AS inverted,
  CASE WHEN fr < 0.2 AND tc > 0.5 THEN 'longitudinal' WHEN max_tilt > 120 AND tc > 0.3 AND mid > 30 AND mid < 80 AND max_tilt < 155 THEN 'off_axis' ELSE 'lateral' END AS axis FROM cc""",
        "shape_scores": shape,
        "physics_match_topk": _top(5, "true"),
        "context_match": _top(3, "context = 'wall'"),
        "hybrid_fusion": f"WITH {SIDES}, b AS (SELECT coalesce(a.run, r.run) AS sig_id, coalesce(a.trick_id, r.trick_id) AS trick_id, coalesce(round(a.c, 4), 0e0) AS p, coalesce(round(r.c, 4), 0e0) AS m FROM a FULL JOIN r ON a.run = r.run AND a.trick_id = r.trick_id), s AS (SELECT *, CASE WHEN sig_id % 5 >= 3 THEN 0.25e0 WHEN sig_id % 2 <> 0 THEN 0.3e0 ELSE 0.4e0 END AS w FROM b JOIN supplier ON s_suppkey = sig_id) SELECT sig_id, trick_id, round(least(w * p + (1 - w) * m + CASE WHEN p > 0.3 AND m > 0.3 THEN 0.15e0 ELSE 0e0 END, 1e0), 3) AS confidence FROM s",
        "ensemble_combine": f"WITH {SIDES} SELECT coalesce(a.run, r.run) AS run, coalesce(a.trick_id, r.trick_id) AS trick_id, round(CASE WHEN a.c IS NULL THEN r.c WHEN r.c IS NULL THEN a.c ELSE 0.6e0 * a.c + 0.4e0 * r.c END, 6) AS confidence FROM a FULL JOIN r ON a.run = r.run AND a.trick_id = r.trick_id",
        "signature_minmax_confidence": "WITH p AS (SELECT l_suppkey AS query, l_partkey % 100 AS reference, min(l_extendedprice) AS d FROM lineitem GROUP BY ALL) SELECT query, reference, round(CASE WHEN max(d) OVER w > min(d) OVER w THEN 1 - (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) ELSE 1e0 END, 6) AS similarity FROM p WINDOW w AS (PARTITION BY query)",
        "rotation_bands": f"WITH {ROT} SELECT CASE WHEN abs(ox * 720) < 90 THEN 'none' WHEN abs(ox * 720) < 270 THEN 'half' WHEN abs(ox * 720) < 450 THEN 'single' WHEN abs(ox * 720) < 810 THEN 'double' ELSE 'multiple' END AS band, count(*) AS n FROM rot GROUP BY 1",
        "top_labels": "WITH e AS (SELECT vec_id AS id, i - 1 AS class, CAST(embedding[i] AS DOUBLE) AS p FROM embeddings, unnest(range(2, 65)) AS t(i)) SELECT id, rank, class, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS rank FROM e) WHERE rank <= 3",
        "kp_quality_range_join": f"WITH {POSE}, m AS (SELECT run, idx, ({' + '.join(f'c{i}' for i in range(17))}) / 17e0 AS mean FROM pose) SELECT a.run * 100000 + a.idx AS detection_id, round(coalesce(avg(mean), 0e0), 6) AS quality FROM pose a LEFT JOIN m ON m.run = a.run AND m.idx BETWEEN a.idx AND a.idx + 9 GROUP BY 1",
        "multi_factor_confidence": "WITH f AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 1 - 5 * l_discount AS b, l_quantity / 50 AS q, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 10 END AS c, CASE WHEN l_linenumber % 2 = 0 THEN 0.5e0 END AS r FROM lineitem) SELECT l_orderkey, l_linenumber, round(least((0.4e0 * b + 0.2e0 * q + coalesce(0.2e0 * c, 0e0) + coalesce(0.2e0 * r, 0e0)) / (0.4e0 + 0.2e0 + CASE WHEN c IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN r IS NULL THEN 0e0 ELSE 0.2e0 END), 1e0), 6) AS confidence FROM f",
        "nms_greedy": f"WITH {DETECTIONS}, {NMS.replace('{where}', '')} SELECT run, k.id AS detection_id FROM kept",
        "score_top3": f"WITH {DETECTIONS}, {NMS.replace('{where}', 'WHERE confidence >= 0.5')}, {DIFFICULTY}, b AS (SELECT run, k.id AS detection_id, -k.c AS confidence, coalesce(difficulty, 0e0) AS difficulty FROM kept LEFT JOIN dif USING (trick_id)), t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY difficulty DESC, confidence DESC, detection_id) AS rank, round(difficulty * confidence, 3) AS weighted FROM b QUALIFY rank <= 3) SELECT run, rank, detection_id, weighted, round(sum(weighted) OVER (PARTITION BY run), 3) AS total FROM t",
        "repeat_rule": f"WITH {DETECTIONS} SELECT run, trick_id, detection_id FROM det QUALIFY row_number() OVER (PARTITION BY run, trick_id ORDER BY start_ms, detection_id) = 1",
        "competition_score": f"WITH {DETECTIONS}, {DIFFICULTY}, sure AS (SELECT * FROM det WHERE confidence >= 0.3), fst AS (SELECT * FROM sure QUALIFY row_number() OVER (PARTITION BY run, trick_id ORDER BY start_ms, detection_id) = 1), v AS (SELECT f.run, detection_id, round(greatest(coalesce(difficulty, 0e0) - CASE WHEN detection_id % 4 = 0 THEN 0.5e0 ELSE 0e0 END, 0e0), 1) AS value FROM fst f LEFT JOIN dif USING (trick_id)), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, detection_id) AS rank FROM v), s AS (SELECT run, round(sum(CASE WHEN rank <= 3 THEN value ELSE 0e0 END), 1) AS final, count(*) FILTER (WHERE rank <= 3) AS counted, count(*) AS d FROM r GROUP BY run) SELECT s.run, final, counted, n - d AS repeats FROM s JOIN (SELECT run, count(*) AS n FROM sure GROUP BY run) USING (run)",
        "parse_names": f"WITH {_parsed()} SELECT * FROM par",
        "difficulty_estimate": f"WITH {_parsed()} SELECT id, CASE WHEN id % 4 = 0 THEN CAST(id % 9 + 1 AS DOUBLE) ELSE CAST(round(CAST(CAST(greatest(1e0, least(10e0, 1 + (rotation - 0.5) * 2 + twist * 1.5 + {_bonus('axis', catalog.AXIS_BONUS)} + {_bonus('entry', catalog.ENTRY_BONUS)} + {_bonus('shape', catalog.SHAPE_BONUS)} + {_bonus('family', catalog.FAMILY_BONUS)})) AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DOUBLE) END AS difficulty FROM par",
        "name_slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (B-' || p_size || ')'), '[()]', '', 'g'), '[ -]', '_', 'g') AS slug FROM part",
        "name_variants": "WITH w AS (SELECT p_partkey, list_filter(string_split(replace(lower(regexp_replace(p_name, '[^A-Za-z0-9 -]', '', 'g')), '-', ' '), ' '), lambda t: t <> '') AS w FROM part) SELECT p_partkey, array_to_string(w, ' ') AS variant FROM w UNION SELECT p_partkey, concat_ws(' ', nullif(array_to_string(w[1 : i - 1], ' '), ''), w[i] || w[i + 1], nullif(array_to_string(w[i + 2 :], ' '), '')) FROM w, unnest(range(1, len(w))) AS t(i)",
        "priority_merge": f"WITH {MERGED} SELECT * FROM mrg",
        "coverage_counts": f"WITH {MERGED} SELECT sources, count(*) AS n FROM mrg GROUP BY sources",
        "label_precedence": f"WITH {LABELS} SELECT item, label, source FROM lab",
        "class_counts_filter": f"WITH {LABELS} SELECT label, count(*) AS n FROM lab WHERE label <> 'not_a_flip' GROUP BY label HAVING count(*) >= 3",
        "anti_join_plan": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "work_status": "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'done' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'needs_extract' ELSE 'needs_download' END AS status FROM customer",
        "chunk_worklist": "SELECT c_custkey AS id, (row_number() OVER (ORDER BY c_custkey) - 1) // (count(*) OVER () // 7 + 1) AS worker FROM customer",
        "diverse_topn": f"WITH {CATALOG}, f AS (SELECT *, row_number() OVER (PARTITION BY flips, twists, axis, direction ORDER BY score DESC, trick_id) AS nth FROM cat) SELECT trick_id AS id, score FROM f WHERE nth = 1 OR score > 10 ORDER BY score DESC, id LIMIT 50",
        "per_class_limit": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part QUALIFY nth <= 5",
        "combo_overlap": f"WITH {CATALOG}, a AS (SELECT DISTINCT flips, twists, axis, direction, shape FROM cat WHERE context = 'ground'), b AS (SELECT DISTINCT flips, twists, axis, direction, shape FROM cat WHERE context = 'wall') SELECT 'both' AS part, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n UNION ALL SELECT 'only_ground', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL SELECT 'only_wall', (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a))",
        "prereq_violations": "SELECT a.p_partkey AS id, b.p_partkey AS prerequisite FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 3 WHERE b.p_size > a.p_size AND b.p_partkey > 0",
        "difficulty_fixpoint": "WITH RECURSIVE up AS (SELECT p_partkey AS id, p_size / 5e0 AS difficulty FROM part WHERE p_partkey // 3 = 0 OR p_partkey // 3 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT p.p_partkey, CASE WHEN p.p_size / 5e0 <= u.difficulty THEN least(round(u.difficulty + 0.5, 1), 10e0) ELSE p.p_size / 5e0 END FROM part p JOIN up u ON p.p_partkey // 3 = u.id WHERE p.p_partkey // 3 > 0) SELECT id, round(difficulty, 1) AS difficulty FROM up",
        "confusion_matrix": "WITH c AS (SELECT CAST(quality AS BIGINT) AS truth, CAST(toxic AS BIGINT) AS guess, count(*) AS n FROM labels GROUP BY ALL) SELECT truth, guess, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share, round(sum(CASE WHEN truth = guess THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS accuracy FROM c",
        "run_lookup_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "override_text": "SELECT o_orderkey, 'Judge override: order ' || o_orderkey || ' set from ' || o_orderstatus || ' to ' || o_orderpriority AS message FROM orders WHERE o_orderstatus = 'F'",
        "submissions_by_status": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth, o_orderkey FROM orders WHERE o_orderstatus = 'P'",
        "html_fields": """SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(coalesce(html, ''), '<a href="')) AS BIGINT) AS links FROM pages""",
        "conversation_log": "SELECT conv_id, string_agg(turn || ':' || coalesce(role, ''), ',' ORDER BY turn, role) AS log FROM conversations GROUP BY conv_id",
    }
