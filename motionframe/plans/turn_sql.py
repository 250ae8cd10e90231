"""DuckDB SQL that gives the rows of the queries of turns, jumps and crops."""

from __future__ import annotations

from motionframe import further_queries
from motionframe.plans import further_sql
from motionframe.plans.further_sql import _CROSS, _description, _rules_sql
from motionframe.plans.sql import POSE, SIGNAL, TRACK, merged

# lengths at ten frames a second: joining gap 6, least length 3, padding 3, pause 1, distance of cuts 5, most 35
_W = "(PARTITION BY run ORDER BY idx)"


def _valleys(name: str, flag: str) -> str:
    """Middles of the stretches with ``flag`` inside the segments ``lng``, as the list ``name``."""
    return f"""{name}_i AS (SELECT *, idx - row_number() OVER (PARTITION BY run, start_idx ORDER BY idx) AS place FROM inl WHERE {flag}),
{name}_s AS (SELECT run, start_idx, end_idx, min(idx) AS a, CASE WHEN max(idx) < end_idx THEN max(idx) + 1 ELSE max(idx) END AS b FROM {name}_i GROUP BY run, start_idx, end_idx, place),
{name} AS (SELECT run, start_idx, list(start_idx + (a - start_idx + b - start_idx) // 2 ORDER BY a) AS pts FROM {name}_s WHERE b - a >= 1 GROUP BY run, start_idx)"""


HYSTERESIS = f"""{TRACK},
smo AS (SELECT run, idx, tilt, tilt_cumulative, twist_cumulative, sum(rate) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3e0 AS s FROM trk),
lev AS (SELECT run, greatest(avg(s) + stddev_pop(s), 8e0) AS high, greatest(avg(s) * 0.5e0, 3e0) AS low, max(idx) AS last FROM smo GROUP BY run),
str AS (SELECT run, min(idx) AS start_idx, max(idx) AS end_idx FROM (SELECT s.run, idx, idx - row_number() OVER (PARTITION BY s.run ORDER BY idx) AS place FROM smo s JOIN lev USING (run) WHERE s > high) GROUP BY run, place),
wea AS (SELECT run, min(idx) AS a, max(idx) AS b FROM (SELECT s.run, idx, idx - row_number() OVER (PARTITION BY s.run ORDER BY idx) AS place FROM smo s JOIN lev USING (run) WHERE s > low) GROUP BY run, place),
{merged("str", "start_idx", "end_idx", 6, "reg")},
gro AS (SELECT r.run, greatest(0, x.a - 3) AS start_idx, least(last, y.b + 3) AS end_idx FROM reg r JOIN lev USING (run) JOIN wea x ON x.run = r.run AND start_idx BETWEEN x.a AND x.b JOIN wea y ON y.run = r.run AND end_idx BETWEEN y.a AND y.b),
gro2 AS (SELECT * FROM gro WHERE end_idx - start_idx >= 3),
{merged("gro2", "start_idx", "end_idx", 6, "sgm")},
lng AS (SELECT * FROM sgm WHERE end_idx - start_idx >= 15),
inl AS (SELECT l.run, start_idx, end_idx, idx, tilt, s, avg(s) OVER (PARTITION BY l.run, start_idx) AS mean FROM lng l JOIN smo m ON m.run = l.run AND idx BETWEEN start_idx AND end_idx),
{_valleys("upr", "tilt < CASE WHEN end_idx - start_idx > 30 THEN 35 ELSE 20 END")},
{_valleys("slo", "end_idx - start_idx > 30 AND s < greatest(mean * 0.3e0, 2e0)")},
cut AS (SELECT l.run, l.start_idx, l.end_idx, list_sort(list_concat([l.start_idx, l.end_idx], list_reduce(list_concat([coalesce(u.pts, [])], list_transform(coalesce(v.pts, []), lambda x: [x])),
  lambda acc, y: CASE WHEN len(list_filter(acc, lambda q: abs(q - y[1]) <= 5)) = 0 THEN list_concat(acc, y) ELSE acc END))) AS p FROM lng l LEFT JOIN upr u ON u.run = l.run AND u.start_idx = l.start_idx LEFT JOIN slo v ON v.run = l.run AND v.start_idx = l.start_idx),
pie AS (SELECT run, p[i] AS start_idx, p[i + 1] AS end_idx FROM cut, unnest(range(1, len(p))) AS t(i) WHERE p[i + 1] - p[i] >= 3 UNION ALL SELECT run, start_idx, end_idx FROM sgm WHERE end_idx - start_idx < 15),
ovr AS (SELECT run, start_idx, end_idx, k, k * ((end_idx - start_idx) // (CAST(floor((end_idx - start_idx) / 35) AS BIGINT) + 1)) AS c FROM pie, unnest(range(1, CAST(floor((end_idx - start_idx) / 35) AS BIGINT) + 1)) AS t(k) WHERE end_idx - start_idx > 35),
slw AS (SELECT o.run, start_idx, end_idx, k, arg_min(idx, s) AS pt FROM ovr o JOIN smo m ON m.run = o.run AND idx BETWEEN start_idx + greatest(0, c - 5) AND start_idx + least(end_idx - start_idx + 1, c + 5) - 1 GROUP BY ALL),
for_ AS (SELECT run, start_idx, list_sort(list_concat([start_idx, end_idx], list(pt))) AS p FROM slw GROUP BY run, start_idx, end_idx),
fin AS (SELECT * FROM pie WHERE end_idx - start_idx <= 35 UNION ALL SELECT run, p[i], p[i + 1] FROM for_, unnest(range(1, len(p))) AS t(i) WHERE p[i + 1] - p[i] >= 3),
mea AS (SELECT f.run, start_idx, end_idx, abs(max_by(tilt_cumulative, idx) - min_by(tilt_cumulative, idx)) AS turned, abs(max_by(twist_cumulative, idx) - min_by(twist_cumulative, idx)) AS twisted, max(s) AS peak, max(tilt) AS most FROM fin f JOIN smo m ON m.run = f.run AND idx BETWEEN start_idx AND end_idx GROUP BY ALL),
hys AS (SELECT run, start_idx, end_idx FROM mea WHERE turned + twisted * 0.7e0 >= 120 AND peak >= 8 AND NOT ((end_idx - start_idx) / 10e0 < 0.5 AND turned < 200) AND NOT ((end_idx - start_idx) / 10e0 < 0.8 AND most < 60 AND turned < 180))"""

SMOOTHED = f"""{TRACK},
wid AS (SELECT run, CASE WHEN median(j) > 0.15 THEN 3e0 WHEN median(j) > 0.08 THEN 2e0 ELSE 1.5e0 END AS sigma FROM (SELECT run, sqrt((ox - lag(ox) OVER w) * (ox - lag(ox) OVER w) + (oy - lag(oy) OVER w) * (oy - lag(oy) OVER w) + (oz - lag(oz) OVER w) * (oz - lag(oz) OVER w)) AS j FROM rot WINDOW w AS {_W}) GROUP BY run),
sgn AS (SELECT *, sum(CASE WHEN dw < 0 THEN 1 ELSE 0 END) OVER {_W} AS odd, max(idx) OVER (PARTITION BY run) + 1 AS n FROM del),
tap AS (SELECT s.run, s.idx, d, sigma, n, ((s.idx + d) % (2 * n) + 2 * n) % (2 * n) AS j FROM sgn s JOIN wid USING (run), unnest(range(-12, 13)) AS t(d) WHERE abs(d) <= floor(4 * sigma + 0.5)),
wei AS (SELECT t.run, t.idx, exp(-0.5e0 * d * d / (sigma * sigma)) * CASE WHEN q.odd % 2 = 1 THEN -1 ELSE 1 END AS w, q.qw, q.qx, q.qy, q.qz FROM tap t JOIN sgn q ON q.run = t.run AND q.idx = CASE WHEN j >= t.n THEN 2 * t.n - 1 - j ELSE j END),
tot AS (SELECT run, idx, sum(w * qw) AS w, sum(w * qx) AS x, sum(w * qy) AS y, sum(w * qz) AS z FROM wei GROUP BY run, idx),
ang AS (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM tot)"""

_TURN = f"""del2 AS (SELECT *, dx * bx + dy * by_ + dz * bz AS p FROM del), nor AS (SELECT *, dw / sqrt(p * p + dw * dw) AS cw, p / sqrt(p * p + dw * dw) AS cp, sqrt(dx * dx + dy * dy + dz * dz) AS whole FROM del2),
swi AS (SELECT *, dw * cw + cp * p AS sw, cw * dx - dw * cp * bx - cp * (dy * bz - dz * by_) AS sx, cw * dy - dw * cp * by_ - cp * (dz * bx - dx * bz) AS sy, cw * dz - dw * cp * bz - cp * (dx * by_ - dy * bx) AS sz FROM nor),
sid AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS side, sx / sqrt(sx * sx + sy * sy + sz * sz) * CASE WHEN sw < 0 THEN -1 ELSE 1 END AS lat FROM swi),
tur AS (SELECT run, idx, coalesce(degrees(2e0 * atan2(side, abs(sw))) * CASE WHEN abs(lat) > 0.3 THEN sign(lat) ELSE 1 END, 0e0) AS flip, coalesce(degrees(2e0 * atan2(abs(cp), abs(cw))) * sign(p), 0e0) AS twist,
  {', '.join(f"coalesce(CASE WHEN dw < 0 THEN -1e0 ELSE 1e0 END * d{a} / whole, 0e0) AS a{a}" for a in 'xyz')} FROM sid)"""

BODY = f"""{_TURN},
ank AS (SELECT run, idx, CASE WHEN idx % 4 <> 3 THEN CAST(e[5] AS DOUBLE) - 1 + CAST(e[61] AS DOUBLE) END AS l, CASE WHEN idx % 4 <> 3 THEN CAST(e[5] AS DOUBLE) - 1 + CAST(e[62] AS DOUBLE) END AS r FROM emb),
gnd AS (SELECT run, min(coalesce(least(l, CASE WHEN l IS NOT NULL THEN r END), ty)) AS g FROM rot JOIN ank USING (run, idx) WHERE idx < 10 GROUP BY run),
bod AS (SELECT run, idx, t_ms, sum(flip) OVER w AS flip, sum(twist) OVER w AS twist, ax, ay, az, (j3 + j4) / 2e0 AS knee, (j0 + j1) / 2e0 AS hip, (j2 + j5 + j8) / 3e0 AS spine, (j15 + j16) / 2e0 AS shoulder, (j17 + j18) / 2e0 AS elbow,
  {', '.join(f"coalesce((t{a} - lag(t{a}) OVER w) * 10e0, 0e0) AS v{a}" for a in 'xyz')}, ty - g AS height, CASE WHEN l IS NULL THEN ty - g > 0.3 ELSE least(l, r) - g > 0.15 END AS airborne
  FROM rot JOIN ank USING (run, idx) JOIN gnd USING (run) JOIN tur USING (run, idx) WINDOW w AS {_W}),
spd AS (SELECT *, {', '.join(f"lag(v{a}, 2) OVER {_W} AS e{a}" for a in 'xyz')} FROM bod),
ins AS (SELECT h.start_idx, h.end_idx, s.* FROM hys h JOIN spd s ON s.run = h.run AND s.idx BETWEEN h.start_idx AND h.end_idx),
tak AS (SELECT * FROM ins WHERE airborne AND idx < start_idx + 10 QUALIFY row_number() OVER (PARTITION BY run, start_idx, end_idx ORDER BY idx) = 1),
ent AS (SELECT h.run, h.start_idx, h.end_idx, CASE WHEN t.idx IS NULL OR t.idx = h.start_idx THEN 'standing' WHEN sqrt(vx * vx + vz * vz) > 1.5 THEN 'running'
  WHEN t.idx >= h.start_idx + 2 AND sqrt(ex * ex + ez * ez) > 0.5 AND sqrt(vx * vx + vz * vz) > 0.3 AND vx * ex + vy * ey + vz * ez < 0 THEN 'wall' ELSE 'standing' END AS entry FROM hys h LEFT JOIN tak t ON t.run = h.run AND t.start_idx = h.start_idx AND t.end_idx = h.end_idx)"""

_SHAPE = """CASE WHEN knee > 70 AND hip > 50 THEN least((knee - 70) / 50 * (hip - 50) / 50, 1e0) WHEN knee > 55 AND hip > 40 THEN 0.3e0 ELSE 0e0 END AS tuck, CASE WHEN knee < 50 AND hip > 50 THEN least((50 - knee) / 50 * (hip - 50) / 50, 1e0) ELSE 0e0 END AS pike,
CASE WHEN knee < 50 AND hip < 40 THEN least((50 - knee) / 50 * (40 - hip) / 40, 1e0) ELSE 0e0 END AS base, CASE WHEN shoulder > 40 THEN least((shoulder - 40) / 60, 1e0) ELSE 0e0 END AS arms"""


def _physics() -> str:
    """Axis, direction, shape and entry are the SQL of their own queries, over these segments instead of stretches."""
    own = further_sql.oracle_sql(further_queries.RULES)
    stretches = "seg AS (SELECT run, idx // 20 * 20 AS start_idx, max(idx) AS end_idx FROM rot GROUP BY run, idx // 20 * 20)"
    parts = ", ".join(f"p_{k} AS ({own[f'segment_{k}'].replace(stretches, 'seg AS (SELECT run, start_idx, end_idx FROM hys)')})" for k in ("axis", "direction", "shape", "entry"))
    snap = lambda x: f"round(CASE WHEN abs({x} - round({x} * 2) / 2) <= 0.2 THEN round({x} * 2) / 2 ELSE {x} END, 1)"
    on = "USING (run, start_idx, end_idx)"
    return f"""WITH {HYSTERESIS}, {parts},
swp AS (SELECT run, idx, tilt, rate, tilt_cumulative, twist_cumulative, coalesce(CASE WHEN abs(d) > 1e-10 THEN 2e0 * atan2(bz * ux - bx * uz, d) ELSE 0e0 END, 0e0) AS s FROM (SELECT *, 1e0 + by_ + uy + bx * ux + by_ * uy + bz * uz AS d FROM trk)),
ins AS (SELECT h.start_idx, h.end_idx, s.*, median(rate) OVER (PARTITION BY s.run, h.start_idx, h.end_idx) AS mid FROM hys h JOIN swp s ON s.run = h.run AND s.idx BETWEEN h.start_idx AND h.end_idx),
agg AS (SELECT run, start_idx, end_idx, max_by(tilt_cumulative, idx) - min_by(tilt_cumulative, idx) AS fd, abs(max_by(twist_cumulative, idx) - min_by(twist_cumulative, idx)) AS tr, abs(degrees(sum(CASE WHEN idx > start_idx THEN s ELSE 0e0 END))) AS ph, max(tilt) AS mt,
  coalesce(median(tilt) FILTER (WHERE rate > greatest(mid, 5e0)), median(tilt)) AS med, coalesce(avg(tilt) FILTER (WHERE rate > greatest(mid, 5e0)), avg(tilt)) AS avg_ FROM ins GROUP BY ALL),
cnt AS (SELECT *, greatest(0e0, tr - ph) AS td, fd / 360 AS f, greatest(0e0, tr - ph) / 360 AS t FROM agg),
knd AS (SELECT *, f < 0.2 AND t > 0.5 AS spin, mt > 120 AND t < 0.3 AS plain, mt > 120 AND t > 0.3 AND med > 30 AND med < 80 AND mt < 155 AS cork FROM cnt)
SELECT run, start_idx, end_idx, {snap('f')} AS flips, {snap('t')} AS twists, round(f, 2) AS flips_raw, round(t, 2) AS twists_raw, round(fd, 1) AS flip_deg, round(td, 1) AS twist_deg, round(tr, 1) AS twist_deg_raw, round(ph, 1) AS phase_deg, round(mt, 1) AS max_tilt,
  CASE WHEN spin THEN 'longitudinal' WHEN plain THEN axis WHEN cork THEN 'off_axis' ELSE 'lateral' END AS axis, CASE WHEN spin THEN 0e0 WHEN NOT plain AND cork THEN round(avg_, 1) ELSE 90e0 END AS axis_angle, direction, shape, entry, mt > 120 AS inverted
FROM knd JOIN p_axis {on} JOIN p_direction {on} JOIN p_shape {on} JOIN p_entry {on}"""


def _planar(rest: str) -> str:
    trunk = lambda a: f"({a}5 + {a}6 + {a}11 + {a}12) / 4e0"
    vector = lambda a, b: f"[x{a} - x{b}, y{a} - y{b}]"
    norm = lambda v: f"sqrt(list_dot_product({v}, {v}))"
    bend = lambda a, b, c: f"degrees(acos(greatest(-1e0, least(1e0, list_dot_product({vector(a, b)}, {vector(c, b)}) / ({norm(vector(a, b))} * {norm(vector(c, b))} + 1e-8)))))"
    return f"""WITH {POSE}, sho AS (SELECT run, idx, {trunk('x')} AS trunk_x, {trunk('y')} AS trunk_y, atan2(y0 - {trunk('y')}, x0 - {trunk('x')}) AS body_angle, abs(y5 - y6) AS lean, x5 - x6 AS across,
  ({bend(11, 13, 15)} + {bend(12, 14, 16)}) / 2 AS knee, ({bend(5, 11, 13)} + {bend(6, 12, 14)}) / 2 AS hip FROM pose),
stp AS (SELECT *, body_angle - lag(body_angle) OVER w AS step, across - lag(across) OVER w AS shift FROM sho WINDOW w AS {_W}),
phy AS (SELECT *, coalesce(CASE WHEN step > pi() THEN step - 2 * pi() WHEN step < -pi() THEN step + 2 * pi() ELSE step END, 0e0) AS turn, sign(shift) AS way FROM stp),
smo AS (SELECT run, idx, sum(abs(turn)) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3e0 AS s FROM phy), lev AS (SELECT run, avg(s) + stddev_pop(s) AS level, max(idx) AS last FROM smo GROUP BY run),
isl AS (SELECT run, min(idx) AS start_idx, max(idx) AS end_idx FROM (SELECT s.run, idx, idx - row_number() OVER (PARTITION BY s.run ORDER BY idx) AS place FROM smo s JOIN lev USING (run) WHERE s > level) GROUP BY run, place),
{merged("isl", "start_idx", "end_idx", 3, "joi")}, air AS (SELECT j.run, greatest(0, start_idx - 2) AS start_idx, least(last, end_idx + 3) AS end_idx FROM joi j JOIN lev USING (run)),
seg AS (SELECT * FROM air WHERE (end_idx - start_idx) / 10e0 > 0.25 AND (end_idx - start_idx) / 10e0 < 5),
ins AS (SELECT g.start_idx, g.end_idx, p.*, quantile_cont(abs(turn), 0.7) OVER (PARTITION BY p.run, g.start_idx, g.end_idx) AS level, lag(way) OVER (PARTITION BY p.run, g.start_idx, g.end_idx ORDER BY idx) AS before FROM seg g JOIN phy p ON p.run = g.run AND p.idx BETWEEN g.start_idx AND g.end_idx),
agg AS (SELECT run, start_idx, end_idx, sum(turn) AS turned, {', '.join(f"coalesce(avg({c}) FILTER (WHERE abs(turn) > level), avg({c})) AS {c}" for c in ('knee', 'hip', 'lean'))}, coalesce(avg(abs(shift)) FILTER (WHERE idx > start_idx), 0e0) AS twist_intensity, count(*) FILTER (WHERE idx >= start_idx + 2 AND way <> before) AS bends FROM ins GROUP BY ALL) {rest}"""


def _analysis(rest: str) -> str:
    seen = " + ".join(f"c{i}" for i in range(17))
    worth = " ".join(f"WHEN '{t}' THEN {v}e0" for t, v in (("squat", 3.5), ("reach", 2.0), ("still", 1.25)))
    return f"""WITH {_rules_sql(further_queries.RULES)}, mea AS (SELECT run, idx, ({seen}) / 17e0 AS mean FROM pose),
qua AS (SELECT m.run, m.trick_id, coalesce(avg(mean), 0e0) AS q FROM mat m LEFT JOIN mea ON mea.run = m.run AND mea.idx BETWEEN start_idx AND end_idx GROUP BY ALL),
ref AS (SELECT m.run, m.trick_id, round(least((0.4e0 * confidence + 0.2e0 * q) / (0.4e0 + 0.2e0), 1e0), 6) AS confidence, a.t_ms AS start_ms, b.t_ms AS end_ms FROM mat m JOIN qua USING (run, trick_id) JOIN ang a ON a.run = m.run AND a.idx = m.start_idx JOIN ang b ON b.run = m.run AND b.idx = m.end_idx),
det AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY start_ms, end_ms, trick_id) AS detection_id, trick_id, confidence, start_ms, end_ms FROM ref WHERE confidence >= 0.3),
bes AS (SELECT *, CASE trick_id {worth} END AS difficulty FROM det WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY run ORDER BY difficulty DESC, confidence DESC, detection_id) <= 2),
scr AS (SELECT run, round(sum(round(difficulty * confidence, 3)), 3) AS total, round(sum(difficulty), 3) AS max_possible FROM bes GROUP BY run) {rest}"""


def oracle_sql() -> dict[str, str]:
    turned = "ax * ax + ay * ay + az * az > 0.01"
    axis = lambda a: f"CASE WHEN bool_or(airborne) THEN avg(a{a}) FILTER (WHERE airborne AND {turned}) ELSE avg(a{a}) FILTER (WHERE {turned}) END AS m{a}"
    air = lambda c: f"coalesce(avg({c}) FILTER (WHERE airborne), avg({c})) AS {c}"
    trunk = lambda a: f"({a}5 + {a}6 + {a}11 + {a}12) / 4e0"
    around = "OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3e0"
    intensity = f"""{POSE}, pla AS (SELECT run, idx, {trunk('y')} AS y, atan2(y0 - {trunk('y')}, x0 - {trunk('x')}) AS a FROM pose),
mvd AS (SELECT run, idx, coalesce(least(abs(a - lag(a) OVER w), 2 * pi() - abs(a - lag(a) OVER w)), 0e0) AS turn, coalesce(abs(y - lag(y) OVER w), 0e0) AS rise FROM pla WINDOW w AS {_W}),
raw AS (SELECT run, idx, sum(turn) {around} * 0.6e0 + sum(rise) {around} * 0.4e0 AS r FROM mvd), int AS (SELECT run, idx, r / (max(r) OVER (PARTITION BY run) + 1e-8) AS intensity FROM raw)"""
    point = lambda c: f"CASE WHEN x0 IS NOT NULL THEN {{'i': idx, 'v': {c}}} END"
    sides = ", ".join(f"last_value({point(c)} IGNORE NULLS) OVER b AS l{c}, first_value({point(c)} IGNORE NULLS) OVER f AS r{c}" for c in ("x0", "y0", "x1", "y1"))
    line = lambda c: f"CASE WHEN l{c} IS NULL THEN r{c}.v WHEN r{c} IS NULL OR l{c}.i = r{c}.i THEN l{c}.v ELSE l{c}.v + (idx - l{c}.i) / CAST(r{c}.i - l{c}.i AS DOUBLE) * (r{c}.v - l{c}.v) END AS {c}"
    wide = "OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15e0"
    square = lambda c, most: (f"CASE WHEN {c} - h < 0 THEN greatest(0e0, CASE WHEN 2 * h > {most} THEN {most} - 2 * h ELSE 0e0 END) WHEN {c} + h > {most} THEN greatest(0e0, {most} - 2 * h) ELSE {c} - h END", f"least({most}, CASE WHEN {c} - h < 0 THEN 2 * h ELSE {c} + h END)")
    (x0, x1), (y0, y1) = square("cx", "1280e0"), square("cy", "720e0")
    part = lambda c, whole, to: f"round(CASE WHEN n < 5 THEN {whole} ELSE {c} END, 3) AS {to}"
    return {
        "hysteresis_segments": f"WITH {HYSTERESIS} SELECT run, start_idx, end_idx FROM hys",
        "smoothed_orientations": f"WITH {SMOOTHED} SELECT run, idx, " + ", ".join(f"round({a} * CASE WHEN w < 0 THEN -1 ELSE 1 END * 2e0 * atan2(m, abs(w)) / m, 4) AS o{a}" for a in "xyz") + " FROM ang",
        "frame_turns": f"WITH {TRACK}, {_TURN} SELECT run, idx, round(flip, 3) + 0e0 AS flip, round(twist, 3) + 0e0 AS twist, round(ax, 3) + 0e0 AS ax, round(ay, 3) + 0e0 AS ay, round(az, 3) + 0e0 AS az FROM tur",
        "body_biomechanics": f"WITH {HYSTERESIS}, {BODY} SELECT run, idx, {', '.join(f'round({c}, 2) + 0e0 AS {c}' for c in ('flip', 'twist', 'knee', 'hip', 'spine', 'shoulder', 'elbow', 'vx', 'vy', 'vz', 'height'))}, airborne FROM bod",
        "takeoff_entries": f"WITH {HYSTERESIS}, {BODY} SELECT run, start_idx, end_idx, entry FROM ent",
        "turn_signatures": f"""WITH {HYSTERESIS}, {BODY}, agg AS (SELECT run, start_idx, end_idx, max_by(flip, idx) - min_by(flip, idx) AS flip_deg, max_by(twist, idx) - min_by(twist, idx) AS twist_deg, {axis('x')}, {axis('y')}, {axis('z')}, {air('knee')}, {air('hip')}, {air('shoulder')}, max(height) AS peak_height, (max_by(t_ms, idx) - min_by(t_ms, idx)) / 1000e0 AS seconds FROM ins GROUP BY ALL),
sha AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS m, {_SHAPE} FROM agg), sco AS (SELECT *, base * arms AS opn, base * (1 - base * arms) AS lay FROM sha)
SELECT run, start_idx, end_idx, round(mx / m, 2) + 0e0 AS ax, round(my / m, 2) + 0e0 AS ay, round(mz / m, 2) + 0e0 AS az, round(flip_deg, 2) + 0e0 AS flip_deg, round(twist_deg, 2) + 0e0 AS twist_deg, CASE WHEN flip_deg > 0 THEN 'backward' ELSE 'forward' END AS direction,
  CASE WHEN tuck + pike + lay + opn = 0 THEN 'layout' WHEN tuck = greatest(tuck, pike, lay, opn) THEN 'tuck' WHEN pike = greatest(pike, lay, opn) THEN 'pike' WHEN lay >= opn THEN 'layout' ELSE 'open' END AS shape,
  round(knee, 2) AS knee, round(hip, 2) AS hip, entry, round(peak_height, 2) AS peak_height, round(seconds, 2) AS seconds FROM sco JOIN ent USING (run, start_idx, end_idx)""",
        "body_intensity": f"WITH {intensity} SELECT run, idx, round(intensity, 4) AS intensity FROM int",
        "intensity_segments": f"""WITH {intensity}, thr AS (SELECT run, avg(intensity) + 0.5e0 * stddev_pop(intensity) AS level, max(idx) AS last FROM int GROUP BY run),
act AS (SELECT i.run, idx, idx - row_number() OVER (PARTITION BY i.run ORDER BY idx) AS place FROM int i JOIN thr USING (run) WHERE intensity > level), isl AS (SELECT run, min(idx) AS start_idx, max(idx) AS end_idx FROM act GROUP BY run, place),
{merged("isl", "start_idx", "end_idx", 5, "joi")}, pad AS (SELECT j.run, greatest(0, start_idx - 1) AS start_idx, CASE WHEN end_idx = last THEN last ELSE least(last, end_idx + 2) END AS end_idx FROM joi j JOIN thr USING (run)), kep AS (SELECT * FROM pad WHERE end_idx - start_idx BETWEEN 3 AND 40),
{merged("kep", "start_idx", "end_idx", 5, "mrg")} SELECT run, start_idx, CASE WHEN end_idx - start_idx > 40 THEN (start_idx + end_idx) // 2 ELSE end_idx END AS end_idx FROM mrg UNION ALL SELECT run, (start_idx + end_idx) // 2, end_idx FROM mrg WHERE end_idx - start_idx > 40""",
        "stable_crops": f"""WITH {SIGNAL}, box AS (SELECT run, idx, {', '.join(f'CASE WHEN idx % 3 <> 0 AND (idx >= 5 OR v >= 5) THEN {e} END AS {c}' for c, e in (('x0', 'v * 12e0'), ('y0', 'v * 7e0'), ('x1', 'v * 12e0 + 60 + idx % 7 * 40'), ('y1', 'v * 7e0 + 90 + idx % 5 * 50')))} FROM sig),
sid AS (SELECT run, idx, count(x0) OVER (PARTITION BY run) AS n, {sides} FROM box WINDOW b AS (PARTITION BY run ORDER BY idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY run ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fil AS (SELECT run, idx, n, {', '.join(line(c) for c in ('x0', 'y0', 'x1', 'y1'))} FROM sid),
smo AS (SELECT run, idx, n, sum((x0 + x1) / 2) {wide} AS cx, sum((y0 + y1) / 2) {wide} AS cy, sum(greatest(greatest(x1 - x0, y1 - y0) * 1.8e0, 400e0)) {wide} AS side FROM fil),
mid AS (SELECT run, median(side) AS m FROM smo GROUP BY run), hal AS (SELECT s.*, least(greatest(side, m * 0.8e0), m * 1.2e0) / 2 AS h FROM smo s JOIN mid USING (run))
SELECT run, idx, {part(x0, '0e0', 'x0')}, {part(y0, '0e0', 'y0')}, {part(x1, '1280e0', 'x1')}, {part(y1, '720e0', 'y1')} FROM hal""",
        "segment_physics": _physics(),
        "training_tensors": further_sql.oracle_sql(further_queries.RULES)["feature_cells"].replace("SELECT run, idx, cell, round(", ", nor AS (SELECT run, idx, cell, ").replace(", 4) AS value FROM cells", " AS value FROM cells)") + """,
ask AS (SELECT k.run, cell, s AS step, s * last / 63e0 AS pos FROM (SELECT DISTINCT run, cell FROM nor) k JOIN (SELECT run, max(idx) AS last FROM nor GROUP BY run) USING (run), unnest(range(64)) AS t(s)),
lef AS (SELECT a.*, n.idx AS li, n.value AS lv FROM ask a ASOF LEFT JOIN nor n ON n.run = a.run AND n.cell = a.cell AND a.pos >= n.idx), rig AS (SELECT a.*, n.idx AS ri, n.value AS rv FROM lef a ASOF LEFT JOIN nor n ON n.run = a.run AND n.cell = a.cell AND a.pos <= n.idx),
val AS (SELECT run, cell, step, CASE WHEN lv IS NULL THEN rv WHEN rv IS NULL OR ri = li THEN lv ELSE lv + (pos - li) / (ri - li) * (rv - lv) END AS v FROM rig),
ful AS (SELECT r.run, s, c, coalesce(v, 0e0) AS v FROM (SELECT DISTINCT run FROM nor) r CROSS JOIN unnest(range(64)) AS t(s) CROSS JOIN unnest(range(75)) AS u(c) LEFT JOIN val ON val.run = r.run AND val.step = s AND val.cell = c)
SELECT f.run, f.s * 75 + f.c AS place, round(f.v, 3) + 0e0 AS flat, round(g.v, 3) + 0e0 AS channels FROM ful f JOIN ful g ON g.run = f.run AND g.c * 64 + g.s = f.s * 75 + f.c""",
        "seeded_split": "SELECT c_custkey AS id, c_mktsegment, row_number() OVER (ORDER BY md5('42:' || c_custkey)) - 1 AS place, row_number() OVER (ORDER BY md5('42:' || c_custkey)) - 1 >= count(*) OVER () - CAST(floor(count(*) OVER () * 0.15e0) AS BIGINT) AS held_out FROM customer",
        "planar_frames": _planar("SELECT run, idx, " + ", ".join(f"round({c}, 4) + 0e0 AS {c}" for c in ("trunk_x", "trunk_y", "body_angle", "turn", "lean", "knee", "hip")) + " FROM phy"),
        "planar_segments": _planar("SELECT run, start_idx, end_idx FROM seg"),
        "planar_physics": _planar("""SELECT run, start_idx, end_idx, round((end_idx - start_idx) / 10e0, 3) AS seconds, round(degrees(abs(turned)), 3) AS degrees, round_even(degrees(abs(turned)) / 360, 1) AS flips, CASE WHEN turned > 0 THEN 'forward' ELSE 'backward' END AS direction,
  CASE WHEN knee < 90 AND hip < 90 THEN 'tuck' WHEN knee > 140 AND hip < 100 THEN 'pike' WHEN knee > 140 AND hip > 140 THEN 'layout' ELSE 'open' END AS shape, round(knee, 3) AS knee, round(hip, 3) AS hip, round(twist_intensity, 3) AS twist_intensity, round_even(bends / 4, 1) AS twists, lean > 0.05 AS sideways, round(lean, 3) AS lean FROM agg"""),
        "analysis_detections": _analysis("SELECT run, detection_id, trick_id, round(confidence, 4) AS confidence, round(start_ms, 4) AS start_ms, round(end_ms, 4) AS end_ms, (run, trick_id) IN (SELECT (run, trick_id) FROM bes) AS is_top3 FROM det"),
        "analysis_scores": _analysis("SELECT run, total, max_possible FROM scr"),
        "analysis_audit": _analysis("""SELECT run, row_number() OVER (PARTITION BY run ORDER BY ms NULLS LAST, detection_id) AS nth, kind, message FROM (
  SELECT run, 'detection' AS kind, start_ms AS ms, detection_id, format('{:02d}:{:02d} {} ({:.2f})', CAST(floor(start_ms / 1000) AS BIGINT) // 60, CAST(floor(start_ms / 1000) AS BIGINT) % 60, trick_id, round(confidence, 2)) AS message FROM det
  UNION ALL SELECT r.run, 'score', NULL, NULL, format('total {:.2f}', round(coalesce(total, 0e0), 2)) FROM (SELECT DISTINCT run FROM pose) r LEFT JOIN scr USING (run))"""),
        "turn_axis": f"WITH {HYSTERESIS}, {_description('x AS (SELECT 1)').removeprefix(TRACK + ',')}, ins AS (SELECT s.start_idx, s.end_idx, b.* FROM hys s JOIN basis b ON b.run = s.run AND b.idx BETWEEN s.start_idx AND s.end_idx), st AS (SELECT * FROM ins WHERE idx = start_idx), mi AS (SELECT * FROM ins QUALIFY row_number() OVER (PARTITION BY run, start_idx, end_idx ORDER BY abs(tilt - 45e0), idx) = 1), cr AS (SELECT st.*, {_CROSS.format(a='st', b='mi')} FROM st JOIN mi USING (run, start_idx, end_idx)) SELECT run, start_idx, end_idx, CASE WHEN sqrt(cx * cx + cy * cy + cz * cz) > 0.1 AND abs(cx * rx + cy * ry + cz * rz) <= abs(cx * fx + cy * fy + cz * fz) THEN 'sagittal' ELSE 'lateral' END AS axis FROM cr",
    }
