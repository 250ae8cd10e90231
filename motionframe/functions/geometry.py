"""Geometry over keypoints and rotations, as SQL expression texts for ``F.expr``.

Missing values are NULL throughout: a NULL operand gives NULL, never an angle of 0.
"""

from __future__ import annotations

#: The 17 keypoints in their order.
KEYPOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
INDEX = {name: i for i, name in enumerate(KEYPOINTS)}
#: Vertex joint of each three-point angle with its two ends.
ANGLES = {
    "left_knee": ("left_hip", "left_knee", "left_ankle"),
    "right_knee": ("right_hip", "right_knee", "right_ankle"),
    "left_hip": ("left_shoulder", "left_hip", "left_knee"),
    "right_hip": ("right_shoulder", "right_hip", "right_knee"),
    "left_elbow": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow": ("right_shoulder", "right_elbow", "right_wrist"),
    "left_shoulder": ("left_elbow", "left_shoulder", "left_hip"),
    "right_shoulder": ("right_elbow", "right_shoulder", "right_hip"),
}
#: Angles between midpoints.
MIDPOINT_ANGLES = {
    "spine": (("left_shoulder", "right_shoulder"), ("left_hip", "right_hip"), ("left_knee", "right_knee")),
    "neck": (("nose",), ("left_shoulder", "right_shoulder"), ("left_hip", "right_hip")),
}
#: Ends of the limbs whose lengths are compared with the torso.
LIMBS = {
    "left_upper_arm": ("left_shoulder", "left_elbow"),
    "right_upper_arm": ("right_shoulder", "right_elbow"),
    "left_forearm": ("left_elbow", "left_wrist"),
    "right_forearm": ("right_elbow", "right_wrist"),
    "left_thigh": ("left_hip", "left_knee"),
    "right_thigh": ("right_hip", "right_knee"),
    "left_shin": ("left_knee", "left_ankle"),
    "right_shin": ("right_knee", "right_ankle"),
}
PAIRED = ("knee", "hip", "elbow", "shoulder")
MIN_CONFIDENCE = 0.3
DEGREES = "57.29577951308232e0"


def clip(x: str, low: str, high: str) -> str:
    """NULL stays NULL, unlike with ``greatest`` and ``least``."""
    return f"CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


def cosine(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Cosine of the angle at b, which rounding may take beyond 1."""
    dot = f"(({ax} - {bx}) * ({cx} - {bx}) + ({ay} - {by}) * ({cy} - {by}))"
    norms = f"(sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by})) * sqrt(({cx} - {bx}) * ({cx} - {bx}) + ({cy} - {by}) * ({cy} - {by})) + 1e-8)"
    return f"({dot} / {norms})"


def of_cosine(x: str) -> str:
    return f"degrees(acos({clip(x, '-1e0', '1e0')}))"


def angle(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Angle at b in degrees."""
    return of_cosine(cosine(ax, ay, bx, by, cx, cy))


def midpoint(joints: tuple[str, ...], axis: str) -> str:
    return "((" + " + ".join(f"{axis}{INDEX[j]}" for j in joints) + f") / {len(joints)}e0)"


def seen(joints: tuple[str, ...], least: float = MIN_CONFIDENCE) -> str:
    """Whether every joint's confidence reaches ``least``; an unknown confidence does not."""
    return "(" + " AND ".join(f"coalesce(c{INDEX[j]}, -1e0) >= {least}" for j in joints) + ")"


def _corners() -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each angle the joints that it needs and its six coordinates."""
    out = {name: (ends, tuple(f"{a}{INDEX[j]}" for j in ends for a in "xy")) for name, ends in ANGLES.items()}
    return out | {name: (tuple(j for part in parts for j in part), tuple(midpoint(p, a) for p in parts for a in "xy")) for name, parts in MIDPOINT_ANGLES.items()}


def joint_cosines() -> dict[str, str]:
    """The cosines of the 10 angles that are not means of two; NULL where a joint is not seen."""
    return {name: f"CASE WHEN {seen(needed)} THEN {cosine(*at)} END" for name, (needed, at) in _corners().items()}


def mean_of_sides(left: str, right: str) -> str:
    return f"coalesce(({left} + {right}) / 2e0, {left}, {right})"


def joint_angles() -> dict[str, str]:
    """The 14 angles over columns x0.., y0.., c0..; NULL where a joint is not seen."""
    out = {name: f"CASE WHEN {seen(needed)} THEN {angle(*at)} END" for name, (needed, at) in _corners().items()}
    return out | {joint: mean_of_sides(f"({out[f'left_{joint}']})", f"({out[f'right_{joint}']})") for joint in PAIRED}


def torso_length() -> str:
    shoulders, hips = ("left_shoulder", "right_shoulder"), ("left_hip", "right_hip")
    dx, dy = (f"({midpoint(shoulders, a)} - {midpoint(hips, a)})" for a in "xy")
    length = f"sqrt({dx} * {dx} + {dy} * {dy})"
    return f"CASE WHEN {seen(shoulders + hips)} AND {length} > 1e-6 THEN {length} END"


def centre_of_mass(axis: str) -> str:
    """Middle of the hips if both are seen, else the mean of the seen keypoints, else of all."""
    count = " + ".join(f"CASE WHEN coalesce(c{i}, -1e0) >= {MIN_CONFIDENCE} THEN 1e0 ELSE 0e0 END" for i in range(17))
    total = " + ".join(f"CASE WHEN coalesce(c{i}, -1e0) >= {MIN_CONFIDENCE} THEN {axis}{i} ELSE 0e0 END" for i in range(17))
    every = " + ".join(f"{axis}{i}" for i in range(17))
    return f"CASE WHEN {seen(('left_hip', 'right_hip'))} THEN {midpoint(('left_hip', 'right_hip'), axis)} WHEN ({count}) > 0e0 THEN ({total}) / ({count}) ELSE ({every}) / 17e0 END"


def body_tilt() -> str:
    """Degrees of the hips-to-shoulders line from upright."""
    shoulders, hips = ("left_shoulder", "right_shoulder"), ("left_hip", "right_hip")
    dx, dy = (f"({midpoint(shoulders, a)} - {midpoint(hips, a)})" for a in "xy")
    return f"CASE WHEN {seen(shoulders + hips)} THEN degrees(atan2({dx}, -({dy}))) END"


def limb_ratio(limb: str) -> str:
    a, b = (INDEX[j] for j in LIMBS[limb])
    return f"CASE WHEN {seen(LIMBS[limb])} THEN sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b})) / ({torso_length()}) END"


def wrap(degrees: str) -> str:
    """An angle difference brought into [-180, 180)."""
    return f"({degrees} - 360e0 * floor(({degrees} + 180e0) / 360e0))"


def snap_to_half(x: str, tolerance: float = 0.2) -> str:
    nearest = f"(round({x} * 2e0) / 2e0)"
    return f"CASE WHEN abs({x} - {nearest}) <= {tolerance}e0 THEN {nearest} ELSE {x} END"
