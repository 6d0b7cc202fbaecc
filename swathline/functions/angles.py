"""Angles: normalisation, bearings, yaw and quaternions. Radians unless a name says degrees."""

from __future__ import annotations


def clamp(v: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {v}))"


def normalize(a: str) -> str:
    """The same angle in (-pi, pi]."""
    return f"atan2(sin({a}), cos({a}))"


def wrap(a: str, half: str) -> str:
    """Adds or takes away full turns of 2 * ``half`` until the angle is in [-half, half]; both ends stay as they are."""
    turn = f"(2e0 * {half})"
    return f"(CASE WHEN {a} > {half} THEN {a} - {turn} * ceil(({a} - {half}) / {turn}) WHEN {a} < -({half}) THEN {a} + {turn} * ceil((-({half}) - {a}) / {turn}) ELSE {a} END)"


def wrap_degrees(a: str) -> str:
    return wrap(a, "180e0")


def wrap_radians(a: str) -> str:
    return wrap(a, "pi()")


def error(yaw: str, target: str) -> str:
    return normalize(f"(({target}) - ({yaw}))")


def hypot(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def distance(x1: str, y1: str, x2: str, y2: str) -> str:
    return hypot(f"({x2}) - ({x1})", f"({y2}) - ({y1})")


def bearing(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"atan2(({y2}) - ({y1}), ({x2}) - ({x1}))"


def unit_vector(x: str, y: str, eps: str = "1e-12") -> tuple[str, str]:
    """The vector at length one; (0, 0) if it is shorter than ``eps``."""
    n = hypot(x, y)
    return f"(CASE WHEN {n} < {eps} THEN 0e0 ELSE ({x}) / {n} END)", f"(CASE WHEN {n} < {eps} THEN 0e0 ELSE ({y}) / {n} END)"


def yaw_of_quaternion(x: str, y: str, z: str, w: str) -> str:
    return f"atan2(2e0 * (({w}) * ({z}) + ({x}) * ({y})), 1e0 - 2e0 * (({y}) * ({y}) + ({z}) * ({z})))"


def quaternion_of_yaw(yaw: str) -> tuple[str, str, str, str]:
    return "0e0", "0e0", f"sin(({yaw}) / 2e0)", f"cos(({yaw}) / 2e0)"


def sticky(a: str, margin: str) -> str:
    """Degrees, moved to the nearest multiple of 90 if it is within ``margin``."""
    near = f"(90e0 * floor(({a}) / 90e0 + 0.5e0))"
    return f"(CASE WHEN abs(({a}) - {near}) <= {margin} THEN {near} ELSE ({a}) END)"
