"""Motion control laws: high-level commands, turning and driving."""

from __future__ import annotations

from dataclasses import dataclass

from . import angles


@dataclass(frozen=True)
class Controller:
    """Settings of the follower; the retry margin is that of the deployed node."""

    heading_realign_rad: float = 0.35
    turn_kp: float = 2.2
    max_turn_cmd: float = 0.8
    turn_min_cmd: float = 0.12
    forward_gain: float = 0.45
    forward_min_cmd: float = 0.05
    max_forward_cmd: float = 0.35
    slowdown_distance_m: float = 1.2
    slowdown_forward_cmd: float = 0.25
    drive_heading_hold: bool = True
    drive_heading_kp: float = 2.0
    drive_heading_max_rps: float = 0.18
    forward_direction_sign: float = 1.0
    turn_direction_sign: float = 1.0
    yaw_tolerance_rad: float = 0.05
    overshoot_retry_margin_m: float = 1.0
    overshoot_min_travel_m: float = 1.5
    improve_m: float = 0.12
    realign_min_travel_m: float = 0.5
    settle_min_s: float = 0.25
    settle_timeout_s: float = 1.5
    settle_turn_rate: float = 0.08
    settle_speed: float = 0.05
    settle_by_speed: bool = False
    course_check_s: float = 5.0


def _f(v: float) -> str:
    """A number as a DOUBLE literal."""
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def command(distance: str, error: str, turn_threshold: str, move_threshold: str) -> dict[str, str]:
    """Turn if the heading is off, else move if the target is far, else stop."""
    e = angles.normalize(error)
    kind = f"CASE WHEN abs({e}) > {turn_threshold} THEN 'turn' WHEN ({distance}) > {move_threshold} THEN 'move' ELSE 'stop' END"
    return {
        "kind": kind,
        "angle_deg": f"CASE WHEN abs({e}) > {turn_threshold} THEN degrees({e}) END",
        "distance_m": f"CASE WHEN abs({e}) <= {turn_threshold} AND ({distance}) > {move_threshold} THEN ({distance}) END",
    }


def needs_realign(error: str, c: Controller = Controller()) -> str:
    return f"(abs({angles.normalize(error)}) > {_f(c.heading_realign_rad)})"


def turn_rate(goal: str, yaw: str, c: Controller = Controller()) -> str:
    """Proportional to the error, clamped, and never slower than the least rate unless it is zero."""
    a = angles.clamp(f"({_f(c.turn_kp)} * {angles.error(yaw, goal)})", f"-{_f(c.max_turn_cmd)}", _f(c.max_turn_cmd))
    least = _f(c.turn_min_cmd)
    return f"({_f(c.turn_direction_sign)} * (CASE WHEN abs({a}) > 0 AND abs({a}) < {least} THEN sign({a}) * {least} ELSE {a} END))"


def drive_speed(distance: str, c: Controller = Controller()) -> str:
    """Proportional to the distance within limits, slow near the target and slower at it."""
    v = angles.clamp(f"({_f(c.forward_gain)} * ({distance}))", _f(c.forward_min_cmd), _f(c.max_forward_cmd))
    v = f"(CASE WHEN ({distance}) < {_f(c.slowdown_distance_m)} THEN least({v}, {_f(c.slowdown_forward_cmd)}) ELSE {v} END)"
    crawl = _f(max(c.forward_min_cmd, 0.12))
    return f"({_f(c.forward_direction_sign)} * (CASE WHEN ({distance}) < 0.45e0 THEN least({v}, {crawl}) ELSE {v} END))"


def hold_rate(yaw: str, hold: str, c: Controller = Controller()) -> str:
    """Turning that keeps a heading while driving."""
    if not (c.drive_heading_hold and c.drive_heading_kp > 1e-9):
        return "0e0"
    return f"({_f(c.turn_direction_sign)} * {angles.clamp(f'({_f(c.drive_heading_kp)} * {angles.error(yaw, hold)})', f'-{_f(c.drive_heading_max_rps)}', _f(c.drive_heading_max_rps))})"


def expected_models(n: str) -> str:
    """Models in a world of n waypoints: the vehicle, the points, and the segments between them."""
    return f"(CASE WHEN ({n}) <= 0 THEN 1 ELSE 1 + ({n}) + greatest(0, ({n}) - 1) END)"
