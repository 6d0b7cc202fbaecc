"""Plane geometry of points, segments and sides (x1, y1)-(x2, y2)."""

from __future__ import annotations

from .angles import hypot

SIDE = ("x1", "y1", "x2", "y2")


def side_t(px: str, py: str, s: tuple[str, str, str, str] = SIDE) -> str:
    """Where along a side, from 0 to 1, a point is nearest."""
    x1, y1, x2, y2 = s
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    return f"coalesce(greatest(0e0, least(1e0, (({px} - {x1}) * {dx} + ({py} - {y1}) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0e0))), 0e0)"


def side_point(t: str, s: tuple[str, str, str, str] = SIDE) -> tuple[str, str]:
    x1, y1, x2, y2 = s
    return f"({x1} + ({t}) * ({x2} - {x1}))", f"({y1} + ({t}) * ({y2} - {y1}))"


def side_distance(px: str, py: str, s: tuple[str, str, str, str] = SIDE) -> str:
    x, y = side_point(side_t(px, py, s), s)
    return hypot(f"{px} - {x}", f"{py} - {y}")


def crosses(px: str, py: str, s: tuple[str, str, str, str] = SIDE) -> str:
    """Whether a ray from the point to the right crosses the side; each level belongs to one of two sides that meet there."""
    x1, y1, x2, y2 = s
    return f"(({y1} > {py}) <> ({y2} > {py}) AND {px} < ({x2} - {x1}) * ({py} - {y1}) / nullif({y2} - {y1}, 0e0) + {x1})"


def cross(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({ax}) * ({by}) - ({ay}) * ({bx}))"


def meeting(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> tuple[str, str]:
    """(t, u): where two segments' lines meet, along each; null if they are parallel."""
    adx, ady, bdx, bdy = f"({a[2]} - {a[0]})", f"({a[3]} - {a[1]})", f"({b[2]} - {b[0]})", f"({b[3]} - {b[1]})"
    d = f"nullif(CASE WHEN abs({cross(adx, ady, bdx, bdy)}) < 1e-12 THEN 0e0 ELSE {cross(adx, ady, bdx, bdy)} END, 0e0)"
    ox, oy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    return f"({cross(ox, oy, bdx, bdy)} / {d})", f"({cross(ox, oy, adx, ady)} / {d})"


def segments_meet(a: tuple[str, str, str, str], b: tuple[str, str, str, str], slack: str = "1e-9") -> str:
    t, u = meeting(a, b)
    return f"coalesce({t} >= -{slack} AND {t} <= 1e0 + {slack} AND {u} >= -{slack} AND {u} <= 1e0 + {slack}, false)"
