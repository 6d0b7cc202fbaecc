"""Polygon overlay and inset of one region in NumPy, to compare with.

A region is rings of points; winding numbers decide what is inside. Sides are
split where they meet, each part is kept if exactly one of its two flanks is
inside the result, and the parts are linked to rings with the inside on the left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
Ring = np.ndarray  # (n, 2)


def area(ring: Ring) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def _sides(rings: list[Ring]) -> np.ndarray:
    return np.concatenate([np.hstack([r, np.roll(r, -1, 0)]) for r in rings]) if rings else np.zeros((0, 4))


def winding(sides: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Winding number of the sides around each point."""
    if not len(sides):
        return np.zeros(len(points), int)
    x1, y1, x2, y2 = (sides[:, k][None, :] for k in range(4))
    px, py = points[:, 0][:, None], points[:, 1][:, None]
    left = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    up, down = (y1 <= py) & (y2 > py) & (left > 0), (y1 > py) & (y2 <= py) & (left < 0)
    return up.sum(1) - down.sum(1)


def _split(sides: np.ndarray) -> np.ndarray:
    """Sides cut at every meeting point, on a grid of a micrometre."""
    out = []
    d = sides[:, 2:] - sides[:, :2]
    for s, v in zip(sides, d, strict=True):
        cross = v[0] * d[:, 1] - v[1] * d[:, 0]
        o = sides[:, :2] - s[:2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (o[:, 0] * d[:, 1] - o[:, 1] * d[:, 0]) / cross
            u = (o[:, 0] * v[1] - o[:, 1] * v[0]) / cross
        hit = t[(np.abs(cross) > 1e-12) & (t > 1e-9) & (t < 1 - 1e-9) & (u > -1e-9) & (u < 1 + 1e-9)]
        # ends of others that lie on this side, which collinear sides share
        n2 = max(float(v @ v), 1e-18)
        for p in (sides[:, :2], sides[:, 2:]):
            along = ((p - s[:2]) @ v) / n2
            off = np.abs((p[:, 0] - s[0]) * v[1] - (p[:, 1] - s[1]) * v[0]) / np.sqrt(n2)
            hit = np.r_[hit, along[(off < 1e-7) & (along > 1e-9) & (along < 1 - 1e-9)]]
        at = np.unique(np.r_[0.0, hit, 1.0])
        pts = np.round(s[:2] + at[:, None] * v, 6)
        out.append(np.hstack([pts[:-1], pts[1:]]))
    parts = np.concatenate(out) if out else np.zeros((0, 4))
    return np.unique(parts[np.abs(parts[:, :2] - parts[:, 2:]).max(1) > 1e-9], axis=0)


def trace(sides: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> list[Ring]:
    """Rings around the points for which ``inside`` holds."""
    parts = _split(sides)
    if not len(parts):
        return []
    mid, v = (parts[:, :2] + parts[:, 2:]) / 2, parts[:, 2:] - parts[:, :2]
    normal = np.stack([-v[:, 1], v[:, 0]], 1) / np.linalg.norm(v, axis=1)[:, None] * 2e-5
    left, right = inside(mid + normal), inside(mid - normal)
    kept = np.vstack([parts[left & ~right], parts[~left & right][:, [2, 3, 0, 1]]])
    kept = np.unique(np.round(kept, 6), axis=0)
    after: dict[tuple, list[int]] = {}
    for k, s in enumerate(kept):
        after.setdefault((s[0], s[1]), []).append(k)
    used, rings = np.zeros(len(kept), bool), []
    for k in range(len(kept)):
        ring = []
        while not used[k]:
            used[k] = True
            ring.append(kept[k, :2])
            on = [j for j in after.get((kept[k, 2], kept[k, 3]), []) if not used[j]]
            if not on:
                break
            heading = np.arctan2(*(kept[k, 2:] - kept[k, :2])[::-1])
            turn = [(np.arctan2(*(kept[j, 2:] - kept[j, :2])[::-1]) - heading + np.pi) % (2 * np.pi) for j in on]
            k = on[int(np.argmax(turn))]  # the leftmost way keeps rings apart where they touch
        if len(ring) >= 3 and abs(area(np.array(ring))) > 1e-6:
            rings.append(np.array(ring))
    return rings


def combine(a: list[Ring], b: list[Ring], how: str) -> list[Ring]:
    """Union, difference, intersection or xor under the non-zero rule."""
    sa, sb = _sides(a), _sides(b)
    rule = {"union": np.logical_or, "intersection": np.logical_and, "difference": lambda x, y: x & ~y, "xor": np.logical_xor}[how]
    return trace(np.vstack([sa, sb]), lambda p: rule(winding(sa, p) != 0, winding(sb, p) != 0))


def inset(rings: list[Ring], distance: float, miter: float = 2.0) -> list[Ring]:
    """The region moved inwards: outer rings (counter-clockwise) shrink, holes (clockwise) grow; mitred, bevelled beyond ``miter``."""
    moved = []
    for r in rings:
        v = np.roll(r, -1, 0) - r
        n = np.stack([-v[:, 1], v[:, 0]], 1) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        before = np.roll(n, 1, 0)
        cos = 1 + (n * before).sum(1)
        pts = []
        for p, n0, n1, c in zip(r, before, n, cos, strict=True):
            if c > 1e-9 and 2 / c <= miter**2 * 2:
                pts.append(p + (n0 + n1) / c * distance)
            else:
                pts += [p + n0 * distance, p + n1 * distance]
        moved.append(np.array(pts))
    sides, given = _sides(moved), _sides(rings)
    # A part narrower than twice the distance turns inside out twice; its corners are too near the given sides.
    return [r for r in trace(sides, lambda p: winding(sides, p) > 0) if _distances(given, r).min() > distance - 1e-3]


def _distances(sides: np.ndarray, points: np.ndarray) -> np.ndarray:
    a, v = sides[None, :, :2], (sides[:, 2:] - sides[:, :2])[None]
    t = np.clip(((points[:, None] - a) * v).sum(2) / np.maximum((v**2).sum(2), 1e-18), 0, 1)
    return np.linalg.norm(a + t[..., None] * v - points[:, None], axis=2)


def rings_of(pdf: pd.DataFrame) -> list[Ring]:
    return [g.sort_values("i")[["x", "y"]].to_numpy(float) for _, g in pdf.groupby("ring", sort=True)]


def frame_of(f: int, rings: list[Ring]) -> pd.DataFrame:
    rows = [(f, k, i, len(r), *p) for k, r in enumerate(sorted(rings, key=lambda r: -area(r))) for i, p in enumerate(r.tolist())]
    return pd.DataFrame(rows, columns=["f", "ring", "i", "n", "x", "y"])
