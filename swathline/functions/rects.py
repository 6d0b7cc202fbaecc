"""Geographic rectangles, as (lat_top, lon_left, lat_bottom, lon_right)."""

from __future__ import annotations

Rect = tuple[str, str, str, str]


def of_corners(lat1: str, lon1: str, lat2: str, lon2: str) -> Rect:
    return f"greatest({lat1}, {lat2})", f"least({lon1}, {lon2})", f"least({lat1}, {lat2})", f"greatest({lon1}, {lon2})"


def contains_point(r: Rect, lat: str, lon: str) -> str:
    """The left and top edges count as inside, the right and bottom ones do not."""
    return f"({r[1]} <= {lon} AND {lon} < {r[3]} AND {r[2]} < {lat} AND {lat} <= {r[0]})"


def contains_rect(r: Rect, s: Rect) -> str:
    return f"({r[1]} <= {s[1]} AND {s[3]} <= {r[3]} AND {r[2]} <= {s[2]} AND {s[0]} <= {r[0]})"


def corners_touch(r: Rect, s: Rect) -> str:
    """Whether a corner of one is inside the other; misses rectangles that cross like a plus sign."""
    inside = lambda a, b: [contains_point(a, lat, lon) for lat in (b[0], b[2]) for lon in (b[1], b[3])]
    return "(" + " OR ".join(inside(r, s) + inside(s, r)) + ")"


def overlaps(r: Rect, s: Rect) -> str:
    """Whether the interiors meet."""
    return f"({r[1]} < {s[3]} AND {s[1]} < {r[3]} AND {r[2]} < {s[0]} AND {s[2]} < {r[0]})"


def same_point(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Both empty, or exactly equal."""
    return f"(({lat1} IS NULL AND {lon1} IS NULL AND {lat2} IS NULL AND {lon2} IS NULL) OR coalesce({lat1} = {lat2} AND {lon1} = {lon2}, false))"
