"""Map tiles: keys, quadkeys, bounds and url templates."""

from __future__ import annotations

import re


def of_point(lat: str, lon: str, zoom: str) -> tuple[str, str]:
    """(x, y) of the tile that holds a point."""
    n = f"pow(2e0, {zoom})"
    y = f"floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * {n})"
    return f"CAST(floor((({lon}) + 180e0) / 360e0 * {n}) AS INT)", f"CAST({y} AS INT)"


def corner(x: str, y: str, zoom: str) -> tuple[str, str]:
    """(lat, lon) of a tile's top left corner."""
    n = f"(pi() - 2e0 * pi() * ({y}) / pow(2e0, {zoom}))"
    return f"(180e0 / pi() * atan(0.5e0 * (exp({n}) - exp(-{n}))))", f"(({x}) / pow(2e0, {zoom}) * 360e0 - 180e0)"


def bounds(x: str, y: str, zoom: str) -> dict[str, str]:
    (top, left), (bottom, right) = corner(x, y, zoom), corner(f"(({x}) + 1)", f"(({y}) + 1)", zoom)
    return {"lat_top": top, "lon_left": left, "lat_bottom": bottom, "lon_right": right}


def parent(v: str, zoom: str, parent_zoom: str) -> str:
    """A key's coordinate at a lower zoom."""
    return f"CAST(floor(({v}) / pow(2e0, ({zoom}) - ({parent_zoom}))) AS INT)"


def holds(x: str, y: str, zoom: str, x2: str, y2: str, zoom2: str) -> str:
    """Whether the first tile is an ancestor of the second."""
    return f"({zoom} < {zoom2} AND {parent(x2, zoom2, zoom)} = {x} AND {parent(y2, zoom2, zoom)} = {y})"


def quadkey(x: str, y: str, zoom: int) -> str:
    """One digit per level: 1 for the x bit, 2 for the y bit."""
    digit = lambda i: f"CAST(CAST(floor(({x}) / {1 << i}) AS BIGINT) % 2 + 2 * (CAST(floor(({y}) / {1 << i}) AS BIGINT) % 2) AS STRING)"
    return "concat(" + ", ".join(digit(i) for i in range(zoom - 1, -1, -1)) + ")"


def zoom_of_scale(scale: str) -> str:
    return f"CAST(floor(17e0 - log2(1e0 / ({scale})) + 0.5e0) AS INT)"


def url(template: str, **values: str) -> str:
    """A template's ``${name}`` places filled with expressions; the template itself is lower-cased first."""
    out = []
    for k, part in enumerate(re.split(r"\$\{(\w+)\}", template.lower())):
        if k % 2:
            out.append(f"CAST({values[part]} AS STRING)")
        elif part:
            out.append("'" + part.replace("'", "''") + "'")
    return f"concat({', '.join(out)})"
