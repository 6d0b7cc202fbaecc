"""Geodesy: projection, distances, bearings and local frames. Degrees in, metres out, unless a name says otherwise."""

from __future__ import annotations

# Fixed radii: of the projection, and of the sphere for haversine and local frames.
PROJECTION_RADIUS = "6378137e0"
SPHERE_RADIUS = "6371000e0"


def clamp_lat(lat: str) -> str:
    return f"greatest(-90e0, least(90e0, {lat}))"


def wrap_lon(lon: str) -> str:
    """Longitudes beyond 180 by more than 1e-6 are wrapped, with the truncated remainder; others stay."""
    return f"(CASE WHEN {lon} > 180.000001e0 THEN (({lon}) + 180e0) % 360e0 - 180e0 WHEN {lon} < -180.000001e0 THEN (({lon}) - 180e0) % 360e0 + 180e0 ELSE {lon} END)"


def project(lat: str, lon: str) -> tuple[str, str]:
    """Web Mercator with y downwards; latitudes above 85 are held at 85, those below -85 are not."""
    half = f"(pi() * {PROJECTION_RADIUS})"
    y = f"(-ln(tan((90e0 + least({lat}, 85e0)) * pi() / 360e0)) / (pi() / 180e0) * {half} / 180e0)"
    return f"(({lon}) * {half} / 180e0)", y


def unproject(x: str, y: str) -> tuple[str, str]:
    """(lat, lon) of a projected point."""
    half = f"(pi() * {PROJECTION_RADIUS})"
    lat = f"(180e0 / pi() * (2e0 * atan(exp(-({y}) / {half} * pi())) - pi() / 2e0))"
    return lat, f"(({x}) / {half} * 180e0)"


def _chord(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dlat, dlon = f"sin(radians(({lat2}) - ({lat1})) / 2e0)", f"sin(radians(({lon2}) - ({lon1})) / 2e0)"
    return f"({dlat} * {dlat} + cos(radians({lat1})) * cos(radians({lat2})) * {dlon} * {dlon})"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = _chord(lat1, lon1, lat2, lon2)
    return f"({SPHERE_RADIUS} * 2e0 * atan2(sqrt({a}), sqrt(greatest(0e0, 1e0 - {a}))))"


def geodesic(x1: str, y1: str, x2: str, y2: str) -> str:
    """Metres between two projected points, by the arcsine form on the projection's radius."""
    (lat1, lon1), (lat2, lon2) = unproject(x1, y1), unproject(x2, y2)
    return f"(2e0 * {PROJECTION_RADIUS} * asin(least(1e0, sqrt({_chord(lat1, lon1, lat2, lon2)}))))"


def compass_bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Degrees clockwise from north, in [-180, 180]."""
    dlon = f"radians(({lon2}) - ({lon1}))"
    y = f"sin({dlon}) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({dlon})"
    return f"degrees(atan2({y}, {x}))"


def hop_bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The compass bearing of a short hop: the northward part as a sum without cancellation.

    cos a sin b - sin a cos b cos d = sin(b - a) + 2 sin a cos b sin(d / 2)^2. The difference on the left keeps
    8 digits of a hop of half a metre, and the rest hangs on the engine's sine.
    """
    dlon = f"radians(({lon2}) - ({lon1}))"
    half = f"sin({dlon} / 2e0)"
    y = f"sin({dlon}) * cos(radians({lat2}))"
    x = f"sin(radians(({lat2}) - ({lat1}))) + 2e0 * sin(radians({lat1})) * cos(radians({lat2})) * {half} * {half}"
    return f"degrees(atan2({y}, {x}))"


def math_bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Radians counter-clockwise from east."""
    return f"(pi() / 2e0 - radians({compass_bearing(lat1, lon1, lat2, lon2)}))"


def yaw_of_compass(bearing: str) -> str:
    """Radians counter-clockwise from east for compass degrees, wrapped once into [-pi, pi]."""
    a = f"(pi() / 2e0 - radians({bearing}))"
    return f"(CASE WHEN {a} > pi() THEN {a} - 2e0 * pi() WHEN {a} < -pi() THEN {a} + 2e0 * pi() ELSE {a} END)"


def local_metres(lat: str, lon: str, lat0: str, lon0: str) -> tuple[str, str]:
    """(east, north) of the origin (lat0, lon0), on a flat earth."""
    return f"(radians(({lon}) - ({lon0})) * cos(radians({lat0})) * {SPHERE_RADIUS})", f"(radians(({lat}) - ({lat0})) * {SPHERE_RADIUS})"


def map_xy(lat: str, lon: str, lat0: str, lon0: str, yaw: str, x0: str = "0e0", y0: str = "0e0") -> tuple[str, str]:
    """Local metres turned by the frame's yaw and moved to its origin."""
    e, n = local_metres(lat, lon, lat0, lon0)
    return f"(({x0}) + cos({yaw}) * {e} - sin({yaw}) * {n})", f"(({y0}) + sin({yaw}) * {e} + cos({yaw}) * {n})"


def polar_point(distance: str, bearing: str) -> tuple[str, str]:
    """(east, north) at compass degrees and a distance."""
    return f"(({distance}) * sin(radians({bearing})))", f"(({distance}) * cos(radians({bearing})))"


def marker_box(lat: str, lon: str, metres: str) -> dict[str, str]:
    """Corners of a square of ``metres`` around a point, in degrees at 111 km each."""
    dlat, dlon = f"(({metres}) / 111000e0 / 2e0)", f"(({metres}) / (111000e0 * cos(radians({lat}))) / 2e0)"
    return {"lat_bottom": f"({lat}) - {dlat}", "lat_top": f"({lat}) + {dlat}", "lon_left": f"({lon}) - {dlon}", "lon_right": f"({lon}) + {dlon}"}
