"""Map views: affine transforms, camera interpolation, scales and their labels."""

from __future__ import annotations

# Fixed lengths of units in metres.
UNITS = {"m": "1e0", "km": "1000e0", "nm": "1852e0", "mi": "1609e0"}


def transform(x: str, y: str, ax: str, ay: str, scale: str, azimuth: str) -> tuple[str, str]:
    """Scale, then turn by compass degrees, about the anchor (ax, ay)."""
    a, dx, dy = f"radians({azimuth})", f"(({x}) - ({ax}))", f"(({y}) - ({ay}))"
    return (
        f"(({ax}) + ({scale}) * ({dx} * cos({a}) - {dy} * sin({a})))",
        f"(({ay}) + ({scale}) * ({dx} * sin({a}) + {dy} * cos({a})))",
    )


def between(a: str, b: str, t: str) -> str:
    return f"(({a}) + (({b}) - ({a})) * ({t}))"


def scale_between(a: str, b: str, t: str) -> str:
    """Scales are interpolated by their logarithms."""
    return f"pow(2e0, log2({a}) + (log2({b}) - log2({a})) * ({t}))"


def fit_scale(width: str, height: str, view_width: str, view_height: str) -> str:
    return f"least(({view_width}) / ({width}), ({view_height}) / ({height}))"


def wheel_factor(delta: str) -> str:
    """Zoom factor of a wheel's turn: half a power of two in, two thirds out, per 120 units."""
    return f"pow(2e0, ({delta}) / 120e0 / (CASE WHEN ({delta}) > 0 THEN 2e0 ELSE 1.5e0 END))"


def fly_scale(from_scale: str, to_scale: str, middle: str, t: str) -> str:
    """A flight goes to the middle scale in its first half and on to the target in its second."""
    return f"(CASE WHEN {t} <= 0.5e0 THEN {scale_between(from_scale, middle, f'(({t}) / 0.5e0)')} ELSE {scale_between(middle, to_scale, f'((({t}) - 0.5e0) / 0.5e0)')} END)"


def fly_position(a: str, b: str, t: str) -> str:
    """Slow at both ends: the fifth power towards the middle, mirrored after it."""
    m = f"((({a}) + ({b})) / 2e0)"
    first = between(a, m, f"pow(({t}) / 0.5e0, 5e0)")
    second = between(m, b, f"(1e0 - pow(1e0 - (({t}) - 0.5e0) / 0.5e0, 5e0))")
    return f"(CASE WHEN {t} <= 0.5e0 THEN {first} ELSE {second} END)"


def fly_millis(distance: str, from_scale: str, to_scale: str, speed: str = "300e0") -> str:
    """3 s, 1 s for no distance, or less if the flight stays below ``speed`` at either scale."""
    d1, d2 = f"(({distance}) * ({from_scale}))", f"(({distance}) * ({to_scale}))"
    return f"(CASE WHEN ({distance}) = 0 THEN 1000e0 WHEN {d1} / 3e0 < {speed} AND {d2} / 3e0 < {speed} THEN floor(1000e0 * greatest({d1}, {d2}) / {speed}) ELSE 3000e0 END)"


def scale_limits(view_width: str, view_height: str, proj_width: str, proj_height: str) -> tuple[str, str]:
    """The least and the greatest scale of a map."""
    return f"least(({view_width}) / ({proj_width}), ({view_height}) / ({proj_height}))", "16e0"


def in_unit(metres: str, unit: str) -> str:
    cases = " ".join(f"WHEN '{u}' THEN ({metres}) / {v}" for u, v in UNITS.items())
    return f"(CASE {unit} {cases} ELSE ({metres}) END)"


def fixed(v: str, decimals: int) -> str:
    """A number with so many decimals, without grouping; halves away from zero."""
    if not decimals:
        return f"CAST(CAST(floor(abs({v}) + 0.5e0) AS BIGINT) * CAST(sign({v}) AS BIGINT) AS STRING)"
    p = 10**decimals
    n = f"CAST(floor(abs({v}) * {p}e0 + 0.5e0) AS BIGINT)"
    sign = f"(CASE WHEN ({v}) < 0 AND {n} > 0 THEN '-' ELSE '' END)"
    return f"concat({sign}, CAST(CAST(floor({n} / {p}e0) AS BIGINT) AS STRING), '.', lpad(CAST({n} % {p} AS STRING), {decimals}, '0'))"


def distance_label(metres: str, unit: str) -> str:
    """Whole units; below one unit, whole metres."""
    v = in_unit(metres, unit)
    return f"(CASE WHEN {v} >= 1 THEN concat({fixed(v, 0)}, ' ', {unit}) ELSE concat({fixed(metres, 0)}, ' m') END)"


def fine_distance_label(metres: str, unit: str) -> str:
    """Whole units; below one unit, two decimals."""
    v = in_unit(metres, unit)
    return f"concat(CASE WHEN {v} >= 1 THEN {fixed(v, 0)} ELSE {fixed(v, 2)} END, ' ', {unit})"


def bar_length(metres: str, pixels: str, least: str) -> tuple[str, str]:
    """(metres, pixels) of a scale bar: the power of ten at or below, doubled until it has ``least`` pixels."""
    m10 = f"floor(pow(10e0, floor(greatest(1e0, log10({metres})))))"
    px = f"ceil({m10} / ({metres}) * ({pixels}))"
    factor = f"(CASE WHEN {px} < ({least}) THEN pow(2e0, ceil(log2(floor(({least}) / {px})))) ELSE 1e0 END)"
    return f"({m10} * {factor})", f"({px} * {factor})"


def degrees_text(v: str, latitude: bool = True, fix_hemisphere: bool = False) -> dict[str, str]:
    """The parts of a coordinate's text: sign, hemisphere (as the reference has it: N below zero), d, di, m, mi, s, si."""
    d = f"abs({v})"
    m = f"(({d} - floor({d})) * 60e0)"
    s = f"(({m} - floor({m})) * 60e0)"
    out = {"sign": f"CASE WHEN ({v}) < 0 THEN '-' ELSE '' END"}
    if latitude:
        out["ns"] = f"CASE WHEN ({v}) {'>=' if fix_hemisphere else '<'} 0 THEN 'N' ELSE 'S' END"
    whole = lambda x: f"CAST(CAST(floor({x}) AS BIGINT) AS STRING)"
    return out | {"di": whole(d), "d": fixed(d, 6), "mi": whole(m), "m": fixed(m, 4), "si": whole(s), "s": fixed(s, 3)}
