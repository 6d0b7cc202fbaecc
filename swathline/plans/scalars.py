"""Queries of the scalar functions, each over all rows of a view."""

from __future__ import annotations

from ..functions import angles, geo, motion, palette, rects, tiles, views
from .spec import projection

_R = rects.of_corners("lat1", "lon1", "lat2", "lon2")
_S = rects.of_corners("lat1 + 5e0", "lon1 - 10e0", "lat2 - 5e0", "lon2 + 10e0")
_ID = {"event_id": "event_id"}


def register() -> None:
    p = projection
    # -- angles, distances and frames over fixes -------------------------------------------------------------------
    x, y = geo.project("lat", "lon")
    p("d1_project", "gps_fix", _ID | {"x": (x, 4), "y": (y, 4)})
    lat, lon = geo.unproject(*geo.project("lat", "lon"))
    p("d2_unproject", "gps_fix", _ID | {"lat": (lat, 9), "lon": (lon, 9)})
    p("d3_geodesic_metres", "gps_fix", _ID | {"metres": (geo.geodesic("(4118821e0)", "(-7361866e0)", *geo.project("lat", "lon")), 4)})
    p("d4_haversine", "gps_fix", _ID | {"metres": (geo.haversine("55e0", "37e0", "lat", "lon"), 4)})
    p("d5_compass_bearing", "gps_fix", _ID | {"degrees": (geo.compass_bearing("54.9e0", "36.9e0", "lat", "lon"), 6)})
    p("d6_math_bearing", "gps_fix", _ID | {"bearing": (geo.math_bearing("54.9e0", "36.9e0", "lat", "lon"), 8), "normal": (angles.normalize(geo.math_bearing("54.9e0", "36.9e0", "lat", "lon")), 8)})
    p("d7_yaw_of_compass", "gps_fix", _ID | {"yaw": (geo.yaw_of_compass("(k * 3.6e0 - 180e0)"), 8)})
    p("d8_normalize_radians", "imu", _ID | {"angle": (angles.normalize("(yaw * 5e0 + 0.1e0)"), 8)})
    p("d9_wrap_angles", "imu", _ID | {"deg": (angles.wrap_degrees("(degrees(yaw) * 5e0 + 0.25e0)"), 6), "rad": (angles.wrap_radians("(yaw * 5e0 + 0.1e0)"), 8)})
    p("d10_clamp", "imu", _ID | {"v": (angles.clamp("yaw", "-1e0", "1e0"), 8)})
    ux, uy = angles.unit_vector("px", "py")
    p("d11_unit_vector", "points", {"id": "id", "x": (ux, 8), "y": (uy, 8)})
    p("d12_enu_origin", "missions", {"mission_id": "mission_id", "lat0_rad": ("radians(origin_lat)", 10), "lon0_rad": ("radians(origin_lon)", 10), "cos_lat0": ("cos(radians(origin_lat))", 10)})
    e, n = geo.local_metres("lat", "lon", "55e0", "37e0")
    p("d13_local_metres", "gps_fix", _ID | {"east": (e, 4), "north": (n, 4)})
    mx, my = geo.map_xy("lat", "lon", "55e0", "37e0", "0.25e0", "1e0", "-2e0")
    p("d14_map_xy", "gps_fix", _ID | {"x": (mx, 4), "y": (my, 4)})
    px, py = geo.polar_point("value", "(k * 3.6e0)")
    p("d15_polar_point", "gps_fix", _ID | {"east": (px, 4), "north": (py, 4)})
    # -- tiles -----------------------------------------------------------------------------------------------------
    tx, ty = tiles.of_point("lat", "lon", "17")
    p("d16_point_to_tile", "gps_fix", _ID | {"x": tx, "y": ty})
    p("d17_tile_bounds", "tiles", _ID | {k: (v, 9) for k, v in tiles.bounds("x", "y", "zoom").items()})
    p("d18_quadkey", "gps_fix", _ID | {"quadkey": tiles.quadkey(tx, ty, 17)})
    p("d19_tile_parent", "tiles", _ID | {"px": tiles.parent("x", "zoom", "12"), "py": tiles.parent("y", "zoom", "12")})
    p("d20_scale_to_zoom", "gps_fix", _ID | {"zoom": tiles.zoom_of_scale("(0.01e0 + k / 100e0)")})
    p("a13_street_tile_url", "tiles", _ID | {"url": tiles.url("https://tile.example.org/${z}/${x}/${y}.png", z="zoom", x="x", y="y")})
    p("a14_quadkey_tile_url", "gps_fix", _ID | {"url": tiles.url("http://t0.tiles.example.org/a${qk}.jpeg?mkt=${lcl}", qk=tiles.quadkey(tx, ty, 17), lcl="'en_US'")})
    p("a15_layer_tile_url", "tiles", _ID | {"url": tiles.url("http://mt1.example.org/lyrs=m&hl=${lcl}&x=${x}&y=${y}&z=${z}", lcl="'en_US'", x="x", y="y", z="zoom")})
    b = tiles.bounds("x", "y", "zoom")
    box = "concat(" + ", ',', ".join(views.fixed(b[k], 6) for k in ("lon_left", "lat_bottom", "lon_right", "lat_top")) + ")"
    height = f"floor(900e0 / (({b['lon_right']} - {b['lon_left']}) / ({b['lat_top']} - {b['lat_bottom']})))"
    p("a16_bbox_url", "tiles", _ID | {"url": f"concat('http://wms.example.org/?bbox=', {box}, '&width=900&height=', {views.fixed(height, 0)})"})
    p("c8_tile_holds_tile", "tiles", _ID | {"holds": tiles.holds("9876", "5182", "14", "x", "y", "zoom")})
    # -- views and labels ------------------------------------------------------------------------------------------
    text = views.degrees_text("(lat - 110e0 * (event_id % 2))")
    p("d21_degrees_text", "gps_fix", _ID | text | {"label": f"concat({text['sign']}, {text['ns']}, ' ', {text['di']}, ' ', {text['mi']}, ' ', {text['s']})"})
    unit = "(CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'km' WHEN 2 THEN 'nm' ELSE 'mi' END)"
    p("d22_units", "gps_fix", _ID | {"v": (views.in_unit("(value * 37e0)", unit), 6), "unit": unit})
    metres = "floor(value * 37e0)"
    p("d23_distance_label", "gps_fix", _ID | {"label": views.distance_label(metres, unit), "fine": views.fine_distance_label(metres, unit)})
    bm, bp = views.bar_length("floor(value * 97e0 + 11e0)", "150e0", "100e0")
    p("d24_scale_bar", "gps_fix", _ID | {"metres": (bm, 3), "pixels": (bp, 3)})
    p("d25_yaw_of_quaternion", "imu", _ID | {"yaw": (angles.yaw_of_quaternion("qx", "qy", "qz", "qw"), 8)})
    q = angles.quaternion_of_yaw("yaw")
    p("d26_quaternion_of_yaw", "imu", _ID | {"z": (q[2], 8), "w": (q[3], 8)})
    p("d27_planar_metrics", "points", {"id": "id", "dist": (angles.distance("0e0", "0e0", "px", "py"), 6), "bearing": (angles.bearing("0e0", "0e0", "px", "py"), 8)})
    p("d28_angle_error", "imu", _ID | {"err": (angles.error("yaw", "(yaw * 3e0 + 0.1e0)"), 8)})
    bearing = angles.bearing("10e0", "5e0", "px", "py")
    p("d29_segment_metrics", "points", {"id": "id", "dist": (angles.distance("10e0", "5e0", "px", "py"), 6), "bearing": (bearing, 8), "err": (angles.error("0.3e0", bearing), 8)})
    cmd = motion.command("value / 100e0", "yaw_err", "0.35e0", "0.9e0")
    p("d30_high_level_command", "gps_fix", _ID | {k: (v, 6) if k != "kind" else v for k, v in motion.command("value / 100e0", "((k - 50) / 60e0)", "0.35e0", "0.9e0").items()})
    assert set(cmd) == {"kind", "angle_deg", "distance_m"}
    p("d31_turn_rate", "imu", _ID | {"w": (motion.turn_rate("0.3e0", "yaw"), 8)})
    p("d32_drive_twist", "gps_fix", _ID | {"v": (motion.drive_speed("(value / 50e0)"), 8), "w": (motion.hold_rate("((k - 50) / 100e0)", "0.05e0"), 8)})
    p("d33_palette", "gps_fix", _ID | {c: (palette.channel("k", i, "1.1e0"), 6) for i, c in enumerate("rgb")} | {"point": palette.rgba_text("k", "1.0"), "disc": palette.rgba_text("k", "0.33")})
    p("d34_hues", "clicks", {"id": "id", "component": palette.hue("id", 57), "island": palette.hue("id", 67, 23), "cutout": palette.hue("id", 53, 17)})
    p("d35_marker_box", "gps_fix", _ID | {k: (v, 9) for k, v in geo.marker_box("lat", "lon", "0.8e0").items()})
    vx, vy = views.transform("px", "py", "3e0", "-4e0", "1.5e0", "(id % 360)")
    p("d36_view_transform", "points", {"id": "id", "x": (vx, 5), "y": (vy, 5)})
    p("d37_interpolation", "gps_fix", _ID | {"scale": (views.scale_between("0.5e0", "8e0", "(k / 100e0)"), 8), "azimuth": (views.between("-30e0", "90e0", "(k / 100e0)"), 8)})
    p("d38_fit_scale", "rects", {"id": "id", "scale": (views.fit_scale("(abs(lon2 - lon1) + 1e0)", "(abs(lat2 - lat1) + 1e0)", "800e0", "600e0"), 8)})
    p("d39_fly_profile", "gps_fix", _ID | {"ms": views.fly_millis("value", "2e0", "1e0"), "scale": (views.fly_scale("2e0", "1e0", "0.25e0", "(k / 100e0)"), 8), "x": (views.fly_position("0e0", "value", "(k / 100e0)"), 6)})
    p("d40_wheel_factor", "gps_fix", _ID | {"factor": (views.wheel_factor("((k - 50) * 120e0 / 10e0)"), 8)})
    p("d41_sticky_azimuth", "gps_fix", _ID | {"azimuth": (angles.sticky("(k * 3.6e0)", "5e0"), 6)})
    low, high = views.scale_limits("800e0", "600e0", "(value + 1e0)", "(value / 2e0 + 1e0)")
    p("d42_scale_limits", "gps_fix", _ID | {"low": (low, 8), "high": (high, 1)})
    mm = lambda v: f"CAST(CASE WHEN {v} < 0 THEN ceil({v} * 1000e0) ELSE floor({v} * 1000e0) END AS BIGINT)"
    p("d43_quantise_mm", "points", {"id": "id", "x": mm("(px / 7e0)"), "y": mm("(py / 7e0)"), "back": (f"{mm('(px / 7e0)')} / 1000e0", 6)})
    p("d44_expected_models", "clicks", {"id": "id", "models": f"CAST({motion.expected_models('(id % 9 - 1)')} AS BIGINT)"})
    # -- predicates ------------------------------------------------------------------------------------------------
    p("c1_clamp_wrap", "rects", {"id": "id", "lat": (geo.clamp_lat("(lat1 * 1.5e0)"), 6), "lon": (geo.wrap_lon("(lon1 * 2.5e0)"), 6)})
    p("c2_same_point", "rects", {"id": "id", "same": rects.same_point("lat1", "lon1", "(CASE WHEN id % 2 = 0 THEN lat1 ELSE lat2 END)", "(CASE WHEN id % 3 = 0 THEN lon2 ELSE lon1 END)")})
    p("c3_rect_of_corners", "rects", {"id": "id"} | dict(zip(("lat_top", "lon_left", "lat_bottom", "lon_right"), _R, strict=True)))
    p("c4_rect_corners", "rects", {"id": "id", "tl_lat": _R[0], "tl_lon": _R[1], "br_lat": _R[2], "br_lon": _R[3], "tr_lon": _R[3], "bl_lat": _R[2]})
    p("c5_rect_contains_point", "rects", {"id": "id", "inside": rects.contains_point(_R, "10e0", "20e0")})
    p("c6_rect_contains_rect", "rects", {"id": "id", "inside": rects.contains_rect(_R, _S)})
    p("c7_rect_intersects", "rects", {"id": "id", "corners": rects.corners_touch(_R, ("30e0", "-40e0", "-10e0", "50e0")), "overlap": rects.overlaps(_R, ("30e0", "-40e0", "-10e0", "50e0"))})
    p("c16_reached_target", "points", {"id": "id", "reached": f"({angles.distance('10e0', '5e0', 'px', 'py')} <= 30e0)"})
    p("c17_needs_realign", "imu", _ID | {"realign": motion.needs_realign("(yaw - 0.3e0)")})
    p("c24_valid_fix", "gps_fix", _ID | {"lat": ("lat", 6), "lon": ("lon", 6)}, "status >= 0 AND NOT isnan(lat) AND NOT isnan(lon)")
    p("c25_valid_imu", "imu", _ID | {"yaw": ("yaw", 8)}, "cov0 >= 0 AND sqrt(qx * qx + qy * qy + qz * qz + qw * qw) >= 1e-6")
    p("c20_valid_anchor", "edges", {"f": "f", "ring": "ring", "i": "i", "valid": "(i >= 0 AND i < n AND n >= 3)"})
    p("p11_projection_bounds", "gps_fix", _ID | {"inside": rects.contains_point(("85e0", "-180e0", "-85e0", "180e0"), "lat", "lon")})
    flags = "CAST(k AS BIGINT)"
    p("p12_bit_flags", "gps_fix", _ID | {"given": f"({flags} | 8)", "cleared": f"({flags} & ~8)", "has": f"(({flags} & 8) <> 0)"})
    p("p17_circle_placemark", "points", {"id": "id", "inside": f"({angles.distance('0e0', '0e0', 'px', 'py')} <= 25e0)"})
    p("p7_anchor_markers", "gps_fix", _ID | {f"{n}_{k}": (v, 9) for n, m in (("click", "0.5e0"), ("restore", "0.8e0")) for k, v in geo.marker_box("lat", "lon", m).items() if "bottom" in k or "left" in k})
    wx, wy = views.transform("px", "py", "0e0", "0e0", "(1e0 / 1.5e0)", "(-30e0)")
    p("o4_camera_moves", "gps_fix", _ID | {"scale": (angles.clamp("(value / 10e0)", "0.5e0", "16e0"), 6), "azimuth": ("((k * 7e0 - 200e0) % 360e0)", 6)})
    p("o6_view_to_map", "points", {"id": "id", "x": (wx, 5), "y": (wy, 5)})
