"""Queries of regions, points and polylines."""

from __future__ import annotations

from ..functions import geo, planar
from ..operators import regions
from .spec import operator, projection, statement

_DIST = planar.side_distance("px", "py")
_T = planar.side_t("px", "py")
_NEAR = f"""
    SELECT id, f, ring, i, t, arc, x, y, dist FROM (SELECT id, p.f, e.ring, e.i, {_T} AS t, e.arc + {_T} * e.len AS arc,
        {planar.side_point(_T)[0]} AS x, {planar.side_point(_T)[1]} AS y, {_DIST} AS dist,
        row_number() OVER (PARTITION BY id, p.f ORDER BY {_DIST}, e.ring, e.i) AS rn
        FROM {{points}} p JOIN ({{arcs}}) e ON p.f = e.f) q WHERE rn = 1"""
_ARCS = "SELECT *, coalesce(sum(len) OVER (PARTITION BY f, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS arc FROM {edges}"


def _near(points: str = "{points}") -> str:
    return _NEAR.replace("{arcs}", _ARCS).replace("{points}", points)


def register() -> None:
    stats = "SELECT f, ring, sum(x1 * y2 - x2 * y1) / 2e0 AS area, sum(len) AS perimeter, min(x1) AS min_x, max(x1) AS max_x, min(y1) AS min_y, max(y1) AS max_y FROM {edges} GROUP BY f, ring"
    operator("e2_ring_area", f"SELECT f, ring, area, area > 0 AS ccw FROM ({stats})", {"area": 6})(lambda t: regions.ring_stats(t["edges"]).selectExpr("f", "ring", "area", "area > 0 AS ccw"))
    statement("e3_region_area", "SELECT f, sum(x1 * y2 - x2 * y1) / 2e0 AS area_m2, sum(x1 * y2 - x2 * y1) / 2e0 * 1e6 AS area_mm2 FROM {edges} WHERE n >= 3 GROUP BY f", {"area_m2": 6, "area_mm2": 0})
    statement("e4_region_bounds", "SELECT f, coalesce(min(x1), -1e0) AS min_x, coalesce(max(x1), 1e0) AS max_x, coalesce(min(y1), -1e0) AS min_y, coalesce(max(y1), 1e0) AS max_y FROM {edges} GROUP BY f", {c: 6 for c in ("min_x", "max_x", "min_y", "max_y")})
    statement("e5_ring_perimeter", "SELECT f, ring, sum(len) AS perimeter FROM {edges} GROUP BY f, ring", {"perimeter": 6})
    # A line through each point, along direction id degrees, clipped to its region's bounds padded by a metre.
    t1, t2 = "((min_x - px) / nullif(dx, 0e0))", "((max_x - px) / nullif(dx, 0e0))"
    u1, u2 = "((min_y - py) / nullif(dy, 0e0))", "((max_y - py) / nullif(dy, 0e0))"
    statement(
        "e6_line_clip",
        f"""SELECT id, f, CASE WHEN t0 <= t1 THEN t0 END AS t_in, CASE WHEN t0 <= t1 THEN t1 END AS t_out FROM (
            SELECT id, f, greatest(least({t1}, {t2}), least({u1}, {u2})) AS t0, least(greatest({t1}, {t2}), greatest({u1}, {u2})) AS t1 FROM (
            SELECT id, p.f, px, py, cos(radians(id % 360 + 0.5e0)) AS dx, sin(radians(id % 360 + 0.5e0)) AS dy, min_x, max_x, min_y, max_y FROM {{points}} p
            JOIN (SELECT f, min(x1) - 1e0 AS min_x, max(x1) + 1e0 AS max_x, min(y1) - 1e0 AS min_y, max(y1) + 1e0 AS max_y FROM {{edges}} GROUP BY f) b ON p.f = b.f) q) r""",
        {"t_in": 5, "t_out": 5},
    )
    nearest = {c: 6 for c in ("t", "arc", "x", "y", "dist")}
    operator("e9_boundary_anchor", _near(), nearest)(lambda t: regions.anchors(t["points"], t["edges"], ["id"]).select("id", "f", "ring", "i", "t", "arc", "x", "y", "dist"))
    operator("e8_nearest_on_region", f"SELECT id, f, x, y, dist FROM ({_near()})", {"x": 6, "y": 6, "dist": 6})(lambda t: regions.anchors(t["points"], t["edges"], ["id"]).select("id", "f", "x", "y", "dist"))
    operator("i6_nearest_argmin", f"SELECT id, f, ring, i FROM ({_near('{clicks}')})")(lambda t: regions.anchors(t["clicks"], t["edges"], ["id"]).select("id", "f", "ring", "i"))
    statement("e10_arc_distance", f"SELECT f, ring, i, least(d, perimeter - d) AS dist FROM (SELECT a.f, a.ring, a.i, a.perimeter, abs(a.arc - a.first) AS d FROM (SELECT *, first_value(arc) OVER (PARTITION BY f, ring ORDER BY i) AS first, sum(len) OVER (PARTITION BY f, ring) AS perimeter FROM ({_ARCS}) z) a) b", {"dist": 6})
    statement(
        "e11_boundary_walk",
        f"""SELECT f, ring, i, forward, CASE WHEN forward THEN i BETWEEN 1 AND 3 ELSE i > 3 OR i = 0 END AS on_walk, x1 AS x, y1 AS y FROM (
            SELECT *, max(CASE WHEN i = 3 THEN arc END) OVER (PARTITION BY f, ring) <= sum(len) OVER (PARTITION BY f, ring) / 2e0 AS forward FROM ({_ARCS}) z) q""",
        {"x": 6, "y": 6},
    )
    operator("e12_ring_distance", f"SELECT id, p.f, e.ring, min({_DIST}) AS dist FROM {{points}} p JOIN {{edges}} e ON p.f = e.f GROUP BY id, p.f, e.ring", {"dist": 6})(lambda t: regions.ring_distances(t["points"], t["edges"], ["id"]))
    statement("e17_segment_projection", f"SELECT id, p.f, e.i, {_T} AS t, {_DIST} AS dist FROM {{clicks}} p JOIN {{outer_edges}} e ON p.f = e.f", {"t": 6, "dist": 6})
    operator("e18_closest_on_contour", f"SELECT id, f, x, y FROM ({_near('{clicks}')}) WHERE ring = 0", {"x": 6, "y": 6})(lambda t: regions.anchors(t["clicks"], t["edges"], ["id"]).where("ring = 0").select("id", "f", "x", "y"))
    px, py = planar.side_point("((goal - e.arc) / e.len)")
    operator(
        "e19_along_contour",
        f"""SELECT id, f, x, y FROM (SELECT g.id, g.f, {px} AS x, {py} AS y, row_number() OVER (PARTITION BY g.id, g.f ORDER BY e.i) AS rn FROM (
            SELECT a.id, a.f, a.ring, ((a.arc + a.id % 50 - 25) % q.perimeter + q.perimeter) % q.perimeter AS goal FROM ({_near()}) a
            JOIN (SELECT f, ring, sum(len) AS perimeter FROM {{edges}} GROUP BY f, ring) q ON a.f = q.f AND a.ring = q.ring) g
            JOIN ({_ARCS}) e ON g.f = e.f AND g.ring = e.ring AND goal >= e.arc AND goal < e.arc + e.len) z WHERE rn = 1""",
        {"x": 4, "y": 4},
    )(lambda t: regions.along_contour(t["points"], t["edges"], ["id"], "id % 50 - 25"))
    statement("e20_corner_count", "SELECT a.f, a.ring, a.i, b.i AS j, least((b.i - a.i + a.n) % a.n, (a.i - b.i + a.n) % a.n) AS corners FROM {edges} a JOIN {edges} b ON a.f = b.f AND a.ring = b.ring")
    meet = planar.meeting(("a.x1", "a.y1", "a.x2", "a.y2"), ("b.x1", "b.y1", "b.x2", "b.y2"))
    hit = planar.segments_meet(("a.x1", "a.y1", "a.x2", "a.y2"), ("b.x1", "b.y1", "b.x2", "b.y2"))
    statement("e23_segment_intersection", f"SELECT a.f, a.i, b.i AS j, {hit} AS meets, CASE WHEN {hit} THEN {meet[0]} END AS t FROM {{outer_edges}} a JOIN {{edges}} b ON a.f = b.f AND b.ring = 1", {"t": 6})
    statement("e26_closed_ring", "SELECT f, ring, i, x, y FROM {region_vertices} UNION ALL SELECT f, ring, n AS i, x, y FROM {region_vertices} WHERE i = 0", {"x": 6, "y": 6})
    statement("p2_ring_close", "SELECT f, ring, count(*) + 1 AS points, max(CASE WHEN i = 0 THEN x END) AS last_x FROM {region_vertices} GROUP BY f, ring", {"last_x": 6})
    covered = f"SELECT id, p.f, max(CASE WHEN {_DIST} <= 1e-9 THEN 1 ELSE 0 END) = 1 OR sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM {{points}} p JOIN {{edges}} e ON p.f = e.f GROUP BY id, p.f"
    operator("c9_point_in_region", covered)(lambda t: regions.inside(t["points"], t["edges"], ["id"]))
    samples = "SELECT id, f, s, px * s / 16e0 AS px, py * s / 16e0 AS py FROM {points} CROSS JOIN (SELECT {explode:0,16} AS s) k"
    operator(
        "c10_chord_inside",
        f"SELECT id, f, min(CASE WHEN inside THEN 1 ELSE 0 END) = 1 AS inside FROM (SELECT id, s, p.f, max(CASE WHEN {_DIST} <= 1e-9 THEN 1 ELSE 0 END) = 1 OR sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM ({samples}) p JOIN {{outer_edges}} e ON p.f = e.f GROUP BY id, s, p.f) q GROUP BY id, f",
    )(lambda t: regions.inside(t.sql(samples), t["outer_edges"], ["id", "s"]).groupBy("id", "f").agg(_expr("min(CASE WHEN inside THEN 1 ELSE 0 END) = 1 AS inside")))
    near = f"SELECT id, p.f, max(CASE WHEN {_DIST} <= 1.4e0 THEN 1 ELSE 0 END) = 1 AS near FROM {{points}} p JOIN {{edges}} e ON p.f = e.f AND e.ring > 0 AND e.n >= 4 GROUP BY id, p.f"
    statement("c12_near_hole", near)
    concave = """SELECT a.f, a.ring, (a.i + 1) % a.n AS i, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) < -1e-6 AS concave
        FROM {edges} a JOIN {edges} b ON a.f = b.f AND a.ring = b.ring AND b.i = (a.i + 1) % a.n"""
    operator("c14_concave_vertex", concave)(lambda t: regions.concave_vertices(t["edges"]))
    statement("c13_near_concave", f"""SELECT a.id, a.f, a.dist <= 5e0 AND (coalesce(c.concave, false) OR coalesce(d.concave, false)) AS near FROM ({_near()}) a
        JOIN (SELECT DISTINCT f, n FROM {{outer_edges}}) m ON a.f = m.f
        LEFT JOIN ({concave}) c ON a.f = c.f AND a.ring = 0 AND c.ring = 0 AND a.i = c.i LEFT JOIN ({concave}) d ON a.f = d.f AND a.ring = 0 AND d.ring = 0 AND (a.i + 1) % m.n = d.i""")
    statement("c11_touches_exclusion", f"SELECT id, bool_or(near) AS touches FROM (SELECT id, {_DIST} <= 1.4e0 AND e.ring > 0 AS near FROM {{points}} p JOIN {{edges}} e ON p.f = e.f) q GROUP BY id")
    statement("c18_point_on_contour", f"SELECT id, p.f, bool_or({_DIST} <= 1e0) AS on_contour FROM {{points}} p JOIN {{outer_edges}} e ON p.f = e.f GROUP BY id, p.f")
    statement("c19_near_duplicate_fixes", "SELECT robot_id, seq, (lat - plat) * (lat - plat) + (lon - plon) * (lon - plon) < 1e-14 AS same FROM (SELECT *, lag(lat) OVER (PARTITION BY robot_id ORDER BY seq) AS plat, lag(lon) OVER (PARTITION BY robot_id ORDER BY seq) AS plon FROM {track}) t WHERE plat IS NOT NULL")
    statement("c27_hit_test", "SELECT p.id, p.f FROM {points} p JOIN (SELECT f, min(x1) AS a, max(x1) AS b, min(y1) AS c, max(y1) AS d FROM {outer_edges} GROUP BY f) r ON p.f = r.f AND px BETWEEN a AND b AND py BETWEEN c AND d")
    pairs = f"SELECT a.f, a.ring, a.i, b.i AS j, {planar.side_point(meet[0], ('a.x1', 'a.y1', 'a.x2', 'a.y2'))[0]} AS x, {planar.side_point(meet[0], ('a.x1', 'a.y1', 'a.x2', 'a.y2'))[1]} AS y FROM {{drawn_edges}} a JOIN {{drawn_edges}} b ON a.f = b.f AND a.ring = b.ring AND b.i > a.i + 1 AND NOT (a.i = 0 AND b.i = a.n - 1) WHERE {hit}"
    operator("f9_self_intersections", pairs, {"x": 6, "y": 6})(lambda t: regions.self_intersections(t["drawn_edges"]))
    statement("g12_intersection_list", f"SELECT e.f, count(p.i) AS n FROM (SELECT DISTINCT f FROM {{drawn_edges}}) e LEFT JOIN ({pairs}) p ON e.f = p.f GROUP BY e.f")
    statement("f10_new_edge_check", f"SELECT a.f, a.i, count(CASE WHEN {hit} THEN 1 END) AS hits FROM {{outer_edges}} a LEFT JOIN {{outer_edges}} b ON a.f = b.f AND b.i < a.i - 1 AND NOT (b.i = 0 AND a.i = a.n - 1) GROUP BY a.f, a.i")
    statement("a3_valid_contours", f"SELECT f FROM (SELECT DISTINCT f FROM {{drawn_edges}}) e WHERE f NOT IN (SELECT f FROM ({pairs}) p)")
    statement("f6_hole_owner", "SELECT h.f, h.ring, min(o.ring) AS owner FROM (SELECT DISTINCT f, ring FROM {edges} WHERE ring > 0) h JOIN (SELECT DISTINCT f, ring FROM {edges} WHERE ring = 0) o ON h.f = o.f GROUP BY h.f, h.ring")
    operator("f14_click_snap", f"SELECT id, f, x, y FROM ({_near('{clicks}')}) WHERE dist <= 1e0 * 10 AND ring = 0", {"x": 6, "y": 6})(lambda t: regions.anchors(t["clicks"], t["edges"], ["id"]).where("dist <= 10e0 AND ring = 0").select("id", "f", "x", "y"))
    statement("g8_ring_counts", "SELECT f, count(CASE WHEN area > 0 THEN 1 END) AS outers, count(CASE WHEN area < 0 THEN 1 END) AS holes FROM (SELECT f, ring, sum(x1 * y2 - x2 * y1) AS area FROM {edges} GROUP BY f, ring) r GROUP BY f")
    statement("g10_geo_extent", "SELECT robot_id, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM {track} GROUP BY robot_id", {c: 9 for c in ("lat_min", "lat_max", "lon_min", "lon_max")})
    statement("h4_cumulative_arc", f"SELECT f, ring, i, arc FROM ({_ARCS}) z", {"arc": 6})
    lat, lon = geo.unproject("(x1 + 4118821e0)", "(y1 - 7361866e0)")
    projection("b25_outline_to_geo", "edges", {"f": "f", "ring": "ring", "i": "i", "lat": (lat, 9), "lon": (lon, 9)})
    statement("b21_build_status", "SELECT f, CASE WHEN n = 0 THEN 'failed' WHEN holes > 0 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT f, count(*) AS n, count(CASE WHEN ring > 0 THEN 1 END) AS holes FROM {edges} GROUP BY f) q")
    statement("p13_cutout_close", "SELECT a.f, a.i, sqrt((a.x2 - b.x1) * (a.x2 - b.x1) + (a.y2 - b.y1) * (a.y2 - b.y1)) <= 1.5e0 AS closes FROM {edges} a JOIN {edges} b ON a.f = b.f AND a.ring = b.ring AND b.i = 0 WHERE a.ring = 1")
    # 1-D set operations on intervals: chords of holes cut from the extent of the contour along d.
    cuts = "SELECT f, min(y1) AS lo, max(y1) AS hi FROM {edges} WHERE ring = 1 GROUP BY f"
    base = "SELECT f, min(y1) AS lo, max(y1) AS hi FROM {outer_edges} GROUP BY f"
    statement("j2_interval_difference", f"SELECT f, lo, hi FROM (SELECT b.f, b.lo, coalesce(least(b.hi, c.lo), b.hi) AS hi FROM ({base}) b LEFT JOIN ({cuts}) c ON b.f = c.f UNION ALL SELECT b.f, greatest(b.lo, c.hi) AS lo, b.hi FROM ({base}) b JOIN ({cuts}) c ON b.f = c.f) q WHERE hi - lo > 2e-3", {"lo": 6, "hi": 6})
    spans = "SELECT f, i, least(y1, y2) AS lo, greatest(y1, y2) AS hi FROM {edges}"
    statement("j1_interval_union", f"""SELECT f, min(lo) AS lo, max(hi) AS hi, count(*) AS parts FROM (SELECT *, sum(fresh) OVER (PARTITION BY f ORDER BY lo, hi, i, ring ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY f ORDER BY lo, hi, i, ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) THEN 1 ELSE 0 END AS fresh
        FROM (SELECT f, ring, i, least(y1, y2) + 1e0 AS lo, greatest(y1, y2) - 1e0 AS hi FROM {{edges}}) s WHERE hi > lo) q) r GROUP BY f, g""", {"lo": 6, "hi": 6})
    statement("j3_interval_intersection", f"SELECT a.f, a.i, b.i AS j, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ({spans}) a JOIN ({spans}) b ON a.f = b.f AND a.i < b.i AND least(a.hi, b.hi) > greatest(a.lo, b.lo)", {"lo": 6, "hi": 6})


def _expr(text: str):
    from pyspark.sql import functions as F

    return F.expr(text)
