"""Queries of overlays, regions of several outer rings, and sweeps in passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..operators import arrangement, passes, regions, sweep
from ..sources.fixtures import Tables
from .planner import C, Stages, _sql
from .spec import operator

# Area of a simple ring inside a rectangle, by its sides: the integral of the height cut to [py1, py2] over the width cut to [px1, px2].
_CLIPPED = """SELECT f, kind, px1, px2, py1, py2, greatest(px1, least(px2, x1)) AS ux, greatest(px1, least(px2, x2)) AS vx,
    CASE WHEN abs(x2 - x1) < 1e-12 THEN y1 ELSE y1 + (greatest(px1, least(px2, x1)) - x1) / (x2 - x1) * (y2 - y1) END AS uy,
    CASE WHEN abs(x2 - x1) < 1e-12 THEN y2 ELSE y1 + (greatest(px1, least(px2, x2)) - x1) / (x2 - x1) * (y2 - y1) END AS vy
    FROM (SELECT e.*, kind, px1, px2, py1, py2 FROM {outer_edges} e JOIN {patches} p ON e.f = p.f) s"""


def _primitive(y: str) -> str:
    return f"(CASE WHEN {y} < py1 THEN py1 * {y} WHEN {y} > py2 THEN py2 * {y} + (py1 * py1 - py2 * py2) / 2e0 ELSE ({y} * {y} + py1 * py1) / 2e0 END)"


_SIZES = f"""SELECT q.f, kind, a, b, common FROM (SELECT f, sum(x1 * y2 - x2 * y1) / 2e0 AS a FROM {{outer_edges}} GROUP BY f) o JOIN (
    SELECT f, kind, max((px2 - px1) * (py2 - py1)) AS b, -sum((vx - ux) * CASE WHEN abs(vy - uy) < 1e-9 THEN greatest(py1, least(py2, uy)) ELSE ({_primitive('vy')} - {_primitive('uy')}) / (vy - uy) END) AS common
    FROM ({_CLIPPED}) c GROUP BY f, kind) q ON o.f = q.f"""
#: Outer rings and holes of each operation, by the kind of the rectangle.
_COUNTS = {
    "union": {"hole": (1, 0), "road": (1, 0), "bite": (1, 0)},
    "intersection": {"hole": (1, 0), "road": (1, 0), "bite": (1, 0)},
    "difference": {"hole": (1, 1), "road": (2, 0), "bite": (1, 0)},
    "xor": {"hole": (1, 1), "road": (4, 0), "bite": (2, 0)},
}
_AREAS = {"union": "a + b - common", "intersection": "common", "difference": "a - common", "xor": "a + b - 2e0 * common"}
#: By fill rule: with both rings in one direction, and with the rectangle turned round.
_RULES = {"evenodd": ("a + b - 2e0 * common",) * 2, "nonzero": ("a + b - common", "a + b - 2e0 * common"), "positive": ("a + b - common", "a - common"), "negative": ("0e0", "b - common")}


def _both(t: Tables):
    """Contours as operand 0, rectangles as operand 1."""
    a, b = t["field_vertices"].withColumn("op", F.lit(0)), t["patch_vertices"].withColumn("op", F.lit(1))
    return a.unionByName(b).withColumn("ring", F.lit(0))


def _sizes(rings, key: list[str]):
    """Area, outer rings and holes of each result."""
    stats = arrangement.edges_of(rings) if "result" not in rings.columns else _edges(rings)
    each = stats.groupBy(*key, "ring").agg(F.expr("sum(x1 * y2 - x2 * y1) / 2e0").alias("area"))
    return each.groupBy(*key).agg(F.sum("area").alias("area"), F.count_if(F.col("area") > 0).cast("int").alias("outers"), F.count_if(F.col("area") < 0).cast("int").alias("holes"))


def _edges(rings):
    a, b = rings.alias("a"), rings.alias("b")
    joined = a.join(b, F.expr("a.f = b.f AND a.result = b.result AND a.ring = b.ring AND b.i = (a.i + 1) % a.n"))
    return joined.selectExpr("a.f", "a.result", "a.ring", "a.i", "a.n", "a.x AS x1", "a.y AS y1", "b.x AS x2", "b.y AS y2")


def _turned(t: Tables):
    """Contour and rectangle as rings of one operand, the rectangle turned round in fields of odd number."""
    patch = t["patch_vertices"].selectExpr("f", "1 AS ring", "IF(f % 2 = 1, 3 - i, i) AS i", "n", "x", "y")
    return t["field_vertices"].selectExpr("f", "0 AS ring", "i", "n", "x", "y").unionByName(patch).withColumn("op", F.lit(0))


def _clip(spans: str, columns: str = "") -> str:
    """Sides between the ends of intervals, as (f, columns, x1, y1, x2, y2) along and across."""
    at = lambda d: f"CASE WHEN d2 = d1 THEN a1 ELSE a1 + ({d} - d1) / (d2 - d1) * (a2 - a1) END"
    p, q = "greatest(lo, least(hi, d1))", "greatest(lo, least(hi, d2))"
    return f"SELECT s.f{columns}, {at(p)} AS x1, {p} AS y1, CASE WHEN d2 = d1 THEN a2 ELSE {at(q)} END AS x2, {q} AS y2 FROM sides s JOIN {spans} r ON s.f = r.f AND least(d1, d2) <= hi AND greatest(d1, d2) >= lo"


def _pass_sql(p: int) -> dict[str, str]:
    """One pass in SQL, as common tables: all fields go through all six, but one that has stopped has no rows in them."""
    small, half = passes.least_area(C), passes.half_band(C)
    t = planar.side_t("sa", "sd")
    cut = """SELECT f, k, d, a AS a0, lead(a) OVER w AS a1, row_number() OVER w AS rn FROM (SELECT s.f, l.k, l.d, s.ring, s.i, s.a1 + (l.d - s.d1) / (s.d2 - s.d1) * (s.a2 - s.a1) AS a
        FROM sides s JOIN {} l ON s.f = l.f AND (s.d1 > l.d) <> (s.d2 > l.d)) x WINDOW w AS (PARTITION BY f, k ORDER BY a, ring, i)"""
    chords = cut.format(f"(SELECT f, d, row_number() OVER (PARTITION BY f ORDER BY d) AS k FROM (SELECT f, lo AS d FROM left{p} UNION SELECT f, hi FROM left{p}) e)")
    return {
        f"anchor{p}": f"""SELECT f, arg_min(place, (dist, place)) AS anchor FROM (SELECT b.f, round({planar.side_distance('sa', 'sd')}, 6) AS dist, round({planar.side_point(t)[1]}, 9) AS place
            FROM ({_clip(f'left{p}')} UNION ALL SELECT f, a0, d, a1, d FROM ({chords}) c WHERE rn % 2 = 1 AND a1 IS NOT NULL) b JOIN starts g ON b.f = g.f) q GROUP BY f""",
        f"lines{p}": f"""SELECT z.f, z.k, min(CASE WHEN spot >= lo - 2e-6 AND spot <= hi + 2e-6 THEN least(greatest(spot + 1e-6, lo + 1e-6), hi - 1e-6) END) AS d FROM (
            SELECT f, k, anchor + k * {C.step}e0 AS spot FROM (SELECT r.f, anchor, min(lo) AS first, max(hi) AS last FROM left{p} r JOIN anchor{p} a ON r.f = a.f GROUP BY r.f, anchor) o
            JOIN (SELECT {{explode:-99,99}} AS k) n ON k >= -floor((greatest(anchor, first) - first) / {C.step}e0 + 1e-9) AND k <= floor((greatest(anchor, last) - anchor) / {C.step}e0 + 1e-9)) z JOIN left{p} r ON z.f = r.f GROUP BY z.f, z.k""",
        f"cuts{p}": f"SELECT f, k, d, a0, a1, a1 - a0 AS len FROM ({cut.format(f'(SELECT * FROM lines{p} WHERE d IS NOT NULL)')}) c WHERE rn % 2 = 1 AND a1 IS NOT NULL AND a1 - a0 >= 0.05e0",
        f"bands{p}": f"SELECT DISTINCT f, k, d, d - {half}e0 AS lo, d + {half}e0 AS hi FROM cuts{p}",
        f"rest{p}": f"""SELECT f, lo, hi FROM (SELECT f, spot AS lo, lead(spot) OVER w AS hi, sum(o) OVER w AS o, sum(t) OVER w AS t FROM (SELECT f, spot, sum(o) AS o, sum(t) AS t FROM (
            SELECT f, lo AS spot, 1 AS o, 0 AS t FROM left{p} UNION ALL SELECT f, hi, -1, 0 FROM left{p} UNION ALL SELECT f, lo, 0, 1 FROM bands{p} UNION ALL SELECT f, hi, 0, -1 FROM bands{p}) m GROUP BY f, spot) e
            WINDOW w AS (PARTITION BY f ORDER BY spot)) z WHERE hi IS NOT NULL AND o > 0 AND t = 0 AND hi - lo > 2e-3""",
        f"took{p}": f"SELECT f, k, d, abs(sum((y2 - y1) * (x1 + x2) / 2e0)) AS area FROM ({_clip(f'(SELECT b.f, k, d, greatest(b.lo, r.lo) AS lo, least(b.hi, r.hi) AS hi FROM bands{p} b JOIN left{p} r ON b.f = r.f AND b.lo < r.hi AND b.hi > r.lo)', ', r.k, r.d')}) z GROUP BY f, k, d",
        f"pass{p}": f"""SELECT g.f, rows + lines AS rows, coalesce(segments, 0) AS segments, CASE WHEN segments > 0 THEN coalesce(now, 0e0) ELSE area END AS area, CASE WHEN area - coalesce(now, 0e0) < {0.1 * small}e0 THEN stalled + 1 ELSE 0 END AS stalled, coalesce(segments, 0) > 0 AS counted
            FROM state{p} g JOIN (SELECT f, count(*) AS lines FROM lines{p} GROUP BY f) l ON g.f = l.f LEFT JOIN (SELECT f, count(*) AS segments FROM cuts{p} GROUP BY f) c ON g.f = c.f
            LEFT JOIN (SELECT f, abs(sum((y2 - y1) * (x1 + x2) / 2e0)) AS now FROM ({_clip(f'rest{p}')}) z GROUP BY f) a ON g.f = a.f""",
        f"state{p + 1}": f"SELECT f, area, stalled, rows FROM pass{p} WHERE counted AND area > {small}e0 AND stalled < {passes.STALLED}",
        f"left{p + 1}": f"SELECT * FROM rest{p} WHERE f IN (SELECT f FROM state{p + 1})",
        f"over{p}": f"SELECT * FROM rest{p} WHERE f IN (SELECT f FROM pass{p} WHERE counted) {'' if p + 1 == passes.MOST else f'AND f NOT IN (SELECT f FROM state{p + 1})'} UNION ALL SELECT * FROM left{p} WHERE f IN (SELECT f FROM pass{p} WHERE NOT counted)",
    }


def _sweep_sql(query: str, each: str) -> str:
    """``each`` is the row source of pass {p}; ``query`` selects from ``every``, the union of all."""
    first = _sql("SELECT 1", "sides", "nested_edges").removesuffix("SELECT 1").rstrip()
    tables = {
        "starts": "SELECT f, a1 AS sa, d1 AS sd FROM sides WHERE ring = 0 AND i = 0",
        "left0": """SELECT f, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY f ORDER BY lo, hi, ring ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY f ORDER BY lo, hi, ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) THEN 1 ELSE 0 END AS fresh
            FROM (SELECT f, ring, min(d1) AS lo, max(d1) AS hi FROM sides GROUP BY f, ring) r) m) z GROUP BY f, island""",
        "state0": f"SELECT f, abs(sum((y2 - y1) * (x1 + x2) / 2e0)) AS area, 0 AS stalled, 0 AS rows FROM ({_clip('left0')}) z GROUP BY f",
    }
    for p in range(passes.MOST):
        tables |= _pass_sql(p)
    every = _union([each.format(p=p) for p in range(passes.MOST)])
    return f"{first}, {', '.join(f'{n} AS MATERIALIZED ({q})' for n, q in tables.items())} {query.format(every=f'({every}) z')}"


def _swept(t: Tables) -> passes.Swept:
    sides = sweep.in_sweep_frame(t["nested_edges"])
    return passes.swept(sides, sides.where("ring = 0 AND i = 0").selectExpr("f", "a1 AS sa", "d1 AS sd"))


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def register() -> None:
    by_kind = lambda how, k: f"CASE kind {' '.join(f'WHEN {chr(39)}{kind}{chr(39)} THEN {n[k]}' for kind, n in _COUNTS[how].items())} END"
    overlays = _union([f"SELECT f, kind, '{how}' AS result, {_AREAS[how]} AS area, {by_kind(how, 0)} AS outers, {by_kind(how, 1)} AS holes FROM sizes" for how in _COUNTS])

    @operator("e21_overlay_areas", f"WITH sizes AS MATERIALIZED ({_SIZES}) {overlays}", {"area": 2})
    def overlay_areas(t: Tables):
        found = _sizes(arrangement.overlaid(_both(t), {how: (how, "nonzero") for how in _COUNTS}), ["f", "result"])
        return found.join(t["patches"].select("f", "kind"), "f").select("f", "kind", "result", "area", "outers", "holes")

    rules = _union([f"SELECT f, '{rule}' AS result, CASE WHEN f % 2 = 1 THEN {turned} ELSE {same} END AS area FROM sizes" for rule, (same, turned) in _RULES.items()])

    @operator("e22_fill_rules", f"WITH sizes AS MATERIALIZED ({_SIZES}) SELECT * FROM ({rules}) z WHERE area > 1e-3", {"area": 2})
    def fill_rules(t: Tables):
        return _sizes(arrangement.overlaid(_turned(t), {rule: ("union", rule) for rule in _RULES}), ["f", "result"]).select("f", "result", "area")

    @operator("e16_cutout_preview", f"SELECT f, a - common AS area, CAST({by_kind('difference', 0)} AS INT) AS outers, kind = 'road' AS multi FROM ({_SIZES}) z", {"area": 2})
    def cutout_preview(t: Tables):
        found = _sizes(arrangement.overlaid(_both(t), {"left": ("difference", "nonzero")}), ["f", "result"])
        return found.select("f", "area", "outers", (F.col("outers") > 1).alias("multi"))

    @operator("p1_simple_regions", "SELECT f, sum(x1 * y2 - x2 * y1) / 2e0 AS area, sum(len) AS perimeter FROM {outer_edges} GROUP BY f", {"area": 2, "perimeter": 2})
    def simple_regions(t: Tables):
        given = t["field_vertices"].selectExpr("f", "0 AS op", "0 AS ring", "IF(f % 2 = 1, n - 1 - i, i) AS i", "n", "x", "y")  # drawn either way round
        stats = regions.ring_stats(arrangement.edges_of(arrangement.overlaid(given, {"region": ("union", "nonzero")}).drop("result")))
        return stats.groupBy("f").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))

    stats = "SELECT f, ring, abs(sum(x1 * y2 - x2 * y1)) / 2e0 AS size, sum(len) AS perimeter FROM {nested_edges} GROUP BY f, ring"
    holds = f"""SELECT p.f, p.ring AS own, s.ring FROM (SELECT f, ring, x1 AS px, y1 AS py FROM {{nested_edges}} WHERE i = 0) p JOIN {{nested_edges}} s ON p.f = s.f AND p.ring <> s.ring
        GROUP BY p.f, p.ring, s.ring HAVING sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) % 2 = 1"""
    forest = f"""SELECT s.f, s.ring, a.parent, CAST(coalesce(a.depth, 0) AS INT) AS depth, coalesce(a.depth, 0) % 2 = 0 AS outer_ring, size, perimeter FROM ({stats}) s LEFT JOIN (
        SELECT h.f, own, count(*) AS depth, arg_min(h.ring, size) AS parent FROM ({holds}) h JOIN ({stats}) t ON h.f = t.f AND h.ring = t.ring GROUP BY h.f, own) a ON s.f = a.f AND s.ring = a.own"""
    nested = f"""SELECT f, ring, parent, depth, outer_ring, CASE WHEN outer_ring THEN ring ELSE parent END AS path, CASE WHEN outer_ring THEN size ELSE -size END AS area, perimeter,
        outer_ring AND size = max(CASE WHEN outer_ring THEN size END) OVER (PARTITION BY f) AS largest FROM ({forest}) z"""
    operator("e1_region_rings", nested, {"area": 6, "perimeter": 6})(lambda t: regions.nesting(t["nested_edges"]).withColumnRenamed("outer", "outer_ring"))
    paths = f"SELECT e.f, e.ring, e.i, n.path FROM {{nested_edges}} e JOIN ({nested}) n ON e.f = n.f AND e.ring = n.ring"
    operator("e1_side_paths", paths)(lambda t: t["nested_edges"].join(regions.nesting(t["nested_edges"]).select("f", "ring", "path"), ["f", "ring"]).select("f", "ring", "i", "path"))

    owner = f"""SELECT n.f, n.node, coalesce(o.ring, g.ring) AS ring FROM nodes n JOIN forest g ON n.f = g.f AND g.largest LEFT JOIN (
        SELECT h.f, node, min(h.ring) AS ring FROM (SELECT p.f, node, s.ring FROM nodes p JOIN sides s ON p.f = s.f GROUP BY p.f, node, s.ring HAVING sum(CASE WHEN {planar.crosses('mx', 'my')} THEN 1 ELSE 0 END) % 2 = 1) h
        JOIN forest r ON h.f = r.f AND h.ring = r.ring AND r.outer_ring GROUP BY h.f, node) o ON n.f = o.f AND n.node = o.node"""
    owned = _sql("SELECT 1", "nodes", "nested_edges").removesuffix("SELECT 1").rstrip() + f", forest AS MATERIALIZED ({nested}) {owner}"

    @operator("f8_stripe_owner", owned)
    def stripe_owner(t: Tables):
        s = Stages(t, source="nested_edges")
        return regions.owners(s.nodes.selectExpr("f", "node", "mx AS px", "my AS py"), s.edges, ["node"])

    by_pass = {"d": 4, "a0": 4, "a1": 4, "len": 4, "area": 2, "lo": 4, "hi": 4}
    only = lambda *names: {n: by_pass[n] for n in names}
    operator("s2_sweep_lines", _sweep_sql("SELECT * FROM {every}", "SELECT f, {p} AS pass, k, d, a0, a1, len FROM cuts{p}"), only("d", "a0", "a1", "len"))(lambda t: _swept(t).stripes.select("f", "pass", "k", "d", "a0", "a1", "len"))
    operator("s2_sweep_passes", _sweep_sql("SELECT f, CAST(count(CASE WHEN counted THEN 1 END) AS INT) AS passes, max(rows) AS rows, CAST(sum(segments) AS BIGINT) AS stripes, min(area) AS area FROM {every} GROUP BY f", "SELECT *, {p} AS pass FROM pass{p}"), only("area"))(
        lambda t: _swept(t).passes.groupBy("f").agg(F.count_if("counted").cast("int").alias("passes"), F.max("rows").alias("rows"), F.sum("segments").alias("stripes"), F.min("area").alias("area"))
    )
    operator("j4_residual_intervals", _sweep_sql("SELECT * FROM {every}", "SELECT f, lo, hi FROM over{p}"), only("lo", "hi"))(lambda t: _swept(t).left)
    operator("e13_band_cover", _sweep_sql("SELECT * FROM {every}", "SELECT f, {p} AS pass, k, d, area FROM took{p}"), only("d", "area"))(lambda t: _swept(t).bands)
