"""Queries of the coverage planner."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, planar
from ..operators import arrangement, graph, passes, regions, routes, sweep
from ..sources.fixtures import Tables
from ..sources.scratch import kept, written
from .spec import operator

C = sweep.PlanConfig()
_A = sweep.ANGLE
_SIDES = f"SELECT *, x1 * sin({_A}) - y1 * cos({_A}) AS a1, x2 * sin({_A}) - y2 * cos({_A}) AS a2, x1 * cos({_A}) + y1 * sin({_A}) AS d1, x2 * cos({_A}) + y2 * sin({_A}) AS d2 FROM {{edges}}"
_LINES = f"""SELECT f, k, d0 + k * 4.0e0 + {sweep.NUDGE} AS d FROM (SELECT f, min(d1) AS lo, max(d1) AS hi, max(CASE WHEN ring = 0 AND i = 0 THEN d1 END) AS d0 FROM sides GROUP BY f) e
    JOIN (SELECT {{explode:-64,64}} AS k) n ON k >= ceil((lo - d0) / 4e0) AND k <= floor((hi - d0) / 4e0)"""
_CUT = """SELECT f, k, d, a0, a1, a1 - a0 AS len FROM (SELECT f, k, d, a AS a0, lead(a) OVER w AS a1, row_number() OVER w AS rn FROM (
    SELECT s.f, l.k, l.d, s.ring, s.i, s.a1 + (l.d - s.d1) / (s.d2 - s.d1) * (s.a2 - s.a1) AS a FROM sides s JOIN lines l ON s.f = l.f AND (s.d1 > l.d) <> (s.d2 > l.d)) x
    WINDOW w AS (PARTITION BY f, k ORDER BY a, ring, i)) p WHERE rn % 2 = 1 AND a1 IS NOT NULL AND a1 - a0 >= 0.05e0"""
_ROWED = "SELECT *, CAST(dense_rank() OVER (PARTITION BY f ORDER BY k) - 1 AS INT) AS row FROM stripes"
_SUPPORTED = f"""SELECT * FROM rowed WHERE len >= {C.min_useful}e0 UNION ALL SELECT * FROM rowed s WHERE len < {C.min_useful}e0 AND len >= {0.55 * C.min_useful}e0
    AND EXISTS (SELECT 1 FROM rowed o WHERE o.f = s.f AND o.row = s.row - 1 AND least(o.a1, s.a1) - greatest(o.a0, s.a0) >= -0.48e0)
    AND EXISTS (SELECT 1 FROM rowed o WHERE o.f = s.f AND o.row = s.row + 1 AND least(o.a1, s.a1) - greatest(o.a0, s.a0) >= -0.48e0)"""
_NODES = f"""SELECT f, CAST(row_number() OVER (PARTITION BY f ORDER BY row, a0) - 1 AS INT) AS node, row, d, a0, a1, len,
    {", ".join(f"{a} * sin({_A}) + d * cos({_A}) AS {n}x, -({a}) * cos({_A}) + d * sin({_A}) AS {n}y" for n, a in (("s", "a0"), ("e", "a1"), ("m", "(a0 + a1) / 2")))}
    FROM (SELECT * EXCLUDE (row), CAST(dense_rank() OVER (PARTITION BY f ORDER BY row) - 1 AS INT) AS row FROM kept) q"""
_EXCL = f"""SELECT n.*, coalesce(e.near, false) AS excl FROM nodes n LEFT JOIN (SELECT p.f, node, min({planar.side_distance('px', 'py')}) <= {C.near_hole}e0 AS near FROM (
    SELECT f, node, sx AS px, sy AS py FROM nodes UNION ALL SELECT f, node, ex, ey FROM nodes UNION ALL SELECT f, node, mx, my FROM nodes) p JOIN sides s ON p.f = s.f AND s.ring > 0 GROUP BY p.f, node) e ON n.f = e.f AND n.node = e.node"""
_CLUSTERED = """SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY f ORDER BY row, a0, a1 ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS cluster FROM (
    SELECT *, CASE WHEN coalesce(a0 > max(a1) OVER (PARTITION BY f, row ORDER BY a0, a1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.05e0 OR excl <> lag(excl) OVER (PARTITION BY f, row ORDER BY a0, a1), true) THEN 1 ELSE 0 END AS fresh FROM flagged) q"""
_LINKS = f"""SELECT f, src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY f, src ORDER BY score, dst) AS rank FROM (
    SELECT a.f, a.node AS src, b.node AS dst, abs((b.a0 + b.a1 - a.a0 - a.a1) / 2) / 4e0 * 1e0 + {C.weight_across}e0 * abs(abs(b.d - a.d) - 4e0) / 4e0 AS score,
    least(a.a1, b.a1) - greatest(a.a0, b.a0) AS overlap, abs((b.a0 + b.a1 - a.a0 - a.a1) / 2) AS along, abs(abs(b.d - a.d) - 4e0) AS mismatch
    FROM clustered a JOIN clustered b ON a.f = b.f AND b.row = a.row + 1 AND a.excl = b.excl) q WHERE (overlap >= -4e0 OR along <= 4e0) AND mismatch <= 4e0 AND score <= 3.4e0) r WHERE rank <= 4"""
_PAIRS = "SELECT DISTINCT l.f, least(a.cluster, b.cluster) AS a, greatest(a.cluster, b.cluster) AS b FROM links l JOIN clustered a ON l.f = a.f AND l.src = a.node JOIN clustered b ON l.f = b.f AND l.dst = b.node WHERE a.cluster <> b.cluster"
_REACH = "SELECT f, cluster AS v, cluster AS w FROM (SELECT DISTINCT f, cluster FROM clustered) c UNION SELECT r.f, r.v, CASE WHEN p.a = r.w THEN p.b ELSE p.a END AS w FROM reach r JOIN pairs p ON r.f = p.f AND (p.a = r.w OR p.b = r.w)"
_COMPS = "SELECT n.*, CAST(dense_rank() OVER (PARTITION BY n.f ORDER BY m.least) - 1 AS INT) AS comp FROM clustered n JOIN (SELECT f, v, min(w) AS least FROM reach GROUP BY f, v) m ON n.f = m.f AND n.cluster = m.v"
_STATS = "SELECT f, comp, min(row) AS min_row, max(row) AS max_row, avg(mx) AS cx, avg(my) AS cy, count(*) AS size, min(least(a0, a1)) AS lo, max(greatest(a0, a1)) AS hi, bool_or(excl) AS excl FROM comps GROUP BY f, comp"
_ARCS = "SELECT *, coalesce(sum(len) OVER (PARTITION BY f, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS arc, sum(len) OVER (PARTITION BY f, ring) AS total FROM sides"
# Closed forms where rings neither meet nor fold: the given contours and cutouts. A ring's corners move along both sides' normals;
# at corners that point into the region and are sharper than the mitre's limit there are two places, one for each side.
_CORNERS = "SELECT f, ring, i, n, x, y, x - px AS ax, y - py AS ay, nx - x AS cx, ny - y AS cy FROM (SELECT *, lag(x, 1, fx_last) OVER w AS px, lag(y, 1, fy_last) OVER w AS py, lead(x, 1, fx) OVER w AS nx, lead(y, 1, fy) OVER w AS ny FROM (SELECT *, first_value(x) OVER u AS fx, first_value(y) OVER u AS fy, last_value(x) OVER u AS fx_last, last_value(y) OVER u AS fy_last FROM {region_vertices} WINDOW u AS (PARTITION BY f, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) a WINDOW w AS (PARTITION BY f, ring ORDER BY i)) b"
_NORMALS = "SELECT f, ring, i, x, y, -ay / sqrt(ax * ax + ay * ay) AS mx, ax / sqrt(ax * ax + ay * ay) AS my, -cy / sqrt(cx * cx + cy * cy) AS ox, cx / sqrt(cx * cx + cy * cy) AS oy, ax * cy - ay * cx < 0 AS dent FROM corners"
_MOVED = f"""SELECT f, ring, i, unnest(CASE WHEN dent AND c < 0.25e0 THEN [{{'s': 0, 'x': x + {C.offset}e0 * mx, 'y': y + {C.offset}e0 * my}}, {{'s': 1, 'x': x + {C.offset}e0 * ox, 'y': y + {C.offset}e0 * oy}}]
    ELSE [{{'s': 0, 'x': x + {C.offset}e0 * (mx + ox) / c, 'y': y + {C.offset}e0 * (my + oy) / c}}] END) AS m FROM (SELECT *, 1e0 + mx * ox + my * oy AS c FROM normals) z"""


def _ring_stats(source: str) -> str:
    """Area and perimeter of rings of (f, ring, i, s, x, y)."""
    near = "lead({0}, 1, first_{0}) OVER (PARTITION BY f, ring ORDER BY i, s) AS {0}2"
    first = "first_value({0}) OVER (PARTITION BY f, ring ORDER BY i, s) AS first_{0}"
    return f"SELECT f, ring, sum(x * y2 - x2 * y) / 2e0 AS area, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS perimeter FROM (SELECT *, {near.format('x')}, {near.format('y')} FROM (SELECT *, {first.format('x')}, {first.format('y')} FROM {source}) p) q GROUP BY f, ring"


_GIVEN = _ring_stats("(SELECT *, 0 AS s FROM {region_vertices})")
_INSET = f"WITH corners AS ({_CORNERS}), normals AS ({_NORMALS}), moved AS ({_MOVED}), inset AS ({_ring_stats('(SELECT f, ring, i, m.s, m.x, m.y FROM moved)')})"
_CTES = {"sides": _SIDES, "lines": _LINES, "stripes": _CUT, "rowed": _ROWED, "kept": _SUPPORTED, "nodes": _NODES, "flagged": _EXCL, "clustered": _CLUSTERED, "links": _LINKS, "pairs": _PAIRS, "reach": _REACH, "comps": _COMPS, "stats": _STATS}


def _sql(text: str, upto: str, edges: str = "edges") -> str:
    names = list(_CTES)
    used = names[: names.index(upto) + 1]
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({_CTES[n]})' for n in used)} {text}".replace("{edges}", f"{{{edges}}}")


class Step(NamedTuple):
    """One table of a plan: the stage it belongs to, what makes it from the plan's other tables, and what is counted as it is written (SQL aggregates)."""

    stage: int
    make: Callable[[Steps], DataFrame]
    counts: dict[str, str]


class Steps:
    """Tables of a plan by name, made when they are first asked for.

    A table is kept for the whole application under a digest of the given tables'
    files and the configuration, so queries share the stages that they have in
    common, and another configuration or another input has tables of its own.
    """

    STEPS: dict[str, Step] = {}

    def __init__(self, t: Tables, c: sweep.PlanConfig = C, source: str = "edges"):
        self.t, self.c, self.source = t, c, source
        self.key = (type(self).__name__, t.fingerprint("supplier"), repr(c), source)

    def _kept(self, name: str) -> tuple[DataFrame, dict[str, float]]:
        step = self.STEPS[name]
        return kept(self.t.spark, (*self.key, name), lambda: step.make(self), step.counts)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.STEPS:
            raise AttributeError(name)
        return self._kept(name)[0]

    def metrics(self) -> list[tuple[int, str, str, float]]:
        """(stage, table, key, value) of all steps, as observed when they were made."""
        return [(step.stage, name, k, v) for name, step in self.STEPS.items() if step.counts for k, v in self._kept(name)[1].items()]


_ROWS = "count(*)"


class Stages(Steps):
    """The planner over raw regions (no inset)."""

    STEPS = {
        "edges": Step(0, lambda p: p.t[p.source], {}),
        "stripes": Step(1, lambda p: sweep.cut(p.sides, p.lines), {}),
        "rowed": Step(2, lambda p: sweep.rowed(p.stripes), {}),
        "nodes": Step(2, lambda p: sweep.numbered(p.kept), {}),
        "clustered": Step(3, lambda p: graph.clusters(sweep.touching(p.nodes, p.edges)), {}),
        "comps": Step(3, lambda p: graph.components(p.clustered, p.links), {}),
    }

    @property
    def sides(self):
        return sweep.in_sweep_frame(self.edges)

    @property
    def lines(self):
        return sweep.lines(self.sides)

    @property
    def kept(self):
        return sweep.supported(self.rowed)

    @property
    def links(self):
        return graph.row_links(self.clustered)


def register() -> None:
    def op(name: str, text: str | None, upto: str, rounded: dict[str, int] | None = None):
        return operator(name, _sql(text, upto) if text else None, rounded)

    op("g6_extent_across", "SELECT f, min(d1) AS lo, max(d1) AS hi FROM sides GROUP BY f", "sides", {"lo": 6, "hi": 6})(lambda t: sweep.in_sweep_frame(t["edges"]).groupBy("f").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")))
    cut = {"d": 5, "a0": 5, "a1": 5, "len": 5}
    op("e7_line_region_intersection", "SELECT f, k, d, a0, a1, len FROM stripes", "stripes", cut)(lambda t: Stages(t).stripes)
    op("h2_distinct_rows", "SELECT f, min(d) AS d FROM stripes GROUP BY f, k", "stripes", {"d": 5})(lambda t: sweep.distinct_rows(Stages(t).stripes))
    row = lambda *order: F.row_number().over(Window.partitionBy("f", "row").orderBy(*order))
    op("i2_along_sort", "SELECT f, node, row, row_number() OVER (PARTITION BY f, row ORDER BY (a0 + a1) / 2, node) AS pos FROM nodes", "nodes")(lambda t: Stages(t).nodes.select("f", "node", "row", row(F.expr("(a0 + a1) / 2"), "node").alias("pos")))
    op("h10_alternation", "SELECT f, node, row, dense_rank() OVER (PARTITION BY f ORDER BY row) % 2 = 1 AS forward FROM nodes", "nodes")(lambda t: sweep.alternated(Stages(t).nodes).select("f", "node", "row", "forward"))
    op("h11_orientation", "SELECT f, node, CASE WHEN row % 2 = 0 THEN a0 ELSE a1 END AS from_a, CASE WHEN row % 2 = 0 THEN a1 ELSE a0 END AS to_a FROM nodes", "nodes", {"from_a": 5, "to_a": 5})(
        lambda t: sweep.alternated(Stages(t).nodes).selectExpr("f", "node", "IF(forward, a0, a1) AS from_a", "IF(forward, a1, a0) AS to_a")
    )
    op("h3_row_of_stripe", "SELECT f, k, a0, row FROM rowed", "rowed", {"a0": 5})(lambda t: Stages(t).rowed.select("f", "k", "a0", "row"))
    op("j6_duplicate_distances", "SELECT f, k, min(d) AS d FROM stripes GROUP BY f, k", "stripes", {"d": 5})(lambda t: Stages(t).stripes.groupBy("f", "k").agg(F.min("d").alias("d")))
    op("f1_neighbour_support", "SELECT f, k, a0, len FROM kept", "kept", {"a0": 5, "len": 5})(lambda t: Stages(t).kept.select("f", "k", "a0", "len"))
    op("s3_filter", "SELECT f, node, row, d, a0, a1 FROM nodes", "nodes", {"d": 5, "a0": 5, "a1": 5})(lambda t: Stages(t).nodes.select("f", "node", "row", "d", "a0", "a1"))
    op("i1_stripe_order", "SELECT f, node, row FROM nodes", "nodes")(lambda t: Stages(t).nodes.select("f", "node", "row"))
    op("c23_along_overlap", "SELECT a.f, a.node AS a, b.node AS b, least(a.a1, b.a1) > greatest(a.a0, b.a0) + 0.5e0 AS over FROM nodes a JOIN nodes b ON a.f = b.f AND b.row = a.row + 1", "nodes")(
        lambda t: _pairs(Stages(t).nodes).selectExpr("f", "a", "b", "least(a1, b1) > greatest(a0, b0) + 0.5e0 AS over")
    )
    op("c22_rows_contiguous", "SELECT a.f, a.node AS a, b.node AS b, abs(a.row - b.row) <= 1 AS near FROM nodes a JOIN nodes b ON a.f = b.f AND b.node = a.node + 1", "nodes")(
        lambda t: (lambda n: n.alias("a").join(n.alias("b"), F.expr("a.f = b.f AND b.node = a.node + 1")))(Stages(t).nodes).selectExpr("a.f", "a.node AS a", "b.node AS b", "abs(a.row - b.row) <= 1 AS near")
    )
    op("h1_row_clusters", "SELECT f, node, cluster FROM clustered", "clustered")(lambda t: Stages(t).clustered.select("f", "node", "cluster"))
    op("g5_cluster_exclusion", "SELECT f, cluster, bool_or(excl) AS excl FROM clustered GROUP BY f, cluster", "clustered")(lambda t: Stages(t).clustered.groupBy("f", "cluster").agg(F.bool_or("excl").alias("excl")))
    gate = "SELECT a.f, a.node AS a, b.node AS b, (least(a.a1, b.a1) - greatest(a.a0, b.a0) >= -4e0 OR abs((b.a0 + b.a1 - a.a0 - a.a1) / 2) <= 4e0) AND abs(abs(b.d - a.d) - 4e0) <= 4e0 AS gate FROM nodes a JOIN nodes b ON a.f = b.f AND b.row = a.row + 1"
    op("k5_geometry_gate", gate, "nodes")(lambda t: _pairs(Stages(t).nodes).selectExpr("f", "a", "b", "(least(a1, b1) - greatest(a0, b0) >= -4e0 OR abs((b0 + b1 - a0 - a1) / 2) <= 4e0) AND abs(abs(e - d) - 4e0) <= 4e0 AS gate"))
    op("k4_edge_score", "SELECT a.f, a.node AS a, b.node AS b, abs((b.a0 + b.a1 - a.a0 - a.a1) / 2) / 4e0 + 1.8e0 * abs(abs(b.d - a.d) - 4e0) / 4e0 AS score FROM nodes a JOIN nodes b ON a.f = b.f AND b.row = a.row + 1", "nodes", {"score": 5})(
        lambda t: _pairs(Stages(t).nodes).selectExpr("f", "a", "b", "abs((b0 + b1 - a0 - a1) / 2) / 4e0 + 1.8e0 * abs(abs(e - d) - 4e0) / 4e0 AS score")
    )
    op("f2_adjacent_row_join", "SELECT f, src, dst, score FROM links", "links", {"score": 5})(lambda t: Stages(t).links)
    op("i3_top_neighbours", "SELECT f, src, count(*) AS n, min(score) AS best FROM links GROUP BY f, src", "links", {"best": 5})(lambda t: Stages(t).links.groupBy("f", "src").agg(F.count("*").alias("n"), F.min("score").alias("best")))
    op("g9_edge_count", "SELECT f, count(*) AS edges FROM (SELECT DISTINCT f, least(src, dst) AS a, greatest(src, dst) AS b FROM links) q GROUP BY f", "links")(lambda t: Stages(t).links.select("f", F.least("src", "dst"), F.greatest("src", "dst")).distinct().groupBy("f").agg(F.count("*").alias("edges")))
    op("k2_components", "SELECT f, node, comp FROM comps", "comps")(lambda t: Stages(t).comps.select("f", "node", "comp"))
    op("k1_stripe_graph", "SELECT f, node, row, cluster, comp, excl FROM comps", "comps")(lambda t: Stages(t).comps.select("f", "node", "row", "cluster", "comp", "excl"))
    op("s4_graph_metrics", "SELECT f, count(*) AS nodes, count(DISTINCT cluster) AS clusters, count(DISTINCT comp) AS components FROM comps GROUP BY f", "comps")(lambda t: Stages(t).comps.groupBy("f").agg(F.count("*").alias("nodes"), F.countDistinct("cluster").alias("clusters"), F.countDistinct("comp").alias("components")))
    op("g1_component_stats", "SELECT f, comp, min_row, max_row, cx, cy, size FROM stats", "stats", {"cx": 5, "cy": 5})(lambda t: graph.component_stats(Stages(t).comps).select("f", "comp", "min_row", "max_row", "cx", "cy", "size"))
    op("g2_component_span", "SELECT f, comp, lo, hi FROM stats", "stats", {"lo": 5, "hi": 5})(lambda t: graph.component_stats(Stages(t).comps).select("f", "comp", "lo", "hi"))
    op("g3_component_exclusion", "SELECT f, comp, excl FROM stats", "stats")(lambda t: graph.component_stats(Stages(t).comps).select("f", "comp", "excl"))
    op("g15_component_slots", "SELECT f, max(comp) + 1 AS slots FROM stats GROUP BY f", "stats")(lambda t: graph.component_stats(Stages(t).comps).groupBy("f").agg((F.max("comp") + 1).alias("slots")))
    _register_routes()
    _register_details()
    _register_merge(op)
    _register_metrics()


#: Fixed names of the planner's stages, in order.
STAGES = ("Prepare", "Sweep", "Filter", "Graph", "Merge", "Routes", "Group", "Stitch", "Approach")


def stage_metrics(s: Stages):
    """(f, stage, key, value): what each stage of a field made, from Prepare to Graph."""
    comps, stripes, kept, links = written(s.comps), s.stripes, written(s.kept), s.links
    count = lambda df, stage, key, what=None: df.groupBy("f").agg((what if what is not None else F.count("*")).cast("double").alias("value")).select("f", F.lit(stage).alias("stage"), F.lit(key).alias("key"), "value")
    parts = [
        count(s.edges, 0, "outerContours", F.countDistinct(F.when(F.col("ring") == 0, F.col("ring")))),
        count(s.edges, 0, "holes", F.countDistinct(F.when(F.col("ring") > 0, F.col("ring")))),
        count(s.lines, 1, "lines"),
        count(stripes, 1, "stripes"),
        count(kept, 2, "kept"),
        count(stripes.select("f", F.lit(1).alias("n")).unionAll(kept.select("f", F.lit(-1).alias("n"))), 2, "dropped", F.sum("n")),
        count(comps, 3, "nodes"),
        count(links, 3, "edges"),
        count(comps, 3, "components", F.countDistinct("comp")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _register_metrics() -> None:
    one = lambda stage, key, source, what="count(*)": f"SELECT f, {stage} AS stage, '{key}' AS key, CAST({what} AS DOUBLE) AS value FROM {source} GROUP BY f"
    rows = " UNION ALL ".join(
        [
            one(0, "outerContours", "sides", "count(DISTINCT CASE WHEN ring = 0 THEN ring END)"),
            one(0, "holes", "sides", "count(DISTINCT CASE WHEN ring > 0 THEN ring END)"),
            one(1, "lines", "lines"),
            one(1, "stripes", "stripes"),
            one(2, "kept", "kept"),
            one(2, "dropped", "(SELECT f, 1 AS n FROM stripes UNION ALL SELECT f, -1 FROM kept) z", "sum(n)"),
            one(3, "nodes", "comps"),
            one(3, "edges", "links"),
            one(3, "components", "comps", "count(DISTINCT comp)"),
        ]
    )
    text = lambda q: _sql("SELECT 1", "comps").removesuffix("SELECT 1").rstrip() + f", metrics AS MATERIALIZED ({rows}) {q}"
    names = "CASE stage " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(STAGES)) + " END"
    # A stage is ok if it made something; its steps are the rows of its output, for Filter with those dropped.
    main = "CASE stage WHEN 0 THEN 'outerContours' WHEN 1 THEN 'stripes' WHEN 2 THEN 'kept' ELSE 'nodes' END"
    status = f"SELECT f, stage, max(CASE WHEN key = {main} THEN value END) AS made, CASE WHEN max(CASE WHEN key = {main} THEN value END) > 0 THEN 'ok' ELSE 'failed' END AS status, greatest(1e0, sum(CASE WHEN key = {main} OR key = 'dropped' THEN value ELSE 0e0 END)) AS steps FROM metrics GROUP BY f, stage"

    def op(name: str, query: str, build) -> None:
        operator(name, text(query))(build)

    def judged(t: Tables):
        key = F.expr(main)
        value = F.max(F.when(F.col("key") == key, F.col("value")))
        return stage_metrics(Stages(t)).groupBy("f", "stage").agg(value.alias("made"), F.when(value > 0, "ok").otherwise("failed").alias("status"), F.greatest(F.lit(1.0), F.sum(F.when((F.col("key") == key) | (F.col("key") == "dropped"), F.col("value")).otherwise(0.0))).alias("steps"))

    op("b19_stage_metrics", "SELECT * FROM metrics", lambda t: stage_metrics(Stages(t)))
    op("b20_first_failure", f"SELECT f, min(CASE WHEN status = 'failed' THEN stage END) AS first_failure, count(CASE WHEN status = 'ok' THEN 1 END) AS ok FROM ({status}) z GROUP BY f", lambda t: judged(t).groupBy("f").agg(F.min(F.when(F.col("status") == "failed", F.col("stage"))).alias("first_failure"), F.count_if(F.col("status") == "ok").alias("ok")))
    op("b24_step_counts", f"SELECT f, stage, steps FROM ({status}) z", lambda t: judged(t).select("f", "stage", "steps"))
    op("g11_stage_counters", "SELECT stage, key, sum(value) AS total, count(*) AS jobs FROM metrics GROUP BY stage, key", lambda t: stage_metrics(Stages(t)).groupBy("stage", "key").agg(F.sum("value").alias("total"), F.count("*").alias("jobs")))
    op("p4_stage_labels", f"SELECT f, {names} AS name, status FROM ({status}) z", lambda t: judged(t).select("f", F.get(F.array(*map(F.lit, STAGES)), F.col("stage")).alias("name"), "status"))
    accessors = f"SELECT m.f, greatest(1e0, max(CASE WHEN key = 'outerContours' THEN value END)) AS outer_contours, max(last_ok) AS last_ok FROM metrics m JOIN (SELECT f, max(CASE WHEN status = 'ok' THEN stage END) AS last_ok FROM ({status}) z GROUP BY f) y ON m.f = y.f GROUP BY m.f"
    op("p5_result_accessors", accessors, lambda t: judged(t).groupBy("f").agg(F.greatest(F.lit(1.0), F.max(F.when(F.col("stage") == 0, F.col("made")))).alias("outer_contours"), F.max(F.when(F.col("status") == "ok", F.col("stage"))).alias("last_ok")))


def _register_merge(op) -> None:
    turn = lambda x: f"radians((15 * {x}.f) % 180 + 0e0)"
    gap = "greatest(0, greatest(a.min_row, b.min_row) - least(a.max_row, b.max_row) - 1)"
    across = f"((b.cx - a.cx) * cos({turn('a')}) + (b.cy - a.cy) * sin({turn('a')}))"
    close = f"({gap} <= 3 AND abs((b.cx - a.cx) * sin({turn('a')}) - (b.cy - a.cy) * cos({turn('a')})) <= 13.6e0 AND abs({across}) <= 19.2e0)"
    bypass = "(least(a.size, b.size) <= 18 AND sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) <= 32e0)"
    free = f"""SELECT a.f, a.comp AS a, b.comp AS b, a.cx AS ux, a.cy AS uy, b.cx AS vx, b.cy AS vy, {across} AS ahead FROM stats a JOIN stats b ON a.f = b.f AND a.comp < b.comp AND a.excl = b.excl WHERE ({close} OR {bypass})
        AND NOT EXISTS (SELECT 1 FROM stats t WHERE t.f = a.f AND t.comp <> a.comp AND t.comp <> b.comp AND least(a.max_row, b.max_row) + 1 <= greatest(a.min_row, b.min_row) - 1 AND least(a.hi, b.hi) > greatest(a.lo, b.lo) + 1e-3
        AND t.max_row >= least(a.max_row, b.max_row) + 1 AND t.min_row <= greatest(a.min_row, b.min_row) - 1 AND least(t.hi, least(a.hi, b.hi)) > greatest(t.lo, greatest(a.lo, b.lo)) + 0.5e0)"""
    dist, t = planar.side_distance("px", "py"), planar.side_t("px", "py")
    chord = f"""SELECT f, a, b FROM (SELECT c.f, a, b, k, sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) % 2 = 1 OR min({dist}) <= 1e-6 AS ok FROM (SELECT f, a, b, k, ux + (vx - ux) * k / 16e0 AS px, uy + (vy - uy) * k / 16e0 AS py
        FROM free CROSS JOIN (SELECT {{explode:0,16}} AS k) n) c JOIN sides s ON c.f = s.f GROUP BY c.f, a, b, k) q GROUP BY f, a, b HAVING min(CASE WHEN ok THEN 1 ELSE 0 END) = 1"""
    places = f"""SELECT DISTINCT f, comp, side, ring, i, n, t >= 0.96e0 AS late, t <= 0.04e0 AS early FROM (SELECT p.f, comp, side, s.ring, s.i, s.n, {t} AS t, row_number() OVER (PARTITION BY p.f, node, side ORDER BY {dist}, s.ring, s.i) AS rn FROM (
        SELECT f, comp, node, 'L' AS side, sx AS px, sy AS py FROM comps UNION ALL SELECT f, comp, node, 'R' AS side, ex AS px, ey AS py FROM comps) p JOIN sides s ON p.f = s.f) q WHERE rn = 1"""

    def fwd(u: str, v: str) -> str:
        n = f"(({v}.i - {u}.i + {u}.n) % {u}.n)"
        return f"CASE WHEN {u}.i = {v}.i THEN 0 WHEN {n} = 1 AND ({u}.late OR {v}.early) THEN 0 ELSE {n} - CASE WHEN {u}.late THEN 1 ELSE 0 END - CASE WHEN {v}.early THEN 1 ELSE 0 END END"

    met = f"SELECT p.f, p.a, p.b, concat(u.side, v.side) AS met FROM free p JOIN places u ON p.f = u.f AND p.a = u.comp JOIN places v ON p.f = v.f AND p.b = v.comp AND u.ring = v.ring WHERE least({fwd('u', 'v')}, {fwd('v', 'u')}) <= 1 GROUP BY ALL"
    has = lambda x: f"EXISTS (SELECT 1 FROM met m WHERE m.f = p.f AND m.a = p.a AND m.b = p.b AND m.met = '{x}')"
    joined = f"""SELECT p.f, p.a, p.b FROM free p JOIN chord c ON p.f = c.f AND p.a = c.a AND p.b = c.b
        WHERE ({has('LL')} AND {has('RR')}) OR ({has('RL')} AND ahead >= -1e0) OR ({has('LR')} AND ahead <= 1e0)"""
    walk = "SELECT f, comp AS v, comp AS w FROM stats UNION SELECT r.f, r.v, CASE WHEN j.a = r.w THEN j.b ELSE j.a END FROM merging r JOIN joined j ON r.f = j.f AND (j.a = r.w OR j.b = r.w)"
    more = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in {"free": free, "chord": chord, "places": places, "met": met, "joined": joined}.items())
    text = lambda q: _sql("SELECT 1", "stats").removesuffix("SELECT 1").rstrip() + f", {more}, merging AS ({walk}) {q}"
    number = "(SELECT f, v AS comp, min(w) AS merged FROM merging GROUP BY f, v)"

    def made(t: Tables):
        s = Stages(t)
        return s.comps, s.edges

    operator("f5_intervening_anti_join", text("SELECT f, a, b FROM free"))(lambda t: graph.merge_candidates(graph.component_stats(made(t)[0])).select("f", "a", "b"))
    operator("f3_component_pairs", text("SELECT f, a, b FROM joined"))(lambda t: graph.merge_pairs(*made(t)))
    operator("s5_merge", text(f"SELECT c.f, node, c.comp, merged FROM comps c JOIN {number} m ON c.f = m.f AND c.comp = m.comp"))(lambda t: graph.merged(*made(t)).select("f", "node", "comp", "merged"))
    operator("k3_union_find", text(f"SELECT f, comp, merged FROM {number} m"))(lambda t: graph.merged(*made(t)).select("f", "comp", "merged").distinct())
    operator("f15_component_map", text(f"SELECT f, merged, count(*) AS raw_components, sum(size) AS stripes FROM {number} m JOIN stats s USING (f, comp) GROUP BY f, merged"))(
        lambda t: graph.merged(*made(t)).groupBy("f", "merged").agg(F.countDistinct("comp").alias("raw_components"), F.count("*").alias("stripes"))
    )
    levels = """SELECT f, comp, node, level FROM (SELECT f, comp, node, 0 AS level, row_number() OVER (PARTITION BY f, comp ORDER BY row, a0, node) AS rn FROM comps) r WHERE rn = 1
        UNION SELECT t.f, t.comp, CASE WHEN l.src = t.node THEN l.dst ELSE l.src END, t.level + 1 FROM tree t JOIN links l ON t.f = l.f AND (l.src = t.node OR l.dst = t.node) WHERE t.level < 120"""
    tree = _sql("SELECT 1", "comps").removesuffix("SELECT 1").rstrip() + f""", tree AS ({levels}), depth AS (SELECT f, node, min(level) AS level FROM tree GROUP BY f, node)
        SELECT d.f, d.node, CASE WHEN d.level = 0 THEN d.node ELSE min(u.node) END AS parent, d.level FROM depth d LEFT JOIN links l ON d.f = l.f AND (l.src = d.node OR l.dst = d.node)
        LEFT JOIN depth u ON u.f = d.f AND u.node = CASE WHEN l.src = d.node THEN l.dst ELSE l.src END AND u.level = d.level - 1 GROUP BY d.f, d.node, d.level"""

    def grown(t: Tables):
        nodes = Stages(t).clustered
        links = written(graph.row_links(nodes))
        return graph.spanning_tree(graph.components(nodes, links), links)

    operator("k6_spanning_tree", tree)(grown)


def _stripes(p: Steps) -> DataFrame:
    sides = sweep.in_sweep_frame(p.edges)
    return passes.swept(sides, sides.where("ring = 0 AND i = 0").selectExpr("f", "a1 AS sa", "d1 AS sd"), p.c).stripes


class FullPlan(Steps):
    """The whole planner: working region, inset, stripes, components, snakes, islands, route."""

    STEPS = {
        "working": Step(0, lambda p: arrangement.working_regions(p.t["region_vertices"]), {}),
        "inset": Step(0, lambda p: arrangement.insets(p.working, p.c.offset), {}),
        "edges": Step(0, lambda p: arrangement.edges_of(p.inset), {"sides": _ROWS, "rings": "count_if(i = 0)", "area": "sum(x1 * y2 - x2 * y1) / 2"}),
        "stripes": Step(1, _stripes, {"rawStripes": _ROWS, "metres": "sum(len)", "laterPasses": "count_if(pass > 0)"}),
        "filtered": Step(2, lambda p: sweep.numbered(sweep.supported(sweep.rowed(p.stripes.drop("row")))), {"kept": _ROWS, "metres": "sum(len)"}),
        "nodes": Step(3, lambda p: graph.clusters(sweep.touching(p.filtered, p.edges)), {"nodes": _ROWS, "excluded": "count_if(excl)"}),
        "links": Step(3, lambda p: graph.row_links(p.nodes), {"edges": _ROWS}),
        "comps": Step(3, lambda p: graph.components(p.nodes, p.links), {}),
        "merged": Step(4, lambda p: graph.merged(p.comps, p.edges), {"merged": "count_if(merged <> comp)", "nodes": _ROWS}),
        "chunks": Step(5, lambda p: routes.snakes(p.merged, p.edges), {"chunks": _ROWS}),
        "islands": Step(6, lambda p: routes.islands(p.chunks, p.edges), {"islands": _ROWS, "chunks": "sum(chunks)"}),
        "visits": Step(7, lambda p: routes.visits(p.islands, p.edges), {}),
        "routes": Step(7, lambda p: routes.routes_of(p.visits), {"fields": _ROWS, "used": "sum(used)", "unreachable": "sum(unreachable)"}),
        "tours": Step(8, lambda p: routes.legs_of(p.visits), {"legs": _ROWS, "points": "sum(size(xs))"}),
    }


#: The nine stages, by number.
STAGE_NAMES = ("Prepare", "Sweep", "Filter", "Graph", "Merge", "Routes", "Group", "Stitch", "Approach")


def stage_report(p: FullPlan) -> DataFrame:
    """(stage, name, key, value, status): metrics of all nine stages over all fields, from the passes that made their tables; a stage that made nothing has failed."""
    found = p.metrics()
    by = {(stage, key): value for stage, _, key, value in found}
    rows = [(stage, STAGE_NAMES[stage], key, value) for stage, _, key, value in found]
    rows.append((2, STAGE_NAMES[2], "dropped", by[1, "rawStripes"] - by[2, "kept"]))
    made = {stage: max(v for (k, _), v in by.items() if k == stage) for stage in range(9)}
    return p.t.spark.createDataFrame([(*r, "ok" if made[r[0]] else "failed") for r in rows], "stage int, name string, key string, value double, status string")


def _register_routes() -> None:
    size = "aggregate(zip_with(xs, ys, (x, y) -> struct(x, y)), named_struct('n', 0D, 'px', CAST(NULL AS DOUBLE), 'py', CAST(NULL AS DOUBLE)), (s, p) -> named_struct('n', s.n + coalesce(sqrt((p.x - s.px) * (p.x - s.px) + (p.y - s.py) * (p.y - s.py)), 0D), 'px', p.x, 'py', p.y)).n"
    near = {"area": 1, "perimeter": 1}
    operator("e15_working_region", _GIVEN, near)(lambda t: regions.ring_stats(arrangement.edges_of(arrangement.working_regions(t["region_vertices"]))).select("f", "ring", "area", "perimeter"))
    operator("e14_inset", f"{_INSET} SELECT * FROM inset", near)(lambda t: regions.ring_stats(arrangement.edges_of(arrangement.insets(arrangement.working_regions(t["region_vertices"]), C.offset))).select("f", "ring", "area", "perimeter"))
    prepared = f"{_INSET} SELECT g.f, count(*) AS rings, sum(g.area) AS working_area, sum(i.area) AS inset_area, 'ok' AS status FROM ({_GIVEN}) g JOIN inset i ON g.f = i.f AND g.ring = i.ring GROUP BY g.f"
    operator("s1_prepare", prepared, {"working_area": 1, "inset_area": 1})(lambda t: _prepared(FullPlan(t)))
    operator("n7_stage_observations")(lambda t: stage_report(FullPlan(t)))
    operator("s6_routes")(lambda t: FullPlan(t).chunks)
    operator("k7_snake_lengths")(lambda t: FullPlan(t).chunks.select("f", "comp", "phase", "chunk", F.expr(size).alias("metres")))
    operator("s7_group")(lambda t: FullPlan(t).islands)
    operator("g7_island_centroids")(lambda t: FullPlan(t).islands.select("f", "comp", "phase", "island", F.expr("aggregate(xs, 0D, (s, x) -> s + x) / size(xs)").alias("cx"), F.expr("aggregate(ys, 0D, (s, y) -> s + y) / size(ys)").alias("cy")))
    hypot = lambda a, b: f"sqrt((u.{a}x - v.{b}x) * (u.{a}x - v.{b}x) + (u.{a}y - v.{b}y) * (u.{a}y - v.{b}y))"
    direct = f"SELECT l.f, src, dst, least({', '.join(hypot(a, b) for a in 'se' for b in 'se')}) AS direct FROM links l JOIN nodes u ON l.f = u.f AND l.src = u.node JOIN nodes v ON l.f = v.f AND l.dst = v.node"

    def hop(t: Tables):
        s = Stages(t)
        nodes = s.clustered
        return routes.hops(nodes, graph.row_links(nodes), s.edges)

    apart = lambda a, b: f"sqrt(pow(u.{a}x - v.{b}x, 2) + pow(u.{a}y - v.{b}y, 2))"
    choice = ", ".join(f"{{'direct': {apart(a, b)}, 'px': u.{a}x, 'py': u.{a}y, 'qx': v.{b}x, 'qy': v.{b}y}}" for a in "se" for b in "se")
    dist = planar.side_distance("px", "py")
    connectors = _sql("SELECT 1", "links").removesuffix("SELECT 1").rstrip() + f""", hop AS MATERIALIZED (SELECT f, src, dst, h.direct, h.px, h.py, h.qx, h.qy FROM (SELECT l.f, src, dst, list_min([{choice}]) AS h FROM links l JOIN nodes u ON l.f = u.f AND l.src = u.node JOIN nodes v ON l.f = v.f AND l.dst = v.node) z),
        clear AS (SELECT f, src, dst FROM (SELECT c.f, src, dst, k, sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) % 2 = 1 OR min({dist}) <= 1e-6 AS ok FROM (SELECT f, src, dst, k, px + (qx - px) * k / 16e0 AS px, py + (qy - py) * k / 16e0 AS py FROM hop CROSS JOIN (SELECT {{explode:0,16}} AS k) n WHERE direct <= 5e0) c
            JOIN sides s ON c.f = s.f GROUP BY c.f, src, dst, k) q GROUP BY f, src, dst HAVING bool_and(ok)),
        arcs AS ({_ARCS}),
        places AS (SELECT * FROM (SELECT p.f, src, dst, head, s.ring, {dist} AS off, s.arc + {planar.side_t('px', 'py')} * s.len AS place, total, row_number() OVER (PARTITION BY p.f, src, dst, head ORDER BY {dist}, s.ring, s.i) AS rn
            FROM (SELECT f, src, dst, true AS head, px, py FROM hop UNION ALL SELECT f, src, dst, false, qx, qy FROM hop) p JOIN arcs s ON p.f = s.f) q WHERE rn = 1 AND off <= 3e0),
        along AS (SELECT a.f, a.src, a.dst, a.off + b.off + least(abs(b.place - a.place), a.total - abs(b.place - a.place)) AS walked FROM places a JOIN places b ON a.f = b.f AND a.src = b.src AND a.dst = b.dst AND a.ring = b.ring AND a.head AND NOT b.head),
        priced AS (SELECT h.f, h.src, h.dst, direct, CASE WHEN direct < 0.05e0 OR c.src IS NOT NULL THEN direct ELSE walked END AS cost FROM hop h LEFT JOIN clear c ON h.f = c.f AND h.src = c.src AND h.dst = c.dst LEFT JOIN along a ON h.f = a.f AND h.src = a.src AND h.dst = a.dst)"""
    operator("k8_connector_cost", f"{connectors} SELECT f, src, dst, direct, cost FROM priced", {"direct": 5, "cost": 4})(lambda t: hop(t).select("f", "src", "dst", "direct", "cost"))
    operator("c21_connector_acceptable", f"{connectors} SELECT f, src, dst, coalesce(cost <= greatest({max(C.intra_limit, 2.5 * C.step)}e0, 2.5e0 * direct), false) AS ok FROM priced")(lambda t: hop(t).select("f", "src", "dst", "ok"))
    operator("k9_direct_cap", _sql(f"SELECT f, src, dst, direct, direct <= 5e0 AS direct_ok FROM ({direct}) z", "links"), {"direct": 5})(lambda t: hop(t).select("f", "src", "dst", "direct", "direct_ok"))
    operator("k13_chunk_grouping")(lambda t: FullPlan(t).islands.groupBy("f", "comp", "phase").agg(F.count("*").alias("islands"), F.sum("chunks").alias("chunks")))
    operator("k15_entry_option")(lambda t: (lambda p: routes.entries(p.islands, p.edges))(FullPlan(t)))
    operator("k14_island_stitching")(lambda t: FullPlan(t).tours.where("island IS NOT NULL").select("f", "step", "comp", "phase", "island", "reverse"))
    operator("i5_stitch_order")(lambda t: FullPlan(t).tours.where("island IS NOT NULL").select("f", "step", "cost", "score"))
    operator("k16_next_hop")(lambda t: FullPlan(t).tours.where("island IS NOT NULL").select("f", "step", "island", "ahead"))
    operator("k17_approach_legs")(lambda t: FullPlan(t).tours.groupBy("f").agg(F.max(F.when(F.col("step") == 0, F.col("cost"))).alias("approach"), F.max(F.when(F.col("island").isNull(), F.col("cost"))).alias("back")))
    operator("k12_connector_points")(lambda t: FullPlan(t).tours.select("f", "step", F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "p")).select("f", "step", "seq", "p.xs", "p.ys"))
    operator("j10_unreachable")(lambda t: FullPlan(t).routes.where("unreachable > 0").select("f", "unreachable"))
    operator("g13_stitch_counters")(lambda t: FullPlan(t).routes.agg(F.sum("islands").alias("islands"), F.sum("used").alias("used"), F.sum("unreachable").alias("unreachable"), F.sum("links").alias("links"), F.sum("phase0").alias("phase0")))
    operator("s8_stitch")(lambda t: FullPlan(t).routes.select("f", "ok", "islands", "used", "unreachable", "links", "phase0"))
    operator("s9_route_points")(lambda t: FullPlan(t).routes.select("f", F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "p")).select("f", "seq", "p.xs", "p.ys"))
    lat, lon = geo.unproject("(xs + 4118821e0)", "(ys - 7361866e0)")
    operator("s10_plan_to_geo")(lambda t: FullPlan(t).routes.select("f", F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "p")).select("f", "seq", "p.xs", "p.ys").selectExpr("f", "seq", f"{lat} AS lat", f"{lon} AS lon"))


def _register_details() -> None:
    """Parts of the planner that the stages above hold, as results of their own."""
    # anchors of the left and right ends of every stripe: the shells of components
    dist = planar.side_distance("px", "py")
    shell = f"""SELECT f, node, side, ring, i, dist FROM (SELECT p.f, node, side, s.ring, s.i, {dist} AS dist, row_number() OVER (PARTITION BY p.f, node, side ORDER BY {dist}, s.ring, s.i) AS rn FROM (
        SELECT f, node, 'left' AS side, sx AS px, sy AS py FROM nodes UNION ALL SELECT f, node, 'right' AS side, ex AS px, ey AS py FROM nodes) p JOIN sides s ON p.f = s.f) q WHERE rn = 1"""

    def shells(t: Tables):
        s = Stages(t)
        both = s.nodes.selectExpr("f", "node", "stack(2, 'left', sx, sy, 'right', ex, ey) AS (side, px, py)")
        return regions.anchors(both, s.edges, ["node", "side"]).select("f", "node", "side", "ring", "i", "dist")

    operator("g4_shell_anchors", _sql(f"SELECT f, node, side, dist FROM ({shell}) z", "nodes"), {"dist": 5})(lambda t: shells(t).select("f", "node", "side", "dist"))
    operator("p3_valid_shell_anchors", _sql(f"SELECT f, count(*) AS anchors FROM ({shell}) z WHERE dist < 3e0 GROUP BY f", "nodes"))(lambda t: shells(t).where("dist < 3").groupBy("f").agg(F.count("*").alias("anchors")))
    place = f"SELECT p.f, node, side, s.ring, {dist} AS dist, s.arc + {planar.side_t('px', 'py')} * s.len AS arc, total, row_number() OVER (PARTITION BY p.f, node, side ORDER BY {dist}, s.ring, s.i) AS rn FROM (SELECT f, node, 'left' AS side, sx AS px, sy AS py FROM nodes UNION ALL SELECT f, node, 'right' AS side, ex AS px, ey AS py FROM nodes) p JOIN ({_ARCS}) s ON p.f = s.f"
    transfer = f"SELECT a.f, a.node, a.ring, a.dist AS d1, b.dist AS d2, least(abs(b.arc - a.arc), a.total - abs(b.arc - a.arc)) AS arc FROM ({place}) a JOIN ({place}) b ON a.f = b.f AND a.node = b.node AND a.ring = b.ring AND a.side = 'left' AND b.side = 'right' AND a.rn = 1 AND b.rn = 1 WHERE a.dist <= 3e0 AND b.dist <= 3e0"

    def transfers(t: Tables):
        s = Stages(t)
        both = s.nodes.selectExpr("f", "node", "stack(2, 'left', sx, sy, 'right', ex, ey) AS (side, px, py)")
        return routes.boundary_transfers(both, s.edges)

    operator("k10_boundary_transfer", _sql(f"SELECT *, d1 + d2 + arc AS score FROM ({transfer}) z", "nodes"), {"d1": 5, "d2": 5, "arc": 4, "score": 4})(transfers)
    # simplified mode: contours without cutouts
    operator("k18_simplified_coverage")(lambda t: _simplified(t).select("f", "rows", F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "p")).select("f", "rows", "seq", "p.xs", "p.ys"))
    operator("k19_boundary_legs")(lambda t: _simplified(t).select("f", "leg", "back"))
    length = "aggregate(zip_with(xs, ys, (x, y) -> struct(x, y)), named_struct('n', 0D, 'px', CAST(NULL AS DOUBLE), 'py', CAST(NULL AS DOUBLE)), (s, p) -> named_struct('n', s.n + coalesce(sqrt((p.x - s.px) * (p.x - s.px) + (p.y - s.py) * (p.y - s.py)), 0D), 'px', p.x, 'py', p.y)).n"
    operator("k20_simplified_route")(lambda t: _simplified(t).select("f", F.size("xs").alias("points"), F.expr(length).alias("metres")))
    inside = f"""SELECT f, src, dst, min(CASE WHEN hit % 2 = 1 OR near THEN 1 ELSE 0 END) = 1 AS inside FROM (SELECT c.f, src, dst, k, sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) AS hit, min({dist}) <= 1e-6 AS near FROM (
        SELECT l.f, src, dst, k, a.mx + (b.mx - a.mx) * k / 16e0 AS px, a.my + (b.my - a.my) * k / 16e0 AS py FROM links l JOIN nodes a ON l.f = a.f AND l.src = a.node JOIN nodes b ON l.f = b.f AND l.dst = b.node CROSS JOIN (SELECT {{explode:0,16}} AS k) n) c
        JOIN sides s ON c.f = s.f GROUP BY c.f, src, dst, k) q GROUP BY f, src, dst"""

    def chords(t: Tables):
        s = Stages(t)
        nodes = s.clustered
        a = nodes.select("f", F.col("node").alias("src"), F.col("mx").alias("ax"), F.col("my").alias("ay"))
        b = nodes.select("f", F.col("node").alias("dst"), F.col("mx").alias("bx"), F.col("my").alias("by"))
        pts = written(graph.row_links(nodes)).join(a, ["f", "src"]).join(b, ["f", "dst"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(16))))
        pts = pts.selectExpr("f", "src", "dst", "k", "ax + (bx - ax) * k / 16e0 AS px", "ay + (by - ay) * k / 16e0 AS py")
        return regions.inside(pts, s.edges, ["src", "dst", "k"], 1e-6).groupBy("f", "src", "dst").agg(F.expr("min(CASE WHEN inside THEN 1 ELSE 0 END) = 1 AS inside"))

    operator("c15_row_edge_inside", _sql(inside, "links"))(chords)
    sample = "SELECT f, ring, arc + h * len / 2e0 AS place, x1 + h * (x2 - x1) / 2e0 AS x, y1 + h * (y2 - y1) / 2e0 AS y FROM arcs CROSS JOIN (SELECT {explode:0,1} AS h) z WHERE i % greatest(1, CAST(floor(n / 48e0) AS INT)) = 0"
    spans = "SELECT a.f, a.ring, a.place, b.place AS outer_place, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS hop FROM samples a JOIN samples b ON a.f = b.f AND a.ring > 0 AND b.ring = 0"
    clear = f"""SELECT f, ring, place, outer_place, hop FROM (SELECT c.f, c.ring, place, outer_place, hop, k, sum(CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END) % 2 = 1 OR min({dist}) <= 1e-6 AS ok
        FROM (SELECT f, ring, place, outer_place, hop, k, ux + (vx - ux) * k / 16e0 AS px, uy + (vy - uy) * k / 16e0 AS py FROM spans CROSS JOIN (SELECT {{explode:0,16}} AS k) n WHERE hop <= 5e0) c JOIN sides s ON c.f = s.f GROUP BY ALL) q
        GROUP BY f, ring, place, outer_place, hop HAVING min(CASE WHEN ok THEN 1 ELSE 0 END) = 1"""
    spanned = _sql("SELECT 1", "sides").removesuffix("SELECT 1").rstrip() + f", arcs AS ({_ARCS}), samples AS ({sample}), spans AS ({spans}), clear AS ({clear})"
    close = spanned.replace("{edges}", "{close_edges}")
    operator("f7_bridge_candidates", f"{close} SELECT f, ring, place, outer_place, hop FROM clear", {"place": 4, "outer_place": 4, "hop": 5})(lambda t: routes.bridges(t["close_edges"]).select("f", "ring", "place", "outer_place", "hop"))
    operator("k11_best_bridge", f"{close} SELECT f, ring, min(hop) AS hop, count(*) AS candidates FROM clear GROUP BY f, ring", {"hop": 5})(lambda t: routes.bridges(t["close_edges"]).groupBy("f", "ring").agg(F.min("hop").alias("hop"), F.count("*").alias("candidates")))
    operator("f4_shell_semi_join", _sql(f"SELECT DISTINCT l.f, l.src, l.dst FROM links l JOIN ({shell}) a ON l.f = a.f AND l.src = a.node JOIN ({shell}) b ON l.f = b.f AND l.dst = b.node AND a.ring = b.ring AND a.side = b.side AND abs(a.i - b.i) <= 1", "links"))(_near_shells)


def _simplified(t: Tables):
    edges = written(t["outer_edges"])
    sides = sweep.in_sweep_frame(edges)
    nodes = written(sweep.numbered(sweep.supported(sweep.rowed(written(sweep.cut(sides, sweep.lines(sides)))))))
    return routes.simplified(nodes, edges, t["clicks"].select("f", "px", "py"))


def _near_shells(t: Tables):
    s = Stages(t)
    nodes = s.clustered
    both = nodes.selectExpr("f", "node", "stack(2, 'left', sx, sy, 'right', ex, ey) AS (side, px, py)")
    found = written(regions.anchors(both, s.edges, ["node", "side"]).select("f", "node", "side", "ring", "i"))
    links = written(graph.row_links(nodes))
    a = found.selectExpr("f", "node AS src", "side", "ring", "i AS ai")
    b = found.selectExpr("f", "node AS dst", "side", "ring", "i AS bi")
    return links.join(a, ["f", "src"]).join(b, ["f", "dst", "side", "ring"]).where("abs(ai - bi) <= 1").select("f", "src", "dst").distinct()


def _prepared(p: FullPlan):
    before = regions.ring_stats(arrangement.edges_of(p.working)).groupBy("f").agg(F.sum("area").alias("working_area"), F.count("*").alias("rings"))
    after = regions.ring_stats(p.edges).groupBy("f").agg(F.sum("area").alias("inset_area"))
    return before.join(after, "f", "left").select("f", "rings", "working_area", "inset_area", F.when(F.col("inset_area").isNull(), "failed").otherwise("ok").alias("status"))


def _pairs(nodes):
    a = nodes.select("f", F.col("node").alias("a"), "row", "a0", "a1", "d")
    b = nodes.select("f", F.col("node").alias("b"), (F.col("row") - 1).alias("row"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("d").alias("e"))
    return a.join(b, ["f", "row"])
