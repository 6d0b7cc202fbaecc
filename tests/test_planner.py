"""Regions, sweep, overlay and routes on closed forms and by invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_overlay as overlay
from swathline.operators import arrangement, commands, graph, passes, regions, routes, sweep
from swathline.sources.scratch import written


def square(x, y, s):
    return np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)


def edges(spark, rings, f=6):
    return arrangement.edges_of(spark.createDataFrame(overlay.frame_of(f, rings)))


@pytest.mark.parametrize(("how", "expected"), [("union", 175), ("intersection", 25), ("difference", 75), ("xor", 150)])
def test_overlay_areas(how, expected):
    assert sum(map(overlay.area, overlay.combine([square(0, 0, 10)], [square(5, 5, 10)], how))) == pytest.approx(expected)


def test_overlay_of_touching_and_nested_squares():
    assert sum(map(overlay.area, overlay.combine([square(0, 0, 10)], [square(10, 0, 5)], "union"))) == pytest.approx(125)
    assert sorted(map(overlay.area, overlay.combine([square(0, 0, 10)], [square(3, 3, 2)], "difference"))) == pytest.approx([-4, 100])


def test_inset_shrinks_grows_holes_and_vanishes():
    assert [overlay.area(r) for r in overlay.inset([square(0, 0, 40)], 2)] == pytest.approx([1296])
    assert sorted(overlay.area(r) for r in overlay.inset([square(0, 0, 40), square(10, 10, 6)[::-1]], 2)) == pytest.approx([-100, 1296])
    assert overlay.inset([square(0, 0, 3)], 2) == []


def test_inside_counts_the_boundary_and_not_the_hole(spark):
    e = edges(spark, [square(0, 0, 10), square(4, 4, 2)[::-1]])
    p = spark.createDataFrame([(1, 6, 1.0, 1.0), (2, 6, 5.0, 5.0), (3, 6, 0.0, 5.0), (4, 6, 11.0, 5.0)], "id int, f long, px double, py double")
    assert {r.id: r.inside for r in regions.inside(p, e, ["id"]).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_sweep_of_a_rectangle(spark):
    e = edges(spark, [np.array([[2, 2], [38, 2], [38, 18], [2, 18]], float)])  # angle 90: lines along x
    sides = sweep.in_sweep_frame(e)
    stripes = sweep.cut(sides, sweep.lines(sides)).toPandas()
    assert sorted(stripes["d"].round(3)) == [2, 6, 10, 14, 18] or sorted(stripes["d"].round(3)) == [2, 6, 10, 14]
    assert stripes["len"].round(3).eq(36).all()


def test_stripes_stop_at_holes(spark):
    e = edges(spark, [square(0, 0, 40), square(15, 15, 10)[::-1]])
    sides = sweep.in_sweep_frame(e)
    cut = sweep.cut(sides, sweep.lines(sides)).toPandas()
    crossing = cut[(cut["d"] > 15) & (cut["d"] < 25)]
    assert crossing.groupby("k").size().eq(2).all() and crossing["len"].max() < 16


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    links = {(int(f), int(a), int(b)) for f, a, b in zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60), rng.integers(0, 40, 60), strict=True) if a != b}
    parent = {(f, v): v for f in range(3) for v in range(40)}
    changed = True
    while changed:
        changed = False
        for f, a, b in links:
            low = min(parent[f, a], parent[f, b])
            if parent[f, a] != low or parent[f, b] != low:
                parent[f, a] = parent[f, b] = low
                changed = True
    found = graph.connected(spark.createDataFrame(sorted(links), "f long, a long, b long"), spark.createDataFrame(sorted(parent), "f long, v long"))
    assert {(r.f, r.v): r.comp for r in found.collect()} == parent


def test_route_covers_stripes_and_stays_in_the_field(spark):
    rings = [square(0, 0, 40)]
    e = edges(spark, overlay.inset(rings, 2))
    sides = sweep.in_sweep_frame(e)
    nodes = graph.clusters(sweep.touching(sweep.numbered(sweep.supported(sweep.rowed(sweep.cut(sides, sweep.lines(sides))))), e))
    merged = graph.merged(graph.components(nodes, graph.row_links(nodes)), e)
    route = routes.stitched(routes.islands(routes.snakes(merged, e), e), e).first()
    assert route.ok and route.unreachable == 0 and route.used == 1
    p = np.stack([route.xs, route.ys], 1)
    assert (p > 1.99).all() and (p < 38.01).all()
    for n in merged.toPandas().itertuples():
        gap = np.linalg.norm(p[:, None] - np.array([[n.sx, n.sy], [n.ex, n.ey]])[None], axis=2).min(0)
        assert (gap < 0.05).all()


def test_commands_of_a_route(spark):
    # a hop that is too short moves the start of the next; a sharp turn before a short hop is not made
    pts = [(1, 0, 55.0, 37.0), (1, 1, 55.0, 37.0001), (1, 2, 55.0, 37.000101), (1, 3, 55.0001, 37.000101)]
    got = commands.route_commands(spark.createDataFrame(pts, "robot_id long, seq int, lat double, lon double")).orderBy("seq", "part").collect()
    assert [(r.seq, r.cmd) for r in got] == [(1, "rotate"), (1, "move"), (3, "rotate"), (3, "move")]
    assert got[0].value == pytest.approx(90, abs=1e-3) and got[2].value == pytest.approx(-90, abs=1e-3)


def test_greedy_filter_compares_with_the_last_kept(spark):
    rows = [(k, i, v) for k in (1, 2) for i, v in enumerate((0.0, 0.03, 0.06, 0.09, 0.2))]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    kept = commands.greedy_filter(df, ["k"], "i", lambda p, q: p[1] - q[1] >= 0.05, ["v"]).orderBy("k", "i").collect()
    assert [(r.k, r.v) for r in kept] == [(k, v) for k in (1, 2) for v in (0, 0.06, 0.2)]


def test_a_long_key_streams_in_batches(spark):
    df = spark.range(25_000).selectExpr("id % 2 AS k", "id AS i", "CAST(id AS DOUBLE) AS v")
    assert commands.greedy_filter(df, ["k"], "i", lambda p, q: p[1] - q[1] >= 10, ["v"]).count() == 2 * 2500
    last = commands.ema(df, ["k"], "i", "v", 1.0).orderBy("i").tail(2)
    assert [r.ema for r in last] == [24_998.0, 24_999.0]


def test_ema(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0)], "k int, i int, v double")
    assert [r.ema for r in commands.ema(df, ["k"], "i", "v", 0.5).orderBy("i").collect()] == [0, 0.5]
    with pytest.raises(ValueError):
        commands.ema(df, ["k"], "i", "v", 0)


def test_empty_field_gives_no_lines(spark):
    empty = edges(spark, [square(0, 0, 4)]).where(F.lit(False))
    assert sweep.cut(sweep.in_sweep_frame(empty), sweep.lines(sweep.in_sweep_frame(empty))).count() == 0


def test_bridges_match_brute_force(spark):
    e = edges(spark, [square(-10, -10, 20), square(-6, -7, 14)[::-1]])
    got = {(r.ring, round(r.place, 6), round(r.outer_place, 6)): r.hop for r in routes.bridges(e).collect()}
    sides = e.toPandas().sort_values(["ring", "i"])
    samples = {0: [], 1: []}
    for ring, own in sides.groupby("ring"):
        arc = 0.0
        for s in own.itertuples():
            samples[ring] += [(arc, s.x1, s.y1), (arc + s.len / 2, (s.x1 + s.x2) / 2, (s.y1 + s.y2) / 2)]
            arc += s.len
    inside = lambda x, y: max(abs(x), abs(y)) <= 10 + 1e-6 and max(abs(x - 1), abs(y)) >= 7 - 1e-6
    want = {}
    for u, px, py in samples[1]:
        for v, qx, qy in samples[0]:
            hop = math.hypot(qx - px, qy - py)
            if hop <= 5 and all(inside(px + (qx - px) * k / 16, py + (qy - py) * k / 16) for k in range(17)):
                want[1, round(u, 6), round(v, 6)] = hop
    assert got.keys() == want.keys() and len(want) > 5 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_simplified_route_covers_every_row(spark):
    e = edges(spark, [square(-10, -10, 20)])
    sides = sweep.in_sweep_frame(e)
    nodes = written(sweep.numbered(sweep.supported(sweep.rowed(sweep.cut(sides, sweep.lines(sides))))))
    f = e.first().f
    row = routes.simplified(nodes, e, spark.createDataFrame([(f, -14.0, -3.0)], "f long, px double, py double")).first()
    pts = list(zip(row.xs, row.ys, strict=True))
    assert pts[0] == (-14.0, -3.0) and pts[-1] == pytest.approx((-14.0, -3.0)) and row.rows == nodes.select("row").distinct().count()
    for n in nodes.collect():
        assert any({tuple(round(x, 6) for x in p) for p in (a, b)} == {(round(n.sx, 6), round(n.sy, 6)), (round(n.ex, 6), round(n.ey, 6))} for a, b in zip(pts, pts[1:]))
    assert row.leg >= 4 - 1e-9 and row.back >= 4 - 1e-9


def test_components_are_merged_by_chord_and_shells(spark):
    # two stripes of one row, apart by a hole: the chord between their middles leaves the region
    e = edges(spark, [square(-10, -10, 20), square(-2, -2, 4)[::-1]])
    f = e.first().f
    node = lambda k, comp, x0, x1, y: (f, k, 0, 0.0, x0, x1, x1 - x0, x0, y, x1, y, (x0 + x1) / 2, y, False, comp)
    schema = "f long, node int, row int, d double, a0 double, a1 double, len double, sx double, sy double, ex double, ey double, mx double, my double, excl boolean, comp int"
    apart = spark.createDataFrame([node(0, 0, -9.5, -2.5, 0.0), node(1, 1, 2.5, 9.5, 0.0)], schema)
    beside = spark.createDataFrame([node(0, 0, -9.5, -2.5, 8.0), node(1, 1, 2.5, 9.5, 8.0)], schema)
    assert graph.merge_pairs(apart, e).count() == 0
    assert [(r.a, r.b) for r in graph.merge_pairs(beside, e).collect()] == [(0, 1)]


def test_connectors_and_entries_match_the_walked_ones(spark):
    rings = [square(-12, -12, 24), square(-9, -4, 8)[::-1], square(4, -3, 6)[::-1]]
    e = edges(spark, rings)
    f, region = e.first().f, routes.Region(e.toPandas(), sweep.PlanConfig())
    rng = np.random.default_rng(5)
    at = rng.uniform(-11.5, 11.5, (40, 4))
    at[0] = at[1]  # two stripes at one place: a connector of no length
    nodes = spark.createDataFrame([(f, k, *map(float, p)) for k, p in enumerate(at)], "f long, node int, sx double, sy double, ex double, ey double")
    links = spark.createDataFrame([(f, 0, 1), *[(f, a, b) for a in range(1, 40) for b in range(a + 1, min(40, a + 6))]], "f long, src int, dst int")
    seen = set()
    for r in routes.hops(nodes, links, e).collect():
        p, q = min(((p, q) for p in (at[r.src, :2], at[r.src, 2:]) for q in (at[r.dst, :2], at[r.dst, 2:])), key=lambda pq: float(np.linalg.norm(pq[1] - pq[0])))
        way = region.connect(p, q, True)
        assert r.cost == (pytest.approx(way[0]) if way else None) and r.ok == (way is not None and way[0] <= max(12.0, 2.5 * r.direct))
        seen.add((way is not None, r.direct_ok))
    assert len(seen) == 4
    isl = spark.createDataFrame([(f, k, k % 2, k, 0, 0, 1, [float(p[0]), 0.0, float(p[2])], [float(p[1]), 0.0, float(p[3])]) for k, p in enumerate(at)] + [(f, 99, 0, 99, 0, 0, 1, [-12.0, 0.0], [-12.0, 0.0])], routes.ISLANDS)
    got = {r.island: (r.reverse, r.cost) for r in routes.entries(isl, e).collect()}
    start, want, over = region.at(0, 0.0), {}, 0
    for k, p in [*enumerate(at), (99, np.array([-12.0, -12.0, 0.0, 0.0]))]:
        head, tail = region.connect(start, p[:2], False), region.connect(start, p[2:], False)
        if head or tail:
            reverse = bool(tail and (not head or tail[0] < head[0]))
            want[k] = (reverse, pytest.approx((tail if reverse else head)[0]))
            over += region.anchor(p[2:] if reverse else p[:2])[0] > 0
    assert got == want and 10 < len(want) and over > 2
    none = e.where(F.lit(False))
    assert routes.entries(isl, none).count() == 0 and {(r.src, r.dst) for r in routes.hops(nodes, links, none).where("ok").collect()} == {(0, 1)}


# ---- stages ----


def test_queries_of_a_session_share_stages(spark, sf_dir):
    from swathline.plans import planner
    from swathline.sources.fixtures import Tables
    from swathline.sources.scratch import clear

    clear(spark)
    one, two = planner.Stages(Tables(spark, sf_dir)), planner.Stages(Tables(spark, sf_dir))
    files = sorted(one.nodes.inputFiles())
    assert sorted(two.nodes.inputFiles()) == files  # read, not made again
    other = planner.Stages(Tables(spark, sf_dir), sweep.PlanConfig(step=5.0))
    assert not set(other.nodes.inputFiles()) & set(files)
    assert not set(planner.Stages(Tables(spark, sf_dir), source="nested_edges").nodes.inputFiles()) & set(files)
    clear(spark)
    assert not set(planner.Stages(Tables(spark, sf_dir)).nodes.inputFiles()) & set(files)


def test_observed_metrics_equal_recounted_tables(spark, sf_dir):
    from swathline.plans import planner
    from swathline.sources.fixtures import Tables

    p = planner.FullPlan(Tables(spark, sf_dir))
    got = {(r.stage, r.key): r.value for r in planner.stage_report(p).collect()}
    assert {stage for stage, _ in got} == set(range(9))
    recounted = {(0, "sides"): p.edges, (1, "rawStripes"): p.stripes, (2, "kept"): p.filtered, (3, "nodes"): p.nodes, (3, "edges"): p.links, (5, "chunks"): p.chunks, (6, "islands"): p.islands, (7, "fields"): p.routes, (8, "legs"): p.tours}
    assert {k: got[k] for k in recounted} == {k: df.count() for k, df in recounted.items()}
    assert got[2, "dropped"] == p.stripes.count() - p.filtered.count()
    assert got[4, "merged"] == p.merged.where("merged <> comp").count()
    assert got[0, "area"] == pytest.approx(sum(r.area for r in regions.ring_stats(p.edges).collect()))
    assert got[7, "used"] == p.routes.agg(F.sum("used")).first()[0]


def test_stale_markers_send_no_publish_through_the_driver(spark):
    publish = lambda n: spark.range(n).selectExpr("id % 3 AS mission_id", "'route' AS ns", "id")
    gone = commands.stale_markers(publish(12), publish(9), spark.range(3).selectExpr("id AS mission_id"))
    assert "Broadcast" not in gone._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in gone.where("ns = 'route'").collect()) == [9, 10, 11]


def test_small_fields_are_dealt_over_all_tasks_and_toured_once(spark):
    ring = overlay.inset([square(0, 0, 40)], 2)
    e = arrangement.edges_of(spark.createDataFrame([r for f in range(8) for r in overlay.frame_of(f, ring).to_dict("records")]))
    isl = spark.createDataFrame([(f, 0, 0, k, 0, 0, 1, [2.0, 38.0], [4.0 + 8 * k] * 2) for f in range(8) for k in range(3)], routes.ISLANDS)
    found = routes.visits(isl, e)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    legs = routes.legs_of(found).orderBy("f", "step").collect()
    route = {r.f: list(zip(r.xs, r.ys, strict=True)) for r in routes.routes_of(found).collect()}
    assert len(route) == 8 and all(sorted(r.island for r in legs if r.f == f and r.island is not None) == [0, 1, 2] for f in route)
    for f, points in route.items():  # every connector's points are on the route, in order
        at = 0
        for p in [p for r in legs if r.f == f for p in zip(r.xs, r.ys, strict=True)]:
            near = [k for k in range(at, len(points)) if math.dist(points[k], p) <= 0.02]
            assert near
            at = near[0]
    assert {tuple(route[f]) for f in route} == {tuple(route[0])}


def test_fields_are_streams_that_may_span_batches(spark):
    ring = overlay.inset([square(0, 0, 40)], 2)
    e = arrangement.edges_of(spark.createDataFrame([r for f in range(9) for r in overlay.frame_of(f, ring).to_dict("records")]))
    isl = spark.createDataFrame([(f, 0, 0, k, 0, 0, 1, [2.0, 38.0], [4.0 + 4 * k] * 2) for f in range(8) for k in range(1 + f)], routes.ISLANDS)  # field 8 has none
    sizes = {}
    for most in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            found = routes.visits(isl, e)
            assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()  # a group of its own for each field costs more than its work
            sizes[most] = sorted((r.f, r.ok, r.islands, r.used, tuple(r.xs), tuple(r.ys), len(r.legs)) for r in found.collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x[:4] for x in sizes["10000"]] == [*[(f, True, 1 + f, 1 + f) for f in range(8)], (8, False, 0, 0)]
    assert sizes["1"] == sizes["3"] == sizes["10000"]


def test_scratch_tables_are_joined_by_shuffles(spark):
    a, b = (written(spark.range(30).selectExpr("id AS f", "id AS v")) for _ in range(2))
    joined = a.groupBy("f").count().join(b.where("v > 3").select("f", "v"), "f", "left_anti")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 4


def test_sweeps_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(passes, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df))[1])
    sides = sweep.in_sweep_frame(edges(spark, [square(0, 0, 40), square(15, 15, 10)[::-1]]))
    found = passes.swept(sides, sides.where("ring = 0 AND i = 0").selectExpr("f", "a1 AS sa", "d1 AS sd"))
    assert found.stripes.count() > 0 and len(plans) > 8 and not [p for p in plans[3:] if "BroadcastExchange" in p]  # the first three read the given sides


def test_points_look_at_sides_inside_their_rows(spark):
    e = written(edges(spark, [square(0, 0, 10), square(4, 4, 2)[::-1]]))
    p = written(spark.createDataFrame([(1, 6, 1.0, 5.0), (2, 6, 5.0, 4.5), (2, 6, 5.0, 9.0), (3, 7, 0.0, 0.0)], "id int, f long, px double, py double"))
    near = regions.anchors(p, e, ["id"])
    assert {(r.id, r.ring, round(r.dist, 9)) for r in near.collect()} == {(1, 0, 1.0), (2, 1, 0.5)}  # of two points of one key the nearer
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    ahead = regions.along_contour(p, e, ["id"], "1")
    assert {(r.id, round(r.x, 9), round(r.y, 9)) for r in ahead.where("id = 1").collect()} == {(1, 0.0, 4.0)}
    plan = ahead._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "transform(sides" in plan


def test_a_side_is_asked_for_its_nearest_place_once(spark):
    e = written(edges(spark, [square(0, 0, 10), square(4, 4, 2)[::-1]]))
    p = written(spark.createDataFrame([(1, 6, 1.0, 5.5), (2, 6, 5.0, 4.5), (3, 6, -3.0, -4.0)], "id int, f long, px double, py double"))
    near = regions.anchors(p, e, ["id"])
    got = {r.id: (r.ring, r.i, *(round(v, 9) for v in (r.t, r.arc, r.x, r.y, r.dist))) for r in near.collect()}
    assert got == {1: (0, 3, 0.45, 34.5, 0.0, 5.5, 1.0), 2: (1, got[2][1], 0.5, got[2][1] * 2 + 1.0, 5.0, 4.0, 0.5), 3: (0, 0, 0.0, 0.0, 0.0, 0.0, 5.0)}
    asked = [line for line in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "array_min" in line]
    assert len(asked) == 1 and asked[0].count(" / ") == 1


def test_tiles_around_an_event_are_sorted_in_its_row(spark, sf_dir):
    from swathline.plans.catalog import QUERIES

    assert "Window" not in QUERIES["i7_center_out"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_links_of_a_field_become_stars_before_the_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "written", lambda df: (made.append(1), written(df))[1])
    order = np.random.default_rng(5).permutation(300).tolist()
    links = spark.createDataFrame([(f, a, b) for f in (1, 2) for a, b in zip(order, order[1:])], "f long, a long, b long")
    found = graph.connected(links, spark.createDataFrame([(f, v) for f in (1, 2) for v in range(301)], "f long, v long"))
    assert {(r.f, r.v, r.comp) for r in found.collect()} == {(f, v, 0 if v < 300 else 300) for f in (1, 2) for v in range(301)}
    assert len(made) <= 4


def test_stars_of_several_batches_are_joined_by_the_rounds(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        order = np.random.default_rng(6).permutation(90).tolist()
        links = spark.createDataFrame([(1, a, b) for a, b in zip(order, order[1:]) if a != 40], "f long, a long, b long")
        cut = order.index(40) + 1
        found = graph.connected(links, spark.createDataFrame([(1, v) for v in order], "f long, v long"))
        assert {(r.v, r.comp) for r in found.collect()} == {(v, min(part)) for part in (order[:cut], order[cut:]) for v in part}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_overlays_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    keep = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df))[1]
    monkeypatch.setattr(arrangement, "written", keep)
    rings = [(6, 0, i, 4, float(x), float(y)) for i, (x, y) in enumerate(square(0, 0, 40))] + [(6, 1, i, 4, float(x), float(y)) for i, (x, y) in enumerate(square(15, 15, 10))]
    found = keep(arrangement.working_regions(spark.createDataFrame(rings, "f long, ring int, i int, n int, x double, y double")))
    assert found.count() == 8 and len(plans) > 4 and not [p for p in plans if "BroadcastExchange" in p]


def test_short_chords_of_a_field_are_tested_together(spark):
    c = sweep.PlanConfig()
    e = edges(spark, [square(0, 0, 40), square(15, 15, 10)[::-1]]).toPandas()
    rng = np.random.default_rng(8)
    p, q = rng.uniform(-2, 42, (400, 2)), rng.uniform(-2, 42, (400, 2))
    alone, region = routes.Region(e, c), routes.Region(e, c)
    region.BLOCK = 1000
    region.prepare_chords(p, q)
    region.inside = None  # no chord is tested again
    assert [region.chord_inside(a, b) for a, b in zip(p, q)] == [alone.chord_inside(a, b) for a, b in zip(p, q)]
    comps, rows = np.sort(rng.integers(0, 3, 60)), np.zeros(60, int)
    for k in range(3):
        rows[comps == k] = np.sort(rng.integers(0, 9, (comps == k).sum()))
    ends = rng.uniform(0, 12, (60, 4))
    want = set()
    for phase in (True, False):
        driven = [(d[:2], d[2:]) if (len(set(rows[(comps == k) & (rows <= r)])) % 2 == 1) == phase else (d[2:], d[:2]) for k, r, d in zip(comps, rows, ends)]
        for k in range(3):
            own = sorted(set(rows[comps == k]))
            after = dict(zip(own, own[1:]))
            want |= {(*driven[s][1], *driven[t][0]) for s in np.flatnonzero(comps == k) for t in np.flatnonzero(comps == k) if s != t and rows[t] in (rows[s], after.get(rows[s])) and ((driven[s][1] - driven[t][0]) ** 2).sum() <= 25}
    assert {(*a, *b) for ps, qs in routes._short_hops(ends, comps, rows, 5.0) for a, b in zip(ps, qs)} == want


def test_what_hangs_on_a_side_alone_is_not_worked_out_for_each_point(spark):
    e = written(edges(spark, [square(0, 0, 10)]))
    near = regions.anchors(spark.createDataFrame([(1, 6, 1.0, 5.5)], "id int, f long, px double, py double"), e, ["id"])
    asked = [line for line in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "array_min" in line]
    assert len(asked) == 1 and ".x2" not in asked[0] and near.first().dist == 1.0
