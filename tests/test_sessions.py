"""Drawing sessions, tiles, parameters, streams over tables, and the connectors of a route, on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from swathline.operators import commands, drawing, routes
from swathline.sources import parameters
from swathline.streaming import follow
from swathline.streaming.tables import drained, landed, streamed

CLICKS = "robot_id long, seq long, op string, x double, y double"


def outcomes(spark, clicks, kind, robot=1):
    df = spark.createDataFrame([(robot, n, *c) for n, c in enumerate(clicks)], CLICKS)
    return [(r.outcome, r.drafted, r.contour, r.cutouts) for r in drawing.sessions(df, kind).orderBy("seq").collect()]


def test_a_contour_closes_near_its_first_vertex(spark):
    square = [("point", 0.0, 0.0), ("point", 9.0, 0.0), ("point", 9.0, 9.0), ("point", 0.0, 9.0)]
    assert outcomes(spark, [*square, ("point", 1.0, 1.0)], "contour")[-1] == ("closed", 0, 4, 0)
    assert outcomes(spark, [*square, ("point", 1.5, 1.5)], "contour")[-1] == ("vertex", 5, 0, 0)
    assert outcomes(spark, [*square[:2], ("point", 1.0, 0.0)], "contour")[-1][0] == "vertex"  # two vertices close nothing
    assert outcomes(spark, [*square, ("cancel", 0.0, 0.0), ("point", 0.0, 0.0)], "contour")[-2:] == [("cancelled", 0, 0, 0), ("vertex", 1, 0, 0)]
    assert outcomes(spark, [*square, ("point", 0.0, 0.0), ("remove", 0.0, 0.0)], "contour")[-1] == ("removed", 0, 0, 0)
    assert outcomes(spark, [*square[:3], ("point", 4.0, -5.0)], "contour")[-1] == ("refused", 3, 0, 0)
    bow = [("point", 0.0, 0.0), ("point", 9.0, 0.0), ("point", 9.0, 9.0), ("point", 12.0, 9.0), ("point", 12.0, 4.0), ("point", 1.0, 0.5)]
    assert outcomes(spark, bow[:5], "contour")[-1] == ("vertex", 5, 0, 0)
    assert outcomes(spark, bow, "contour")[-1] == ("intersects", 0, 0, 0)  # the closing side from (12, 4) cuts x = 9


def test_cutouts_are_added_and_taken_back(spark):
    tri = [("point", 0.0, 0.0), ("point", 4.0, 0.0), ("point", 0.0, 4.0)]
    did = outcomes(spark, [("undo", 0.0, 0.0), *tri[:2], ("finish", 0.0, 0.0), tri[2], ("finish", 0.0, 0.0), *tri, ("finish", 0.0, 0.0), *tri, ("undo", 0.0, 0.0), ("clear", 0.0, 0.0)], "cutout")
    assert did[0] == ("none", 0, 0, 0) and did[3] == ("too_few", 2, 0, 0) and did[5] == ("added", 0, 0, 1)
    assert did[9] == ("added", 0, 0, 2) and did[13] == ("undone", 0, 0, 1) and did[14] == ("cleared", 0, 0, 0)


def test_no_clicks(spark):
    assert drawing.sessions(spark.createDataFrame([], CLICKS), "contour").count() == 0


def test_tiles_come_only_while_in_view(spark):
    steps = [(1, 1, True, 3, 1, 1), (1, 2, False, 3, 0, 1), (1, 3, True, 3, 1, 2), (1, 4, False, 4, 9, 9), (1, 5, True, 3, 1, 1), (1, 6, True, 4, 8, 10)]
    got = drawing.tile_states(spark.createDataFrame(steps, "robot_id long, seq long, reply boolean, zoom int, x int, y int")).collect()
    assert {(r.zoom, r.x, r.y) for r in got if r.state == "finished"} == {(3, 1, 2), (4, 8, 10)}
    assert len(got) == 6 + 9  # the view at the edge has six tiles


def test_parameters_are_clamped(spark):
    rows = [(1, 1, "turn_kp", -3.0), (1, 2, "gps_alpha", 9.0), (1, 3, "gps_alpha", None), (1, 4, "gps_alpha", math.nan), (1, 5, "no_such", 1.0), (1, 6, "settle_min_s", 4.0), (1, 7, "turn_direction_sign", -0.2), (1, 8, "forward_gain", 1.0), (1, 9, "forward_gain", 0.7)]
    got = {r.name: r.value for r in parameters.parameters(spark.createDataFrame(rows, "robot_id long, seq long, name string, value double")).collect()}
    assert got.keys() == parameters.defaults().keys()
    assert (got["turn_kp"], got["gps_alpha"], got["turn_direction_sign"], got["forward_gain"], got["settle_min_s"], got["settle_timeout_s"]) == (0.0, 1.0, -1.0, 0.7, 4.0, 4.0)
    assert got["yaw_tolerance_rad"] == 0.05


def test_a_manual_route_starts_at_the_robot(spark):
    clicks = spark.createDataFrame([(1, 2, 55.0, 37.001), (1, 1, 55.0, 37.0), (2, 1, 55.0, 37.0)], "robot_id long, seq int, lat double, lon double")
    starts = spark.createDataFrame([(1, 55.001, 37.0)], "robot_id long, lat double, lon double")
    got = [(r.robot_id, r.pos, r.lat, round(r.metres)) for r in commands.manual_route(clicks, starts).orderBy("robot_id", "pos").collect()]
    assert got == [(1, 1, 55.001, 0), (1, 2, 55.0, 111), (1, 3, 55.0, 175), (2, 1, 55.0, 0)]


def test_streams_land_what_the_tables_hold(spark, sf_dir):
    t = streamed(spark, sf_dir)
    assert t["gps_fix"].isStreaming
    assert landed(t["gps_fix"].select("event_id")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_the_last_marker_of_a_micro_batch_wins(spark, sf_dir):
    marks = streamed(spark, sf_dir)["gps_fix"].selectExpr("'fix' AS ns", "1 AS id", "'ADD' AS action", "event_id")
    path = drained(marks, lambda df, n, path: follow.markers_upsert(df, n, path, "event_id"))
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0]
    assert [r.event_id for r in follow.markers(spark, path).collect()] == [last]


def square(spark, size=40.0):
    p = [(0.0, 0.0), (size, 0.0), (size, size), (0.0, size)]
    return spark.createDataFrame([(1, 0, i, *p[i], *p[(i + 1) % 4], size) for i in range(4)], "f long, ring int, i int, x1 double, y1 double, x2 double, y2 double, len double")


def test_chunks_may_join_where_rows_touch(spark):
    rows = [(1, 0, 0, 0, 0, 2, [0.0, 5.0], [0.0, 0.0]), (1, 0, 0, 1, 3, 5, [5.0, 9.0], [3.0, 3.0]), (1, 0, 0, 2, 7, 8, [0.0, 1.0], [9.0, 9.0]), (1, 0, 1, 3, 3, 5, [0.0, 1.0], [9.0, 9.0])]
    got = routes.chunk_candidates(spark.createDataFrame(rows, routes.CHUNKS)).orderBy("a", "b", "flip").collect()
    assert [(r.a, r.b, r.flip, r.direct) for r in got] == [(0, 1, False, 3.0), (0, 1, True, 5.0)]


def test_connectors_of_a_route(spark):
    rows = [(1, 0, 0, 0, 0, 1, 1, [1.0, 8.0, 8.0, 1.0, 1.0], [1.0, 1.0, 3.0, 3.0, 4.0]), (1, 1, 0, 1, 0, 1, 1, [2.0, 9.0, 9.0, 8.0, 2.0], [20.0, 6.0, 7.0, 9.0, 9.0])]
    isl = spark.createDataFrame(rows, routes.ISLANDS)
    got = routes.tours(isl, square(spark)).orderBy("step").collect()
    whole = routes.stitched(isl, square(spark)).first()
    assert [r.island for r in got] == [0, 1, None] and whole.used == 2 and whole.unreachable == 0
    assert not got[0].reverse and got[0].ahead == pytest.approx(math.dist((1.0, 4.0), (2.0, 9.0)))
    assert got[1].reverse and got[1].ahead == 0.0  # the tail is nearer
    assert [round(r.cost, 6) for r in got] == [2.0, 8.0, 22.0]  # to the boundary, along it, and from it
    for r in got:
        pts = list(zip(r.xs, r.ys))
        assert r.cost >= 0 and pts[-1] in {(1.0, 1.0), (2.0, 9.0), (0.0, 0.0)}
    assert (whole.xs[0], whole.ys[0]) == (0.0, 0.0) == (whole.xs[-1], whole.ys[-1])


def test_camera_states_follow_each_action(spark):
    import math

    from swathline.operators import camera

    actions = [("drag", 10, 0), ("scale_by", 2, 0), ("drag", 10, 0), ("rotate_by", 90, 0), ("drag", 4, 0), ("rotate_by", -30, 0), ("scale_to", 4, 0), ("scale_by", 0.5, 0), ("move_to", 7, 8), ("drag", 0, 6), ("rotate_to", 10, 0), ("rotate_by", 5, 0)]
    rows = [(r, i + 1, k, float(p), float(q)) for r in (1, 2) for i, (k, p, q) in enumerate(actions[: 12 if r == 1 else 5])]
    got = {(g.robot_id, g.seq): g for g in camera.states(spark.createDataFrame(rows, "robot_id long, seq long, kind string, p double, q double")).collect()}
    for robot in (1, 2):
        scale, azimuth, x, y = 1.0, 0.0, 0.0, 0.0
        for _, seq, kind, p, q in (r for r in rows if r[0] == robot):
            scale = scale * p if kind == "scale_by" else p if kind == "scale_to" else scale
            azimuth = azimuth + p if kind == "rotate_by" else p if kind == "rotate_to" else azimuth
            c, s = math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
            x, y = (p, q) if kind == "move_to" else (x - (p * c - q * s) / scale, y - (p * s + q * c) / scale) if kind == "drag" else (x, y)
            g = got[robot, seq]
            assert (g.scale, g.azimuth, g.x, g.y) == pytest.approx((scale, azimuth, x, y))
