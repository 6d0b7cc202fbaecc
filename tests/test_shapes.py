"""Overlays in joins against the NumPy clipper, ring forests and sweeps in passes."""

import brute_overlay as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import arrangement, passes, regions, sweep


def square(x, y, s):
    return np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)


def star(rng, x, y, n, least=5, most=20):
    a, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(least, most, n)
    return np.stack([x + r * np.cos(a), y + r * np.sin(a)], 1)


def vertices(spark, cases):
    rows = [(f, op, k, i, *map(float, p)) for f, both in enumerate(cases) for op, rings in enumerate(both) for k, ring in enumerate(rings) for i, p in enumerate(ring)]
    return spark.createDataFrame(rows, "f long, op int, ring int, i int, x double, y double")


def areas(rings):
    """Sorted areas of the rings of each (f, result)."""
    out = {}
    for key, g in rings.groupby(["f", "result", "ring"]):
        assert list(g["n"]) == [len(g)] * len(g)
        out.setdefault(key[:2], []).append(brute.area(g.sort_values("i")[["x", "y"]].to_numpy()))
    return {k: sorted(v) for k, v in out.items()}


def test_overlays_match_the_clipper(spark):
    rng = np.random.default_rng(4)
    cases = [
        ([square(0, 0, 10)], [square(5, 5, 10)]),
        ([square(0, 0, 10)], [square(10, 0, 5)]),  # a shared side
        ([square(0, 0, 10)], [square(3, 3, 2)]),
        ([square(0, 0, 10)], [square(0, 0, 10)]),  # copies
        ([square(0, 0, 10)], [square(10, 10, 5)]),  # a shared corner
        ([square(0, 0, 10)], [square(20, 0, 5)]),
        ([star(rng, 0, 0, 12)], [star(rng, 8, 3, 9)]),
        ([star(rng, 0, 0, 30), star(rng, 40, 0, 10)], [star(rng, 20, 3, 40, 3, 40)]),
        ([np.array([[0, 0], [10, 10], [10, 0], [0, 10]], float)], [square(2, 2, 3)]),  # crosses itself
        ([square(0, 0, 10)], []),
    ]
    got = areas(arrangement.overlaid(vertices(spark, cases), {h: (h, "nonzero") for h in arrangement.OVERLAY}).toPandas())
    for f, (a, b) in enumerate(cases):
        for how in arrangement.OVERLAY:
            assert got.get((f, how), []) == pytest.approx(sorted(map(brute.area, brute.combine(a, b, how))), abs=1e-4)


def test_fill_rules_of_rings_that_overlap(spark):
    a, b = square(0, 0, 10), square(5, 5, 10)
    got = areas(arrangement.overlaid(vertices(spark, [([a, b], []), ([a, b[::-1]], []), ([a[::-1], b[::-1]], [])]), {r: ("union", r) for r in arrangement.FILL}).toPandas())
    total = {k: round(sum(v), 6) for k, v in got.items()}
    assert total == {
        **{(0, r): v for r, v in {"evenodd": 150, "nonzero": 175, "positive": 175}.items()},
        **{(1, r): v for r, v in {"evenodd": 150, "nonzero": 150, "positive": 75, "negative": 75}.items()},
        **{(2, r): v for r, v in {"evenodd": 150, "nonzero": 175, "negative": 175}.items()},
    }


def test_a_cutout_across_a_field_leaves_two_paths(spark):
    field, road = square(0, 0, 40), np.array([[-5, 18], [45, 18], [45, 22], [-5, 22]], float)
    given = vertices(spark, [([field], [road]), ([field, square(5, 5, 6)], [road])]).withColumn("ring", F.when(F.col("op") == 0, F.col("ring")).otherwise(F.col("ring") + 1))
    region = arrangement.working_regions(given.where("f = 0"))
    e = arrangement.edges_of(region)
    assert sorted(r.area for r in regions.ring_stats(e).collect()) == pytest.approx([720, 720])
    assert {(r.ring, r.path, r.outer) for r in regions.nesting(e).collect()} == {(0, 0, True), (1, 1, True)}


def test_insets_match_the_clipper(spark):
    rng = np.random.default_rng(6)
    cases = [[square(0, 0, 40)], [square(0, 0, 40), square(10, 10, 6)[::-1]], [square(0, 0, 3)], [star(rng, 0, 0, 9, 15, 40)], [np.array([[0, 0], [30, 0], [30, 3], [50, 3], [50, 0], [80, 0], [80, 30], [50, 30], [50, 6], [30, 6], [30, 30], [0, 30]], float)]]
    got = arrangement.insets(vertices(spark, [(rings, []) for rings in cases]).withColumn("n", F.lit(0)), 2.0).withColumn("result", F.lit("inset")).toPandas()
    found = areas(got)
    for f, rings in enumerate(cases):
        assert found.get((f, "inset"), []) == pytest.approx(sorted(map(brute.area, brute.inset(rings, 2.0))), abs=1e-3)
    assert len(found[4, "inset"]) == 2  # a neck narrower than twice the distance parts the field


def test_ring_forest(spark):
    rings = [square(0, 0, 100), square(10, 10, 60)[::-1], square(20, 20, 30), square(25, 25, 5)[::-1], square(200, 0, 50), square(210, 10, 5), square(230, 30, 5)]
    e = arrangement.edges_of(vertices(spark, [(rings, [])]).withColumn("n", F.expr("4")))
    got = {r.ring: (r.parent, r.depth, r.outer, r.path, r.largest) for r in regions.nesting(e).collect()}
    assert got == {
        0: (None, 0, True, 0, True),
        1: (0, 1, False, 0, False),
        2: (1, 2, True, 2, False),
        3: (2, 3, False, 2, False),
        4: (None, 0, True, 4, False),
        5: (4, 1, False, 4, False),  # a hole by its place, whatever its direction
        6: (4, 1, False, 4, False),
    }
    points = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, 22.0, 22.0), (3, 0, 205.0, 5.0), (4, 0, -50.0, 5.0)], "id int, f long, px double, py double")
    assert {r.id: r.ring for r in regions.owners(points, e, ["id"]).collect()} == {1: 0, 2: 0, 3: 4, 4: 0}
    held = {(r.id, r.ring) for r in regions.ring_holds(points, e, ["id"]).collect()}
    assert held == {(1, 0), (2, 0), (2, 1), (2, 2), (3, 4)}


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "f long, op int, ring int, i int, n int, x double, y double")
    assert arrangement.overlaid(none, {"u": ("union", "nonzero")}).count() == 0 and arrangement.insets(none, 2.0).count() == 0


# ---- sweeps ----


def swept(spark, rings, start, step=4.0):
    """Sweeps rings in a frame of their own: x along, y across."""
    e = arrangement.edges_of(vertices(spark, [(rings, [])]).withColumn("n", F.lit(4)))
    sides = e.selectExpr("*", "x1 AS a1", "x2 AS a2", "y1 AS d1", "y2 AS d2")
    return passes.swept(sides, spark.createDataFrame([(0, *start)], "f long, sa double, sd double"), sweep.PlanConfig(step=step))


def test_one_pass_takes_a_rectangle(spark):
    got = swept(spark, [square(0, 0, 20)], (0.0, 10.0))
    stripes = got.stripes.toPandas().sort_values("row")
    assert list(stripes["d"].round(3)) == [10, 14, 18, 6, 2] and stripes["len"].round(3).eq(20).all()  # the anchor's line, those after, those before
    assert got.left.count() == 0 and [r.rows for r in got.passes.collect()] == [5]
    assert got.bands.toPandas()["area"].sum() == pytest.approx(400)


def test_what_lines_miss_is_left_for_the_next_pass(spark):
    # Lines at 1, 5, 9, ... miss the second part, 2.2 high between two of them; only half of it is in the bands.
    low, high = np.array([[0, 0], [20, 0], [20, 2], [0, 2]], float), np.array([[0, 6], [30, 6], [30, 8.2], [0, 8.2]], float)
    got = swept(spark, [low, high], (0.0, 1.0))
    by_pass = {r["pass"]: (r.rows, r.segments, round(r.area, 3)) for r in got.passes.collect()}
    # First pass: lines at 1 and 5; the one at 1 takes [-1, 3], the one at 5 cuts nothing and has no band.
    # Second pass: one line where the second part begins; what is above its band is under the least area.
    assert by_pass == {0: (2, 1, 66.0), 1: (3, 1, 6.0)}
    assert got.stripes.toPandas().sort_values("pass")["d"].round(3).tolist() == [1.0, 6.0]
    assert [(round(r.lo, 3), round(r.hi, 3)) for r in got.left.collect()] == [(8.0, 8.2)]


def test_fields_stop_on_their_own(spark):
    both = vertices(spark, [([square(0, 0, 20)], []), ([square(0, 0, 2), np.array([[0, 6], [30, 6], [30, 8.2], [0, 8.2]], float)], [])])
    sides = arrangement.edges_of(both.withColumn("n", F.lit(4))).selectExpr("*", "x1 AS a1", "x2 AS a2", "y1 AS d1", "y2 AS d2")
    starts = spark.createDataFrame([(0, 0.0, 10.0), (1, 0.0, 1.0)], "f long, sa double, sd double")
    got = passes.swept(sides, starts)
    assert {r.f: r.n for r in got.passes.groupBy("f").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 2}


def test_a_sliver_too_small_for_a_pass_is_left(spark):
    # Lines at 0, 10 and 20 take up to 25; of 16 metres those at 0 and 10 leave the last one.
    got = swept(spark, [np.array([[0, 0], [1.5, 0], [1.5, 20.5], [0, 20.5]], float)], (0.0, 0.0), step=10.0)
    left = [(round(r.lo, 3), round(r.hi, 3)) for r in got.left.collect()]
    assert [r["pass"] for r in got.passes.collect()] == [0] and left == []
    small = swept(spark, [np.array([[0, 0], [1.5, 0], [1.5, 16], [0, 16]], float)], (0.0, 0.0), step=10.0)
    assert [(round(r.lo, 3), round(r.hi, 3)) for r in small.left.collect()] == [(15.0, 16.0)]  # 1.5 square metres, under the least area of 50
