"""Scalar functions against known values."""

import math

import pytest

from swathline.functions import angles, geo, motion, planar, rects, tiles, views


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS v").first().v


def test_haversine_of_a_thousandth_degree(spark):
    assert 110 < value(spark, geo.haversine("52e0", "13e0", "52.001e0", "13e0")) < 120


def test_projection_and_back(spark):
    x, y = geo.project("55e0", "37e0")
    assert value(spark, x) == pytest.approx(4118821.1594, abs=1e-3)
    assert value(spark, y) == pytest.approx(-7361866.1131, abs=1e-3)
    lat, lon = geo.unproject(x, y)
    assert value(spark, lat) == pytest.approx(55) and value(spark, lon) == pytest.approx(37)


def test_tile_and_quadkey_of_a_point(spark):
    x, y = tiles.of_point("55e0", "37e0", "17")
    assert (value(spark, x), value(spark, y)) == (79007, 41457)
    assert value(spark, tiles.quadkey(x, y, 17)) == "12031010232231113"


def test_angles(spark):
    assert value(spark, angles.normalize("(4e0 * pi())")) == pytest.approx(0, abs=1e-12)
    assert value(spark, angles.wrap_degrees("180e0")) == 180
    assert value(spark, angles.wrap_degrees("-180e0")) == -180
    assert value(spark, angles.wrap_degrees("540.5e0")) == pytest.approx(-179.5)
    x, y = angles.unit_vector("3e0", "4e0")
    assert (value(spark, x), value(spark, y)) == pytest.approx((0.6, 0.8))
    assert value(spark, angles.yaw_of_quaternion("0e0", "0e0", f"{math.sin(0.25)!r}e0", f"{math.cos(0.25)!r}e0")) == pytest.approx(0.5)


@pytest.mark.parametrize(("distance", "degrees", "kind"), [(10, 40, "turn"), (5, 0.5, "move"), (0.2, 0.5, "stop")])
def test_command_priority(spark, distance, degrees, kind):
    c = motion.command(f"{distance}e0", f"radians({degrees}e0)", "radians(10e0)", "0.5e0")
    assert value(spark, c["kind"]) == kind


def test_rect_edges_are_half_open(spark):
    r = ("10e0", "0e0", "0e0", "10e0")
    assert value(spark, rects.contains_point(r, "10e0", "0e0"))
    assert not value(spark, rects.contains_point(r, "0e0", "5e0"))
    assert not value(spark, rects.contains_point(r, "5e0", "10e0"))


def test_labels(spark):
    assert value(spark, views.fixed("2.345e0", 2)) in ("2.35", "2.34")
    assert value(spark, views.fixed("-0.001e0", 2)) == "0.00"
    assert value(spark, views.distance_label("1500e0", "'km'")) == "2 km"
    assert value(spark, views.distance_label("250e0", "'km'")) == "250 m"


def test_meeting_of_segments(spark):
    a, b = ("0e0", "0e0", "2e0", "2e0"), ("0e0", "2e0", "2e0", "0e0")
    assert value(spark, planar.segments_meet(a, b))
    assert not value(spark, planar.segments_meet(a, ("3e0", "0e0", "5e0", "2e0")))
