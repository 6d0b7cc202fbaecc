"""Regions as edge tables: (f, ring, i, n, x1, y1, x2, y2, len), ring 0 the contour, others holes.

Points and lines meet a region in an equi-join on ``f`` with the edges, so a
plan is hash joins and grouped aggregates; ties are decided by (ring, side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, planar
from ..sources.scratch import shuffled


def ring_stats(edges: DataFrame) -> DataFrame:
    """Signed area, perimeter and bounds of each ring."""
    return edges.groupBy("f", "ring").agg(
        F.expr("sum(x1 * y2 - x2 * y1) / 2e0").alias("area"),
        F.sum("len").alias("perimeter"),
        F.min("x1").alias("min_x"),
        F.max("x1").alias("max_x"),
        F.min("y1").alias("min_y"),
        F.max("y1").alias("max_y"),
    )


def with_arcs(edges: DataFrame) -> DataFrame:
    """Edges with ``arc``, the length of the ring before each."""
    w = Window.partitionBy("f", "ring").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("arc", F.coalesce(F.sum("len").over(w), F.lit(0.0)))


def inside(points: DataFrame, edges: DataFrame, key: list[str], eps: float = 1e-9) -> DataFrame:
    """Points (key..., f, px, py) with whether the region covers them: odd crossings, or on a side."""
    near = F.expr(f"{planar.side_distance('px', 'py')} <= {eps!r}")
    joined = points.join(edges, "f")
    found = joined.groupBy(*key, "f").agg(F.sum(F.expr(f"CASE WHEN {planar.crosses('px', 'py')} THEN 1 ELSE 0 END")).alias("crossings"), F.max(near.cast("int")).alias("on_edge"))
    return found.select(*key, "f", ((F.col("on_edge") == 1) | (F.col("crossings") % 2 == 1)).alias("inside"))


def ring_holds(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., f, ring): the rings that points (key..., f, px, py) are inside of, whatever the rings' direction.

    A point meets the sides of its field at its height only: both are put into
    bands of the field's mean side height.
    """
    band = edges.groupBy("f").agg(F.greatest(F.avg(F.abs(F.col("y2") - F.col("y1"))), F.lit(1e-3)).alias("band"))
    spread = edges.join(band, "f").withColumn("bucket", F.explode(F.sequence(F.floor(F.least("y1", "y2") / F.col("band")), F.floor(F.greatest("y1", "y2") / F.col("band")))))
    at = points.join(band, "f").withColumn("bucket", F.floor(F.col("py") / F.col("band")))
    hit = at.join(spread.select("f", "bucket", "ring", *planar.SIDE), ["f", "bucket"]).where(planar.crosses("px", "py"))
    return hit.groupBy(*key, "f", "ring").agg(F.count("*").alias("crossings")).where("crossings % 2 = 1").drop("crossings")


def nesting(edges: DataFrame) -> DataFrame:
    """The forest of rings: (f, ring, parent, depth, outer, path, area, perimeter, largest).

    ``parent``: the smallest ring that holds the ring's first vertex, null at the
    top. Rings of even depth are outer ones, whatever their direction; ``path`` is
    the outer ring that a ring bounds: itself, or a hole's parent. ``area`` is
    positive for outer rings; ``largest`` marks the field's greatest outer ring.
    """
    stats = ring_stats(edges).select("f", "ring", F.abs("area").alias("size"), "perimeter")
    probes = edges.where("i = 0").select("f", F.col("ring").alias("own"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    holds = ring_holds(probes, edges, ["own"]).where("ring <> own").join(stats.select("f", "ring", "size"), ["f", "ring"])
    above = holds.groupBy("f", F.col("own").alias("ring")).agg(F.count("*").alias("depth"), F.min(F.struct("size", "ring")).alias("least"))
    found = stats.join(above, ["f", "ring"], "left").select("f", "ring", F.col("least.ring").alias("parent"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), "size", "perimeter")
    found = found.withColumn("outer", F.col("depth") % 2 == 0)
    best = F.max(F.when(F.col("outer"), F.struct("size", -F.col("ring")))).over(Window.partitionBy("f"))
    return found.select(
        "f", "ring", "parent", "depth", "outer", F.when(F.col("outer"), F.col("ring")).otherwise(F.col("parent")).alias("path"), F.when(F.col("outer"), F.col("size")).otherwise(-F.col("size")).alias("area"), "perimeter", (F.struct("size", -F.col("ring")) == best).alias("largest")
    )


def owners(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., f, ring): the first outer ring that holds each point; of one that none holds, the field's greatest."""
    rings = nesting(edges).where("outer").select("f", "ring", "largest")
    first = ring_holds(points, edges, key).join(rings.select("f", "ring"), ["f", "ring"]).groupBy(*key, "f").agg(F.min("ring").alias("first"))
    other = rings.where("largest").select("f", F.col("ring").alias("other"))
    return points.join(first, [*key, "f"], "left").join(other, "f").select(*key, "f", F.coalesce("first", "other").alias("ring"))


def anchors(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The nearest boundary place of each point (key..., f, px, py): ring, side, t, arc, x, y, dist.

    A point looks at its field's sides inside its own row, so a task sorts its points and not every pair of a point and a side.
    What is asked of every side is its distance only, each part of it once, as functions of arrays are not compiled: what hangs on the side alone
    (its vector and that one's square) comes with it; the rest is of the nearest.
    """
    across, up, square = "(x2 - x1)", "(y2 - y1)", "(x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)"
    own = F.struct("ring", "i", "len", "arc", *planar.SIDE, F.expr(across).alias("vx"), F.expr(up).alias("vy"), F.expr(f"nullif({square}, 0e0)").alias("vv"))
    t = "coalesce(greatest(0e0, least(1e0, ((px - s.x1) * s.vx + (py - s.y1) * s.vy) / s.vv)), 0e0)"
    placed = f"transform(sides, s -> named_struct('s', s, 't', {t}))"
    off = f"transform({placed}, u -> named_struct('s', u.s, 't', u.t, 'dx', px - (u.s.x1 + u.t * u.s.vx), 'dy', py - (u.s.y1 + u.t * u.s.vy)))"
    near = f"transform({off}, w -> named_struct('dist', {angles.hypot('w.dx', 'w.dy')}, 'ring', w.s.ring, 'i', w.s.i, 't', w.t, 's', w.s))"
    sides = with_arcs(edges).groupBy("f").agg(F.collect_list(own).alias("sides"))
    nearest = points.join(shuffled(sides), "f").select(*key, "f", F.expr(f"array_min({near})").alias("n"))
    best = nearest.groupBy(*key, "f").agg(F.min("n").alias("n")).select(*key, "f", "n.dist", "n.ring", "n.i", "n.t", "n.s")
    return best.selectExpr(*key, "f", "dist", "ring", "i", "t", "s.arc + t * s.len AS arc", "s.x1 + t * s.vx AS x", "s.y1 + t * s.vy AS y")


def ring_distances(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    return points.join(edges, "f").groupBy(*key, "f", "ring").agg(F.min(F.expr(planar.side_distance("px", "py"))).alias("dist"))


def concave_vertices(edges: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(f, ring, i, concave): whether the ring turns right at vertex i of a counter-clockwise ring."""
    before = edges.select("f", "ring", F.expr("(i + 1) % n").alias("i"), F.expr("x2 - x1").alias("ax"), F.expr("y2 - y1").alias("ay"))
    after = edges.select("f", "ring", "i", F.expr("x2 - x1").alias("bx"), F.expr("y2 - y1").alias("by"))
    turn = F.expr(planar.cross("ax", "ay", "bx", "by"))
    return before.join(after, ["f", "ring", "i"]).select("f", "ring", "i", (turn < -eps).alias("concave"))


def self_intersections(edges: DataFrame) -> DataFrame:
    """Pairs of sides of one ring that meet: (f, ring, i, j, x, y). Neighbours and the closing pair are skipped."""
    a = edges.select("f", "ring", "n", F.col("i").alias("i"), *[F.col(c).alias(f"a_{c}") for c in planar.SIDE])
    b = edges.select("f", "ring", F.col("i").alias("j"), *[F.col(c).alias(f"b_{c}") for c in planar.SIDE])
    s, r = tuple(f"a_{c}" for c in planar.SIDE), tuple(f"b_{c}" for c in planar.SIDE)
    t, _ = planar.meeting(s, r)
    x, y = planar.side_point(t, s)
    pairs = a.join(b, ["f", "ring"]).where("j > i + 1 AND NOT (i = 0 AND j = n - 1)").where(planar.segments_meet(s, r))
    return pairs.select("f", "ring", "i", "j", F.expr(x).alias("x"), F.expr(y).alias("y"))


def along_contour(points: DataFrame, edges: DataFrame, key: list[str], step: str) -> DataFrame:
    """The place ``step`` metres (an SQL expression; negative: backwards) along the ring from each point's nearest place."""
    arcs = shuffled(with_arcs(edges))
    total = shuffled(edges.groupBy("f", "ring").agg(F.sum("len").alias("perimeter")))
    goal = anchors(points, edges, key).join(total, ["f", "ring"]).select(*key, "f", "ring", F.expr(f"pmod(arc + ({step}), perimeter)").alias("goal"))
    hit = goal.join(arcs, ["f", "ring"]).where("goal >= arc AND goal < arc + len")
    t = "((goal - arc) / len)"
    x, y = planar.side_point(t)
    return hit.groupBy(*key, "f").agg(F.min(F.struct("i", F.expr(x).alias("x"), F.expr(y).alias("y"))).alias("place")).select(*key, "f", "place.x", "place.y")
