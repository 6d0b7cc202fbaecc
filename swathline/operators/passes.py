"""Sweeping a region in passes until nothing is left of it.

A pass lays lines a step apart through what is left of a field, from the place of
its boundary nearest to the field's start, takes the stripes that they cut, and
takes a band of half a step either side of each line that cut one. Bands are
parallel, so what is left is always the region between some values of the
across-distance d: a set of intervals per field. A pass is joins of sides,
intervals and lines on the field and a bucket of d, one window over the starts and
ends of intervals and bands, and sums for the areas.

A field stops by itself: if nothing is left, if no line cut a stripe, if the area
left is small, if two passes in a row took next to nothing, or after ``MOST``
passes. Each pass is written as a table, and fields that have stopped take no part
in the next one, so the driver's loop is at most ``MOST`` steps whatever the fields.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planar
from ..sources.scratch import shuffled, written
from .sweep import PlanConfig, cut

MOST, STALLED = 6, 2
#: Intervals that are no wider are slivers; lines at an interval's end are moved inside by ``INSIDE``.
SLIVER, INSIDE = 2e-3, 1e-6


class Swept(NamedTuple):
    """Tables of a finished sweep.

    ``stripes``: f, pass, k, row, d, a0, a1, len. ``bands``: f, pass, k, d, area,
    what each line's band took of what was left. ``left``: f, lo, hi.
    ``passes``: f, pass, rows, segments, area (left after it), and whether it is counted.
    """

    stripes: DataFrame
    bands: DataFrame
    left: DataFrame
    passes: DataFrame


def least_area(c: PlanConfig) -> float:
    return max(1.0, 0.5 * c.step * c.step)


def half_band(c: PlanConfig) -> float:
    return max(0.25, 0.5 * c.step)


def clipped(sides: DataFrame, spans: DataFrame) -> DataFrame:
    """Sides cut to intervals (f, lo, hi, ...) of d: the interval's columns with x1, y1 (along and across) to x2, y2."""
    inside = lambda end: f"greatest(lo, least(hi, {end}))"
    at = lambda d: f"IF(d2 = d1, a1, a1 + ({d} - d1) / (d2 - d1) * (a2 - a1))"
    both = sides.select("f", "a1", "a2", "d1", "d2").join(spans, "f").where("least(d1, d2) <= hi AND greatest(d1, d2) >= lo")
    p, q = inside("d1"), inside("d2")
    return both.selectExpr(*spans.columns, f"IF(d1 = d2, a1, {at(p)}) AS x1", f"{p} AS y1", f"IF(d1 = d2, a2, {at(q)}) AS x2", f"{q} AS y2")


def extents(sides: DataFrame) -> DataFrame:
    """(f, lo, hi): the values of d that a ring of the field has, as intervals; parts of a region with nothing between them have one each."""
    rings = sides.groupBy("f", "ring").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    w = Window.partitionBy("f").orderBy("lo", "hi", "ring")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rings.withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("f", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def areas(sides: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """The area of the region between each interval's ends, by ``key``. Rings are directed: contours and holes the opposite way."""
    return shuffled(clipped(sides, spans).groupBy(*key).agg(F.abs(F.sum(F.expr("(y2 - y1) * (x1 + x2) / 2e0"))).alias("area")))


def _subtracted(spans: DataFrame, bands: DataFrame) -> DataFrame:
    """Intervals (f, lo, hi) less bands (f, lo, hi), without slivers: a running count of open intervals and bands over their ends."""
    ends = lambda df, a, b: df.select("f", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(a).alias("open"), F.lit(b).alias("taken")), F.struct(F.col("hi").alias("at"), F.lit(-a).alias("open"), F.lit(-b).alias("taken")))).alias("e"))
    marks = ends(spans, 1, 0).union(ends(bands, 0, 1)).select("f", "e.*").groupBy("f", "at").agg(F.sum("open").alias("open"), F.sum("taken").alias("taken"))
    w = Window.partitionBy("f").orderBy("at")
    swept = marks.select("f", F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), F.sum("open").over(w).alias("open"), F.sum("taken").over(w).alias("taken"))
    return swept.where(f"hi IS NOT NULL AND open > 0 AND taken = 0 AND hi - lo > {SLIVER!r}D").select("f", "lo", "hi")


def _anchors(sides: DataFrame, spans: DataFrame, starts: DataFrame, c: PlanConfig) -> DataFrame:
    """(f, anchor): d of the place nearest to the start (f, sa, sd) on the boundary of what is left: its sides, and the lines where it was cut."""
    ends = spans.select("f", F.explode(F.array("lo", "hi")).alias("d")).distinct()
    extent = sides.groupBy("f").agg(F.min("d1").alias("d0"), F.max("d1").alias("d9"))
    inner = shuffled(ends.join(extent, "f").where("d > d0 AND d < d9").select("f", "d", F.row_number().over(Window.partitionBy("f").orderBy("d")).alias("k")))
    chords = cut(sides, inner, c, 0.0).selectExpr("f", "a0 AS x1", "d AS y1", "a1 AS x2", "d AS y2")
    own = clipped(sides, spans).select("f", *planar.SIDE).union(chords).join(shuffled(starts), "f")
    t = planar.side_t("sa", "sd")
    best = F.min(F.struct(F.round(F.expr(planar.side_distance("sa", "sd")), 6).alias("dist"), F.round(F.expr(planar.side_point(t)[1]), 9).alias("anchor")))
    return shuffled(own.groupBy("f").agg(best.alias("b")).select("f", "b.anchor"))


def _lines(spans: DataFrame, anchor: DataFrame, c: PlanConfig) -> DataFrame:
    """(f, k, d, place): lines a step apart over what is left, through the anchor, none outside of its intervals; ``place`` is their order: the anchor's, those after, those before."""
    over = spans.groupBy("f").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).join(anchor, "f")
    steps = lambda metres: F.floor(metres / c.step + 1e-9).cast("int")
    k = F.sequence(-steps(F.greatest("anchor", "first") - F.col("first")), steps(F.greatest("anchor", "last") - F.col("anchor")))
    every = over.select("f", "anchor", F.explode(k).alias("k")).withColumn("at", F.expr(f"anchor + k * {c.step!r}D"))
    order = F.row_number().over(Window.partitionBy("f").orderBy(F.when(F.col("k") == 0, 0).when(F.col("k") > 0, 1).otherwise(2), F.abs("k"))) - 1
    every = every.withColumn("place", order)
    bucket = lambda x: F.floor(x / c.step)
    near = every.withColumn("bucket", bucket(F.col("at")))
    wide = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo") - INSIDE), bucket(F.col("hi") + INSIDE))))
    hit = near.join(wide, ["f", "bucket"], "left").withColumn("d", F.expr(f"IF(at >= lo - {2 * INSIDE!r}D AND at <= hi + {2 * INSIDE!r}D, least(greatest(at + {INSIDE!r}D, lo + {INSIDE!r}D), hi - {INSIDE!r}D), NULL)"))
    return hit.groupBy("f", "k", "place").agg(F.min("d").alias("d"))


def swept(sides: DataFrame, starts: DataFrame, c: PlanConfig = PlanConfig()) -> Swept:
    """Sweeps the regions of ``sides`` (edges in the sweep frame) from ``starts`` (f, sa, sd)."""
    sides = written(sides)
    small, half = least_area(c), half_band(c)
    left = extents(sides)
    state = areas(sides, left, ["f"]).select("f", "area", F.lit(0).alias("stalled"), F.lit(0).alias("rows"))
    left, state = written(left), written(state)
    stripes, bands, done, passes = [], [], [], []
    for p in range(MOST):
        active = shuffled(left.join(state.select("f"), "f", "left_semi"))  # what is joined is no scratch table any more
        at = written(_lines(active, _anchors(sides, active, starts, c), c).join(state.select("f", F.col("rows").alias("before")), "f").select("f", "k", "d", (F.col("before") + F.col("place")).alias("row")))
        cuts = written(cut(sides, at.where("d IS NOT NULL").select("f", "k", "d"), c).join(at.select("f", "k", "row"), ["f", "k"]).select("f", F.lit(p).alias("pass"), "k", "row", "d", "a0", "a1", "len"))
        taken = cuts.select("f", "k", "d").distinct().selectExpr("f", "k", "d", f"d - {half!r}D AS lo", f"d + {half!r}D AS hi")
        rest = written(_subtracted(active, taken.select("f", "lo", "hi")))
        both = taken.alias("b").join(active.alias("s"), "f").where("b.lo < s.hi AND b.hi > s.lo").selectExpr("f", "k", "d", "greatest(b.lo, s.lo) AS lo", "least(b.hi, s.hi) AS hi")
        bands.append(written(areas(sides, both, ["f", "k", "d"]).select("f", F.lit(p).alias("pass"), "k", "d", "area")))
        found = shuffled(at.groupBy("f").agg(F.count("*").alias("lines")).join(cuts.groupBy("f").agg(F.count("*").alias("segments")), "f", "left").fillna(0, ["segments"]))
        after = areas(sides, rest, ["f"]).withColumnRenamed("area", "now")
        now = state.join(found, "f").join(after, "f", "left").fillna(0.0, ["now"])
        counted = F.col("segments") > 0
        now = now.select(
            "f",
            F.lit(p).alias("pass"),
            (F.col("rows") + F.col("lines")).cast("int").alias("rows"),
            "segments",
            F.when(counted, F.col("now")).otherwise(F.col("area")).alias("area"),
            F.when(F.col("area") - F.col("now") < 0.1 * small, F.col("stalled") + 1).otherwise(0).alias("stalled"),
            counted.alias("counted"),
        )
        now = written(now)
        stripes.append(cuts)
        passes.append(now)
        go = now.where(F.col("counted") & (F.col("area") > small) & (F.col("stalled") < STALLED)) if p + 1 < MOST else now.where("false")
        # A pass without stripes takes nothing, so what was left stays.
        rest = rest.join(now.where("counted").select("f"), "f", "left_semi").union(active.join(now.where("NOT counted").select("f"), "f", "left_semi"))
        done.append(written(rest.join(go.select("f"), "f", "left_anti")))
        left, state = written(rest.join(go.select("f"), "f", "left_semi")), written(go.select("f", "area", "stalled", "rows"))
        if state.isEmpty():
            break

    def together(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    return Swept(together(stripes), together(bands), together(done), together(passes))
