"""Coverage stripes: parallel lines cut by regions, filtered and numbered into rows.

A job is a field ``f`` with a direction. Sides are turned into the sweep frame
(along ``a``, across ``d``) once; a line is a value of d, so cutting regions by
lines is an equi-join of sides and lines on (f, bucket of d) and a window that
pairs crossings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PlanConfig:
    """Tunables of the planner, with the derived thresholds."""

    step: float = 4.0
    offset: float = 2.0
    useful_factor: float = 0.65
    useful_min: float = 0.8
    weight_along: float = 1.0
    weight_across: float = 1.8
    weight_angle: float = 0.35
    score_limit: float = 3.4
    gate_factor: float = 1.0
    neighbours: int = 4
    merge_row_gap: int = 3
    merge_along_factor: float = 3.4
    merge_across_factor: float = 4.8
    merge_tiny: int = 18
    intra_factor: float = 2.2
    intra_min: float = 12.0
    direct_max: float = 5.0
    long_jump_weight: float = 1.05

    @property
    def min_useful(self) -> float:
        return max(self.useful_min, self.useful_factor * self.step)

    @property
    def slack(self) -> float:
        return max(0.5, self.gate_factor * self.step)

    @property
    def near_hole(self) -> float:
        return max(0.45, 0.35 * self.step)

    @property
    def intra_limit(self) -> float:
        return max(self.intra_min, self.intra_factor * self.step)


ANGLE = "radians((15 * f) % 180 + 0e0)"
#: Lines are moved by a micrometre, so that none runs along a side or through a vertex.
NUDGE = "1e-6"


def in_sweep_frame(edges: DataFrame, angle: str = ANGLE) -> DataFrame:
    """Sides with their ends' places along (a) and across (d) the sweep; angle 0 points to map north."""
    s, c = f"sin({angle})", f"cos({angle})"
    return edges.selectExpr(
        "*",
        f"x1 * {s} - y1 * {c} AS a1",
        f"x2 * {s} - y2 * {c} AS a2",
        f"x1 * {c} + y1 * {s} AS d1",
        f"x2 * {c} + y2 * {s} AS d2",
    )


def lines(sides: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, k, d): lines a step apart through the region's extent, from the contour's first vertex both ways."""
    extent = sides.groupBy("f").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max(F.expr("CASE WHEN ring = 0 AND i = 0 THEN d1 END")).alias("d0"))
    k = F.explode(F.sequence(F.ceil((F.col("lo") - F.col("d0")) / c.step).cast("int"), F.floor((F.col("hi") - F.col("d0")) / c.step).cast("int")))
    return extent.select("f", "d0", k.alias("k")).select("f", "k", F.expr(f"d0 + k * {c.step!r}e0 + {NUDGE}").alias("d"))


def cut(sides: DataFrame, at: DataFrame, c: PlanConfig = PlanConfig(), shortest: float = 0.05) -> DataFrame:
    """Stripes (f, k, d, a0, a1, len): the parts of lines inside the region.

    Sides and lines meet in buckets of one step of d, so a field with many of
    both joins each side only with the lines that it can cross.
    """
    bucket = F.floor(F.col("d") / c.step)
    reach = F.explode(F.sequence(F.floor(F.least("d1", "d2") / c.step), F.floor(F.greatest("d1", "d2") / c.step)))
    crossing = sides.select("f", "ring", "i", "a1", "a2", "d1", "d2", reach.alias("bucket")).join(at.withColumn("bucket", bucket), ["f", "bucket"]).where("(d1 > d) <> (d2 > d)")
    crossing = crossing.select("f", "k", "d", "ring", "i", F.expr("a1 + (d - d1) / (d2 - d1) * (a2 - a1)").alias("a"))
    w = Window.partitionBy("f", "k").orderBy("a", "ring", "i")
    paired = crossing.select("f", "k", "d", F.col("a").alias("a0"), F.lead("a").over(w).alias("a1"), F.row_number().over(w).alias("rn"))
    return paired.where("rn % 2 = 1 AND a1 IS NOT NULL").select("f", "k", "d", "a0", "a1", (F.col("a1") - F.col("a0")).alias("len")).where(F.col("len") >= shortest)


def _runs(stripes: DataFrame, eps: float) -> DataFrame:
    """(f, run, all, ds): distinct values of d in runs whose neighbours are less than ``eps`` apart, and those of a run that are kept.

    A value is kept if it is at least ``eps`` above the last one kept; as runs are
    further apart than that, each is folded on its own, however many rows a field has.
    """
    w = Window.partitionBy("f").orderBy("d")
    values = stripes.select("f", "d").distinct().withColumn("new", (F.col("d") - F.lag("d").over(w) >= eps).cast("int"))
    values = values.withColumn("run", F.coalesce(F.sum("new").over(w), F.lit(0)))
    fold = F.expr(f"aggregate(all, cast(array() as array<double>), (acc, x) -> IF(size(acc) = 0 OR x >= element_at(acc, -1) + {eps!r}D, concat(acc, array(x)), acc))")
    return values.groupBy("f", "run").agg(F.array_sort(F.collect_list("d")).alias("all")).withColumn("ds", fold)


def distinct_rows(stripes: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, d): the values of d, each at least a tolerance above the last one kept."""
    return _runs(stripes, max(0.05, 0.05 * c.step)).select("f", F.explode("ds").alias("d"))


def rowed(stripes: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Stripes with ``row``, the place of the nearest kept d; it is one of the stripe's own run."""
    runs = _runs(stripes, max(0.05, 0.05 * c.step))
    before = Window.partitionBy("f").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.expr("transform(all, d -> named_struct('d', d, 'i', array_position(ds, element_at(array_sort(transform(ds, x -> named_struct('e', abs(x - d), 'x', x))), 1).x) - 1))")
    rows = runs.withColumn("base", F.coalesce(F.sum(F.size("ds")).over(before), F.lit(0))).select("f", "base", F.explode(nearest).alias("p"))
    rows = rows.select("f", "p.d", (F.col("base") + F.col("p.i")).cast("int").alias("row"))
    return stripes.join(rows, ["f", "d"]).select(*stripes.columns, "row")


def supported(stripes: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Long stripes, and shorter ones with a neighbour on both sides: two semi-joins on the row."""
    slack = max(0.4, 0.12 * c.step)
    least, floor = c.min_useful, 0.55 * c.min_useful
    long = stripes.where(F.col("len") >= least)
    short = stripes.where((F.col("len") < least) & (F.col("len") >= floor))
    other = stripes.select(F.col("f").alias("g"), F.col("row").alias("r"), F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    for side in (-1, 1):
        touch = (F.col("g") == F.col("f")) & (F.col("r") == F.col("row") + side) & (F.least("a1", "b1") - F.greatest("a0", "b0") >= -slack)
        short = short.join(other, touch, "left_semi")
    return long.unionByName(short)


def numbered(stripes: DataFrame) -> DataFrame:
    """Kept stripes as nodes: rows renumbered without gaps, ids in (row, along) order, and their ends on the map."""
    w = Window.partitionBy("f")
    s, c = f"sin({ANGLE})", f"cos({ANGLE})"
    out = stripes.withColumn("row", F.dense_rank().over(w.orderBy("row")) - 1).withColumn("node", F.row_number().over(w.orderBy("row", "a0")) - 1)
    return out.selectExpr("f", "node", "row", "d", "a0", "a1", "len", *[f"{a} * {s} + d * {c} AS {n}x" for n, a in (("s", "a0"), ("e", "a1"), ("m", "(a0 + a1) / 2"))], *[f"-({a}) * {c} + d * {s} AS {n}y" for n, a in (("s", "a0"), ("e", "a1"), ("m", "(a0 + a1) / 2"))])


def alternated(nodes: DataFrame) -> DataFrame:
    """Nodes with ``forward``: rows are driven in turns, the first one along the sweep."""
    return nodes.withColumn("forward", F.dense_rank().over(Window.partitionBy("f").orderBy("row")) % 2 == 1)


def touching(nodes: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Nodes with ``excl``: whether an end or the middle is near a hole's side."""
    from ..functions import planar

    points = nodes.select("f", "node", F.explode(F.array(*[F.struct(F.col(f"{n}x").alias("px"), F.col(f"{n}y").alias("py")) for n in "sem"])).alias("p")).select("f", "node", "p.*")
    near = points.join(edges.where("ring > 0"), "f").groupBy("f", "node").agg((F.min(F.expr(planar.side_distance("px", "py"))) <= c.near_hole).alias("excl"))
    return nodes.join(near, ["f", "node"], "left").withColumn("excl", F.coalesce("excl", F.lit(False)))
