"""The stripe graph: clusters on a row, links between rows, components and their merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shuffled, written
from .sweep import PlanConfig


def clusters(nodes: DataFrame, gap: float = 0.05) -> DataFrame:
    """Nodes with ``cluster``: stripes of a row that touch and agree in ``excl`` share one."""
    row = Window.partitionBy("f", "row").orderBy("a0", "a1")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("a0") > F.max("a1").over(before) + gap) | (F.col("excl") != F.lag("excl").over(row)), F.lit(True))
    field = Window.partitionBy("f").orderBy("row", "a0", "a1")
    return nodes.withColumn("new", new.cast("int")).withColumn("cluster", F.sum("new").over(field.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


def row_links(nodes: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, src, dst, score): each stripe's best links to the next row, by the geometry gate and the score."""
    a = nodes.select("f", F.col("node").alias("src"), F.col("row"), "a0", "a1", "d", "excl")
    b = nodes.select("f", F.col("node").alias("dst"), (F.col("row") - 1).alias("row"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("d").alias("e"), F.col("excl").alias("bexcl"))
    both = a.join(b, ["f", "row"]).withColumns(
        {
            "overlap": F.least("a1", "b1") - F.greatest("a0", "b0"),
            "along": F.abs((F.col("b0") + F.col("b1") - F.col("a0") - F.col("a1")) / 2),
            "mismatch": F.abs(F.abs(F.col("e") - F.col("d")) - c.step),
        }
    )
    score = c.weight_along * F.col("along") / c.step + c.weight_across * F.col("mismatch") / c.step  # stripes are parallel: no angle
    gate = ((F.col("overlap") >= -c.slack) | (F.col("along") <= c.slack)) & (F.col("mismatch") <= c.slack)
    ok = both.where(gate).withColumn("score", score).where((F.col("score") <= c.score_limit) & (F.col("excl") == F.col("bexcl")))
    rank = F.row_number().over(Window.partitionBy("f", "src").orderBy("score", "dst"))
    return ok.withColumn("rank", rank).where(F.col("rank") <= c.neighbours).select("f", "src", "dst", "score")


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of links (f, a, b) as stars (f, v, root): a vertex and the smallest one that the batch's links lead to."""
    for pdf in batches:
        ends = np.stack([np.tile(pdf["f"].to_numpy(), 2), np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()])], axis=1)
        every, at = np.unique(ends, axis=0, return_inverse=True)
        a, b = at.reshape(2, -1)
        root, before = np.arange(len(every)), None
        while before is None or (root != before).any():
            before, low = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
            while (root[root] != root).any():
                root = root[root]
        yield pd.DataFrame({"f": every[:, 0], "v": every[:, 1], "root": every[root, 1]})


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(f, v, comp): components of (f, a, b) links over all vertices (f, v); a component is named by its smallest vertex.

    Links are dealt by field and each batch of them is made into stars, which
    connect the same vertices; a field whose links are in one batch is done then.
    Over the stars, labels take the least of the neighbours' and then jump to their
    label's label, so chains halve; each round is a table, and rounds grow with the
    logarithm of the number of batches that a component's links are in.
    """
    dealt = links.selectExpr("f", "CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b").repartition("f").sortWithinPartitions("f", "a", "b")
    kinds = {x.name: x.dataType.simpleString() for x in nodes.schema}
    stars = written(dealt.mapInPandas(_stars, "f bigint, v bigint, root bigint").selectExpr(f"CAST(f AS {kinds['f']}) AS f", *[f"CAST({x} AS {kinds['v']}) AS {x}" for x in ("v", "root")]))
    both = stars.where("v <> root").selectExpr("f", "v AS a", "root AS b")
    both = written(both.union(both.select("f", "b", "a")).distinct())
    first = shuffled(stars.groupBy("f", "v").agg(F.min("root").alias("root")))
    label = written(nodes.select("f", "v").join(first, ["f", "v"], "left").select("f", "v", F.coalesce("root", "v").alias("comp")))
    while True:
        near = shuffled(both.join(label, (both["f"] == label["f"]) & (both["b"] == label["v"])).groupBy(both["f"].alias("f"), both["a"].alias("v")).agg(F.min("comp").alias("near")))
        least = label.join(near, ["f", "v"], "left").select("f", "v", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = shuffled(least.select(F.col("f"), F.col("v").alias("comp"), F.col("comp").alias("up")))
        now = written(least.join(up, ["f", "comp"], "left").select("f", "v", F.coalesce("up", "comp").alias("comp"), (F.coalesce("up", "comp") != F.col("was")).alias("news")))
        label = now.drop("news")
        if now.where("news").isEmpty():
            return label


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Clustered nodes, best a table, with ``comp``, numbered by the smallest cluster. The rounds start from tables."""
    of = nodes.select("f", F.col("node"), F.col("cluster"))
    pairs = links.join(of.select("f", F.col("node").alias("src"), F.col("cluster").alias("ca")), ["f", "src"]).join(of.select("f", F.col("node").alias("dst"), F.col("cluster").alias("cb")), ["f", "dst"])
    pairs = pairs.select("f", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).where("a <> b").distinct()
    found = connected(pairs, nodes.select("f", F.col("cluster").alias("v")).distinct())
    number = F.dense_rank().over(Window.partitionBy("f").orderBy("comp")) - 1
    return nodes.join(found.withColumnRenamed("v", "cluster"), ["f", "cluster"]).withColumn("comp", number)


def component_stats(nodes: DataFrame) -> DataFrame:
    """Rows, centroid, size, along-span and exclusion flag of each component."""
    return nodes.groupBy("f", "comp").agg(
        F.min("row").alias("min_row"),
        F.max("row").alias("max_row"),
        F.avg("mx").alias("cx"),
        F.avg("my").alias("cy"),
        F.count("*").alias("size"),
        F.min(F.least("a0", "a1")).alias("lo"),
        F.max(F.greatest("a0", "a1")).alias("hi"),
        F.bool_or("excl").alias("excl"),
    )


def merge_candidates(stats: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, a, b, close, bypass, ...): pairs of components that agree in exclusion, are near, and have no third one between them.

    ``close``: rows at most a few apart and centroids near along and across.
    ``bypass``: one is tiny, whatever the rows between; its chord is tested later.
    """
    from .sweep import ANGLE

    a = stats.select("f", *[F.col(x).alias(f"a_{x}") for x in stats.columns if x != "f"])
    b = stats.select("f", *[F.col(x).alias(f"b_{x}") for x in stats.columns if x != "f"])
    pairs = a.join(b, "f").where("a_comp < b_comp AND a_excl = b_excl")
    pairs = pairs.withColumns(
        {
            "gap": F.greatest(F.lit(0), F.greatest("a_min_row", "b_min_row") - F.least("a_max_row", "b_max_row") - 1),
            "along": F.expr(f"abs((b_cx - a_cx) * sin({ANGLE}) - (b_cy - a_cy) * cos({ANGLE}))"),
            "a_d": F.expr(f"a_cx * cos({ANGLE}) + a_cy * sin({ANGLE})"),
            "b_d": F.expr(f"b_cx * cos({ANGLE}) + b_cy * sin({ANGLE})"),
            "apart": F.sqrt((F.col("b_cx") - F.col("a_cx")) ** 2 + (F.col("b_cy") - F.col("a_cy")) ** 2),
            "tiny": (F.col("a_size") <= c.merge_tiny) | (F.col("b_size") <= c.merge_tiny),
        }
    )
    near = (F.col("along") <= max(6.0, c.merge_along_factor * c.step)) & (F.abs(F.col("a_d") - F.col("b_d")) <= max(10.0, c.merge_across_factor * c.step))
    pairs = pairs.withColumn("close", near & (F.col("gap") <= c.merge_row_gap)).withColumn("bypass", F.col("tiny") & (F.col("apart") <= max(20.0, 8 * c.step))).where("close OR bypass")
    third = stats.select(F.col("f").alias("g"), F.col("comp").alias("t"), F.col("min_row").alias("t0"), F.col("max_row").alias("t1"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    low, high = F.least("a_max_row", "b_max_row") + 1, F.greatest("a_min_row", "b_min_row") - 1
    band_lo, band_hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    blocked = (F.col("f") == F.col("g")) & ~F.col("t").isin(F.col("a_comp"), F.col("b_comp")) & (low <= high) & (band_hi > band_lo + 1e-3) & (F.col("t1") >= low) & (F.col("t0") <= high) & (F.least("thi", band_hi) > F.greatest("tlo", band_lo) + 0.5)
    return pairs.join(third, blocked, "left_anti").select("f", F.col("a_comp").alias("a"), F.col("b_comp").alias("b"), "close", "bypass", "a_cx", "a_cy", "b_cx", "b_cy", "a_d", "b_d")


def shells(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(f, comp, side, ring, i, n, last, first): on which sides of the region the left and right ends of a component's stripes lie.

    ``last`` and ``first``: the place is a side's end or start, next to a corner.
    """
    from . import regions

    ends = nodes.selectExpr("f", "comp", "node", "stack(2, 'left', sx, sy, 'right', ex, ey) AS (side, px, py)")
    found = regions.anchors(ends, edges, ["comp", "node", "side"]).select("f", "comp", "side", "ring", "i", (F.col("t") >= 0.96).alias("last"), (F.col("t") <= 0.04).alias("first")).distinct()
    return found.join(edges.select("f", "ring", "i", "n"), ["f", "ring", "i"])


def _corners(a: str, b: str) -> str:
    """Corners passed on the way forward from one place to another of a ring; a corner at either place does not count."""
    way = f"pmod({b}_i - {a}_i, n)"
    return f"IF({a}_i = {b}_i, 0, greatest(0, {way} - IF({a}_last, 1, 0) - IF({b}_first AND {way} - IF({a}_last, 1, 0) > 0, 1, 0)))"


def merge_pairs(nodes: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, a, b): components of ``nodes`` that become one.

    Of the candidates those whose centroids see each other inside the region and
    whose shells meet: both their left and right ends are a corner apart at most,
    or those that face each other across the sweep. A field has one outer ring,
    so all its components are on the same path.
    """
    from . import regions

    found = written(merge_candidates(component_stats(nodes), c))
    points = found.select("f", "a", "b", "a_cx", "a_cy", "b_cx", "b_cy", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("k"))
    points = points.selectExpr("f", "a", "b", "k", "a_cx + (b_cx - a_cx) * k / 16e0 AS px", "a_cy + (b_cy - a_cy) * k / 16e0 AS py")
    chord = shuffled(regions.inside(points, edges, ["a", "b", "k"], 1e-6).groupBy("f", "a", "b").agg(F.bool_and("inside").alias("chord")).where("chord"))
    own = written(shells(nodes, edges))
    named = lambda x: own.select("f", "ring", "n", F.col("comp").alias(x), *[F.col(k).alias(f"{x}_{k}") for k in ("side", "i", "last", "first")])
    meets = found.select("f", "a", "b").join(named("a"), ["f", "a"]).join(named("b"), ["f", "ring", "n", "b"]).where(f"least({_corners('a', 'b')}, {_corners('b', 'a')}) <= 1")
    sides = lambda x, y: F.bool_or((F.col("a_side") == x) & (F.col("b_side") == y)).alias(f"{x}_{y}")
    meets = shuffled(meets.groupBy("f", "a", "b").agg(*[sides(x, y) for x in ("left", "right") for y in ("left", "right")]))
    facing = f"CASE WHEN abs(a_d - b_d) > {max(1.0, 0.2 * c.step)!r}D THEN IF(a_d < b_d, right_left, left_right) ELSE right_left OR left_right END"
    return found.join(chord, ["f", "a", "b"]).join(meets, ["f", "a", "b"]).where(f"(left_left AND right_right) OR {facing}").select("f", "a", "b")


def merged(nodes: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Nodes with ``merged``, the component after merging."""
    nodes = written(nodes)
    found = connected(merge_pairs(nodes, edges, c), nodes.select("f", F.col("comp").alias("v")).distinct())
    return nodes.join(found.select("f", F.col("v").alias("comp"), F.col("comp").alias("merged")), ["f", "comp"])


def spanning_tree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(f, node, parent, level): the breadth-first tree of each component from its first stripe by (row, along); a root is its own parent.

    Of several neighbours one level up the smallest is the parent. One group per
    component, each link looked at twice.
    """
    of = nodes.select("f", F.col("comp").alias("within"), F.col("node").alias("src"))
    own = links.select("f", "src", "dst").join(of, ["f", "src"]).select(F.col("f").alias("field"), "within", "src", "dst")

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        beside: dict[int, list[int]] = {}
        for a, b in zip(links["src"], links["dst"], strict=True):
            beside.setdefault(a, []).append(b)
            beside.setdefault(b, []).append(a)
        root = nodes.sort_values(["row", "a0", "node"])["node"].iat[0]
        above, level, depth = {root: root}, [root], 0
        out = [(key[0], root, root, 0)]
        while level:
            depth += 1
            found: dict[int, int] = {}
            for u in level:  # in order, so the smallest neighbour comes first
                for v in beside.get(u, ()):
                    if v not in above:
                        found.setdefault(v, u)
            out += [(key[0], v, u, depth) for v, u in found.items()]
            above |= found
            level = sorted(found)
        return pd.DataFrame(out, columns=["f", "node", "parent", "level"])

    return nodes.select("f", "comp", "node", "row", "a0").groupBy("f", "comp").cogroup(own.groupBy("field", "within")).applyInPandas(run, "f bigint, node int, parent int, level int")
