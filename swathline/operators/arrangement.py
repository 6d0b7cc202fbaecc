"""Polygon overlay as joins: sides cut where they meet, winding numbers, flanks, and rings linked by pointer doubling.

Vertices are (f, op, ring, i, n, x, y): closed rings of operand 0 or 1 of a field
``f``. Nothing is done in one group of a field:

* ``parts`` meets sides in an equi-join on (f, cell) and cuts each at what it
  meets; ends are numbers on a grid of a hundredth of a micrometre, so equal places are equal keys;
* ``faces`` sums, for each part, the windings of the parts that a ray from its
  middle crosses, in an equi-join on (f, band across the ray), which gives the
  winding numbers of both operands on both flanks;
* ``outline`` keeps the parts with the result on one flank only, turns them so
  that it is on the left, links each to the next one around the same face by a
  join on the node, and names and orders rings by doubling: each round looks
  twice as far ahead, so rounds grow with the logarithm of the longest ring.

A ring is what stays connected on the inside: polygons that touch in a corner are
two rings. Vertices on a straight line are left out. A field whose result is empty
has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planar
from ..sources.scratch import shuffled, written

#: The grid of nodes, in metres, and how near to a side an end of another lies on it.
GRID, NEAR = 1e-8, 2e-8
#: Rays go along (RAY_X, RAY_Y), a direction that no side of ordinary fields has.
RAY_X, RAY_Y = 0.7648421872844885, 0.644217687237691
NODE = ("ax", "ay", "bx", "by")

FILL = {"evenodd": "{0} % 2 <> 0", "nonzero": "{0} <> 0", "positive": "{0} > 0", "negative": "{0} < 0"}
OVERLAY = {"union": "{0} OR {1}", "intersection": "{0} AND {1}", "difference": "{0} AND NOT {1}", "xor": "{0} <> {1}"}


def sides_of(vertices: DataFrame) -> DataFrame:
    """(f, op, ring, i, x1, y1, x2, y2): a side from each vertex to the next of its ring, on the grid."""
    w = Window.partitionBy("f", "op", "ring").orderBy("i")
    snap = lambda c: F.round(F.col(c) / GRID).cast("bigint")
    v = vertices.select("f", "op", "ring", "i", snap("x").alias("ax"), snap("y").alias("ay"))
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = v.withColumns({"bx": F.coalesce(F.lead("ax").over(w), F.first("ax").over(first)), "by": F.coalesce(F.lead("ay").over(w), F.first("ay").over(first))})
    named = dict(zip(planar.SIDE, NODE, strict=True))
    return v.where("ax <> bx OR ay <> by").withColumns({s: F.col(n) * GRID for s, n in named.items()})


def _cells(lo: Column, hi: Column, cell: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def parts(sides: DataFrame) -> DataFrame:
    """(f, ax, ay, bx, by, w0, w1): what lies between neighbouring nodes, once, from the smaller node to the greater, with each operand's net windings."""
    sides = written(sides)
    size = F.greatest(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))), F.lit(1e-3))
    sides = shuffled(sides.join(sides.groupBy("f").agg(size.alias("cell")), "f").withColumn("key", F.struct("op", "ring", "i")))
    spread = sides.withColumn("cx", _cells(F.least("x1", "x2") - NEAR, F.greatest("x1", "x2") + NEAR, F.col("cell")))
    spread = spread.withColumn("cy", _cells(F.least("y1", "y2") - NEAR, F.greatest("y1", "y2") + NEAR, F.col("cell")))
    a = spread.select("f", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("key", *planar.SIDE, *NODE)])
    b = spread.select("f", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("key", *planar.SIDE, *NODE)])
    one, two = tuple(f"a_{c}" for c in planar.SIDE), tuple(f"b_{c}" for c in planar.SIDE)
    boxes = " AND ".join(f"least(a_{c}1, a_{c}2) <= greatest(b_{c}1, b_{c}2) + {NEAR!r}D AND least(b_{c}1, b_{c}2) <= greatest(a_{c}1, a_{c}2) + {NEAR!r}D" for c in "xy")
    pairs = a.join(b, ["f", "cx", "cy"]).where(f"a_key < b_key AND {boxes}").drop("cx", "cy").dropDuplicates(["f", "a_key", "b_key"])
    t, u = planar.meeting(one, two)
    x, y = planar.side_point(t, one)
    length = lambda s: f"sqrt(({s[2]} - {s[0]}) * ({s[2]} - {s[0]}) + ({s[3]} - {s[1]}) * ({s[3]} - {s[1]}))"
    within = lambda t, s: f"{t} * {length(s)} > {NEAR!r}D AND (1e0 - {t}) * {length(s)} > {NEAR!r}D"
    # A proper crossing is a node of both, computed once; an end of one on the other is a node of the other.
    found = [
        f"IF({within(t, one)} AND {within(u, two)}, array(named_struct('key', a_key, 't', {t}, 'gx', CAST(round({x} / {GRID!r}D) AS BIGINT), 'gy', CAST(round({y} / {GRID!r}D) AS BIGINT)),"
        f" named_struct('key', b_key, 't', {u}, 'gx', CAST(round({x} / {GRID!r}D) AS BIGINT), 'gy', CAST(round({y} / {GRID!r}D) AS BIGINT))), array())"
    ]
    for mine, own, other, ends in (("a", one, two, ("ax", "ay", "bx", "by")), ("b", two, one, ("ax", "ay", "bx", "by"))):
        yours = "b" if mine == "a" else "a"
        for px, py, gx, gy in ((other[0], other[1], *ends[:2]), (other[2], other[3], *ends[2:])):
            at = planar.side_t(px, py, own)
            on = f"{planar.side_distance(px, py, own)} <= {NEAR!r}D AND {within(at, own)}"
            found.append(f"IF({on}, array(named_struct('key', {mine}_key, 't', {at}, 'gx', {yours}_{gx}, 'gy', {yours}_{gy})), array())")
    cuts = pairs.select("f", F.explode(F.expr(f"concat({', '.join(found)})")).alias("c")).select("f", "c.*")
    ends = sides.select("f", "key", F.explode(F.expr("array(struct(0D AS t, ax AS gx, ay AS gy), struct(1D AS t, bx AS gx, by AS gy))")).alias("c")).select("f", "key", "c.*")
    nodes = cuts.unionByName(ends).groupBy("f", "key", "gx", "gy").agg(F.min("t").alias("t"))
    w = Window.partitionBy("f", "key").orderBy("t", "gx", "gy")
    cut = nodes.select("f", F.col("key.op").alias("op"), "gx", "gy", F.lead("gx").over(w).alias("hx"), F.lead("gy").over(w).alias("hy")).where("hx IS NOT NULL")
    forward = "(gx < hx OR (gx = hx AND gy < hy))"
    cut = cut.selectExpr("f", "op", f"IF({forward}, 1, -1) AS w", *[f"IF({forward}, {p}, {q}) AS {n}" for n, p, q in (("ax", "gx", "hx"), ("ay", "gy", "hy"), ("bx", "hx", "gx"), ("by", "hy", "gy"))])
    summed = cut.groupBy("f", *NODE).agg(*[F.sum(F.when(F.col("op") == k, F.col("w")).otherwise(0)).alias(f"w{k}") for k in (0, 1)])
    return summed.where("w0 <> 0 OR w1 <> 0")


def faces(parts: DataFrame) -> DataFrame:
    """Parts with ``left0``, ``left1``, ``right0``, ``right1``: the winding numbers on their flanks, as seen from (ax, ay) to (bx, by)."""
    parts = written(parts)
    across = lambda x, y: f"({y} * {RAY_X!r}D - {x} * {RAY_Y!r}D) * {GRID!r}D"
    along = lambda x, y: f"({x} * {RAY_X!r}D + {y} * {RAY_Y!r}D) * {GRID!r}D"
    placed = parts.selectExpr("*", f"{across('ax', 'ay')} AS v1", f"{across('bx', 'by')} AS v2", f"{along('ax', 'ay')} AS u1", f"{along('bx', 'by')} AS u2")
    placed = shuffled(placed.join(placed.groupBy("f").agg(F.greatest(F.avg(F.abs(F.col("v2") - F.col("v1"))), F.lit(1e-3)).alias("band")), "f"))
    middles = placed.select("f", *[F.col(c).alias(f"m_{c}") for c in NODE], F.expr("(u1 + u2) / 2").alias("um"), F.expr("(v1 + v2) / 2").alias("vm"), F.expr("floor((v1 + v2) / 2 / band)").alias("bucket"))
    spread = placed.withColumn("bucket", _cells(F.least("v1", "v2"), F.greatest("v1", "v2"), F.col("band"))).select("f", "bucket", *NODE, "u1", "v1", "u2", "v2", "w0", "w1")
    other = " OR ".join(f"{c} <> m_{c}" for c in NODE)
    hit = middles.join(spread, ["f", "bucket"]).where(f"(v1 > vm) <> (v2 > vm) AND ({other}) AND u1 + (vm - v1) / (v2 - v1) * (u2 - u1) > um")
    up = F.when(F.col("v2") > F.col("v1"), 1).otherwise(-1)
    beyond = hit.groupBy("f", *[f"m_{c}" for c in NODE]).agg(*[F.sum(up * F.col(f"w{k}")).alias(f"r{k}") for k in (0, 1)])
    beyond = beyond.select("f", *[F.col(f"m_{c}").alias(c) for c in NODE], "r0", "r1")
    both = placed.join(beyond, ["f", *NODE], "left").fillna(0, ["r0", "r1"])
    # Beyond the part, along the ray, is its right flank if it goes up, else its left one.
    near = [f"r{k} + IF(v2 > v1, w{k}, -w{k})" for k in (0, 1)]
    return both.selectExpr("f", *NODE, *[f"IF(v2 > v1, {near[k]}, r{k}) AS left{k}" for k in (0, 1)], *[f"IF(v2 > v1, r{k}, {near[k]}) AS right{k}" for k in (0, 1)])


def inside(flank: str, how: str, rule: str = "nonzero") -> str:
    """An SQL condition: whether the flank (``left`` or ``right``) is in the result."""
    return OVERLAY[how].format(*[f"({FILL[rule].format(f'{flank}{k}')})" for k in (0, 1)])


def outline(flanked: DataFrame, results: dict[str, tuple[str, str]]) -> DataFrame:
    """(f, result, ring, i, n, x, y): rings around the named results, each an operation and a fill rule; outer rings counter-clockwise and first, by falling area."""
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("result"), F.expr(inside("left", *how)).alias("l"), F.expr(inside("right", *how)).alias("r")) for name, how in results.items()]))
    kept = flanked.select("f", *NODE, kinds.alias("k")).where("k.l <> k.r")
    turned = kept.selectExpr("f", "k.result AS result", *[f"IF(k.l, {p}, {q}) AS {p}" for p, q in zip(NODE, ("bx", "by", "ax", "ay"), strict=True)])
    key = ["f", "result"]
    edges = written(turned.withColumn("e", F.row_number().over(Window.partitionBy(*key).orderBy(*NODE))))
    # The next edge around the face on the left: the first one clockwise from the way back.
    out = edges.select(*key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("e").alias("next"), F.expr("atan2(by - ay, bx - ax)").alias("heading"))
    turn = F.pmod(F.expr("atan2(CAST(ay - by AS DOUBLE), CAST(ax - bx AS DOUBLE))") - F.col("heading"), F.lit(2 * 3.141592653589793))
    after = edges.join(out, [*key, "bx", "by"]).groupBy(*key, "e").agg(F.min(F.struct(F.when(turn < 1e-12, 7.0).otherwise(turn).alias("turn"), "next")).alias("n")).select(*key, "e", F.col("n.next").alias("to"))
    # ``low``: the least edge of the next 2^k and how many steps ahead it is.
    state = written(after.withColumn("low", F.struct(F.col("e").alias("at"), F.lit(0).alias("steps"))))
    reach = 1
    while True:
        ahead = state.select(*key, F.col("e").alias("to"), F.col("to").alias("further"), F.col("low").alias("there"))
        there = F.struct(F.col("there.at").alias("at"), (F.col("there.steps") + reach).alias("steps"))
        now = written(state.join(ahead, [*key, "to"]).select(*key, "e", F.col("further").alias("to"), F.least("low", there).alias("low"), (F.col("there.at") < F.col("low.at")).alias("news")))
        state, reach = now.drop("news"), 2 * reach
        if now.where("news").isEmpty():
            break
    ring = Window.partitionBy(*key, "low.at")
    placed = edges.join(state.select(*key, "e", "low"), [*key, "e"]).withColumn("n", F.count("*").over(ring))
    placed = placed.select(*key, F.col("low.at").alias("at"), F.expr("(n - low.steps) % n").alias("i"), "n", (F.col("ax") * GRID).alias("x"), (F.col("ay") * GRID).alias("y"))
    return _numbered(_straightened(placed, key), key)


def _straightened(placed: DataFrame, key: list[str]) -> DataFrame:
    """Vertices without those on the line between their neighbours."""
    ring = Window.partitionBy(*key, "at")
    w, whole = ring.orderBy("i"), ring.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in "xy":
        placed = placed.withColumns({f"p{c}": F.coalesce(F.lag(c).over(w), F.last(c).over(whole)), f"q{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole))})
    bent = f"abs({planar.cross('x - px', 'y - py', 'qx - x', 'qy - y')}) > {2 * GRID!r}D * (abs(qx - px) + abs(qy - py))"
    kept = placed.where(bent).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(ring))
    return kept.where("n >= 3").select(*key, "at", "i", "n", "x", "y")


def _numbered(placed: DataFrame, key: list[str]) -> DataFrame:
    ring = Window.partitionBy(*key, "at")
    w, whole = ring.orderBy("i"), ring.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xy")
    sized = placed.withColumn("part", F.col("x") * ny - nx * F.col("y"))
    areas = sized.groupBy(*key, "at").agg((F.sum("part") / 2).alias("area")).where("abs(area) > 1e-6")
    ranked = areas.withColumn("ring", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("area"), "at")) - 1)
    return placed.join(shuffled(ranked), [*key, "at"]).select(*key, "ring", F.col("i").cast("int").alias("i"), F.col("n").cast("int").alias("n"), "x", "y")


def overlaid(vertices: DataFrame, results: dict[str, tuple[str, str]]) -> DataFrame:
    """Rings of the named results over ``vertices`` (f, op, ring, i, x, y)."""
    return outline(faces(parts(sides_of(vertices))), results)


def working_regions(vertices: DataFrame) -> DataFrame:
    """(f, ring, i, n, x, y): contours (ring 0) less cutouts (other rings, in either direction)."""
    given = vertices.withColumn("op", F.when(F.col("ring") == 0, 0).otherwise(1))
    return overlaid(given, {"region": ("difference", "nonzero")}).drop("result")


def insets(regions: DataFrame, distance: float, miter: float = 2.0) -> DataFrame:
    """Regions moved inwards: outer rings shrink, holes grow; mitred, bevelled beyond ``miter``. What folds over itself goes, as its winding is not positive."""
    ring = Window.partitionBy("f", "ring")
    w, whole = ring.orderBy("i"), ring.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = regions.select("f", "ring", "i", "x", "y")
    for c in "xy":
        v = v.withColumns({f"p{c}": F.coalesce(F.lag(c).over(w), F.last(c).over(whole)), f"q{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole))})
    before, after = "sqrt((x - px) * (x - px) + (y - py) * (y - py))", "sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y))"
    v = v.selectExpr("*", f"(py - y) / {before} AS mx", f"(x - px) / {before} AS my", f"(y - qy) / {after} AS ox", f"(qx - x) / {after} AS oy").withColumn("c", F.expr("1e0 + mx * ox + my * oy"))
    moved = lambda nx, ny: f"named_struct('x', x + {distance!r}D * {nx}, 'y', y + {distance!r}D * {ny})"
    places = f"IF(c > 1e-9 AND 2e0 / c <= {2 * miter**2!r}D, array({moved('(mx + ox) / c', '(my + oy) / c')}), array({moved('mx', 'my')}, {moved('ox', 'oy')}))"
    points = v.select("f", "ring", "i", F.posexplode(F.expr(places)).alias("s", "p"))
    points = points.select("f", F.lit(0).alias("op"), "ring", (F.row_number().over(ring.orderBy("i", "s")) - 1).alias("i"), "p.x", "p.y")
    found = written(overlaid(points, {"inset": ("union", "positive")}).drop("result"))
    # A part narrower than twice the distance turns inside out twice; its corners are too near the given sides.
    cell = F.lit(max(4 * distance, 1e-3))
    given = sides_of(regions.withColumn("op", F.lit(0))).select("f", *planar.SIDE)
    given = given.withColumn("cx", _cells(F.least("x1", "x2") - distance, F.greatest("x1", "x2") + distance, cell)).withColumn("cy", _cells(F.least("y1", "y2") - distance, F.greatest("y1", "y2") + distance, cell))
    at = found.select("f", "ring", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    wrong = at.join(given, ["f", "cx", "cy"]).where(f"{planar.side_distance('x', 'y')} <= {distance - 1e-3!r}D").select("f", "ring").distinct()
    return found.join(wrong, ["f", "ring"], "left_anti")


def edges_of(rings: DataFrame) -> DataFrame:
    """The edge table of (f, ring, i, n, x, y)."""
    a, b = rings.alias("a"), rings.alias("b")
    joined = a.join(b, F.expr("a.f = b.f AND a.ring = b.ring AND b.i = (a.i + 1) % a.n"))
    return joined.selectExpr("a.f", "a.ring", "a.i", "a.n", "a.x AS x1", "a.y AS y1", "b.x AS x2", "b.y AS y2", "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len")
