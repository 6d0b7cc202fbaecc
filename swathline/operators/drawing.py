"""Drawing sessions: clicks that grow a draft polygon, close it to a contour, or add and take back cutouts; and tiles on their way.

A draft is what one user draws by hand; a session's clicks stream through one
task, which holds the draft and the number of cutouts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan

#: What a click did, and the session after it.
OUTCOMES = "{key} bigint, seq bigint, outcome string, drafted int, contour int, cutouts int"


@dataclass
class Session:
    draft: list[tuple[float, float]] = field(default_factory=list)
    contour: int = 0
    cutouts: int = 0


def _side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))


def crosses(chain: list[tuple[float, float]], p: tuple[float, float], q: tuple[float, float]) -> bool:
    """Whether the segment p-q properly crosses a side of an open chain; touching is no crossing."""
    if len(chain) < 2:
        return False
    c, a, b = np.array(chain, float), np.array(p, float), np.array(q, float)
    u, v = c[:-1], c[1:]
    return bool(((_side(a, b, u) * _side(a, b, v) < 0) & (_side(u, v, a) * _side(u, v, b) < 0)).any())


def contour_click(s: Session, op: str, p: tuple[float, float], reach: float) -> str:
    """A click while a contour is drawn. A click near the first of three or more vertices closes the draft; a new contour drops the cutouts."""
    if op == "cancel":
        s.draft = []
        return "cancelled"
    if op == "remove":
        s.draft, s.contour, s.cutouts = [], 0, 0
        return "removed"
    d = s.draft
    if len(d) >= 3 and np.hypot(p[0] - d[0][0], p[1] - d[0][1]) <= reach:
        fine = not crosses(d[1:-1], d[-1], d[0])  # the other sides were tested when they were drawn
        if fine:
            s.contour, s.cutouts = len(d), 0
        s.draft = []
        return "closed" if fine else "intersects"
    if d and crosses(d[:-1], d[-1], p):
        return "refused"
    d.append(p)
    return "vertex"


def cutout_click(s: Session, op: str, p: tuple[float, float]) -> str:
    """A click while a cutout is drawn. A draft that can't be finished stays; undo drops the draft and the last cutout."""
    d = s.draft
    if op == "clear":
        s.draft, s.cutouts = [], 0
        return "cleared"
    if op == "undo":
        s.draft, had = [], s.cutouts
        s.cutouts = max(0, had - 1)
        return "undone" if had else "none"
    if op == "finish":
        if len(d) < 3:
            return "too_few"
        if crosses(d[1:-1], d[-1], d[0]):
            return "intersects"
        s.draft, s.cutouts = [], s.cutouts + 1
        return "added"
    if d and crosses(d[:-1], d[-1], p):
        return "refused"
    d.append(p)
    return "vertex"


def sessions(clicks: DataFrame, kind: str, key: str = "robot_id", reach: float = 1.5) -> DataFrame:
    """``OUTCOMES`` of clicks (key, seq, op, x, y); ``kind`` is contour or cutout. Any other ``op`` than those above sets a vertex."""

    def step(s: Session, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seq, op, x, y in rows[["seq", "op", "x", "y"]].itertuples(index=False, name=None):
            did = contour_click(s, op, (x, y), reach) if kind == "contour" else cutout_click(s, op, (x, y))
            out.append((rows[key].iat[0], seq, did, len(s.draft), s.contour, s.cutouts))
        return pd.DataFrame(out, columns=[key, "seq", "outcome", "drafted", "contour", "cutouts"])

    return scan(clicks.select(key, "seq", "op", "x", "y"), [key], ["seq"], lambda _: Session(), step, OUTCOMES.format(key=key))


def tile_states(steps: DataFrame, key: str = "robot_id") -> DataFrame:
    """(key, zoom, x, y, state) of each tile that was in view, from views and replies (key, seq, reply, zoom, x, y).

    A view asks for the tile it is at and the eight around it. A reply counts
    only if its tile is in the last view before it; else it is discarded.
    """
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(~F.col("reply"), F.struct("zoom", "x", "y")), ignorenulls=True).over(w)
    now = steps.withColumn("v", seen)
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = now.where("NOT reply").select(key, "zoom", around.alias("a")).selectExpr(key, "zoom", "a.x", "a.y", "0 AS got").where("x >= 0 AND y >= 0 AND x < pow(2e0, zoom) AND y < pow(2e0, zoom)")
    got = now.where("reply AND v.zoom = zoom AND abs(v.x - x) <= 1 AND abs(v.y - y) <= 1").selectExpr(key, "zoom", "x", "y", "1 AS got")
    both = asked.unionByName(got).groupBy(key, "zoom", "x", "y").agg(F.max("got").alias("got"))
    return both.select(key, "zoom", "x", "y", F.when(F.col("got") == 1, "finished").otherwise("requested").alias("state"))


#: Layers in drawing order.
LAYERS = ("main", "cutout", "draft", "route", "robot")


def layers(contours: DataFrame, cutouts: DataFrame, drawn: DataFrame, waypoints: DataFrame, fixes: DataFrame) -> DataFrame:
    """(z, layer, items): the five layers with how many items their sources give them; a draft is a session whose last click left one open."""
    last = drawn.groupBy("robot_id").agg(F.max_by("drafted", "seq").alias("drafted")).where("drafted > 0").select(F.col("robot_id").alias("item"))
    sources = [contours.select(F.col("f").alias("item")), cutouts.select(F.col("f").alias("item")), last, waypoints.select(F.col("mission_id").alias("item")), fixes.where("status >= 0").select(F.col("robot_id").alias("item"))]
    out = None
    for z, (name, items) in enumerate(zip(LAYERS, sources, strict=True)):
        own = items.agg(F.countDistinct("item").alias("items")).select(F.lit(z).alias("z"), F.lit(name).alias("layer"), "items")
        out = own if out is None else out.unionByName(own)
    return out
