"""Routes over stripes: snakes per component, islands, one stitched route per job.

The greedy steps depend on what was chosen before, so they run in functions of
one job's rows: snakes per (job, component, phase), stitching per job. Everything
that can be a join or a window (stripes, links, components) is done before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .sweep import PlanConfig

CHUNKS = "f bigint, comp bigint, phase int, chunk int, min_row int, max_row int, xs array<double>, ys array<double>"
ISLANDS = "f bigint, comp bigint, phase int, island int, min_row int, max_row int, chunks int, xs array<double>, ys array<double>"
COVERAGE = "f bigint, rows int, leg double, back double, xs array<double>, ys array<double>"
TOURS = "f bigint, step int, comp bigint, phase int, island int, reverse boolean, cost double, ahead double, score double, xs array<double>, ys array<double>"
ROUTES = "f bigint, ok boolean, islands int, used int, unreachable int, links int, phase0 int, xs array<double>, ys array<double>"

_LEG = TOURS.split(", ")[1:]
VISITS = f"{ROUTES}, legs array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _LEG)}>>"
_CHORD = np.linspace(0, 1, 17)[:, None]


def _apart(p: np.ndarray, q: np.ndarray) -> float:
    x, y = float(q[0]) - float(p[0]), float(q[1]) - float(p[1])
    return math.sqrt(x * x + y * y)


Columns = Mapping[str, np.ndarray]

_SIDE = ["ring", "i", "x1", "y1", "x2", "y2", "len"]
_NONE = {"array": "array()", "boolean": "false"}


def by_field(rows: DataFrame, sides: DataFrame, run: Callable[[int, Columns, Columns], list[tuple]], schema: str) -> DataFrame:
    """``run(f, rows, sides)`` of each field that has any: its rows and its sides (``_SIDE``) as arrays by column.

    Both are one stream, sorted by field, that is cut where the field changes: a
    group of its own for each small field would cost more than what is done in it.
    Fields are dealt over all shuffle partitions, as Spark would join the few bytes
    of many into one task. A task holds one batch and the field that it ends in.
    """
    names = [x for x in rows.columns if x != "f"]
    kinds = {**{x.name: x.dataType for x in rows.schema}, **{x.name: x.dataType for x in sides.schema}}

    def tagged(df: DataFrame, own: list[str], part: int) -> DataFrame:
        none = {x: f"CAST({_NONE.get(kinds[x].typeName(), '0')} AS {kinds[x].simpleString()}) AS {x}" for x in (*_SIDE, *names)}
        return df.selectExpr("f", f"{part} AS part", *[x if x in own else none[x] for x in (*_SIDE, *names)])

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {x: pdf[x].to_numpy() for x in pdf.columns}
        f, part, out = at["f"], at["part"], []
        cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
        for a, b in zip(cuts, cuts[1:]):
            m = a + int(np.searchsorted(part[a:b], 1))
            out += run(int(f[a]), {x: at[x][m:b] for x in names}, {x: at[x][a:m] for x in _SIDE})
        return _rows(out, schema)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last field so far, which may go on
        for pdf in batches:
            f = pdf["f"].to_numpy()
            for cut in np.flatnonzero(f != f[-1])[-1:] + 1:
                yield made(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held, pdf = [], pdf.iloc[cut:]
            if held and held[-1]["f"].iat[0] != f[-1]:
                yield made(pd.concat(held, ignore_index=True))
                held = []
            if len(pdf):
                held.append(pdf)
        if held:
            yield made(pd.concat(held, ignore_index=True))

    both = tagged(sides, _SIDE, 0).unionByName(tagged(rows, names, 1))
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "f").sortWithinPartitions("f", "part").mapInPandas(stream, schema)


class Region:
    """Inside tests, nearest boundary places and walks along rings.

    Places and bridges are kept once found, as the greedy steps ask for the same
    ends again and again; ``prepare`` finds the places of many points at once, and
    ``prepare_chords`` which of many short chords stay inside.
    """

    #: Point-side pairs that are looked at together.
    BLOCK = 1 << 18

    def __init__(self, edges: Columns | pd.DataFrame, c: PlanConfig):
        ring, i = np.asarray(edges["ring"]), np.asarray(edges["i"])
        order = np.lexsort((i, ring))
        x1, y1, x2, y2, self.len = (np.asarray(edges[k])[order] for k in ("x1", "y1", "x2", "y2", "len"))
        self.a = np.stack([x1, y1], axis=1)
        self.v = np.stack([x2, y2], axis=1) - self.a
        self.ring, self.c = ring[order], c
        self.ax, self.ay, self.vx, self.vy = (np.ascontiguousarray(k) for k in (*self.a.T, *self.v.T))
        self.vv = np.maximum(self.vx * self.vx + self.vy * self.vy, 1e-18)
        self.arc = np.zeros(len(order))
        self.own: dict[int, np.ndarray] = {}
        self.total: dict[int, float] = {}
        for r in np.unique(self.ring).tolist():
            k = np.flatnonzero(self.ring == r)
            self.own[r] = k
            self.arc[k] = np.cumsum(self.len[k]) - self.len[k]
            self.total[r] = float(self.len[k].sum())
        self.near: dict[tuple[float, float], tuple[int, float, float]] = {}
        self.spans: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        self.straight: dict[tuple[float, ...], bool] = {}

    def places(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point and side: the nearest place as a share of the side, and its distance."""
        px, py = p[:, :1], p[:, 1:]
        t = np.clip(((px - self.ax) * self.vx + (py - self.ay) * self.vy) / self.vv, 0, 1)
        dx, dy = self.ax + t * self.vx - px, self.ay + t * self.vy - py
        return t, np.sqrt(dx * dx + dy * dy)

    def inside(self, p: np.ndarray) -> np.ndarray:
        px, py = p[:, :1], p[:, 1:]
        cut = (self.ay > py) != (self.ay + self.vy > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = self.vx * (py - self.ay) / self.vy + self.ax
        found = (cut & (px < x)).sum(1) % 2 == 1
        rest = np.flatnonzero(~found)
        if len(rest):
            found[rest] = self.places(p[rest])[1].min(1) <= 1e-6
        return found

    def chord_inside(self, p: np.ndarray, q: np.ndarray) -> bool:
        found = self.straight.get((*p.tolist(), *q.tolist())) if self.straight else None
        return bool(self.inside(p + _CHORD * (q - p)).all()) if found is None else found

    def prepare_chords(self, p: np.ndarray, q: np.ndarray) -> None:
        """Find which chords from points p to points q stay inside."""
        for k in range(0, len(p), rows := max(1, self.BLOCK // (len(_CHORD) * max(1, len(self.len))))):
            a, b = p[k : k + rows], q[k : k + rows]
            ok = self.inside((a[:, None] + _CHORD * (b - a)[:, None]).reshape(-1, 2)).reshape(len(a), -1).all(1)
            self.straight.update(zip(map(tuple, np.concatenate([a, b], axis=1).tolist()), ok.tolist(), strict=True))

    def direct_cap(self) -> float:
        """How far apart the ends of a straight connector inside a component are at most."""
        return min(max(0.5, self.c.direct_max), max(max(0.5, self.c.direct_max), 1.35 * self.c.step))

    def prepare(self, p: np.ndarray) -> None:
        """Find the boundary places of points (x, y)."""
        for k in range(0, len(p), rows := max(1, self.BLOCK // max(1, len(self.len)))):
            part = p[k : k + rows]
            t, d = self.places(part)
            at, row = d.argmin(1), np.arange(len(part))
            arcs = self.arc[at] + t[row, at] * self.len[at]
            self.near.update(zip(map(tuple, part.tolist()), zip(self.ring[at].tolist(), arcs.tolist(), d[row, at].tolist(), strict=True), strict=True))

    def anchor(self, p: np.ndarray) -> tuple[int, float, float]:
        """(ring, arc, distance) of the nearest boundary place."""
        key = (float(p[0]), float(p[1]))
        if key not in self.near:
            self.prepare(np.array([key]))
        return self.near[key]

    def at(self, ring: int, arc: float) -> np.ndarray:
        own = self.own[ring]
        k = own[max(0, int(np.searchsorted(self.arc[own], arc % self.total[ring], side="right")) - 1)]
        return self.a[k] + self.v[k] * min(1.0, (arc % self.total[ring] - self.arc[k]) / max(self.len[k], 1e-12))

    def arc_distance(self, ring: int, a: float, b: float) -> float:
        d = (b - a) % self.total[ring]
        return min(d, self.total[ring] - d)

    def walk(self, ring: int, a: float, b: float) -> list[np.ndarray]:
        """Vertices passed on the shorter way from a to b, then the place b; ties go forward."""
        own, total = self.own[ring], self.total[ring]
        way = (b - a) % total
        forward = way <= total - way
        ahead = (self.arc[own] - a if forward else a - self.arc[own]) % total
        passed = own[(ahead > 1e-9) & (ahead < (way if forward else total - way) - 1e-9)]
        ahead = (self.arc[passed] - a if forward else a - self.arc[passed]) % total
        return [*self.a[passed[np.argsort(ahead)]], self.at(ring, b)]

    def connect(self, p: np.ndarray, q: np.ndarray, intra: bool) -> tuple[float, Callable[[], list[np.ndarray]]] | None:
        """Cost of a legal connector from p to q, and what gives its points without p; None if there is none."""
        direct = _apart(p, q)
        if direct < 0.05:
            return direct, list
        cap = self.direct_cap() if intra else 0.0
        if direct <= cap and self.chord_inside(p, q):
            return direct, lambda: [q]
        reach = max(1.0, 0.75 * self.c.step)
        (r1, a1, d1), (r2, a2, d2) = self.anchor(p), self.anchor(q)
        if d1 > reach or d2 > reach:
            return None
        if r1 == r2:
            return d1 + d2 + self.arc_distance(r1, a1, a2), lambda: [self.at(r1, a1), *self.walk(r1, a1, a2), q]
        if intra or (r1 > 0) == (r2 > 0):
            return None
        return self.bridge(q, (r1, a1, d1), (r2, a2, d2))

    def chords(self, r1: int, r2: int) -> tuple[np.ndarray, ...]:
        """(u, w, hop) of the short chords inside the region from samples of one ring to another's."""
        if (r1, r2) not in self.spans:
            samples = []
            for r in (r1, r2):
                own = self.own[r][:: max(1, len(self.own[r]) // 48)]
                samples.append(np.r_[self.arc[own], self.arc[own] + self.len[own] / 2])
            pu, pw = (np.array([self.at(r, x) for x in xs]) for r, xs in zip((r1, r2), samples, strict=True))
            d = pw[None] - pu[:, None]
            hop = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])
            found = [(i, j) for i, j in np.argwhere(hop <= max(0.5, min(2.5 * self.c.step, self.c.direct_max))) if self.chord_inside(pu[i], pw[j])]
            i, j = np.array(found, int).reshape(-1, 2).T
            self.spans[r1, r2] = samples[0][i], samples[1][j], hop[i, j]
        return self.spans[r1, r2]

    def bridge(self, q: np.ndarray, one: tuple, two: tuple) -> tuple[float, Callable[[], list[np.ndarray]]] | None:
        """Along one ring, over a short chord inside the region, along the other."""
        (r1, a1, d1), (r2, a2, d2) = one, two
        u, w, hop = self.chords(r1, r2)
        if not len(hop):
            return None
        one_way, other_way = (u - a1) % self.total[r1], (a2 - w) % self.total[r2]
        score = d1 + np.minimum(one_way, self.total[r1] - one_way) + hop + np.minimum(other_way, self.total[r2] - other_way) + d2
        k = int(score.argmin())
        return float(score[k]), lambda: [self.at(r1, a1), *self.walk(r1, a1, u[k]), self.at(r2, w[k]), *self.walk(r2, w[k], a2), q]


def snakes(nodes: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Chunks (``CHUNKS``) of each component's snake, in both starting directions; nodes have ``merged``."""

    def run(f: int, nodes: Columns, sides: Columns) -> list[tuple]:
        region, out = Region(sides, c), []
        ends = np.stack([nodes[k] for k in ("sx", "sy", "ex", "ey")], axis=1)
        region.prepare(ends.reshape(-1, 2))
        comps, rows_of = nodes["merged"], nodes["row"]
        order = np.lexsort((nodes["node"], nodes["a0"], rows_of, comps))
        for p, q in _short_hops(ends[order], comps[order], rows_of[order], region.direct_cap()):
            region.prepare_chords(p, q)
        for own in _runs(order, comps):
            comp = comps[own[0]]
            for phase in (0, 1):
                forward, pts, rows = phase == 0, [], []

                def flush(comp=comp, phase=phase) -> None:
                    if len(pts) > 1:
                        out.append((f, comp, phase, len(out), min(rows), max(rows), *_xy(pts)))
                    pts.clear()
                    rows.clear()

                for stripes in _runs(own, rows_of):
                    row = rows_of[stripes[0]]
                    left = [(s[:2], s[2:]) if forward else (s[2:], s[:2]) for s in ends[stripes]]
                    if not forward:
                        left.reverse()
                    while left:
                        if not pts:
                            start, end = left.pop(0)
                            pts.append(start)
                        else:
                            nearest = sorted(range(len(left)), key=lambda k: _apart(left[k][0], pts[-1]))
                            ways = ((k, region.connect(pts[-1], left[k][0], True)) for k in nearest)
                            k, way = next(((k, w) for k, w in ways if w is not None), (None, None))
                            if way is None:
                                flush()
                                continue
                            start, end = left.pop(k)
                            cost, path = way
                            direct = _apart(start, pts[-1])
                            if cost > max(c.intra_limit, 2.5 * direct, 2.5 * c.step):
                                flush()
                                pts.append(start)
                            else:
                                pts.extend(path())
                        pts.append(end)
                        rows.append(int(row))
                    forward = not forward
                flush()
        return out

    return by_field(nodes.select("f", "merged", "row", "node", "a0", "sx", "sy", "ex", "ey"), edges.select("f", *_SIDE), run, CHUNKS)


def _short_hops(ends: np.ndarray, comps: np.ndarray, rows: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(from, to) in blocks: hops of at most ``most`` from a stripe's end to the start of another of its row or the component's next one, in both directions of driving.

    Stripes are sorted by component and row, so those that a stripe can go on to are a range.
    """
    fresh = np.r_[True, (comps[1:] != comps[:-1]) | (rows[1:] != rows[:-1])]
    start = np.flatnonzero(fresh)
    run, end = np.cumsum(fresh) - 1, np.r_[start[1:], len(comps)]
    last = np.r_[comps[start][1:] != comps[start][:-1], True]
    till = np.where(last, end, np.r_[end[1:], len(comps)])[run]
    first = np.flatnonzero(np.r_[True, comps[start][1:] != comps[start][:-1]])
    even = (run - first[np.searchsorted(first, run, side="right") - 1]) % 2 == 0
    size = till - start[run]
    block = np.cumsum(size) // Region.BLOCK
    for b in np.unique(block):
        s = np.flatnonzero(block == b)
        src = np.repeat(s, size[s])
        dst = np.arange(len(src)) - np.repeat(np.cumsum(size[s]) - size[s], size[s]) + start[run[src]]
        src, dst = src[src != dst], dst[src != dst]
        for forward in (even, ~even):
            p = np.where(forward[src, None], ends[src, 2:], ends[src, :2])
            q = np.where(forward[dst, None], ends[dst, :2], ends[dst, 2:])
            d = q - p
            near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] <= most * most
            yield p[near], q[near]


def _runs(order: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """Places in order, cut where the key changes."""
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []


def _points(rows: Columns, k: int) -> list[np.ndarray]:
    return list(np.stack([rows["xs"][k], rows["ys"][k]], axis=1))


def _xy(pts: list[np.ndarray]) -> tuple[list[float], list[float]]:
    return [p[0] for p in pts], [p[1] for p in pts]


def islands(chunks: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Chunks of one component and phase joined at tails where rows touch and the connector is cheap: ``ISLANDS``."""

    def run(f: int, chunks: Columns, sides: Columns) -> list[tuple]:
        region, out = Region(sides, c), []
        comps, phases = chunks["comp"].tolist(), chunks["phase"].tolist()
        lows, highs = chunks["min_row"].tolist(), chunks["max_row"].tolist()
        every = [(k, _points(chunks, k)) for k in np.lexsort((chunks["chunk"], chunks["phase"], chunks["comp"])).tolist()]
        region.prepare(np.array([p for _, pts in every for p in (pts[0], pts[-1])]).reshape(-1, 2))
        for (comp, phase), own in groupby(every, key=lambda e: (comps[e[0]], phases[e[0]])):
            made: list[list] = []
            for ch, pts in own:
                best = None
                for isl in made:
                    if min(isl[1], highs[ch]) < max(isl[0], lows[ch]) - 1:
                        continue
                    for flip in (False, True):
                        goal = pts[-1] if flip else pts[0]
                        way = region.connect(isl[3][-1], goal, True)
                        direct = _apart(goal, isl[3][-1])
                        if way and way[0] <= max(c.intra_limit, 2.5 * direct, 2.5 * c.step) and (best is None or way[0] < best[0]):
                            best = (way[0], isl, flip, way[1])
                if best is None:
                    made.append([lows[ch], highs[ch], 1, pts])
                else:
                    _, isl, flip, path = best
                    isl[3] += path() + (pts[::-1] if flip else pts)[1:]
                    isl[0], isl[1], isl[2] = min(isl[0], lows[ch]), max(isl[1], highs[ch]), isl[2] + 1
            for lo, hi, n, pts in made:
                out.append((f, comp, phase, len(out), lo, hi, n, *_xy(pts)))
        return out

    return by_field(chunks, edges.select("f", *_SIDE), run, ISLANDS)


def _tour(region: Region, todo: list[tuple], c: PlanConfig) -> tuple[list[tuple], tuple | None, list[int]]:
    """The order in which islands (comp, phase, points) are visited from the contour's first vertex.

    Gives (island, reverse, connector's cost and points, hop after it, score) of each visit, the connector back, and what stays out of reach.
    The next island has the best entry cost plus 0.45 of the hop after it, with
    penalties for tiny and far ones; a component's phase is fixed by its first
    island, and the other phase's islands are dropped.
    """
    start = region.at(0, 0.0)
    region.prepare(np.array([start, *[p for *_, pts in todo for p in (pts[0], pts[-1])]]))
    at, chosen, used, steps = start, {}, set(), []
    while True:
        best = None
        for k, (comp, phase, pts) in enumerate(todo):
            if k in used or chosen.get(comp, phase) != phase:
                continue
            for flip in (False, True):
                goal, leave = (pts[-1], pts[0]) if flip else (pts[0], pts[-1])
                way = region.connect(at, goal, False)
                if way is None:
                    continue
                rest = [min(_apart(p[0], leave), _apart(p[-1], leave)) for j, (cc, ph, p) in enumerate(todo) if j != k and j not in used and chosen.get(cc, ph) == ph]
                ahead = float(min(rest)) if rest else 0.0
                tiny = 0.5 * c.step if len(pts) <= 4 and way[0] > c.intra_limit else 0.0
                far = c.long_jump_weight * max(0.0, (way[0] - c.direct_max) / c.step)
                score = way[0] + 0.45 * ahead + tiny + far
                if best is None or score < best[4] - 1e-12:
                    best = (k, flip, way, ahead, score)
        if best is None:
            break
        k, flip = best[:2]
        comp, phase, pts = todo[k]
        at = pts[0] if flip else pts[-1]
        used.add(k)
        chosen.setdefault(comp, phase)
        steps.append((k, flip, (best[2][0], best[2][1]()), *best[3:]))
    back = region.connect(at, start, False) if used else None
    back = (back[0], back[1]()) if back else None
    return steps, back, [k for k, (comp, phase, _) in enumerate(todo) if k not in used and chosen.get(comp, phase) == phase]


def visits(isl: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig(), decimate: float = 0.02) -> DataFrame:
    """One row per job: its route (``ROUTES``) from the contour's first vertex through the islands in the order of ``_tour`` and back, and ``legs``, its connectors (``TOURS``)."""

    def run(f: int, isl: Columns, sides: Columns) -> list[tuple]:
        region, own = Region(sides, c), np.argsort(isl["island"], kind="stable")
        comps, phases, at = (isl[k][own].tolist() for k in ("comp", "phase", "island"))
        todo = [(comp, phase, _points(isl, k)) for comp, phase, k in zip(comps, phases, own.tolist(), strict=True)]
        steps, back, missed = _tour(region, todo, c)
        route, legs = [region.at(0, 0.0)], []
        for n, (k, flip, way, ahead, score) in enumerate(steps):
            pts = todo[k][2]
            route += way[1] + (pts[::-1] if flip else pts)[1:]
            legs.append((n, todo[k][0], todo[k][1], at[k], flip, way[0], ahead, score, *_xy(way[1])))
        if back:
            route += back[1]
            legs.append((len(steps), None, None, None, None, back[0], None, None, *_xy(back[1])))
        kept = route[:1]
        for p in route[1:]:
            if _apart(kept[-1], p) > decimate:
                kept.append(p)
        legs = [dict(zip([x.split()[0] for x in _LEG], leg, strict=True)) for leg in legs]
        return [(f, len(kept) >= 2, len(todo), len(steps), len(missed), max(0, len(steps) - 1), sum(p == 0 for _, p, _ in todo), *_xy(kept), legs)]

    return by_field(isl.select("f", "comp", "phase", "island", "xs", "ys"), edges.select("f", *_SIDE), run, VISITS)


def routes_of(found: DataFrame) -> DataFrame:
    """The routes (``ROUTES``) of ``visits``."""
    return found.drop("legs")


def legs_of(found: DataFrame) -> DataFrame:
    """The connectors (``TOURS``) of ``visits``, one per visit in order, from the approach to the first island; the last, without an island, leads back."""
    return found.select("f", F.explode("legs").alias("leg")).select("f", "leg.*")


def stitched(isl: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig(), decimate: float = 0.02) -> DataFrame:
    """One route per job (``ROUTES``)."""
    return routes_of(visits(isl, edges, c, decimate))


def tours(isl: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """The connectors of each job's route (``TOURS``)."""
    return legs_of(visits(isl, edges, c))


def chunk_candidates(chunks: DataFrame) -> DataFrame:
    """(f, comp, phase, a, b, flip, direct): which chunk may go on at whose tail, at its head or flipped: one component and phase, rows that touch."""
    one = lambda k: chunks.select("f", "comp", "phase", F.col("chunk").alias(k), *[F.col(x).alias(f"{k}_{x}") for x in ("min_row", "max_row", "xs", "ys")])
    near = one("a").join(one("b"), ["f", "comp", "phase"]).where("a < b AND least(a_max_row, b_max_row) >= greatest(a_min_row, b_min_row) - 1")
    ends = F.explode(F.array(*[F.struct(F.lit(flip).alias("flip"), F.element_at("b_xs", k).alias("x"), F.element_at("b_ys", k).alias("y")) for flip, k in ((False, 1), (True, -1))]))
    tail = near.withColumns({"e": ends, "px": F.element_at("a_xs", -1), "py": F.element_at("a_ys", -1)})
    return tail.select("f", "comp", "phase", "a", "b", "e.flip", F.sqrt((F.col("px") - F.col("e.x")) ** 2 + (F.col("py") - F.col("e.y")) ** 2).alias("direct"))


def _rows(out: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", legs ")[0].split(", ")]
    return pd.DataFrame(out, columns=[*names, "legs"] if ", legs " in schema else names)


def hops(nodes: DataFrame, links: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, src, dst, direct, direct_ok, cost, ok): connectors between linked stripes, from the end of one to the end of the other that is nearest.

    ``cost`` is null where no connector is legal; ``direct_ok``: short enough to go straight; ``ok``: cheap enough to be taken.
    Joins only: a straight hop needs its 17 places inside the region, others go along one ring.
    """
    from . import regions

    cap = min(max(0.5, c.direct_max), max(max(0.5, c.direct_max), 1.35 * c.step))
    key = ["src", "dst"]
    ends = lambda k: nodes.select("f", F.col("node").alias(k), *[F.col(x).alias(f"{k}_{x}") for x in ("sx", "sy", "ex", "ey")])
    near = F.least(*[F.struct(F.sqrt((F.col(f"src_{a}x") - F.col(f"dst_{b}x")) ** 2 + (F.col(f"src_{a}y") - F.col(f"dst_{b}y")) ** 2).alias("direct"), *[F.col(f"{k}_{e}{x}").alias(f"{n}{x}") for k, e, n in (("src", a, "p"), ("dst", b, "q")) for x in "xy"]) for a in "se" for b in "se"])
    pairs = written(links.select("f", *key).join(ends("src"), ["f", "src"]).join(ends("dst"), ["f", "dst"]).select("f", *key, near.alias("h")).select("f", *key, "h.*"))
    short = pairs.where(F.col("direct") <= cap).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(16)))).selectExpr("f", *key, "k", "px + (qx - px) * k / 16e0 AS px", "py + (qy - py) * k / 16e0 AS py")
    clear = regions.inside(short, edges, [*key, "k"], 1e-6).groupBy("f", *key).agg(F.bool_and("inside").alias("clear"))
    both = pairs.selectExpr("f", *key, "stack(2, 'left', px, py, 'right', qx, qy) AS (side, px, py)")
    along = boundary_transfers(both, edges, c, key).select("f", *key, "score")
    cost = F.when((F.col("direct") < 0.05) | F.coalesce("clear", F.lit(False)), F.col("direct")).otherwise(F.col("score"))
    found = pairs.join(clear, ["f", *key], "left").join(along, ["f", *key], "left").withColumn("cost", cost)
    ok = F.coalesce(F.col("cost") <= F.greatest(F.lit(max(c.intra_limit, 2.5 * c.step)), 2.5 * F.col("direct")), F.lit(False))
    return found.select("f", *key, "direct", (F.col("direct") <= cap).alias("direct_ok"), "cost", ok.alias("ok"))


def entries(isl: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, comp, phase, island, reverse, cost): how each island is best entered from the contour's first vertex: at its head, or at its tail if that is cheaper.

    No row where neither is legal. Joins only: an end in reach of the contour is
    reached along it, one in reach of a hole by the best bridge to that hole.
    """
    from . import regions

    key, reach = ["comp", "phase", "island"], max(1.0, 0.75 * c.step)
    one = lambda k, flip: F.struct(F.lit(flip).alias("reverse"), F.element_at("xs", k).alias("px"), F.element_at("ys", k).alias("py"))
    ends = written(isl.select("f", *key, F.explode(F.array(one(1, False), one(-1, True))).alias("e")).select("f", *key, "e.*"))
    start = edges.where("ring = 0 AND i = 0").selectExpr("f", "x1 AS sx", "y1 AS sy")
    total = edges.groupBy("f", "ring").agg(F.sum("len").alias("total"))
    arc = lambda d, n: f"least(pmod({d}, {n}), pmod(-({d}), {n}))"
    straight = ends.join(start, "f").selectExpr("f", *key, "reverse", "sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)) AS cost").where("cost < 0.05")
    near = written(regions.anchors(ends, edges, [*key, "reverse"]).where(F.col("dist") <= reach).join(total, ["f", "ring"]).select("f", "ring", *key, "reverse", "dist", F.col("arc").alias("u"), "total"))
    outer = near.where("ring = 0").selectExpr("f", *key, "reverse", f"dist + {arc('u', 'total')} AS cost")
    contour = total.where("ring = 0").selectExpr("f", "total AS outer_total")
    spans = bridges(edges, c).select("f", "ring", "place", "outer_place", "hop").join(contour, "f")
    over = near.where("ring > 0").join(spans, ["f", "ring"]).selectExpr("f", *key, "reverse", f"dist + {arc('outer_place', 'outer_total')} + hop + {arc('u - place', 'total')} AS cost")
    # a straight end is dearer by a walk that starts where it stands, so the least of all ways is the one that is taken
    ways = straight.union(outer).union(over)
    best = F.min(F.struct("cost", "reverse")).alias("w")
    return ways.groupBy("f", *key).agg(best).select("f", *key, "w.reverse", "w.cost")


def boundary_transfers(ends: DataFrame, edges: DataFrame, c: PlanConfig = PlanConfig(), key: Sequence[str] = ("node",)) -> DataFrame:
    """(f, key..., ring, d1, d2, arc, score): ways along one ring between the left and the right point of a key; ``ends`` (f, key..., side, px, py).

    Joins only: both points' nearest boundary places must be on one ring and in reach; the score is both distances and the shorter arc.
    """
    from . import regions

    reach = max(1.0, 0.75 * c.step)
    near = regions.anchors(ends, edges, [*key, "side"]).where(f"dist <= {reach!r}")
    total = edges.groupBy("f", "ring").agg(F.sum("len").alias("total"))
    a = near.where("side = 'left'").selectExpr("f", *key, "ring", "dist AS d1", "arc AS u")
    b = near.where("side = 'right'").selectExpr("f", *key, "ring", "dist AS d2", "arc AS v")
    both = a.join(b, ["f", *key, "ring"]).join(total, ["f", "ring"]).withColumn("arc", F.expr("least(pmod(v - u, total), pmod(u - v, total))"))
    return both.select("f", *key, "ring", "d1", "d2", "arc", F.expr("d1 + d2 + arc").alias("score"))


def ring_samples(edges: DataFrame, most: int = 48) -> DataFrame:
    """(f, ring, place, x, y): about ``most`` vertices of each ring, evenly, and the middles of the sides from them; ``place`` along the ring."""
    from . import regions

    picked = regions.with_arcs(edges).where(f"i % greatest(1, CAST(floor(n / {most}e0) AS INT)) = 0")
    return picked.selectExpr("f", "ring", "stack(2, arc, x1, y1, arc + len / 2, (x1 + x2) / 2, (y1 + y2) / 2) AS (place, x, y)")


def bridges(edges: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """(f, ring, place, outer_place, px, py, qx, qy, hop): short chords inside the region between a hole's samples and the contour's.

    Samples meet in square cells as wide as the longest bridge, each with its
    neighbours, so a field with long rings joins only what can be near.
    """
    from . import regions

    longest = max(0.5, min(2.5 * c.step, c.direct_max))
    cell = lambda x: F.floor(F.col(x) / longest)
    samples = ring_samples(edges)
    holes = samples.where("ring > 0").select("f", F.col("ring").alias("hole"), "place", F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    outer = samples.where("ring = 0").select("f", F.col("place").alias("outer_place"), F.col("x").alias("qx"), F.col("y").alias("qy"), around.alias("c")).select("f", "outer_place", "qx", "qy", "c.cx", "c.cy")
    near = holes.join(outer, ["f", "cx", "cy"]).withColumn("hop", F.expr("sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))")).where(F.col("hop") <= longest).drop("cx", "cy")
    key = ["hole", "place", "outer_place"]
    points = near.select("f", *key, "px", "py", "qx", "qy", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("k")).selectExpr("f", *key, "k", "px + (qx - px) * k / 16e0 AS px", "py + (qy - py) * k / 16e0 AS py")
    clear = regions.inside(points, edges, [*key, "k"], 1e-6).groupBy("f", *key).agg(F.bool_and("inside").alias("clear")).where("clear")
    return near.join(clear.select("f", *key), ["f", *key]).withColumnRenamed("hole", "ring")


def simplified(nodes: DataFrame, edges: DataFrame, starts: DataFrame, c: PlanConfig = PlanConfig()) -> DataFrame:
    """Simplified route (``COVERAGE``) of each field: along the boundary to a snake over all rows, and back.

    Rows go in order, each from its end that is nearer to where the last one
    stopped; a hop without a legal connector is straight. The snake is turned
    round if its tail is nearer to the boundary place of the start (f, px, py).
    The legs walk the ring between the boundary places of their ends, however far
    these are. No cutouts: ``nodes`` and ``edges`` are of contours.
    """

    def run(f: int, nodes: Columns, rest: Columns) -> list[tuple]:
        given = rest["ring"] >= 0
        sides, start = {k: v[given] for k, v in rest.items()}, np.stack([rest["x1"], rest["y1"]], axis=1)[~given]
        if not len(nodes["node"]) or given.all() or not given.any():
            return []
        region, route = Region(sides, c), []

        def add(p: np.ndarray) -> None:
            if not route or _apart(route[-1], p) > 0.02:
                route.append(p)

        every, rows_of = np.stack([nodes[k] for k in ("sx", "sy", "ex", "ey")], axis=1), nodes["row"]
        region.prepare(every.reshape(-1, 2))
        for own in _runs(np.lexsort((nodes["node"], nodes["a0"], rows_of)), rows_of):
            ends = every[own]
            forward = not route or _apart(ends[0, :2], route[-1]) <= _apart(ends[-1, 2:], route[-1])
            for e in ends if forward else ends[::-1]:
                first, last = (e[:2], e[2:]) if forward else (e[2:], e[:2])
                way = region.connect(route[-1], first, True) if route else None
                for p in way[1]() if way else [first]:
                    add(p)
                add(last)
        ring, arc, _ = region.anchor(start[0])
        place = region.at(ring, arc)
        if _apart(route[-1], place) < _apart(route[0], place):
            route.reverse()

        def leg(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
            (r1, u, _), (r2, v, _) = region.anchor(p), region.anchor(q)
            return [region.at(r1, u), *region.walk(r1, u, v), q] if r1 == r2 else [q]

        length = lambda pts: float(sum(_apart(a, b) for a, b in zip(pts, pts[1:])))
        there, back = [start[0], *leg(start[0], route[0])], [route[-1], *leg(route[-1], start[0])]
        whole = [*there, *route[1:], *back[1:]]
        return [(f, len(np.unique(rows_of)), length(there), length(back), *_xy(whole))]

    at = starts.selectExpr("f", "-1 AS ring", "0 AS i", "px AS x1", "py AS y1", "0e0 AS x2", "0e0 AS y2", "0e0 AS len")
    return by_field(nodes.select("f", "node", "row", "a0", "sx", "sy", "ex", "ey"), edges.select("f", *_SIDE).union(at), run, COVERAGE)
