"""Routes to motion commands, and decimation of point sequences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, geo
from .ordered import scan


def route_commands(points: DataFrame, key: str = "robot_id", least_m: float = 0.2, u_turn_deg: float = 150.0, u_turn_m: float = 2.0, start_angle: float = 0.0) -> DataFrame:
    """Rotate and move commands along each key's points (key, seq, lat, lon).

    A hop shorter than ``least_m`` gives no command, though the next one starts
    where it ended. A turn is against the last hop that did; one of over
    ``u_turn_deg`` before a hop of under ``u_turn_m`` is left out, as are turns
    of up to 0.001 degrees. Two windows share one shuffle and sort on (key, seq).
    """
    w = Window.partitionBy(key).orderBy("seq")
    hops = points.select(key, "seq", "lat", "lon", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0")).where("lat0 IS NOT NULL")
    hops = hops.select(key, "seq", F.expr(geo.haversine("lat0", "lon0", "lat", "lon")).alias("distance_m"), F.expr(geo.hop_bearing("lat0", "lon0", "lat", "lon")).alias("azimuth"))
    kept = hops.where(F.col("distance_m") >= least_m)
    before = F.lag("azimuth", 1, start_angle).over(w)
    turned = kept.withColumn("delta", before).withColumn("delta", F.expr(angles.wrap_degrees("(azimuth - delta)")))
    no_turn = (F.abs("delta") > u_turn_deg) & (F.col("distance_m") < u_turn_m)
    rotate = F.when(~no_turn & (F.abs("delta") > 1e-3), F.struct(F.lit(0).alias("part"), F.lit("rotate").alias("cmd"), F.col("delta").alias("value")))
    move = F.struct(F.lit(1).alias("part"), F.lit("move").alias("cmd"), F.col("distance_m").alias("value"))
    return turned.select(key, "seq", F.explode(F.array_compact(F.array(rotate, move))).alias("c")).select(key, "seq", "c.*")


def manual_route(clicks: DataFrame, starts: DataFrame, key: str = "robot_id") -> DataFrame:
    """(key, pos, lat, lon, metres): a route of clicked points (key, seq, lat, lon) from the robot's place (key, lat, lon), if it is known; metres so far.

    Both windows share one shuffle and sort on the key.
    """
    both = clicks.select(key, F.col("seq").cast("bigint").alias("seq"), "lat", "lon").union(starts.select(key, F.lit(None).cast("bigint"), "lat", "lon"))
    w = Window.partitionBy(key).orderBy(F.col("seq").asc_nulls_first())
    hops = both.withColumns({"pos": F.row_number().over(w), "lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)}).withColumn("hop", F.coalesce(F.expr(geo.haversine("lat0", "lon0", "lat", "lon")), F.lit(0.0)))
    return hops.select(key, "pos", "lat", "lon", F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("metres"))


def command_documents(commands: DataFrame, key: str = "robot_id") -> DataFrame:
    """One JSON array of {cmd, data} per key, in route order."""
    data = F.when(F.col("cmd") == "rotate", F.struct(F.round("value", 4).alias("delta_angle"), F.lit(None).cast("double").alias("distance_m"))).otherwise(F.struct(F.lit(None).cast("double").alias("delta_angle"), F.round("value", 4).alias("distance_m")))
    item = F.struct("seq", "part", F.struct("cmd", data.alias("data")).alias("c"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])
    return commands.groupBy(key).agg(F.to_json(listed).alias("commands"), F.count("*").alias("n"))


def greedy_filter(points: DataFrame, keys: list[str], order: str, keep: Callable[[tuple, tuple], bool], columns: list[str]) -> DataFrame:
    """Keeps a point if ``keep(p, q)`` says so of it and the last kept one, both as tuples of (order, columns); each key's first point stays.

    One streaming pass over each key's sorted points.
    """
    names = [*keys, order, *columns]
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)

    def step(last: list, rows: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for p in rows[[order, *columns]].itertuples(index=False, name=None):
            kept.append(not last or bool(keep(p, last[0])))
            if kept[-1]:
                last[:] = [p]
        return rows[kept]

    return scan(points.select(*names), keys, [order], lambda _: [], step, schema)


def ema(points: DataFrame, keys: list[str], order: str, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Low-pass filter per key: the first value, then alpha * value + (1 - alpha) * before. One streaming pass."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    names = [*keys, order]
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names) + f", {name} double"

    def step(last: list, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v in rows["_value"].to_numpy(float):
            last[:] = [alpha * v + (1 - alpha) * last[0] if last else v]
            out.append(last[0])
        return rows[names].assign(**{name: out})

    return scan(points.select(*names, F.col(value).cast("double").alias("_value")), keys, [order], lambda _: [], step, schema)


def stale_markers(before: DataFrame, now: DataFrame, missions: DataFrame) -> DataFrame:
    """(mission_id, ns, id, action): deletes of markers (mission_id, ns, id) that the last publish had and this one has not, and of the markers of earlier versions.

    Both publishes are shuffled: a route's arrows are a hundred times its waypoints,
    by whose file Spark would take them for small and send them whole through the driver.
    """
    old = F.explode(F.array(F.struct(F.lit("waypoints_route_line").alias("ns"), F.lit(4000).alias("id")), F.struct(F.lit("robot_target_line").alias("ns"), F.lit(4001).alias("id"))))
    gone = before.join(now.hint("merge"), ["mission_id", "ns", "id"], "left_anti").select("mission_id", "ns", "id")
    return gone.unionByName(missions.select("mission_id", old.alias("m")).select("mission_id", "m.ns", "m.id")).withColumn("action", F.lit("DELETE"))
