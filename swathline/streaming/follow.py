"""Structured Streaming: the follower with state per robot, and event-time windows."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.motion import Controller
from ..operators import telemetry


def follow(readings: DataFrame, s: telemetry.Sensors = telemetry.Sensors(), c: Controller = Controller(), idle_ms: int | None = None) -> DataFrame:
    """Ticks of a stream of readings with a ``plan`` column: the robot's mission as JSON {origin, way}.

    The state is the robot's, as one JSON value; rows of a micro-batch are taken
    in (t, seq) order, rows that come later than later ones in arrival order.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        robot = telemetry.Robot(**json.loads(state.get[0])) if state.exists else telemetry.Robot()
        rows = telemetry.batches(parts)
        if len(rows):
            rows = rows.sort_values(["t", "seq"])
            plan = json.loads(rows["plan"].iat[0])
            _, ticks = telemetry.advance(robot, rows, tuple(plan["origin"]), [tuple(p) for p in plan["way"]], s, c)
            state.update((json.dumps(dataclasses.asdict(robot)),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
            yield ticks

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return readings.groupBy("robot_id").applyInPandasWithState(run, telemetry.TICK, "robot string", "append", timeout)


def plans(missions: DataFrame) -> DataFrame:
    """(robot_id, plan): each robot's mission as the JSON that ``follow`` reads."""
    point = F.struct("i", F.array("x", "y", "reach_radius_m").alias("p"))
    origin = F.array(F.first("origin_lat"), F.first("origin_lon"), F.first("yaw"))
    way = F.transform(F.array_sort(F.collect_list(point)), lambda w: w["p"])
    return missions.groupBy("robot_id").agg(F.to_json(F.struct(origin.alias("origin"), way.alias("way"))).alias("plan"))


def course_windows(readings: DataFrame, seconds: int = 5, late: str = "2 seconds") -> DataFrame:
    """Last heading and number of readings per robot and window of event time (column ``ts``)."""
    return (
        readings.withWatermark("ts", late)
        .groupBy("robot_id", F.window("ts", f"{seconds} seconds"))
        .agg(F.max_by("yaw", F.struct("ts", "seq")).alias("yaw"), F.count("*").alias("n"))
        .select("robot_id", F.col("window.start").alias("start"), "yaw", "n")
    )


def segments(readings: DataFrame, gap: str = "2 seconds", late: str = "2 seconds") -> DataFrame:
    """Mission segments: sessions of a robot's readings that no gap parts."""
    return (
        readings.withWatermark("ts", late)
        .groupBy("robot_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
        .select("robot_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "first", "last")
    )


def markers_upsert(batch: DataFrame, batch_id: int, path: str, order: str | None = None) -> None:
    """A ``foreachBatch`` sink: the latest marker of each (ns, id), deletes applied, as a version of the table per micro-batch.

    ``order``: a column that says which of a micro-batch's markers of one (ns, id) is the latest; without it there may be one only.

    A version is made from the one before and replaces none, so a failure leaves
    the last one whole, and a micro-batch that comes again writes its own again.
    """
    spark = batch.sparkSession
    both = batch.withColumn("age", F.lit(1))
    before = markers(spark, path, batch_id)
    if before is not None:
        both = before.withColumn("age", F.lit(0)).unionByName(both)
    latest = both.groupBy("ns", "id").agg(F.max_by(F.struct(*batch.columns), F.struct("age", order) if order else "age").alias("m")).select("m.*").where("action <> 'DELETE'")
    latest.write.mode("overwrite").parquet(f"{path}/version={batch_id}")


def markers(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The marker table's last version, or the last one before a micro-batch; None if there is none."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        versions = versions.where(F.col("version") < before)
    last = versions.agg(F.max("version")).first()[0]  # a partition's name, not data
    return None if last is None else versions.where(F.col("version") == last).drop("version")
