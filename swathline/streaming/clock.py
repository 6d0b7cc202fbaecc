"""Stateful streams in event time: readings in order behind the watermark, a control clock, and an as-of join of two streams.

A processor buffers a robot's readings until the watermark has passed them, then
takes them in the order of (time, id), whatever order and micro-batch they came
in. A timer wakes it when the watermark passes the next thing to do, so a robot
that says nothing is served all the same. State per robot is the readings that the
watermark has not passed, and a few numbers; a robot that has been silent for long
has no timer and no state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that the processors take: times in microseconds; ``ok``: a valid reading.
READING = "robot_id bigint, ts timestamp, us bigint, id bigint, kind string, ok boolean"
TICK = "robot_id bigint, tick_us bigint, have_gps boolean, have_imu boolean, state string, missing string"
MARKER = "robot_id bigint, tick_us bigint, fix_id bigint"
POLL = "robot_id bigint, tick_us bigint, n bigint, state string"
ALIGNED = "robot_id bigint, id bigint, fix_id bigint"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Hands a robot's readings to ``reading`` in order, once the watermark has passed them; ``due`` says when else to wake."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us bigint, id bigint, kind string, ok boolean")
        self.memory = handle.getValueState("memory", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(pdf[["us", "id", "kind", "ok"]].itertuples(index=False, name=None))
            self.pending.appendList([(int(u), int(i), k, bool(o)) for u, i, k, o in new])
            least = min(u for u, *_ in new)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))  # the watermark is in milliseconds
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        waiting = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        out: list[tuple] = []
        for row in waiting:
            if row[0] > now:
                break
            out += self.until(key[0], memory, row[0])
            out += self.reading(key[0], memory, *row)
        waiting = [r for r in waiting if r[0] > now]
        out += self.until(key[0], memory, min(now + 1, waiting[0][0] if waiting else now + 1))
        if waiting:
            self.pending.put(waiting)
        else:
            self.pending.clear()
        wake = [x for x in (self.due(memory), waiting[0][0] if waiting else None) if x is not None]
        if wake:
            self.handle.registerTimer(max(-(-min(wake) // 1000), now // 1000 + 1))
        if memory and (wake or not self.forgets):
            self.memory.update((json.dumps(memory),))
        else:
            self.memory.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")]).astype({"id": "Int64", "fix_id": "Int64"} if self.schema == ALIGNED else {})

    forgets = True

    def until(self, robot: int, memory: dict, us: int) -> list[tuple]:
        """What falls due before ``us``."""
        return []

    def reading(self, robot: int, memory: dict, us: int, id: int, kind: str, ok: bool) -> list[tuple]:
        raise NotImplementedError

    def due(self, memory: dict) -> int | None:
        return None

    def close(self) -> None:
        pass


class Ticking(Ordered):
    """Ticks at every multiple of ``period`` from a reading on, for as long as ``tick`` says; later readings start the clock again."""

    period = 1

    def tick(self, robot: int, memory: dict, us: int) -> tuple[list[tuple], bool]:
        """Rows of one tick, and whether there is a next one."""
        raise NotImplementedError

    def until(self, robot, memory, us):
        out = []
        while memory.get("next") is not None and memory["next"] < us:
            rows, more = self.tick(robot, memory, memory["next"])
            out += rows
            memory["next"] = memory["next"] + self.period if more else None
        return out

    def wind(self, memory: dict, us: int) -> None:
        """The next tick is at ``us`` or after it."""
        memory["next"] = max(memory.get("next") or 0, -(-us // self.period) * self.period)

    def due(self, memory):
        return memory.get("next")


class Clock(Ticking):
    """Control ticks until the first one at which a robot has been silent for longer than both sensors' limits.

    A sensor counts if its last reading was valid and is no older than its limit; without both the robot is told to stop.
    """

    schema = TICK

    def __init__(self, period_us: int, gps_us: int, imu_us: int):
        self.period, self.limits = period_us, {"gps": gps_us, "imu": imu_us}

    def reading(self, robot, memory, us, id, kind, ok):
        memory[kind] = us if ok else None
        memory["last"] = us
        self.wind(memory, us)
        return []

    def tick(self, robot, memory, us):
        have = {k: memory.get(k) is not None and us - memory[k] <= limit for k, limit in self.limits.items()}
        missing = ", ".join(k for k in ("gps", "imu") if not have[k])
        return [(robot, us, have["gps"], have["imu"], "stop" if missing else "live", missing)], us - memory["last"] <= max(self.limits.values())


class Refresh(Ticking):
    """The robot's marker at every tick, at its last valid fix, until it has been silent for longer than ``silence_us``."""

    schema = MARKER

    def __init__(self, period_us: int, silence_us: int):
        self.period, self.silence = period_us, silence_us

    def reading(self, robot, memory, us, id, kind, ok):
        if kind == "gps" and ok:
            memory.update(fix=id, last=us)
            self.wind(memory, us)
        return []

    def tick(self, robot, memory, us):
        return [(robot, us, memory["fix"])], us - memory["last"] <= self.silence


class Readiness(Ticking):
    """Polls of how many readings there have been, until the number is the same in ``stable`` polls after the first of them, or ``deadline_us`` after the first reading."""

    schema = POLL
    forgets = False

    def __init__(self, period_us: int, stable: int, deadline_us: int):
        self.period, self.stable, self.deadline = period_us, stable, deadline_us

    def reading(self, robot, memory, us, id, kind, ok):
        if not memory:
            memory.update(first=us, count=0, seen=-1, same=0)
            self.wind(memory, us)
        memory["count"] += 1
        return []

    def tick(self, robot, memory, us):
        memory["same"] = memory["same"] + 1 if memory["count"] == memory["seen"] else 0
        memory["seen"] = memory["count"]
        state = "ready" if memory["same"] >= self.stable else "late" if us - memory["first"] >= self.deadline else "waiting"
        return [(robot, us, memory["count"], state)], state == "waiting"


class LatestFix(Ordered):
    """For every IMU reading the last valid fix before it or at its time, if it is no older than ``limit_us``."""

    schema = ALIGNED
    forgets = False

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def reading(self, robot, memory, us, id, kind, ok):
        if kind == "gps":
            if ok:
                memory.update(fix=id, at=us)
            return []
        fresh = "at" in memory and us - memory["at"] <= self.limit
        return [(robot, id, memory["fix"] if fresh else None)]


@contextmanager
def keyed_state(spark: SparkSession):
    """State in RocksDB, as timers need, while streams start; the session's own setting afterwards."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def tagged(gps: DataFrame, imu: DataFrame, late: str) -> DataFrame:
    """One stream of ``READING`` from two, each (robot_id, ts, id, ok) with its own watermark; the later of two sources holds the watermark back."""
    own = lambda df, kind: df.withWatermark("ts", late).select("robot_id", "ts", F.unix_micros("ts").alias("us"), "id", F.lit(kind).alias("kind"), "ok")
    return own(gps, "gps").unionByName(own(imu, "imu"))


def processed(readings: DataFrame, processor: Ordered) -> DataFrame:
    """The processor's rows over a stream of ``READING``."""
    return readings.groupBy("robot_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="append", timeMode="EventTime")
