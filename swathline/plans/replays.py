"""Queries of telemetry replay. The comparison walks each robot's readings in a recursive statement of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import telemetry
from ..sources.fixtures import Tables
from .spec import operator

#: Seconds between a robot's readings in the replay: the given events are days apart, the control loop runs many times a second.
PERIOD = 0.5


def readings(t: Tables) -> DataFrame:
    both = t["gps_fix"].alias("g").join(t["imu"].alias("i"), "event_id")
    seq = F.expr("CAST(row_number() OVER (PARTITION BY g.robot_id ORDER BY g.ts, event_id) AS INT)")
    return both.select(F.col("g.robot_id").alias("robot_id"), seq.alias("seq"), "status", "lat", "lon", "cov0", "yaw", "wz").withColumn("t", F.col("seq") * PERIOD).select(*[c.split()[0] for c in telemetry.READING.split(", ")])


def missions(t: Tables) -> DataFrame:
    return t["waypoint_xy"].alias("w").join(t["missions"].alias("m"), "mission_id").select(F.col("mission_id").cast("bigint").alias("robot_id"), "origin_lat", "origin_lon", F.lit(0.0).alias("yaw"), "i", "x", "y", "reach_radius_m")


_READINGS = f"""SELECT *, seq * {PERIOD}e0 AS t FROM (SELECT g.robot_id, CAST(row_number() OVER (PARTITION BY g.robot_id ORDER BY g.ts, g.event_id) AS INT) AS seq, status, lat, lon, cov0, yaw, wz
    FROM {{gps_fix}} g JOIN {{imu}} i ON g.event_id = i.event_id) q"""
_POINTS = "SELECT w.mission_id AS robot_id, i, x, y, reach_radius_m AS radius, origin_lat AS lat0, origin_lon AS lon0 FROM {waypoint_xy} w JOIN {missions} m ON w.mission_id = m.mission_id"
_COLUMNS = "robot_id, seq, lat, lon, x, y, speed, fix_t, imu_t, yaw, wz, have_gps, have_imu, mode, target, goal, since, hold, from_x, from_y, planned, best, distance, err, v, w, event, waited"
# Level by level: the reading after a robot's state, both sensors, freshness, the target, the course check, what the tick is about, its outcome.
_STEP = """
    SELECT s.*, r.seq AS seq1, r.t, r.status, r.lat AS glat, r.lon AS glon, r.cov0, r.yaw AS gyaw, r.wz AS gwz, h.lat0, h.lon0, h.n, coalesce(r.status >= 0 AND r.lat IS NOT NULL AND r.lon IS NOT NULL, false) AS fix, coalesce(r.cov0 >= 0 AND r.yaw IS NOT NULL, false) AS turned
    FROM walk s JOIN readings r ON r.robot_id = s.robot_id AND r.seq = s.seq + 1 LEFT JOIN heads h ON h.robot_id = s.robot_id"""
_SENSED = f"""
    SELECT *, CASE WHEN fix THEN CASE WHEN fix_t IS NOT NULL AND t - fix_t > 1e-6 THEN 0.25e0 * least(2e0, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / (t - fix_t)) + 0.75e0 * speed ELSE speed END WHEN status < 0 THEN 0e0 ELSE speed END AS speed1,
        CASE WHEN fix THEN t WHEN status < 0 THEN NULL ELSE fix_t END AS fix_t1, CASE WHEN fix THEN true WHEN status < 0 THEN false ELSE have_gps END AS gps0,
        CASE WHEN turned THEN atan2(sin(gyaw), cos(gyaw)) ELSE yaw END AS yaw1, CASE WHEN turned THEN coalesce(gwz, 0e0) ELSE wz END AS wz1, CASE WHEN turned THEN t ELSE imu_t END AS imu_t1, have_imu OR turned AS imu0
    FROM (SELECT *, CASE WHEN fix THEN radians(lon1 - coalesce(lon0, 0e0)) * cos(radians(coalesce(lat0, 0e0))) * 6371000e0 ELSE x END AS x1, CASE WHEN fix THEN radians(lat1 - coalesce(lat0, 0e0)) * 6371000e0 ELSE y END AS y1
        FROM (SELECT *, CASE WHEN fix THEN CASE WHEN lat IS NULL THEN glat ELSE 0.15e0 * glat + (1e0 - 0.15e0) * lat END ELSE lat END AS lat1, CASE WHEN fix THEN CASE WHEN lon IS NULL THEN glon ELSE 0.15e0 * glon + (1e0 - 0.15e0) * lon END ELSE lon END AS lon1 FROM ({_STEP}) a) b) c"""
_FRESH = f"SELECT *, gps0 AND NOT coalesce(t - fix_t1 > 2e0, false) AS gps1, imu0 AND NOT coalesce(t - imu_t1 > 1e0, false) AS imu1 FROM ({_SENSED}) d"
_AIMED = f"""
    SELECT e.*, CASE WHEN NOT (gps1 AND imu1) THEN 'blind' WHEN target >= coalesce(n, 0) THEN 'done' ELSE 'live' END AS sight, p.radius,
        sqrt((p.x - x1) * (p.x - x1) + (p.y - y1) * (p.y - y1)) AS dist, atan2(p.y - y1, p.x - x1) AS bearing
    FROM ({_FRESH}) e LEFT JOIN points p ON p.robot_id = e.robot_id AND p.i = e.target"""
_CHECKED = f"""
    SELECT *, CASE WHEN sight <> 'live' THEN sight WHEN mode = 'DRIVING' AND off AND floor((seq1 - 1) * {PERIOD}e0 / 5e0) > floor((seq1 - 2) * {PERIOD}e0 / 5e0) THEN 'check'
        WHEN mode = 'TURN_INIT' AND dist <= radius THEN 'reached' WHEN mode IN ('TURN_INIT', 'TURNING') THEN 'turn' WHEN mode = 'SETTLE_BEFORE_DRIVE' THEN 'before' WHEN mode = 'DRIVING' THEN 'drive' ELSE 'after' END AS act
    FROM (SELECT *, abs(err1) > 0.35e0 AS off FROM (SELECT *, atan2(sin(bearing - yaw1), cos(bearing - yaw1)) AS err1 FROM ({_AIMED}) f) g) h"""
_JUDGED = f"""
    SELECT *, CASE WHEN act = 'turn' THEN atan2(sin(goal1 - yaw1), cos(goal1 - yaw1)) END AS rest, t - since >= 1.5e0 OR (t - since >= 0.25e0 AND abs(wz1) <= 0.08e0) AS still,
        CASE WHEN gone > 0.5e0 AND dist > radius AND off THEN 'realign' WHEN gone >= 1.5e0 AND dist > best1 + 1e0 THEN 'overshoot' WHEN gone >= planned THEN 'distance' END AS halt
    FROM (SELECT *, CASE WHEN act = 'turn' AND mode = 'TURN_INIT' THEN bearing ELSE goal END AS goal1, sqrt((x1 - from_x) * (x1 - from_x) + (y1 - from_y) * (y1 - from_y)) AS gone,
        CASE WHEN act = 'drive' AND dist + 0.12e0 < best THEN dist ELSE best END AS best1 FROM ({_CHECKED}) i) j"""
_ENDED = f"""
    SELECT *, CASE act WHEN 'check' THEN 'course_check' WHEN 'reached' THEN 'reached' WHEN 'turn' THEN CASE WHEN abs(rest) <= 0.05e0 THEN 'turned' END WHEN 'before' THEN CASE WHEN still THEN 'driving' END
        WHEN 'drive' THEN halt WHEN 'after' THEN CASE WHEN still THEN CASE WHEN dist <= radius THEN 'arrived' ELSE 'missed' END END END AS event1,
        greatest(-0.8e0, least(0.8e0, 2.2e0 * rest)) AS turn_w, least(CASE WHEN dist < 1.2e0 THEN 0.25e0 ELSE 0.35e0 END, greatest(0.05e0, least(0.35e0, 0.45e0 * dist))) AS ahead FROM ({_JUDGED}) k"""
_WALK = f"""
    SELECT robot_id, 0 AS seq, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, 0e0 AS x, 0e0 AS y, 0e0 AS speed, CAST(NULL AS DOUBLE) AS fix_t, CAST(NULL AS DOUBLE) AS imu_t, 0e0 AS yaw, 0e0 AS wz, false AS have_gps, false AS have_imu, 'TURN_INIT' AS mode, 0 AS target,
        0e0 AS goal, 0e0 AS since, 0e0 AS hold, 0e0 AS from_x, 0e0 AS from_y, 0e0 AS planned, 1e300 AS best, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS err, 0e0 AS v, 0e0 AS w, CAST(NULL AS STRING) AS event, CAST(NULL AS DOUBLE) AS waited
    FROM (SELECT DISTINCT robot_id FROM readings) z
    UNION ALL SELECT robot_id, seq1, lat1, lon1, x1, y1, speed1, fix_t1, imu_t1, yaw1, wz1, gps1, imu1,
        CASE WHEN act = 'done' THEN 'DONE' WHEN event1 IN ('course_check', 'realign', 'overshoot', 'distance') THEN 'SETTLE_AFTER_DRIVE' WHEN event1 = 'turned' THEN 'SETTLE_BEFORE_DRIVE' WHEN event1 = 'driving' THEN 'DRIVING'
            WHEN event1 IN ('reached', 'arrived', 'missed') THEN 'TURN_INIT' WHEN act = 'turn' THEN 'TURNING' ELSE mode END,
        target + CASE WHEN event1 IN ('reached', 'arrived') THEN 1 ELSE 0 END, goal1, CASE WHEN event1 IN ('course_check', 'realign', 'overshoot', 'distance', 'turned') THEN t ELSE since END,
        CASE WHEN event1 = 'driving' THEN yaw1 ELSE hold END, CASE WHEN event1 = 'driving' THEN x1 ELSE from_x END, CASE WHEN event1 = 'driving' THEN y1 ELSE from_y END, CASE WHEN event1 = 'driving' THEN dist ELSE planned END, CASE WHEN event1 = 'driving' THEN dist ELSE best1 END,
        CASE WHEN sight = 'live' THEN dist END, CASE WHEN sight = 'live' THEN err1 END, CASE WHEN act = 'drive' AND event1 IS NULL THEN CASE WHEN dist < 0.45e0 THEN least(ahead, 0.12e0) ELSE ahead END ELSE 0e0 END,
        CASE WHEN act = 'drive' AND event1 IS NULL THEN greatest(-0.18e0, least(0.18e0, 2e0 * atan2(sin(hold - yaw1), cos(hold - yaw1)))) WHEN act = 'turn' AND event1 IS NULL THEN CASE WHEN abs(turn_w) > 0 AND abs(turn_w) < 0.12e0 THEN sign(turn_w) * 0.12e0 ELSE turn_w END ELSE 0e0 END,
        event1, CASE WHEN event1 IN ('driving', 'arrived', 'missed') THEN t - since END FROM ({_ENDED}) l"""


def _walked(text: str) -> str:
    heads = "SELECT robot_id, min(lat0) AS lat0, min(lon0) AS lon0, count(*) AS n FROM points GROUP BY robot_id"
    return f"WITH RECURSIVE readings AS ({_READINGS}), points AS ({_POINTS}), heads AS ({heads}), walk AS ({_WALK}), ticks AS (SELECT *, mode AS state, seq * {PERIOD}e0 AS t FROM walk WHERE seq > 0) {text}"


def register() -> None:
    pose = lambda t: telemetry.replay(readings(t), missions(t), "poses")
    ticks = lambda t: telemetry.replay(readings(t), missions(t))

    def op(name: str, text: str, rounded: dict[str, int] | None = None):
        return operator(name, _walked(text), rounded)

    op("m1_gps_update", "SELECT robot_id, seq, x, y, speed FROM ticks", {"x": 3, "y": 3, "speed": 4})(lambda t: pose(t).select("robot_id", "seq", "x", "y", "speed"))
    op("m4_control_ticks", "SELECT robot_id, seq, state, target, v, w FROM ticks", {"v": 4, "w": 4})(lambda t: ticks(t).select("robot_id", "seq", "state", "target", "v", "w"))
    changes = "SELECT before, state, count(*) AS n FROM (SELECT state, lag(state) OVER (PARTITION BY robot_id ORDER BY seq) AS before FROM ticks) q WHERE before IS NULL OR before <> state GROUP BY before, state"
    op("m5_state_changes", changes)(lambda t: ticks(t).withColumn("before", F.expr("lag(state) OVER (PARTITION BY robot_id ORDER BY seq)")).where("before IS NULL OR before <> state").groupBy("before", "state").agg(F.count("*").alias("n")))
    op("m15_completion", "SELECT robot_id, max(target) AS targets, min(CASE WHEN state = 'DONE' THEN seq END) AS done_at FROM ticks GROUP BY robot_id")(
        lambda t: ticks(t).groupBy("robot_id").agg(F.max("target").alias("targets"), F.min(F.expr("CASE WHEN state = 'DONE' THEN seq END")).alias("done_at"))
    )
    op("g14_best_distance", "SELECT robot_id, target, min(distance) AS best FROM ticks WHERE state = 'DRIVING' GROUP BY robot_id, target", {"best": 3})(lambda t: ticks(t).where("state = 'DRIVING'").groupBy("robot_id", "target").agg(F.min("distance").alias("best")))
    op("b5_velocity_commands", "SELECT robot_id, t, v AS linear_x, w AS angular_z FROM ticks WHERE v <> 0 OR w <> 0", {"linear_x": 4, "angular_z": 4})(
        lambda t: ticks(t).where("v <> 0 OR w <> 0").select("robot_id", "t", F.col("v").alias("linear_x"), F.col("w").alias("angular_z"))
    )
    # -- what ends a turn, a drive and a wait ----------------------------------------------------------------------
    for name, event in (("m6_turn_completion", "turned"), ("m7_overshoot", "overshoot"), ("m8_drive_realign", "realign"), ("m9_planned_distance", "distance"), ("m11_course_realign", "course_check")):
        op(name, f"SELECT robot_id, seq, target, distance, err AS heading_error FROM ticks WHERE event = '{event}'", {"distance": 3, "heading_error": 4})(
            lambda t, event=event: ticks(t).where(F.col("event") == event).select("robot_id", "seq", "target", "distance", "heading_error")
        )
    op("m12_settle_deadlines", "SELECT event, waited, count(*) AS n FROM ticks WHERE waited IS NOT NULL GROUP BY event, waited")(lambda t: ticks(t).where("waited IS NOT NULL").groupBy("event", "waited").agg(F.count("*").alias("n")))
    op("h13_settle_window", "SELECT robot_id, seq, waited, waited >= 1.5e0 AS timed_out FROM ticks WHERE waited IS NOT NULL")(lambda t: ticks(t).where("waited IS NOT NULL").select("robot_id", "seq", "waited", F.expr("waited >= 1.5e0 AS timed_out")))
