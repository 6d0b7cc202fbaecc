"""Queries of document sources: texts are made by Spark from the tables and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commands
from ..sources import documents
from ..sources.fixtures import Tables
from .spec import operator, statement


def geojson(t: Tables) -> DataFrame:
    """A document per field: every fifth a LineString, every seventh without a usable feature."""
    point = F.struct("i", F.array(F.round(F.col("x") * 1e-5 + 37, 9), F.round(F.col("y") * 1e-5 + 55, 9)).alias("p"))
    rings = t["field_vertices"].groupBy("f").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["p"]).alias("pts"))
    line = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("LineString").alias("type"), F.col("pts").alias("coordinates")).alias("geometry"))).alias("features")))
    polygon = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("Polygon").alias("type"), F.array("pts").alias("coordinates")).alias("geometry"))).alias("features")))
    return rings.select(F.col("f").alias("id"), F.when(F.col("f") % 7 == 0, '{"features": []}').when(F.col("f") % 5 == 0, line).otherwise(polygon).alias("body"))


def mission_texts(t: Tables) -> DataFrame:
    item = F.when(F.col("i") % 3 == 1, F.to_json(F.array("lat", "lon"))).otherwise(F.to_json(F.struct(F.col("wid").alias("id"), F.col("lat").alias("latitude"), F.col("lon").alias("lng"), "reach_radius_m")))
    ways = t["waypoints"].groupBy("mission_id").agg(F.array_sort(F.collect_list(F.struct("i", item.alias("w")))).alias("ws"))
    origin = F.when(F.col("mission_id") % 3 > 0, F.to_json(F.struct(F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon"), "yaw")))
    parts = F.concat(F.lit('{"waypoints": ['), F.concat_ws(", ", F.transform("ws", lambda w: w["w"])), F.lit("]"), F.coalesce(F.concat(F.lit(', "origin": '), origin), F.lit("")), F.lit("}"))
    return ways.join(t["missions"], "mission_id").select(F.col("mission_id").alias("id"), parts.alias("body"))


def world_texts(t: Tables) -> DataFrame:
    robot = t["missions"].selectExpr("mission_id AS id", "-1 AS i", "'robot' AS name", "0e0 AS x", "0e0 AS y")
    models = t["waypoint_xy"].selectExpr("mission_id AS id", "i", "wid AS name", "x", "y").union(robot)
    return documents.world_documents(models, t["missions"].selectExpr("mission_id AS id", "origin_lat AS lat", "origin_lon AS lon", "degrees(yaw) AS heading_deg"))


def register() -> None:
    ring = "SELECT f AS id, CAST(NULL AS STRING) AS error, 0 AS feature, i, round(y * 1e-5 + 55, 9) AS lat, round(x * 1e-5 + 37, 9) AS lon FROM {field_vertices} WHERE f % 7 <> 0"
    close = "SELECT f AS id, CAST(NULL AS STRING) AS error, 0 AS feature, n AS i, round(y * 1e-5 + 55, 9) AS lat, round(x * 1e-5 + 37, 9) AS lon FROM {field_vertices} WHERE f % 7 <> 0 AND i = 0"
    none = "SELECT s_suppkey AS id, 'no usable feature' AS error, NULL AS feature, NULL AS i, NULL AS lat, NULL AS lon FROM {supplier} WHERE s_suppkey % 7 = 0"
    operator("a1_geojson_contours", f"{ring} UNION ALL {close} UNION ALL {none}", {"lat": 8, "lon": 8})(lambda t: documents.contours(geojson(t)))
    operator("a2_geometry_points", f"SELECT id, count(i) AS points FROM ({ring} UNION ALL {close} UNION ALL {none}) q GROUP BY id")(lambda t: documents.contours(geojson(t)).groupBy("id").agg(F.count("i").alias("points")))
    ways = "SELECT w.mission_id AS id, CASE WHEN w.mission_id % 3 > 0 THEN origin_lat ELSE f.lat END AS lat0, i, CASE WHEN i % 3 = 1 THEN concat('wp_', CAST(i + 1 AS STRING)) ELSE wid END AS wid, w.lat AS latitude, w.lon AS longitude, CASE WHEN i % 3 = 1 THEN 0.9e0 ELSE reach_radius_m END AS reach_radius_m FROM {waypoints} w JOIN {missions} m ON w.mission_id = m.mission_id JOIN (SELECT mission_id, lat FROM {waypoints} WHERE i = 0) f ON f.mission_id = w.mission_id"
    operator("a4_waypoint_documents", ways, {"lat0": 8, "latitude": 8, "longitude": 8, "reach_radius_m": 6})(lambda t: documents.missions(mission_texts(t)).select("id", "lat0", "i", "wid", "latitude", "longitude", "reach_radius_m"))
    operator("a17_world_models", "SELECT mission_id AS id, 'robot' AS name FROM {missions} WHERE mission_id IN (SELECT mission_id FROM {waypoints})")(lambda t: documents.world_models(world_texts(t)).select("id", "name"))
    operator("b14_world_documents", "SELECT mission_id AS id, count(*) + 1 AS models FROM {waypoint_xy} GROUP BY mission_id")(lambda t: world_texts(t).selectExpr("id", "CAST(size(xpath(body, '/sdf/world/model/@name')) AS BIGINT) AS models"))
    statement("e24_polyline_assembly", "SELECT mission_id, i, x, y FROM (SELECT *, lag(x) OVER (PARTITION BY mission_id ORDER BY i) AS px, lag(y) OVER (PARTITION BY mission_id ORDER BY i) AS py FROM {waypoint_xy}) q WHERE px IS NULL OR sqrt((x - px) * (x - px) + (y - py) * (y - py)) > 0.02e0", {"x": 4, "y": 4})
    statement("p9_context_overlay", "SELECT f, ring, CASE WHEN ring = 0 THEN 57 * f % 360 ELSE (53 * f + 17) % 360 END AS hue, count(*) AS sides FROM {edges} GROUP BY f, ring")
    # an update is shown if none was in the 200 ms of its robot before it: the clock of a fix is its number, 50 ms apart
    ms = "SELECT robot_id, seq, seq * 50 AS ms FROM {track}"
    walk = f"WITH RECURSIVE clock AS ({ms}), shown AS (SELECT robot_id, seq, ms, ms AS last, true AS visible FROM clock WHERE seq = 1 UNION ALL SELECT c.robot_id, c.seq, c.ms, CASE WHEN c.ms - s.last >= 200 THEN c.ms ELSE s.last END, c.ms - s.last >= 200 FROM shown s JOIN clock c ON c.robot_id = s.robot_id AND c.seq = s.seq + 1) SELECT robot_id, seq, ms FROM shown WHERE visible"
    operator("m18_update_throttle", walk)(lambda t: commands.greedy_filter(t.sql(ms), ["robot_id"], "seq", lambda p, q: p[1] - q[1] >= 200, ["ms"]))
