"""Queries of tracks, missions, commands, markers and tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import angles, geo, palette
from ..operators import commands
from ..operators import tree as trees
from ..sources.fixtures import Tables
from .spec import operator, projection, statement

_HAV = geo.haversine("lat0", "lon0", "lat", "lon")
_AZ = geo.hop_bearing("lat0", "lon0", "lat", "lon")
_HOPS = "SELECT robot_id, seq, lat, lon, lag(lat) OVER (PARTITION BY robot_id ORDER BY seq) AS lat0, lag(lon) OVER (PARTITION BY robot_id ORDER BY seq) AS lon0 FROM {track}"
_KEPT = f"SELECT *, lag(azimuth, 1, 0e0) OVER (PARTITION BY robot_id ORDER BY seq) AS before FROM (SELECT robot_id, seq, {_HAV} AS distance_m, {_AZ} AS azimuth FROM ({_HOPS}) h WHERE lat0 IS NOT NULL) k WHERE distance_m >= 0.2e0"
_TURNED = f"SELECT robot_id, seq, distance_m, {angles.wrap_degrees('(azimuth - before)')} AS delta FROM ({_KEPT}) t"
_COMMANDS = f"""
    SELECT robot_id, seq, 0 AS part, 'rotate' AS cmd, delta AS value FROM ({_TURNED}) a WHERE NOT (abs(delta) > 150e0 AND distance_m < 2e0) AND abs(delta) > 1e-3
    UNION ALL SELECT robot_id, seq, 1 AS part, 'move' AS cmd, distance_m AS value FROM ({_TURNED}) b"""
_NEXT = "SELECT *, lead(x) OVER (PARTITION BY mission_id ORDER BY i) AS nx, lead(y) OVER (PARTITION BY mission_id ORDER BY i) AS ny, lead(reach_radius_m) OVER (PARTITION BY mission_id ORDER BY i) AS nr FROM {waypoint_xy}"
_LEN = angles.hypot("nx - x", "ny - y")


def register() -> None:
    # -- routes and commands ---------------------------------------------------------------------------------------
    operator("h7_route_commands", _COMMANDS, {"value": 4})(lambda t: commands.route_commands(t["track"]))
    item = """concat('{"cmd":"', cmd, '","data":{"', CASE cmd WHEN 'rotate' THEN 'delta_angle' ELSE 'distance_m' END, '":', CAST(round(value, 4) AS VARCHAR), '}}')"""
    operator("b1_command_documents", f"SELECT robot_id, count(*) AS n, md5(concat('[', string_agg({item}, ',' ORDER BY seq, part), ']')) AS document FROM ({_COMMANDS}) c GROUP BY robot_id")(lambda t: commands.command_documents(commands.route_commands(t["track"])).select("robot_id", "n", F.md5("commands").alias("document")))
    operator("b26_command_panel", f"SELECT robot_id, concat('[', string_agg({item}, ',' ORDER BY seq, part), ']') AS commands, count(*) AS n FROM ({_COMMANDS}) c GROUP BY robot_id")(lambda t: commands.command_documents(commands.route_commands(t["track"])))
    statement("h5_adjacent_pairs", f"SELECT robot_id, seq, {_HAV} AS metres FROM ({_HOPS}) h WHERE lat0 IS NOT NULL", {"metres": 4})
    statement("k22_robot_prepend", "SELECT robot_id, seq + 1 AS pos, lat, lon FROM {track} UNION ALL SELECT mission_id AS robot_id, 1 AS pos, origin_lat AS lat, origin_lon AS lon FROM {missions}", {"lat": 9, "lon": 9})
    route = "SELECT robot_id, seq, lat, lon FROM {track} UNION ALL SELECT mission_id, 0, origin_lat, origin_lon FROM {missions}"
    operator(
        "k21_manual_route",
        f"SELECT robot_id, 1 + count(*) OVER v AS pos, lat, lon, coalesce(sum({_HAV}) OVER w, 0e0) AS metres FROM (SELECT *, lag(lat) OVER (PARTITION BY robot_id ORDER BY seq) AS lat0, lag(lon) OVER (PARTITION BY robot_id ORDER BY seq) AS lon0 FROM ({route}) r) q WINDOW v AS (PARTITION BY robot_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY robot_id ORDER BY seq ROWS UNBOUNDED PRECEDING)",
        {"lat": 9, "lon": 9, "metres": 2},
    )(lambda t: commands.manual_route(t["track"], t["missions"].selectExpr("mission_id AS robot_id", "origin_lat AS lat", "origin_lon AS lon")))
    statement(
        "b2_simulator_points",
        f"SELECT robot_id, seq, d * cos(radians(b)) AS north, -d * sin(radians(b)) AS minus_east FROM (SELECT t.robot_id, seq, {geo.haversine('origin_lat', 'origin_lon', 'lat', 'lon')} AS d, {geo.compass_bearing('origin_lat', 'origin_lon', 'lat', 'lon')} AS b, count(*) OVER (PARTITION BY t.robot_id) AS n FROM {{track}} t JOIN {{missions}} m ON t.robot_id = m.mission_id) q WHERE seq < n",
        {"north": 3, "minus_east": 3},
    )
    operator(
        "b3_waypoint_documents",
        "SELECT mission_id, count(*) AS n, min(i) AS first, max(i) AS last FROM {waypoints} GROUP BY mission_id",
    )(lambda t: _documents(t).select("mission_id", F.size("d.waypoints").cast("bigint").alias("n"), F.expr("int(d.waypoints[0].id) - 1").alias("first"), F.expr("int(element_at(d.waypoints, -1).id) - 1").alias("last")))
    # -- missions and waypoints ------------------------------------------------------------------------------------
    statement("a4_waypoints", "SELECT mission_id, i, wid, greatest(0.05e0, reach_radius_m) AS reach_radius_m, x, y FROM {waypoint_xy}", {"x": 4, "y": 4, "reach_radius_m": 3})
    statement("a5_lat_lon_aliases", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN lat END, CASE WHEN event_id % 3 = 1 THEN lat END) AS latitude, coalesce(CASE WHEN event_id % 4 = 0 THEN lon END, CASE WHEN event_id % 4 = 1 THEN lon END, CASE WHEN event_id % 4 = 2 THEN lon END) AS longitude FROM {gps_fix}", {"latitude": 9, "longitude": 9})
    statement("a6_mission_frames", "SELECT m.mission_id, coalesce(CASE WHEN m.mission_id % 3 > 0 THEN origin_lat END, lat) AS lat0, coalesce(CASE WHEN m.mission_id % 3 > 0 THEN origin_lon END, lon) AS lon0, yaw FROM {missions} m LEFT JOIN {waypoints} w ON m.mission_id = w.mission_id AND w.i = 0", {"lat0": 9, "lon0": 9, "yaw": 8})
    statement("f12_target_lookup", f"SELECT g.event_id, w.wid, {geo.haversine('g.lat', 'g.lon', 'w.lat', 'w.lon')} AS metres FROM {{gps_fix}} g JOIN {{waypoints}} w ON g.robot_id = w.mission_id AND w.i = g.k % 3", {"metres": 3})
    statement("i8_first_waypoint", "SELECT mission_id, wid, lat, lon FROM {waypoints} WHERE i = 0", {"lat": 9, "lon": 9})
    statement("p16_visual_waypoints", "SELECT mission_id, i, wid AS name, x, y, reach_radius_m AS radius FROM {waypoint_xy}", {"x": 4, "y": 4, "radius": 3})
    # -- markers ---------------------------------------------------------------------------------------------------
    state = "CASE WHEN i < mission_id % 5 THEN 'visited' WHEN i = mission_id % 5 THEN 'current' ELSE 'future' END"
    projection("b7_point_markers", "waypoint_xy", {"mission_id": "mission_id", "id": "i", "x": ("x", 4), "y": ("y", 4), "scale": "CASE WHEN i = mission_id % 5 THEN 0.48e0 ELSE 0.35e0 END", "state": state, "red": (palette.channel("i", 0), 4)})
    projection("b8_radius_markers", "waypoint_xy", {"mission_id": "mission_id", "id": "1000 + i", "diameter": ("2e0 * reach_radius_m", 4)})
    projection("b9_label_markers", "waypoint_xy", {"mission_id": "mission_id", "id": "2000 + i", "text": "concat(CAST(i + 1 AS STRING), ': ', wid)"})
    count = f"(CAST(floor(greatest(0.05e0, {_LEN} - 0.28e0) / 0.45e0) AS INT) + 1)"
    arrows = f"SELECT mission_id, i, x, y, nx, ny, {_LEN} AS len, greatest(1, {count}) AS n FROM ({_NEXT}) s WHERE nx IS NOT NULL AND {_LEN} >= 1e-4"
    operator(
        "b11_route_arrows",
        f"SELECT mission_id, i, k, x + (nx - x) * (k + 0.5e0) / n - 0.16e0 * (nx - x) / len AS tail_x, y + (ny - y) * (k + 0.5e0) / n - 0.16e0 * (ny - y) / len AS tail_y, sin(atan2(ny - y, nx - x) / 2e0) AS qz FROM (SELECT *, CAST(unnest(generate_series(0, n - 1)) AS INT) AS k FROM ({arrows}) a) b",
        {"tail_x": 3, "tail_y": 3, "qz": 6},
    )(lambda t: t.sql(arrows).withColumn("k", F.explode(F.expr("sequence(0, n - 1)"))).selectExpr("mission_id", "i", "k", "x + (nx - x) * (k + 0.5e0) / n - 0.16e0 * (nx - x) / len AS tail_x", "y + (ny - y) * (k + 0.5e0) / n - 0.16e0 * (ny - y) / len AS tail_y", "sin(atan2(ny - y, nx - x) / 2e0) AS qz"))
    # Two publishes of a mission, the second without its last waypoint: arrows are numbered anew from 3000 on, so the last ones are stale, and two fixed markers are always deleted.
    route, shorter = "'waypoints_route_arrow'", f"SELECT a.* FROM ({arrows}) a JOIN (SELECT mission_id, max(i) AS last FROM {{waypoints}} GROUP BY mission_id) m ON a.mission_id = m.mission_id AND a.i < m.last - 1"
    sizes = f"SELECT o.mission_id, o.n AS before, coalesce(w.n, 0) AS after FROM (SELECT mission_id, sum(n) AS n FROM ({arrows}) x GROUP BY mission_id) o LEFT JOIN (SELECT mission_id, sum(n) AS n FROM ({shorter}) y GROUP BY mission_id) w ON o.mission_id = w.mission_id"

    def published(t: Tables, text: str):
        every = t.sql(text).withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
        return every.select("mission_id", F.lit("waypoints_route_arrow").alias("ns"), (F.row_number().over(Window.partitionBy("mission_id").orderBy("i", "k")) + 2999).alias("id"))

    operator(
        "b10_stale_markers",
        f"""SELECT mission_id, {route} AS ns, CAST(unnest(generate_series(CAST(3000 + after AS BIGINT), CAST(2999 + before AS BIGINT))) AS INT) AS id, 'DELETE' AS action FROM ({sizes}) s
            UNION ALL SELECT mission_id, 'waypoints_route_line', 4000, 'DELETE' FROM {{missions}} UNION ALL SELECT mission_id, 'robot_target_line', 4001, 'DELETE' FROM {{missions}}""",
    )(lambda t: commands.stale_markers(published(t, arrows), published(t, shorter), t["missions"].select("mission_id")))
    statement("b12_trajectory", "SELECT robot_id, CASE WHEN count(*) >= 2 THEN 'ADD' ELSE 'DELETE' END AS action, count(*) AS points FROM {track} GROUP BY robot_id")
    projection("b13_robot_markers", "imu", {"event_id": "event_id", "arrow": "5000", "label": "5001", "qz": ("sin(yaw / 2e0)", 8), "qw": ("cos(yaw / 2e0)", 8)})
    projection("b15_waypoint_models", "waypoint_xy", {"mission_id": "mission_id", "name": "wid", "pose_x": ("x", 4), "pose_y": ("y", 4), "sphere": "0.18e0", "disc": ("reach_radius_m", 3), "rgba": palette.rgba_text("i", "1.0")})
    statement("b16_route_segments", f"SELECT mission_id, i, (x + nx) / 2e0 AS mx, (y + ny) / 2e0 AS my, greatest({_LEN}, 1e-6) + 0.36e0 AS length, atan2(ny - y, nx - x) AS yaw, {palette.rgba_text('(i + 1)', '1.0')} AS rgba FROM ({_NEXT}) s WHERE nx IS NOT NULL", {"mx": 3, "my": 3, "length": 3, "yaw": 6})
    projection("b17_spherical_coordinates", "missions", {"mission_id": "mission_id", "lat": ("origin_lat", 9), "lon": ("origin_lon", 9), "heading_deg": ("degrees(yaw)", 9)})
    statement("b18_segment_overlap", f"SELECT mission_id, i, {_LEN} AS chord, reach_radius_m + nr AS radii, {_LEN} < reach_radius_m + nr AS overlap FROM ({_NEXT}) s WHERE nx IS NOT NULL", {"chord": 3, "radii": 3})
    statement("b22_polyline_segments", f"SELECT mission_id, i, x, y, nx, ny, nx - 2e0 * (nx - x) / {_LEN} AS head_x, ny - 2e0 * (ny - y) / {_LEN} AS head_y FROM ({_NEXT}) s WHERE nx IS NOT NULL AND {_LEN} > 1e-6", {c: 3 for c in ("x", "y", "nx", "ny", "head_x", "head_y")})
    statement("e25_polyline_path", "SELECT mission_id, i, CASE WHEN i = 0 THEN 'move' ELSE 'line' END AS op, x, y FROM {waypoint_xy}", {"x": 4, "y": 4})
    # -- sequences -------------------------------------------------------------------------------------------------
    statement("h9_speed", f"SELECT robot_id, seq, least(2e0, d / nullif(dt, 0e0)) AS speed FROM (SELECT robot_id, seq, {_HAV} AS d, dt FROM (SELECT robot_id, seq, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, seq * 1e0 - lag(seq) OVER w AS dt FROM {{track}} WINDOW w AS (PARTITION BY robot_id ORDER BY seq)) q WHERE lat0 IS NOT NULL) r WHERE dt > 1e-6", {"speed": 5})
    statement("h12_route_prefix", "SELECT mission_id, i, count(*) OVER (PARTITION BY mission_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS points_so_far FROM {waypoints}")
    statement("h14_stable_reads", "SELECT robot_id, seq, count(*) OVER (PARTITION BY robot_id, g ORDER BY seq ROWS UNBOUNDED PRECEDING) * ok AS stable FROM (SELECT *, sum(1 - ok) OVER (PARTITION BY robot_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT robot_id, CAST(row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) AS INT) AS seq, CASE WHEN status >= 0 THEN 1 ELSE 0 END AS ok FROM {gps_fix}) a) b WHERE ok = 1")
    statement("m16_readiness", "SELECT robot_id, min(seq) AS ready_at FROM (SELECT robot_id, seq, ok + coalesce(lag(ok) OVER (PARTITION BY robot_id ORDER BY seq), 0) AS run FROM (SELECT robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) AS seq, CASE WHEN status >= 0 THEN 1 ELSE 0 END AS ok FROM {gps_fix}) a) b WHERE run = 2 GROUP BY robot_id")
    operator("h6_decimation", _greedy("{track}", "robot_id", "seq", ["lat", "lon"], "(p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon) > 4e-8"), {"lat": 9, "lon": 9})(
        lambda t: commands.greedy_filter(t["track"], ["robot_id"], "seq", lambda p, q: (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]) > 4e-8, ["lat", "lon"])
    )
    seconds = "SELECT robot_id, event_id, row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) AS seq, k * 1e0 AS v FROM {gps_fix}"
    walk = f"""WITH RECURSIVE s AS ({seconds}), w AS (SELECT robot_id, seq, v AS ema FROM s WHERE seq = 1
        UNION ALL SELECT s.robot_id, s.seq, 0.25e0 * s.v + (1e0 - 0.25e0) * w.ema FROM w JOIN s ON s.robot_id = w.robot_id AND s.seq = w.seq + 1) SELECT robot_id, seq, ema FROM w"""
    operator("h8_low_pass", walk, {"ema": 8})(lambda t: commands.ema(t.sql(seconds), ["robot_id"], "seq", "v", 0.25))
    operator("m13_log_throttle", _greedy("(SELECT robot_id, event_id, CAST(epoch(ts) AS DOUBLE) AS s FROM {gps_fix})", "robot_id", "event_id", ["s"], "p.s - q.s >= 3600e0"), {"s": 3})(
        lambda t: commands.greedy_filter(t["gps_fix"].selectExpr("robot_id", "event_id", "CAST(CAST(ts AS TIMESTAMP) AS DOUBLE) AS s"), ["robot_id"], "event_id", lambda p, q: p[1] - q[1] >= 3600, ["s"])
    )
    statement("i9_step_limit", "SELECT robot_id, seq, lat FROM {track} WHERE seq <= 5", {"lat": 9})
    statement("i10_log_cap", "SELECT robot_id, event_id FROM (SELECT robot_id, event_id, row_number() OVER (PARTITION BY robot_id ORDER BY event_id DESC) AS rn FROM {gps_fix}) q WHERE rn <= 500")
    statement("j5_row_concatenation", "SELECT robot_id AS k, seq AS i FROM {track} UNION ALL SELECT mission_id, i FROM {waypoints}")
    statement("j7_edge_set", "SELECT DISTINCT least(robot_id, k) AS a, greatest(robot_id, k) AS b FROM {gps_fix} WHERE robot_id <> k")
    # -- streams seen as batches -----------------------------------------------------------------------------------
    statement("g16_missing_sensors", "SELECT robot_id, CASE WHEN fixes = 0 THEN 'gps' WHEN yaws = 0 THEN 'imu' ELSE '' END AS missing FROM (SELECT g.robot_id, count(CASE WHEN status >= 0 THEN 1 END) AS fixes, count(CASE WHEN cov0 >= 0 THEN 1 END) AS yaws FROM {gps_fix} g JOIN {imu} i ON g.event_id = i.event_id GROUP BY g.robot_id) q")
    statement("p10_pose_flags", "SELECT g.event_id, g.status >= 0 AND i.cov0 >= 0 AS have_pose FROM {gps_fix} g JOIN {imu} i ON g.event_id = i.event_id")
    statement("m2_imu_update", f"SELECT i.event_id, {angles.normalize('(i.yaw + m.yaw)')} AS yaw, wz FROM {{imu}} i JOIN {{missions}} m ON i.robot_id = m.mission_id WHERE cov0 >= 0", {"yaw": 7, "wz": 6})
    # as-of: the latest valid fix within a limit, at every IMU reading
    asof = """SELECT event_id, robot_id, CASE WHEN age <= 86400e0 THEN fix_id END AS fix_id FROM (SELECT event_id, robot_id, fix_id, s - fix_s AS age FROM (
        SELECT *, max(CASE WHEN is_fix THEN event_id END) OVER w AS fix_id, max(CASE WHEN is_fix THEN s END) OVER w AS fix_s FROM (
        SELECT event_id, robot_id, {seconds} AS s, status >= 0 AND event_id % 3 = 0 AS is_fix FROM {gps_fix}) e WINDOW w AS (PARTITION BY robot_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)) a) b"""
    operator("f11_asof_alignment", asof.replace("{seconds}", "CAST(epoch(ts) AS DOUBLE)"))(lambda t: t.sql(asof.replace("{seconds}", "CAST(CAST(ts AS TIMESTAMP) AS DOUBLE)")))
    latch = asof.replace("86400e0", "7200e0").replace("event_id % 3 = 0", "event_id % 2 = 0")
    operator("m3_freshness", latch.replace("{seconds}", "CAST(epoch(ts) AS DOUBLE)"))(lambda t: t.sql(latch.replace("{seconds}", "CAST(CAST(ts AS TIMESTAMP) AS DOUBLE)")))
    operator("m10_course_windows", "SELECT robot_id, CAST(floor(CAST(epoch(ts) AS DOUBLE) / 3600e0) AS BIGINT) AS win, max(event_id) AS last_event, count(*) AS n FROM {imu} GROUP BY ALL")(
        lambda t: t["imu"].groupBy("robot_id", F.expr("CAST(floor(CAST(CAST(ts AS TIMESTAMP) AS DOUBLE) / 3600e0) AS BIGINT)").alias("win")).agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))
    )
    gaps = "SELECT robot_id, count(*) AS sessions FROM (SELECT robot_id, s - lag(s) OVER (PARTITION BY robot_id ORDER BY s, event_id) AS gap FROM (SELECT robot_id, event_id, {seconds} AS s FROM {imu}) e) g WHERE gap IS NULL OR gap > 1800e0 GROUP BY robot_id"
    operator("m19_debounce_sessions", gaps.replace("{seconds}", "CAST(epoch(ts) AS DOUBLE)"))(
        lambda t: t["imu"].withColumn("at", F.col("ts").cast("timestamp")).groupBy("robot_id", F.session_window("at", "1800 seconds 1 millisecond")).count().groupBy("robot_id").agg(F.count("*").alias("sessions"))
    )
    # -- tiles -----------------------------------------------------------------------------------------------------
    statement("f16_tile_coverage", "SELECT p.event_id AS parent, count(DISTINCT CAST(c.x AS BIGINT) * 1000000 + c.y) AS children FROM {tiles} p JOIN {tiles} c ON p.robot_id = c.robot_id AND c.zoom = p.zoom + 1 AND CAST(floor(c.x / 2e0) AS INT) = p.x AND CAST(floor(c.y / 2e0) AS INT) = p.y GROUP BY p.event_id")
    around = "SELECT event_id, zoom, x + dx AS x, y + dy AS y FROM {tiles} CROSS JOIN (SELECT {explode:-1,1} AS dx) a CROSS JOIN (SELECT {explode:-1,1} AS dy) b"
    statement("o1_visible_tiles", f"SELECT event_id, zoom, x, y FROM ({around}) v WHERE x >= 0 AND y >= 0 AND x < pow(2e0, zoom) AND y < pow(2e0, zoom)")
    statement("j9_missing_tiles", f"SELECT DISTINCT v.zoom, v.x, v.y FROM ({around}) v LEFT JOIN (SELECT DISTINCT zoom, x, y FROM {{tiles}}) h ON v.zoom = h.zoom AND v.x = h.x AND v.y = h.y WHERE h.zoom IS NULL")
    center_out = f"SELECT event_id, x, y, row_number() OVER (PARTITION BY event_id ORDER BY abs(dx) + abs(dy), x, y) AS pos FROM (SELECT v.event_id, v.x, v.y, v.x - t.x AS dx, v.y - t.y AS dy FROM ({around}) v JOIN {{tiles}} t ON v.event_id = t.event_id) q"
    operator("i7_center_out", center_out)(_center_out)
    statement("o2_evicted_tiles", "SELECT a.event_id, bool_or(d.event_id IS NOT NULL) AS covered, bool_or(abs(a.zoom - 14) > 4) AS far FROM {tiles} a LEFT JOIN {tiles} d ON a.robot_id = d.robot_id AND d.zoom = a.zoom - 1 AND CAST(floor(a.x / 2e0) AS INT) = d.x AND CAST(floor(a.y / 2e0) AS INT) = d.y GROUP BY a.event_id")
    # -- text ------------------------------------------------------------------------------------------------------
    model = "CASE WHEN line LIKE '- %' THEN trim(substring(line, 3)) ELSE trim(line) END"
    names = f"SELECT doc_id, pos, {model} AS name FROM {{text_lines}} WHERE length(trim(line)) BETWEEN 1 AND 60 AND line NOT LIKE '[%' AND line NOT LIKE 'WARNING%' AND line NOT LIKE 'ERROR%'"
    statement("a18_model_lines", names)
    statement("j8_ordered_distinct", f"SELECT doc_id, name, min(pos) AS pos FROM ({names}) n GROUP BY doc_id, name")
    # -- item tree -------------------------------------------------------------------------------------------------
    tree = """WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS depth, robot_id AS id, robot_id AS root, 1e0 AS opacity FROM (SELECT DISTINCT user_id AS robot_id FROM {events} WHERE user_id < 4) r
        UNION ALL SELECT depth + 1, c.id, root, opacity * (0.9e0 - (c.id % 5) / 50e0) FROM t JOIN (SELECT DISTINCT user_id AS id, CAST(floor(user_id / 4e0) AS BIGINT) AS parent FROM {events} WHERE user_id >= 4) c ON c.parent = t.id) SELECT id, root, depth, opacity FROM t"""
    items = "SELECT id, CASE WHEN id >= 4 THEN CAST(floor(id / 4e0) AS BIGINT) END AS parent, CASE WHEN id < 4 THEN 1e0 ELSE 0.9e0 - (id % 5) / 50e0 END AS own FROM (SELECT DISTINCT user_id AS id FROM {events}) u"
    operator("c26_effective_opacity", tree, {"opacity": 8})(lambda t: trees.effective(t.sql(items)))
    statement("o5_item_tree", "SELECT p.id AS parent, count(c.id) AS children FROM (SELECT DISTINCT user_id AS id FROM {events}) p LEFT JOIN (SELECT DISTINCT user_id AS id, CAST(floor(user_id / 4e0) AS BIGINT) AS parent FROM {events}) c ON c.parent = p.id GROUP BY p.id")


def _greedy(source: str, key: str, order: str, columns: list[str], keep: str) -> str:
    """DuckDB's form of ``greedy_filter``: a recursive walk along each key's rows."""
    cols = ", ".join(columns)
    kept = lambda a: ", ".join(f"CASE WHEN {keep} THEN p.{c} ELSE q.{c} END AS {c}" for c in columns)
    return f"""WITH RECURSIVE s AS (SELECT {key}, {order}, {cols}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source} z),
        w AS (SELECT {key}, {order}, rn, true AS is_kept, {cols} FROM s WHERE rn = 1
        UNION ALL SELECT p.{key}, p.{order}, p.rn, {keep} AS is_kept, {kept(0)} FROM w q JOIN s p ON p.{key} = q.{key} AND p.rn = q.rn + 1)
        SELECT {key}, {order}, {cols} FROM w WHERE is_kept"""


def _center_out(t):
    """The nine tiles around each event's own, from the inside out: they are made and sorted inside one row per event, so a task sorts its events and no tiles."""
    moved = "named_struct('off', abs(v.x + s.dx - o.x) + abs(v.y + s.dy - o.y), 'x', v.x + s.dx, 'y', v.y + s.dy)"
    steps = "array(" + ", ".join(f"named_struct('dx', {dx}, 'dy', {dy})" for dx in (-1, 0, 1) for dy in (-1, 0, 1)) + ")"
    own = t["tiles"].where("event_id IS NOT NULL").groupBy("event_id").agg(F.collect_list(F.struct("x", "y")).alias("own"))
    sorted_ = F.expr(f"array_sort(flatten(flatten(transform(own, v -> transform(own, o -> transform({steps}, s -> {moved}))))))")
    return own.select("event_id", F.posexplode(sorted_).alias("pos", "v")).select("event_id", "v.x", "v.y", (F.col("pos") + 1).alias("pos"))


def _documents(t):
    """One mission document per mission: origin, default radius and waypoints in order."""
    point = F.struct("i", F.struct((F.col("i") + 1).cast("string").alias("id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("w"))
    ways = t["waypoints"].groupBy("mission_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["w"]).alias("waypoints"))
    origin = F.struct(F.col("origin_lat").alias("latitude"), F.col("origin_lon").alias("longitude"), "yaw")
    return ways.join(t["missions"], "mission_id").select("mission_id", F.struct(origin.alias("origin"), F.lit(0.9).alias("default_reach_radius_m"), "waypoints").alias("d"))
