"""Queries of drawing sessions, tiles on their way, parameters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera, drawing
from ..sources import parameters
from ..sources.fixtures import duckdb_sql
from ..streaming import clock, follow
from ..streaming.tables import drained, landed, streamed
from .spec import ORACLE, QUERIES, operator

# A click per event on a grid of 12 by 12 metres; some events are commands.
_CLICKS = """SELECT robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY event_id) AS seq, k, (k * 7 % 12) * 1e0 AS x, (CAST(floor(value) AS BIGINT) % 12) * 1e0 AS y,
    CASE {ops} ELSE 'point' END AS op FROM {gps_fix}"""
_CONTOUR = _CLICKS.replace("{ops}", "WHEN k = 50 THEN 'remove' WHEN k % 25 = 1 THEN 'cancel'")
_CUTOUT = _CLICKS.replace("{ops}", "WHEN k = 50 THEN 'clear' WHEN k % 20 = 1 THEN 'undo' WHEN k % 5 = 2 THEN 'finish'")


def _cross(chain: str, px: str, py: str, qx: str, qy: str, first: str, last: str) -> str:
    """Whether a side of a list of points, from number ``first`` to ``last``, crosses p-q."""
    side = lambda ax, ay, bx, by, cx, cy: f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"
    u, v = (f"{chain}[i].x", f"{chain}[i].y"), (f"{chain}[i + 1].x", f"{chain}[i + 1].y")
    a = f"sign({side(px, py, qx, qy, *u)}) * sign({side(px, py, qx, qy, *v)}) < 0"
    b = f"sign({side(*u, *v, px, py)}) * sign({side(*u, *v, qx, qy)}) < 0"
    return f"len(list_filter(range({first}, {last}), lambda i: {a} AND {b})) > 0"


_END, _FIRST = "draft[len(draft)]", "draft[1]"
_OPEN = _cross("draft", f"{_END}.x", f"{_END}.y", "c.x", "c.y", "1", "len(draft) - 1")
_CLOSING = _cross("draft", f"{_END}.x", f"{_END}.y", f"{_FIRST}.x", f"{_FIRST}.y", "2", "len(draft) - 1")
_NEAR = f"len(draft) >= 3 AND sqrt((c.x - {_FIRST}.x) * (c.x - {_FIRST}.x) + (c.y - {_FIRST}.y) * (c.y - {_FIRST}.y)) <= 1.5e0"
_SETS = f"CASE WHEN len(draft) > 0 AND {_OPEN} THEN 'refused' ELSE 'vertex' END"
_CONTOUR_DID = f"CASE WHEN op = 'cancel' THEN 'cancelled' WHEN op = 'remove' THEN 'removed' WHEN {_NEAR} THEN CASE WHEN {_CLOSING} THEN 'intersects' ELSE 'closed' END ELSE {_SETS} END"
_CUTOUT_DID = f"CASE WHEN op = 'clear' THEN 'cleared' WHEN op = 'undo' THEN CASE WHEN cutouts > 0 THEN 'undone' ELSE 'none' END WHEN op = 'finish' THEN CASE WHEN len(draft) < 3 THEN 'too_few' WHEN {_CLOSING} THEN 'intersects' ELSE 'added' END ELSE {_SETS} END"


def _walk(clicks: str, did: str, dropped: str) -> str:
    """A recursive walk along each robot's clicks; ``dropped``: outcomes that end the draft."""
    return f"""WITH RECURSIVE c AS MATERIALIZED ({clicks}), w AS (SELECT DISTINCT robot_id, CAST(0 AS BIGINT) AS seq, '' AS outcome, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS draft, 0 AS contour, 0 AS cutouts FROM c
        UNION ALL SELECT robot_id, seq, did, CASE WHEN did = 'vertex' THEN list_append(draft, {{'x': x, 'y': y}}) WHEN did IN ({dropped}) THEN [] ELSE draft END,
            CAST(CASE did WHEN 'closed' THEN len(draft) WHEN 'removed' THEN 0 ELSE contour END AS INT),
            CASE WHEN did IN ('closed', 'removed', 'cleared') THEN 0 WHEN did = 'added' THEN cutouts + 1 WHEN did = 'undone' THEN cutouts - 1 ELSE cutouts END
        FROM (SELECT w.robot_id, c.seq, c.x, c.y, draft, contour, cutouts, {did} AS did FROM w JOIN c ON c.robot_id = w.robot_id AND c.seq = w.seq + 1) z)
        SELECT robot_id, seq, outcome, len(draft) AS drafted, contour, cutouts FROM w WHERE seq > 0"""


_TILE_STEPS = "SELECT robot_id, event_id AS seq, CAST(floor(event_id / 6e0) AS BIGINT) % 3 = 0 AS reply, zoom, x, y FROM {tiles}"
_VIEWED = f"""SELECT s.*, v.zoom AS vz, v.x AS vx, v.y AS vy FROM ({_TILE_STEPS}) s LEFT JOIN (SELECT r.robot_id, r.seq, max(q.seq) AS at FROM ({_TILE_STEPS}) r JOIN ({_TILE_STEPS}) q ON r.robot_id = q.robot_id AND q.seq < r.seq AND NOT q.reply WHERE r.reply GROUP BY r.robot_id, r.seq) b ON b.robot_id = s.robot_id AND b.seq = s.seq
    LEFT JOIN ({_TILE_STEPS}) v ON v.robot_id = b.robot_id AND v.seq = b.at"""
_TILES = f"""SELECT robot_id, zoom, x, y, CASE WHEN max(got) = 1 THEN 'finished' ELSE 'requested' END AS state FROM (
    SELECT robot_id, zoom, x + dx AS x, y + dy AS y, 0 AS got FROM ({_TILE_STEPS}) s CROSS JOIN (SELECT {{explode:-1,1}} AS dx) a CROSS JOIN (SELECT {{explode:-1,1}} AS dy) b WHERE NOT reply
    UNION ALL SELECT robot_id, zoom, x, y, 1 FROM ({_VIEWED}) z WHERE reply AND vz = zoom AND abs(vx - x) <= 1 AND abs(vy - y) <= 1) q WHERE x >= 0 AND y >= 0 AND x < pow(2e0, zoom) AND y < pow(2e0, zoom) GROUP BY robot_id, zoom, x, y"""
_NAMES = list(parameters.defaults())
_OVERRIDES = f"SELECT robot_id, event_id AS seq, CASE event_id % {len(_NAMES) + 1} {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(_NAMES))} ELSE 'unknown' END AS name, CASE WHEN k % 10 <> 0 THEN k / 25e0 - 1e0 END AS value FROM {{gps_fix}}"


def _parameters() -> str:
    known, least, most = parameters.defaults(), parameters.BOUNDS, "NULL"
    rows = ", ".join(f"('{n}', {d!r}e0, {repr(least[n][0]) + 'e0' if n in least else 'NULL'}, {repr(least[n][1]) + 'e0' if n in least and least[n][1] is not None else most})" for n, d in known.items())
    read = f"""SELECT r.robot_id, d.name, CASE WHEN d.name IN ({', '.join(f"'{n}'" for n in parameters.DIRECTIONS)}) THEN CASE WHEN coalesce(o.value, d.value) >= 0 THEN 1e0 ELSE -1e0 END ELSE least(greatest(coalesce(o.value, d.value), lo), coalesce(hi, 1e300)) END AS value
        FROM (SELECT DISTINCT robot_id FROM ({_OVERRIDES}) a) r CROSS JOIN (VALUES {rows}) d (name, value, lo, hi)
        LEFT JOIN (SELECT robot_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY robot_id, name ORDER BY seq DESC) AS rn FROM ({_OVERRIDES}) b WHERE value IS NOT NULL) c WHERE rn = 1) o ON o.robot_id = r.robot_id AND o.name = d.name"""
    return f"WITH p AS ({read}) SELECT p.robot_id, p.name, CASE WHEN p.name = 'settle_timeout_s' THEN greatest(p.value, s.value) ELSE p.value END AS value FROM p JOIN p s ON p.robot_id = s.robot_id AND s.name = 'settle_min_s'"


#: Camera actions of each robot's session, from its fixes.
_ACTIONS = """SELECT robot_id, seq, kind, CASE kind WHEN 'scale_by' THEN 0.75e0 + (k % 8) * pi() / 31e0 WHEN 'scale_to' THEN 0.5e0 + (k % 7) * pi() / 13e0 ELSE k * 3e0 - 150e0 END AS p, (k * 7 % 100) - 50e0 AS q FROM (
    SELECT robot_id, k, row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) AS seq,
        CASE event_id % 11 WHEN 0 THEN 'scale_to' WHEN 1 THEN 'rotate_to' WHEN 2 THEN 'move_to' WHEN 3 THEN 'rotate_by' WHEN 4 THEN 'rotate_by' WHEN 5 THEN 'scale_by' WHEN 6 THEN 'scale_by' ELSE 'drag' END AS kind FROM {gps_fix}) e"""


def register() -> None:
    contour = _walk(_CONTOUR, _CONTOUR_DID, "'cancelled', 'removed', 'closed', 'intersects'")
    cutout = _walk(_CUTOUT, _CUTOUT_DID, "'cleared', 'undone', 'none', 'added'")
    operator("s11_contour_lifecycle", contour)(lambda t: drawing.sessions(t.sql(_CONTOUR), "contour"))
    operator("s12_cutout_lifecycle", cutout)(lambda t: drawing.sessions(t.sql(_CUTOUT), "cutout"))
    operator("p14_contour_mode", f"SELECT robot_id, max(contour) AS most, count(CASE WHEN outcome = 'closed' THEN 1 END) AS contours FROM ({contour}) q GROUP BY robot_id")(
        lambda t: drawing.sessions(t.sql(_CONTOUR), "contour").groupBy("robot_id").agg(F.max("contour").alias("most"), F.count_if(F.col("outcome") == "closed").alias("contours"))
    )
    # Layers from what feeds them, in drawing order: contours, holes, open drafts of cutouts, routes, robots.
    last = "SELECT robot_id, drafted, row_number() OVER (PARTITION BY robot_id ORDER BY seq DESC) AS rn FROM"
    rows = "SELECT 0 AS z, 'main' AS layer, count(DISTINCT f) AS items FROM {field_vertices} UNION ALL SELECT 1, 'cutout', count(DISTINCT f) FROM {cutout_vertices} UNION ALL SELECT 2, 'draft', count(*) FROM drafts UNION ALL SELECT 3, 'route', count(DISTINCT mission_id) FROM {waypoints} UNION ALL SELECT 4, 'robot', count(DISTINCT robot_id) FROM {gps_fix} WHERE status >= 0"
    operator("p18_layers", f"WITH drafts AS MATERIALIZED (SELECT * FROM ({last} ({cutout}) s) q WHERE rn = 1 AND drafted > 0) {rows}")(lambda t: drawing.layers(t["field_vertices"], t["cutout_vertices"], drawing.sessions(t.sql(_CUTOUT), "cutout"), t["waypoints"], t["gps_fix"]))
    walk = f"""WITH RECURSIVE a AS MATERIALIZED ({_ACTIONS}), w AS (SELECT DISTINCT robot_id, CAST(0 AS BIGINT) AS seq, 1e0 AS scale, 0e0 AS azimuth, 0e0 AS x, 0e0 AS y FROM a
        UNION ALL SELECT w.robot_id, a.seq, CASE kind WHEN 'scale_by' THEN scale * p WHEN 'scale_to' THEN p ELSE scale END, CASE kind WHEN 'rotate_by' THEN azimuth + p WHEN 'rotate_to' THEN p ELSE azimuth END,
            CASE kind WHEN 'move_to' THEN p WHEN 'drag' THEN x - (p * cos(radians(azimuth)) - q * sin(radians(azimuth))) / scale ELSE x END, CASE kind WHEN 'move_to' THEN q WHEN 'drag' THEN y - (p * sin(radians(azimuth)) + q * cos(radians(azimuth))) / scale ELSE y END
        FROM w JOIN a ON a.robot_id = w.robot_id AND a.seq = w.seq + 1) SELECT * FROM w WHERE seq > 0"""
    operator("n6_camera_chain", walk, {"scale": 5, "azimuth": 4, "x": 3, "y": 3})(lambda t: camera.states(t.sql(_ACTIONS)))
    operator("o3_tile_state", _TILES)(lambda t: drawing.tile_states(t.sql(_TILE_STEPS)))
    operator("a10_parameters", _parameters(), {"value": 6})(lambda t: parameters.parameters(t.sql(_OVERRIDES)))
    _streams()


def _streams() -> None:
    def stream(name: str, view: str, columns: list[str]) -> None:
        QUERIES[name] = lambda spark, sf_dir: landed(streamed(spark, sf_dir)[view].selectExpr(*columns))
        ORACLE[name] = f"SELECT {', '.join(columns)} FROM {duckdb_sql('{' + view + '}')}"

    stream("a8_gps_stream", "gps_fix", ["event_id", "robot_id", "status", "round(lat, 9) AS lat", "round(lon, 9) AS lon"])
    stream("a9_imu_stream", "imu", ["event_id", "robot_id", "round(qz, 8) + 0e0 AS qz", "round(qw, 8) + 0e0 AS qw", "cov0", "round(wz, 8) + 0e0 AS wz"])
    mark = ["'robot' AS ns", "robot_id AS id", "CASE WHEN status < 0 THEN 'DELETE' ELSE 'ADD' END AS action", "event_id", "round(lat, 9) AS lat", "round(lon, 9) AS lon"]

    def sink(spark, sf_dir):
        path = drained(streamed(spark, sf_dir)["gps_fix"].selectExpr(*mark), lambda df, n, path: follow.markers_upsert(df, n, path, "event_id"))
        return follow.markers(spark, path).select("ns", "id", "event_id", "lat", "lon")

    QUERIES["b6_marker_sink"] = sink
    ORACLE["b6_marker_sink"] = f"SELECT ns, id, event_id, lat, lon FROM (SELECT {", ".join(mark)}, row_number() OVER (PARTITION BY robot_id ORDER BY event_id DESC) AS rn FROM {duckdb_sql('{gps_fix}')} g) q WHERE rn = 1 AND action = 'ADD'"
    _clocks()


_HOUR = 3_600_000_000
_US = "epoch_us(CAST(ts AS TIMESTAMP))"
#: How far the watermark stays behind; what it has passed at the end of the given events is what the streams have given out.
_LATE, _LATE_US = "1 hour", _HOUR
_PASSED = f"""SELECT (least(max(CASE WHEN event_id % 3 = 0 THEN us END), max(us)) // 1000) * 1000 - {_LATE_US} AS mark FROM (SELECT event_id, {_US} AS us FROM {{gps_fix}}) e"""
_SENSORS = f"SELECT g.robot_id, g.event_id AS id, epoch_us(CAST(g.ts AS TIMESTAMP)) AS us, g.event_id % 3 = 0 AS is_gps, status >= 0 AS gps_ok, cov0 >= 0 AS imu_ok FROM {{gps_fix}} g JOIN {{imu}} i ON g.event_id = i.event_id"


def _clocked(spark, sf_dir: str, processor: clock.Ordered):
    """The processor over two streams: fixes of every third event, and all IMU readings."""
    gps = streamed(spark, sf_dir)["gps_fix"].selectExpr("robot_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id", "status >= 0 AS ok").where("id % 3 = 0")
    imu = streamed(spark, sf_dir)["imu"].selectExpr("robot_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id", "cov0 >= 0 AS ok")
    with clock.keyed_state(spark):
        return landed(clock.processed(clock.tagged(gps, imu, _LATE), processor))


def _clocks() -> None:
    def op(name: str, processor: clock.Ordered, text: str) -> None:
        QUERIES[name] = lambda spark, sf_dir: _clocked(spark, sf_dir, processor)
        ORACLE[name] = duckdb_sql(f"WITH passed AS ({_PASSED}), sensors AS MATERIALIZED ({_SENSORS}) {text}")

    day, period = 24 * _HOUR, 2 * _HOUR
    latest = f"""SELECT robot_id, id, imu_ok, CASE WHEN us - fix_us <= {day} THEN fix_id END AS fix_id, us FROM (SELECT *, last_value(CASE WHEN is_gps AND gps_ok THEN id END IGNORE NULLS) OVER w AS fix_id, last_value(CASE WHEN is_gps AND gps_ok THEN us END IGNORE NULLS) OVER w AS fix_us
        FROM sensors WINDOW w AS (PARTITION BY robot_id ORDER BY us, id ROWS UNBOUNDED PRECEDING)) q"""
    op("f11_stream_alignment", clock.LatestFix(day), f"SELECT robot_id, id, fix_id FROM ({latest}) z WHERE us <= (SELECT mark FROM passed)")
    # A tick belongs to the last reading before it or at its time; the last ones are at most a period later than the longest limit.
    grid = """SELECT r.*, t.us0 + n * {period} AS tick_us FROM (SELECT *, ((us + {period} - 1) // {period}) * {period} AS us0 FROM ({rows}) a) t JOIN (SELECT * FROM ({rows}) b) r ON r.robot_id = t.robot_id AND r.id = t.id
        JOIN (SELECT {{explode:0,400}} AS n) k ON t.us0 + n * {period} < coalesce(r.next_us, 9223372036854775807) AND t.us0 + (n - 1) * {period} - r.us <= {silence} WHERE t.us0 + n * {period} <= (SELECT mark FROM passed)"""
    readings = """SELECT *, lead(us) OVER w AS next_us, last_value(CASE WHEN is_gps THEN us END IGNORE NULLS) OVER v AS gps_us, last_value(CASE WHEN is_gps THEN gps_ok END IGNORE NULLS) OVER v AS gps_good
        FROM sensors WINDOW w AS (PARTITION BY robot_id ORDER BY us, id), v AS (PARTITION BY robot_id ORDER BY us, id ROWS UNBOUNDED PRECEDING)"""
    have = f"SELECT robot_id, tick_us, coalesce(gps_good AND tick_us - gps_us <= {day}, false) AS have_gps, imu_ok AND tick_us - us <= {day // 2} AS have_imu FROM ({grid.format(period=period, rows=readings, silence=day)}) g"
    op("m4_clock_ticks", clock.Clock(period, day, day // 2), f"SELECT *, CASE WHEN have_gps AND have_imu THEN 'live' ELSE 'stop' END AS state, CASE WHEN have_gps AND have_imu THEN '' WHEN have_imu THEN 'gps' WHEN have_gps THEN 'imu' ELSE 'gps, imu' END AS missing FROM ({have}) h")
    fixes = "SELECT *, lead(us) OVER (PARTITION BY robot_id ORDER BY us, id) AS next_us FROM sensors WHERE is_gps AND gps_ok"
    op("m14_marker_refresh", clock.Refresh(_HOUR, 6 * _HOUR), f"SELECT robot_id, tick_us, id AS fix_id FROM ({grid.format(period=_HOUR, rows=fixes, silence=6 * _HOUR)}) g")
    step = 6 * _HOUR
    every = f"SELECT robot_id, us FROM sensors UNION ALL SELECT robot_id, us FROM sensors WHERE is_gps"
    polls = f"""SELECT f.robot_id, first, tick_us, count(e.us) AS n FROM (SELECT robot_id, first, ((first + {step} - 1) // {step} + k) * {step} AS tick_us FROM (SELECT robot_id, min(us) AS first FROM sensors GROUP BY robot_id) a CROSS JOIN (SELECT {{explode:0,20}} AS k) b) f
        JOIN ({every}) e ON e.robot_id = f.robot_id AND e.us <= tick_us GROUP BY f.robot_id, first, tick_us"""
    runs = f"SELECT *, CASE WHEN n = lag(n, 1) OVER w AND n = lag(n, 2) OVER w THEN 'ready' WHEN tick_us - first >= {3 * day} THEN 'late' ELSE 'waiting' END AS state FROM ({polls}) p WINDOW w AS (PARTITION BY robot_id ORDER BY tick_us)"
    op("m16_readiness_polls", clock.Readiness(step, 2, 3 * day), f"SELECT robot_id, tick_us, n, state FROM (SELECT *, count(CASE WHEN state <> 'waiting' THEN 1 END) OVER (PARTITION BY robot_id ORDER BY tick_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM ({runs}) r) q WHERE over = 0 AND tick_us <= (SELECT mark FROM passed)")
