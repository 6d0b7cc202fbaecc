"""Views over the given tables: telemetry, tracks, missions, fields, jobs and points.

Each view is one SQL text that Spark and DuckDB both run; ``{events}`` and the
like stand for tables or other views. Spark gets them as DataFrames, so Catalyst
sees one plan down to the Parquet scan; the text for DuckDB nests them.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "embeddings")



def _edges(vertices: str) -> str:
    """Sides of rings of a view, or a query in brackets: one row per side, to the next vertex of the ring or back to its first."""
    source = vertices if vertices.startswith("(") else f"{{{vertices}}}"
    return f"""
        SELECT f, ring, i, n, x AS x1, y AS y1, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len
        FROM (SELECT *, coalesce(lead(x) OVER (PARTITION BY f, ring ORDER BY i), first_value(x) OVER (PARTITION BY f, ring ORDER BY i)) AS x2,
            coalesce(lead(y) OVER (PARTITION BY f, ring ORDER BY i), first_value(y) OVER (PARTITION BY f, ring ORDER BY i)) AS y2 FROM {source} w) v"""


VIEWS = {
    # One reading per event: position within 0.001 degrees of (55, 37); no fix at errors.
    "gps_fix": """
        SELECT event_id, user_id AS robot_id, ts, k, value,
            CASE WHEN event_type = 'error' THEN -1 ELSE 0 END AS status,
            55e0 + (CAST(floor(value * 100e0) AS BIGINT) % 2001 - 1000) * 1e-6 AS lat,
            37e0 + (k - 50) * 1e-5 AS lon
        FROM (SELECT *, CAST({json:props,k} AS INT) AS k FROM {events})""",
    "imu": """
        SELECT event_id, robot_id, ts, yaw, 0e0 AS qx, 0e0 AS qy, sin(yaw / 2e0) AS qz, cos(yaw / 2e0) AS qw, cov0, wz
        FROM (SELECT event_id, user_id AS robot_id, ts, (CAST({json:props,k} AS INT) - 50) * pi() / 50e0 AS yaw,
            CASE WHEN event_type = 'signup' THEN -1e0 ELSE 0e0 END AS cov0, value / 1000e0 AS wz FROM {events})""",
    "track": """
        SELECT robot_id, CAST(row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) AS INT) AS seq, ts, lat, lon
        FROM {gps_fix} WHERE status >= 0""",
    # Planned waypoints: a mission per robot, the track decimated to every third fix.
    "missions": """
        SELECT robot_id AS mission_id, 55e0 + (robot_id % 25) * 1e-3 AS origin_lat, 37e0 AS origin_lon, (robot_id % 50) * pi() / 25e0 AS yaw
        FROM (SELECT DISTINCT user_id AS robot_id FROM {events})""",
    "waypoints": """
        SELECT robot_id AS mission_id, CAST(floor((seq - 1) / 3e0) AS INT) AS i, concat('wp_', CAST(CAST(floor((seq - 1) / 3e0) AS INT) + 1 AS STRING)) AS wid,
            lat, lon, 0.5e0 + (seq % 10) / 10e0 AS reach_radius_m
        FROM {track} WHERE seq % 3 = 1""",
    "waypoint_xy": """
        SELECT w.mission_id, i, wid, reach_radius_m,
            radians(lon - origin_lon) * cos(radians(origin_lat)) * 6371000e0 AS x, radians(lat - origin_lat) * 6371000e0 AS y
        FROM {waypoints} w JOIN {missions} m ON w.mission_id = m.mission_id""",
    # A star-shaped simple contour per supplier, counter-clockwise, of 5 to 8 vertices.
    "field_vertices": """
        SELECT f, i, n, (40 + ((7 * f + 13 * i) % 11) * 3) * cos(2e0 * pi() * i / n) AS x, (40 + ((7 * f + 13 * i) % 11) * 3) * sin(2e0 * pi() * i / n) AS y
        FROM (SELECT s_suppkey AS f, 5 + s_suppkey % 4 AS n FROM {supplier}) s
        JOIN (SELECT {explode:0,7} AS i) t ON i < n""",
    # A square hole in every third field, inside its contour.
    "cutout_vertices": """
        SELECT f, i, 4 AS n, CASE WHEN i IN (0, 3) THEN -h ELSE h END AS x, CASE WHEN i IN (0, 1) THEN h ELSE -h END AS y
        FROM (SELECT s_suppkey AS f, 6e0 + s_suppkey % 5 AS h FROM {supplier} WHERE s_suppkey % 3 = 0) s CROSS JOIN (SELECT {explode:0,3} AS i) t""",
    "region_vertices": """
        SELECT f, 0 AS ring, i, n, x, y FROM {field_vertices} UNION ALL SELECT f, 1 AS ring, i, n, x, y FROM {cutout_vertices}""",
    # The edge table: one row per side, to the next vertex of the ring or back to its first.
    "edges": _edges("region_vertices"),
    # Rectangles that meet the contours: a hole inside, a road across, or a bite at the first vertex.
    "patches": """
        SELECT f, CASE f % 3 WHEN 0 THEN 'hole' WHEN 1 THEN 'road' ELSE 'bite' END AS kind,
            CASE f % 3 WHEN 0 THEN -6e0 - f % 5 WHEN 1 THEN -90e0 ELSE 32e0 + (7 * f % 11) * 3 END AS px1, CASE f % 3 WHEN 0 THEN -6e0 - f % 5 WHEN 1 THEN -3e0 - f % 4 ELSE -8e0 END AS py1,
            CASE f % 3 WHEN 0 THEN 6e0 + f % 5 WHEN 1 THEN 90e0 ELSE 48e0 + (7 * f % 11) * 3 END AS px2, CASE f % 3 WHEN 0 THEN 6e0 + f % 5 WHEN 1 THEN 3e0 + f % 4 ELSE 8e0 END AS py2
        FROM (SELECT s_suppkey AS f FROM {supplier}) s""",
    "patch_vertices": """
        SELECT f, i, 4 AS n, CASE WHEN i IN (0, 3) THEN px1 ELSE px2 END AS x, CASE WHEN i IN (0, 1) THEN py1 ELSE py2 END AS y FROM {patches} p CROSS JOIN (SELECT {explode:0,3} AS i) t""",
    # Regions of several outer rings: the contour and its hole, an island inside the hole, and a second part with a hole of its own.
    "nested_vertices": """
        SELECT f, ring, i, n, x, y FROM {region_vertices}
        UNION ALL SELECT f, 2 AS ring, i, 4 AS n, CASE WHEN i IN (0, 3) THEN -3e0 ELSE 3e0 END AS x, CASE WHEN i IN (0, 1) THEN -3e0 ELSE 3e0 END AS y
            FROM (SELECT s_suppkey AS f FROM {supplier} WHERE s_suppkey % 3 = 0) s CROSS JOIN (SELECT {explode:0,3} AS i) t
        UNION ALL SELECT f, 3 AS ring, i, 4 AS n, CASE WHEN i IN (0, 3) THEN 90e0 ELSE 150e0 END AS x, (f % 3 - 1) * 40e0 + CASE WHEN i IN (0, 1) THEN -30e0 ELSE 30e0 END AS y
            FROM (SELECT s_suppkey AS f FROM {supplier} WHERE s_suppkey % 2 = 0) s CROSS JOIN (SELECT {explode:0,3} AS i) t
        UNION ALL SELECT f, 4 AS ring, i, 4 AS n, CASE WHEN i IN (0, 3) THEN 128e0 ELSE 112e0 END AS x, (f % 3 - 1) * 40e0 + CASE WHEN i IN (0, 1) THEN -8e0 ELSE 8e0 END AS y
            FROM (SELECT s_suppkey AS f FROM {supplier} WHERE s_suppkey % 4 = 0) s CROSS JOIN (SELECT {explode:0,3} AS i) t""",
    "nested_edges": _edges("nested_vertices"),
    # Contours that cross themselves in every fifth field, where two vertices are drawn in the wrong order.
    "drawn_edges": _edges("(SELECT f, ring, CASE WHEN f % 5 = 0 AND ring = 0 AND i = 1 THEN 2 WHEN f % 5 = 0 AND ring = 0 AND i = 2 THEN 1 ELSE i END AS i, n, x, y FROM {region_vertices})"),
    # A hole a few metres inside the first side of every second field.
    "close_edges": _edges("""(SELECT f, 0 AS ring, i, n, x, y FROM {field_vertices} UNION ALL SELECT f, 1 AS ring, i, 4 AS n, cx + CASE WHEN i IN (0, 3) THEN -2e0 ELSE 2e0 END AS x, cy + CASE WHEN i IN (0, 1) THEN 2e0 ELSE -2e0 END AS y
        FROM (SELECT f, mx - 6e0 * mx / sqrt(mx * mx + my * my) AS cx, my - 6e0 * my / sqrt(mx * mx + my * my) AS cy FROM (
            SELECT f, avg(x) AS mx, avg(y) AS my FROM {field_vertices} WHERE i < 2 AND f % 2 = 0 GROUP BY f) m) h CROSS JOIN (SELECT {explode:0,3} AS i) t)"""),
    "outer_edges": "SELECT * FROM {edges} WHERE ring = 0",
    # Customers as points near the fields, as many fields as suppliers; suppliers as clicks.
    "points": """
        SELECT c_custkey AS id, 1 + c_custkey % (SELECT count(*) FROM {supplier}) AS f, (floor(abs(c_acctbal) * 100e0) % 14001) / 100e0 - 70e0 AS px, (c_custkey * 37 % 14001) / 100e0 - 70e0 AS py FROM {customer}""",
    "clicks": """
        SELECT s_suppkey AS id, s_suppkey AS f, (floor(abs(s_acctbal) * 100e0) % 14001) / 100e0 - 70e0 AS px, (s_suppkey * 37 % 14001) / 100e0 - 70e0 AS py FROM {supplier}""",
    # Tracks as tile keys and rectangles.
    "rects": """
        SELECT o_orderkey AS id, (o_orderkey * 7 % 160 - 80) + 0e0 AS lat1, (o_orderkey * 13 % 340 - 170) + 0e0 AS lon1,
            (o_custkey * 11 % 160 - 80) + 0e0 AS lat2, (o_custkey * 17 % 340 - 170) + 0e0 AS lon2 FROM {orders}""",
    "tiles": """
        SELECT event_id, robot_id, ts, zoom, CAST(floor((lon + 180e0) / 360e0 * pow(2e0, zoom)) AS INT) AS x,
            CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * pow(2e0, zoom)) AS INT) AS y
        FROM (SELECT *, 14 + event_id % 6 AS zoom FROM {gps_fix})""",
    "text_lines": """
        SELECT doc_id, pos, line FROM {lines:documents,doc_id,text}""",
}

_MARK = re.compile(r"\{([a-z_]+)(?::([^}]*))?\}")


def _dialect(kind: str, args: str, engine: str) -> str:
    a = args.split(",")
    if kind == "json":
        return f"get_json_object({a[0]}, '$.{a[1]}')" if engine == "spark" else f"json_extract_string({a[0]}, '$.{a[1]}')"
    if kind == "explode":
        return f"explode(sequence({a[0]}, {a[1]}))" if engine == "spark" else f"CAST(unnest(generate_series({a[0]}, {a[1]})) AS INT)"
    if kind == "lines":
        table, key, text = a
        if engine == "spark":
            return f"(SELECT {key}, posexplode(split({text}, '\\n')) AS (pos, line) FROM {{{table}}})"
        return f"(SELECT {key}, CAST(generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS INT) AS pos, unnest(string_split({text}, chr(10))) AS line FROM {table})"
    raise KeyError(kind)


def duckdb_sql(text: str) -> str:
    """The text with every view nested in place."""

    def put(m: re.Match) -> str:
        if m[2] is not None:
            return _dialect(m[1], m[2], "duckdb")
        return f"({duckdb_sql(VIEWS[m[1]])})" if m[1] in VIEWS else m[1]

    return _MARK.sub(put, text)


class Tables:
    """The tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.sql(VIEWS[name]) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def fingerprint(self, *names: str) -> str:
        """A digest of the tables' files: their paths, lengths and times of change."""
        hadoop = self.spark._jsc.hadoopConfiguration()
        found = []
        for name in names:
            for file in sorted(self[name].inputFiles()):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
                status = path.getFileSystem(hadoop).getFileStatus(path)
                found.append(f"{file} {status.getLen()} {status.getModificationTime()}")
        return hashlib.sha256("\n".join(found).encode()).hexdigest()

    def sql(self, text: str) -> DataFrame:
        """Run a text with ``{view}`` marks."""
        text = _MARK.sub(lambda m: _dialect(m[1], m[2], "spark") if m[2] is not None else m[0], text)
        names = {m[1] for m in _MARK.finditer(text)}
        return self.spark.sql(text, **{n: self[n] for n in names})
