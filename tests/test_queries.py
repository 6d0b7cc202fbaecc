"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math
import os
from collections import Counter

import pytest

from swathline.plans.catalog import ORACLE, QUERIES

TABLES = "nation customer supplier orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; with SWATHLINE_ALL=1 all of them.
SAMPLE = sorted(ORACLE) if os.environ.get("SWATHLINE_ALL") else ["d1_project", "d18_quadkey", "d21_degrees_text", "c7_rect_intersects", "c9_point_in_region", "e9_boundary_anchor", "e7_line_region_intersection", "h7_route_commands", "h6_decimation", "f11_asof_alignment", "j2_interval_difference", "b11_route_arrows", "k2_components", "i3_top_neighbours", "s5_merge", "k6_spanning_tree", "m4_control_ticks", "m12_settle_deadlines", "b19_stage_metrics", "k10_boundary_transfer"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    ours = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    theirs = duck.sql(ORACLE[name])
    at = [theirs.columns.index(c) for c in sorted(theirs.columns)]
    assert sorted(df.columns) == sorted(theirs.columns)
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())


def test_every_sql_has_a_query():
    assert not set(ORACLE) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["robot_id", "seq", "part", "cmd", "value"] and df.count() > 0


def test_queries_can_be_listed_before_a_session_starts():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


@pytest.mark.parametrize("name", ["b1_command_documents", "b26_command_panel"])
def test_documents_of_short_hops_are_the_same_as_duckdb(spark, sf_dir, tmp_path, name):
    """Turns between hops of under a metre, near the middle of two fourth decimals: digits that cancel must not decide."""
    import datetime

    import duckdb

    tracks = [(1733, 55, 1736, 52, 1735, 57), (358, 59, 359, 63, 361, 67), (361, 33, 359, 29, 358, 25), (1269, 21, 1268, 22, 1269, 23), (623, 60, 620, 59, 621, 60), (1267, 46, 1269, 47, 1268, 50)]
    tracks += [(1269, 60, 1268, 59, 1269, 58), (609, 47, 606, 52, 607, 53), (616, 55, 617, 53, 620, 55), (607, 68, 606, 70, 605, 65), (605, 30, 607, 28, 610, 27), (607, 74, 606, 76, 605, 71)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(3 * u + i, at + datetime.timedelta(seconds=i), u, "view", t[2 * i] / 100 + 0.005, f'{{"k": {t[2 * i + 1]}}}') for u, t in enumerate(tracks) for i in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    theirs = c.sql(ORACLE[name])
    assert sorted(map(tuple, df.select(*theirs.columns).collect())) == sorted(theirs.fetchall())
    assert df.count() == len(tracks)
