"""Timers and as-of joins in event time: late rows, silent robots, several micro-batches."""

from datetime import UTC, datetime, timedelta

import pytest

from swathline.streaming import clock

START = datetime(2024, 1, 1, tzinfo=UTC)
SECOND = 1_000_000
SCHEMA = "robot_id long, ts timestamp, id long, ok boolean"


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, tmp_path, name, processor, gps, imu, late="10 seconds"):
    """The processor over two streams, a file of each per micro-batch; ``gps`` and ``imu`` are lists of such files' rows."""
    streams = []
    for kind, files in (("gps", gps), ("imu", imu)):
        for k, rows in enumerate(files):
            spark.createDataFrame([(r, at(s), i, ok) for r, s, i, ok in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{kind}/{k}")
        streams.append(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{kind}/*"))
    with clock.keyed_state(spark):
        stream = clock.processed(clock.tagged(*streams, late), processor)
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.table(name)


def seconds(rows, column="tick_us"):
    zero = int(START.timestamp()) * SECOND
    return [(r[column] - zero) // SECOND for r in rows]


def test_alignment_takes_late_rows_in_order(spark, tmp_path):
    # The second micro-batch brings a fix and a reading that are older than those of the first, within the watermark's delay.
    gps = [[(1, 0, 10, True), (1, 8, 12, True)], [(1, 4, 11, True), (1, 30, 13, False), (2, 100, 14, True)]]
    imu = [[(1, 1, 20, True), (1, 9, 23, True)], [(1, 3, 21, True), (1, 5, 22, True), (1, 31, 24, True), (1, 60, 25, True), (2, 100, 26, True)], [(2, 200, 27, True)]]
    got = run(spark, tmp_path, "aligned", clock.LatestFix(40 * SECOND), gps, imu)
    # The fix at 30 s is lost, so the last valid one is at 8 s; at 60 s it is too old. The watermark ends at 90 s, of the fixes' stream.
    assert {r.id: r.fix_id for r in got.collect()} == {20: 10, 21: 10, 22: 11, 23: 12, 24: 12, 25: None}


def test_a_silent_robot_is_stopped_by_the_clock(spark, tmp_path):
    other = [(2, s, 100 + s, True) for s in range(0, 120, 5)]
    own = [(1, s, s, True) for s in range(1, 20)]
    got = run(spark, tmp_path, "silent", clock.Clock(2 * SECOND, 4 * SECOND, 2 * SECOND), [own + other], [own + other])
    rows = sorted(got.where("robot_id = 1").collect(), key=lambda r: r.tick_us)
    assert seconds(rows) == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24]  # no reading after 19 s; the clock runs out one tick after both limits
    assert [r.state for r in rows] == ["live"] * 10 + ["stop"] * 2
    assert [r.missing for r in rows][-2:] == ["imu", "gps, imu"]


def test_a_lost_fix_stops_at_once_and_the_clock_starts_again(spark, tmp_path):
    gps = [[(1, 1, 1, True), (1, 3, 2, False), (1, 5, 3, True), (1, 61, 4, True), (2, 300, 9, True)]]
    imu = [[(1, s, 10 + s, True) for s in (1, 3, 5, 61)] + [(2, 300, 19, True)]]
    rows = sorted(run(spark, tmp_path, "lost", clock.Clock(2 * SECOND, 4 * SECOND, 4 * SECOND), gps, imu).where("robot_id = 1").collect(), key=lambda r: r.tick_us)
    assert list(zip(seconds(rows), [r.state for r in rows], strict=True)) == [(2, "live"), (4, "stop"), (6, "live"), (8, "live"), (10, "stop"), (62, "live"), (64, "live"), (66, "stop")]


def test_markers_are_refreshed_until_silence(spark, tmp_path):
    gps = [[(1, 1, 1, True), (1, 4, 2, False), (1, 5, 3, True), (2, 100, 9, True)]]
    imu = [[(1, 1, 11, True), (2, 100, 19, True)]]
    rows = sorted(run(spark, tmp_path, "marks", clock.Refresh(2 * SECOND, 3 * SECOND), gps, imu).where("robot_id = 1").collect(), key=lambda r: r.tick_us)
    assert list(zip(seconds(rows), [r.fix_id for r in rows], strict=True)) == [(2, 1), (4, 1), (6, 3), (8, 3), (10, 3)]


@pytest.mark.parametrize(("arrivals", "want"), [((1, 2, 3), [(2, 2, "waiting"), (4, 3, "waiting"), (6, 3, "waiting"), (8, 3, "ready")]), (tuple(range(1, 40)), [(s, min(s, 39), "late" if s >= 11 else "waiting") for s in range(2, 14, 2)][:6])])
def test_polls_end_when_stable_or_late(spark, tmp_path, arrivals, want):
    gps = [[(1, s, s, True) for s in arrivals] + [(2, 200, 99, True)]]
    imu = [[(2, 200, 98, True)]]
    rows = sorted(run(spark, tmp_path, f"polls{len(arrivals)}", clock.Readiness(2 * SECOND, 2, 10 * SECOND), gps, imu).where("robot_id = 1").collect(), key=lambda r: r.tick_us)
    assert list(zip(seconds(rows), [r.n for r in rows], [r.state for r in rows], strict=True)) == want


def test_the_sessions_state_provider_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with clock.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before
