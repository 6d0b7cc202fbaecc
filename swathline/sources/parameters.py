"""Parameters of the follower with overrides, each clamped as it is read."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motion import Controller
from ..operators.telemetry import Sensors

# Least and greatest value of each parameter; None: no limit. A direction is 1 or -1.
BOUNDS = {
    "yaw_tolerance_rad": (0.001, None),
    "heading_realign_rad": (0.001, None),
    "turn_kp": (0.0, None),
    "turn_min_cmd": (0.0, None),
    "max_turn_cmd": (0.0, None),
    "max_forward_cmd": (0.0, None),
    "forward_gain": (0.0, None),
    "forward_min_cmd": (0.0, None),
    "drive_heading_kp": (0.0, None),
    "drive_heading_max_rps": (0.0, None),
    "slowdown_distance_m": (0.0, None),
    "slowdown_forward_cmd": (0.0, None),
    "overshoot_retry_margin_m": (0.02, None),
    "overshoot_min_travel_m": (0.0, None),
    "settle_min_s": (0.0, None),
    "settle_timeout_s": (0.0, None),
    "settle_turn_rate": (0.0, None),
    "settle_speed": (0.0, None),
    "course_check_s": (0.1, None),
    "gps_alpha": (0.01, 1.0),
    "gps_timeout_s": (0.0, None),
    "imu_timeout_s": (0.0, None),
}
DIRECTIONS = ("turn_direction_sign", "forward_direction_sign")


def defaults() -> dict[str, float]:
    both = {**asdict(Controller()), **asdict(Sensors())}
    return {name: float(both[name]) for name in (*BOUNDS, *DIRECTIONS)}


def parameters(overrides: DataFrame, key: str = "robot_id") -> DataFrame:
    """(key, name, value): every parameter of each key, its last override by ``seq`` or the default, clamped.

    ``overrides``: (key, seq, name, value). Names that are not known and values
    that are null or NaN are passed over. A settling's timeout is never under its
    least wait. One shuffle on the key: a key's values are a map of fixed size.
    """
    known = defaults()
    last = [F.max_by("value", F.when((F.col("name") == n) & F.col("value").isNotNull() & ~F.isnan("value"), F.col("seq"))).alias(n) for n in known]
    wide = overrides.groupBy(key).agg(*last)
    value = {n: F.coalesce(F.col(n), F.lit(d)) for n, d in known.items()}
    for n, (lo, hi) in BOUNDS.items():
        value[n] = F.greatest(value[n], F.lit(lo))
        if hi is not None:
            value[n] = F.least(value[n], F.lit(hi))
    for n in DIRECTIONS:
        value[n] = F.when(value[n] >= 0, 1.0).otherwise(-1.0)
    value["settle_timeout_s"] = F.greatest(value["settle_timeout_s"], value["settle_min_s"])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in value.items()]))
    return wide.select(key, pairs.alias("p")).select(key, "p.*")
