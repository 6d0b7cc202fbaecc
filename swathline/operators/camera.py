"""Camera actions of map sessions, one after the other.

Each action starts from the state that the one before left: scale, azimuth and
centre. Scales multiply and angles add up, and an absolute action starts anew, so
the states are running sums within segments that absolute actions begin; a drag
moves the centre by its view vector, turned by the azimuth and divided by the
scale of its own row, so centres are running sums over those. All of it is windows
over a session's ordered actions; no action waits for another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def states(actions: DataFrame) -> DataFrame:
    """(robot_id, seq, scale, azimuth, x, y) after each of ``actions`` (robot_id, seq, kind, p, q).

    Kinds: scale_by and scale_to (p), rotate_by and rotate_to (p in degrees),
    move_to (p, q on the map), drag (p, q in the view). A session starts at scale
    1, azimuth 0 and (0, 0); factors and scales are positive.
    """

    def segments(df: DataFrame, kind: str) -> tuple[DataFrame, WindowSpec]:
        name = f"after_{kind}"
        ordered = Window.partitionBy("robot_id").orderBy("seq")
        df = df.withColumn(name, F.sum((F.col("kind") == kind).cast("int")).over(ordered))
        return df, Window.partitionBy("robot_id", name).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def given(kind: str, value: str, other: float) -> Column:
        return F.when(F.col("kind") == kind, F.expr(value)).otherwise(F.lit(other))

    df, w = segments(actions, "scale_to")
    df = df.withColumn("scale", F.exp(F.sum(given("scale_by", "ln(p)", 0.0) + given("scale_to", "ln(p)", 0.0)).over(w)))
    df, w = segments(df, "rotate_to")
    df = df.withColumn("azimuth", F.sum(given("rotate_by", "p", 0.0) + given("rotate_to", "p", 0.0)).over(w))
    turn = "radians(azimuth)"
    df, w = segments(df, "move_to")
    df = df.withColumn("x", F.sum(given("drag", f"-(p * cos({turn}) - q * sin({turn})) / scale", 0.0) + given("move_to", "p", 0.0)).over(w))
    df = df.withColumn("y", F.sum(given("drag", f"-(p * sin({turn}) + q * cos({turn})) / scale", 0.0) + given("move_to", "q", 0.0)).over(w))
    return df.select("robot_id", "seq", "scale", "azimuth", "x", "y")
