"""Item trees: what an item has from all items above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def effective(items: DataFrame) -> DataFrame:
    """(id, root, depth, opacity) of items (id, parent, own): the product of own opacities up to the root.

    Each round joins an item with the item it points to and then points where that
    one does, so pointers double: rounds grow with the logarithm of the depth, and
    no round holds more than one row per item. Items whose parent is missing, and
    those below them, have no row.
    """
    up = F.col("parent")
    state = written(items.select("id", up.alias("up"), F.coalesce(up, F.col("id")).alias("root"), F.when(up.isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("own").alias("opacity")))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("opacity").alias("over"))
        moved = state.where("up IS NOT NULL").join(above, "up").select("id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("opacity") * F.col("over")).alias("opacity"))
        state = written(state.where("up IS NULL").unionByName(moved))
    return state.select("id", "root", "depth", "opacity")
