"""Streams over the given tables, and what a stream has landed as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables
from ..sources.scratch import folder


def streamed(spark: SparkSession, sf_dir: str, table: str = "events") -> Tables:
    """The views with one table read as a stream of its files; a view that only projects and filters it is a stream too."""
    t = Tables(spark, sf_dir)
    schema = t[table].schema
    # a pattern, as the source takes a plain path for a folder and the table may be one file
    t.made[table] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{{{table}.parquet}}")
    return t


def landed(stream: DataFrame) -> DataFrame:
    """All that a stream has now, through the Parquet sink: each file's rows once, also after a restart."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drained(stream: DataFrame, sink: Callable[[DataFrame, int, str], None]) -> str:
    """Runs a ``foreachBatch`` sink (batch, number, path) over all that a stream has now; gives the sink's path."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(lambda df, n: sink(df, n, f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/rows"
