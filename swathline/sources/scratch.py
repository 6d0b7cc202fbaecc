"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves on one machine; on a
    cluster executors would not see each other's files there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='swathline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/swathline-{spark.sparkContext.applicationId}"


def shuffled(df: DataFrame) -> DataFrame:
    """Rows that grow with the input: their joins sort and shuffle both sides.

    Spark sizes a side by the files below it. Those of fields and stripes are a
    hundredth of their rows in memory, and what is exploded counts as what it was
    made from, so such a side would pass for small and go whole through the driver.
    """
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """Write a result to a table of its own in ``folder`` and read it again; its joins are shuffled."""
    return shuffled(stored(df))


def stored(df: DataFrame) -> DataFrame:
    """Write a result to a table of its own in ``folder`` and read it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _Kept(NamedTuple):
    path: str
    schema: StructType
    metrics: dict[str, float]


_KEPT: dict[tuple, _Kept] = {}


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], counts: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """The table that ``make`` gives, written once per application and key, and its metrics; its joins are shuffled.

    ``counts`` are SQL aggregates that Spark observes in the pass that writes the table.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        df, path = make(), f"{folder(spark)}/{uuid.uuid4().hex}"
        seen = Observation()
        observed = df.observe(seen, *[F.expr(c).alias(k) for k, c in counts.items()]) if counts else df
        observed.write.parquet(path)
        _KEPT[key] = _Kept(path, df.schema, {k: float(v or 0) for k, v in seen.get.items()} if counts else {})
    found = _KEPT[key]
    return shuffled(spark.read.schema(found.schema).parquet(found.path)), found.metrics


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has written so far; what still reads them fails afterwards."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
