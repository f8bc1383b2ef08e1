"""Intermediate tables in the folder that the cluster shares, and size-checked broadcasts."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import fresh  # noqa: F401


def save(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. The table's
    path is added to ``held``, for ``remove``."""
    spark = df.sparkSession
    path = shared.fresh(spark, name)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that nothing reads any more, and empty the list. The driver's garbage collection lets go of the shuffles
    of the steps that made them, which else stay on the executors' disks until it happens to run."""
    jvm = spark.sparkContext._jvm
    for path in held:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    held.clear()
    gc.collect()
    jvm.System.gc()


def bounded(saved: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``saved`` (a written table) with a broadcast hint if its counted rows fit in ``limit`` bytes, else unhinted:
    the join then shuffles both sides."""
    return F.broadcast(saved) if saved.count() * row_bytes <= limit else saved
