"""Written tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: What the tables that ``save`` wrote were made from, by path: their columns' origins are looked up there.
MADE_FROM: dict[str, DataFrame] = {}
#: Rows that a task of a keyed step takes.
TASK_ROWS = 250_000


def root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine, which will do only if
    executors are threads of this machine (a local master); anything else is an error instead of tables in pieces."""
    place = spark.conf.get(SETTING, None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set(SETTING, place)
    return place.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. The table's path is added to ``held``, for ``remove``."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    MADE_FROM[path] = df
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(rows: float) -> int:
    """Partitions of a keyed step of so many rows, so that a task's memory does not grow with them, whatever the session's number of partitions."""
    return max(1, math.ceil(rows / TASK_ROWS))


def bounded(saved: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``saved`` (a written table) with a broadcast hint if its counted rows fit in ``limit`` bytes, else unhinted."""
    return F.broadcast(saved) if saved.count() * row_bytes <= limit else saved


def remove(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that nothing reads any more, empty the list, and let go of the shuffles that made them."""
    jvm = spark.sparkContext._jvm
    for path in held:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        MADE_FROM.pop(path, None)
    held.clear()
    gc.collect()
    jvm.System.gc()
