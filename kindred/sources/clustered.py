"""Tables that are stored in buckets of a column, so that a lookup reads one bucket and a join does not shuffle them.

The layout is kept in a file beside the data: whoever reads the folder gets the buckets without a catalogue that remembers them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from . import versions

LAYOUT = "_layout.json"


@dataclass(frozen=True)
class Layout:
    column: str
    buckets: int = 64
    sort: tuple[str, ...] = ()


def write(rows: DataFrame, path: str, layout: Layout) -> None:
    """``rows`` as Parquet, a file for each bucket, sorted within it, with a Bloom filter of the column. Rows are shuffled once by the
    hash that buckets go by, so that no task writes to more than its own."""
    spark, name = rows.sparkSession, _name(path, "w")
    dealt = rows.repartition(layout.buckets, layout.column)
    writer = dealt.write.format("parquet").mode("errorifexists").option("path", path).option(f"parquet.bloom.filter.enabled#{layout.column}", "true")
    writer.bucketBy(layout.buckets, layout.column).sortBy(layout.column, *layout.sort).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    jvm, place, store = versions._store(f"{path}/{LAYOUT}", spark)
    out = store.create(place, True)
    try:
        out.write(bytearray(json.dumps(asdict(layout) | {"schema": rows.schema.json()}).encode()))
    finally:
        out.close()


def is_clustered(path: str, spark: SparkSession) -> bool:
    _, place, store = versions._store(f"{path}/{LAYOUT}", spark)
    return store.exists(place)


def read(path: str, spark: SparkSession) -> DataFrame:
    """The table with its buckets."""
    from pyspark.sql.types import StructType

    jvm, place, store = versions._store(f"{path}/{LAYOUT}", spark)
    stream = store.open(place)
    try:
        made = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    name, sort = _name(path, "r"), [made["column"], *made["sort"]]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(made["schema"])))
    quoted = lambda x: ", ".join(f"`{c}`" for c in x)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({quoted([made['column']])}) SORTED BY ({quoted(sort)}) INTO {made['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _name(path: str, kind: str) -> str:
    return f"clustered_{kind}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
