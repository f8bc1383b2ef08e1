"""The log of published versions: numbered entries that are created once and never changed.

An entry becomes visible whole, under a name that must not be there yet: a hard link on local file systems, a rename that
does not overwrite on stores whose rename is atomic (HDFS and the like). So of two publishers that began from the same entry one comes second and
fails, and a reader, who takes the entry with the highest number, sees one version or the other. Object stores that cannot refuse
to overwrite need a publisher at a time."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_versions"


class ConcurrentPublish(RuntimeError):
    """Another version was published since this publisher began; nothing has changed."""


def _store(path: str, spark: SparkSession):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last(root: str, spark: SparkSession) -> tuple[int, dict | None]:
    """Number and content of the newest entry; 0 and None where nothing was published."""
    jvm, folder, store = _store(f"{root}/{FOLDER}", spark)
    names = [x.getPath().getName() for x in store.listStatus(folder)] if store.exists(folder) else []
    number = max((int(x.removesuffix(".json")) for x in names if x.endswith(".json") and not x.startswith(".")), default=0)
    return number, entry(root, number, spark) if number else None


def entry(root: str, number: int, spark: SparkSession) -> dict:
    jvm, place, store = _store(f"{root}/{FOLDER}/{number:010d}.json", spark)
    stream = store.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def append(root: str, base: int, content: dict, spark: SparkSession) -> int:
    """Puts an entry after ``base`` and gives its number; ConcurrentPublish if there is one already."""
    number = base + 1
    jvm, part, store = _store(f"{root}/{FOLDER}/.{uuid.uuid4().hex}", spark)
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{FOLDER}/{number:010d}.json")
    out = store.create(part, False)
    try:
        out.write(bytearray((json.dumps(content | {"base": base}, indent=2) + "\n").encode()))
    finally:
        out.close()
    try:
        if store.getUri().getScheme() == "file":
            nio = jvm.java.nio.file
            local = lambda p: nio.Path.of(jvm.java.net.URI.create(store.makeQualified(p).toUri().toString()))
            nio.Files.createLink(local(target), local(part))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(part), store.makeQualified(target), options)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise ConcurrentPublish(f"version {number} of {root} was published meanwhile") from e
        raise
    finally:
        store.delete(part, False)
    return number
