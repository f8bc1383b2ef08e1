"""Lines of the members of archives, as dumps come: tar files, plain or compressed, and single compressed files.

A Python data source: a member is a partition, a long member of a plain tar is several (cut at line ends), and each is streamed in
batches of ``BATCH_BYTES``. Members of a plain tar are found by their headers and read in place. A compressed tar cannot be
entered in the middle: the reader of a member decompresses what lies before it too, without keeping it, so that such archives
of many members are better unpacked once (``unpacked``). Archives are opened through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import fnmatch
import io
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared
from .digests import filesystem

BATCH_BYTES = 4 << 20
#: Bytes of a member of a plain tar that a partition reads.
SPLIT = 128 << 20
#: Endings of compressed files and the names of their codecs.
CODECS = {".gz": "gzip", ".tgz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".xz": "xz"}
SCHEMA = "archive string, member string, at long, value string"


def is_archive(path: str) -> bool:
    return path.endswith((".tar", *CODECS))


def _codec(path: str) -> str | None:
    return next((name for end, name in CODECS.items() if path.endswith(end)), None)


def _is_tar(path: str) -> bool:
    return path.endswith((".tar", ".tgz")) or any(path.endswith(f".tar{end}") for end in CODECS)


class _Input(io.RawIOBase):
    """An Arrow file as Python's libraries read one."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.f.seek(at, whence)

    def tell(self) -> int:
        return self.f.tell()

    def readinto(self, buffer) -> int:
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _open(uri: str):
    """The file, decompressed as it is read."""
    store, path = filesystem(uri)
    raw = io.BufferedReader(_Input(store.open_input_file(path)), 1 << 20)
    codec = _codec(uri)
    if codec == "gzip":
        import gzip

        return gzip.GzipFile(fileobj=raw)
    if codec == "bz2":
        import bz2

        return bz2.BZ2File(raw)
    if codec == "xz":
        import lzma

        return lzma.LZMAFile(raw)
    if codec == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True), 1 << 20)
    return raw


@dataclass
class Part(InputPartition):
    archive: str
    member: str
    start: int  # in a plain tar the place of its first byte in the archive, else how many members lie before it
    first: int  # of the member's bytes, the first that is read, and the one after the last
    end: int
    size: int  # of the member


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members, self.split = options["path"], options.get("members", "*"), int(options.get("split", SPLIT))

    def partitions(self) -> list[Part]:
        """Headers only: a plain tar is sought through, a compressed one is streamed once."""
        if not _is_tar(self.path):
            return [Part(self.path, self.path.rsplit("/", 1)[-1], -1, 0, 1 << 62, 1 << 62)]
        plain, out = _codec(self.path) is None, []
        with _open(self.path) as f, tarfile.open(fileobj=f, mode="r:" if plain else "r|") as tar:
            for n, x in enumerate(tar):
                if x.isfile() and fnmatch.fnmatch(x.name, self.members):
                    step = self.split if plain else max(1, x.size)
                    out += [Part(self.path, x.name, x.offset_data if plain else n, k, min(k + step, x.size), x.size) for k in range(0, x.size, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with _open(part.archive) as f:
            if part.start < 0:
                yield from _batches(part, f, 0)
            elif _codec(part.archive) is None:
                at = max(part.first - 1, 0)
                f.seek(part.start + at)
                yield from _batches(part, _Limited(f, part.size - at), at)
            else:
                with tarfile.open(fileobj=f, mode="r|") as tar:
                    x = next(x for n, x in enumerate(tar) if n == part.start)
                    yield from _batches(part, tar.extractfile(x), 0)


class _Limited(io.RawIOBase):
    def __init__(self, f, left: int):
        self.f, self.left = f, left

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.f.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _batches(part: Part, f, at: int) -> Iterator[pa.RecordBatch]:
    """Lines that begin within the part, without their ends; ``at`` is the place in the member of the first byte of ``f``."""
    f = io.BufferedReader(f, 1 << 20) if isinstance(f, io.RawIOBase) else f
    if part.first:
        at += len(f.readline())  # of the line that began before this part, or the line end just before it
    held, places, size = [], [], 0

    def batch() -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([part.archive] * n), pa.array([part.member] * n), pa.array(places, pa.int64()), pa.array(held, pa.binary()).cast(pa.string())], ["archive", "member", "at", "value"])

    while at < part.end:
        line = f.readline()
        if not line:
            break
        held.append(line.removesuffix(b"\n").removesuffix(b"\r"))
        places.append(at)
        at += len(line)
        size += len(line)
        if size >= BATCH_BYTES:
            yield batch()
            held, places, size = [], [], 0
    if held:
        yield batch()


class ArchiveLines(DataSource):
    """Options: path of one archive, members (a pattern of names), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def lines(spark: SparkSession, path: str, members: str = "*", split: int = SPLIT) -> DataFrame:
    """(archive, member, at, value): every line of the matching members; ``at`` is where it begins in its member. Lines are UTF-8."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("path", path).option("members", members).option("split", str(split)).load()


def unpacked(spark: SparkSession, path: str, members: str = "*") -> DataFrame:
    """``lines``, written once to the shared folder: for a compressed archive that is read more than once."""
    return shared.save(lines(spark, path, members), "unpacked")


def json_lines(spark: SparkSession, path: str, schema: str, members: str = "*") -> DataFrame:
    """JSON lines of an archive, or of files and folders that Spark reads itself, with the columns of ``schema``; of lines that are no JSON all are null."""
    if not is_archive(path) or not _is_tar(path):
        return spark.read.schema(schema).json(path)
    return lines(spark, path, members).select(F.from_json("value", schema).alias("__row")).select("__row.*")
