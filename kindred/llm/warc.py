"""A deterministic sharded WARC writer and its reader.

Records are sorted by page id and payload digest (those without an id by digest and url) into range shards whose borders come
from a hash sample of these keys (the same data give the same borders), so that no id, and no lack of one, makes a shard
that grows with its rows; each shard rolls to a new file once the compressed size passes a limit. Headers and digests are made
anew for every record; ids, dates and gzip members hold nothing that changes from run to run. Of records with equal
payloads the smallest page id is the response and the others revisit it, without a second copy of the payload.

A task writes under a temporary name of its own attempt and returns one manifest row for each file. Only rows of tasks
that ended well reach the manifest; a commit step then renames their files, and the manifest table is written last:
readers open only what it lists, so an archive without one does not exist yet. A lost executor costs its running tasks.

Defined results: a null html is an empty payload; a null url is written as ``urn:page:<id>``; control characters in a
url are percent-encoded; null page ids come first and are never referred to; of rows with equal page id and payload the
first is the response and the others revisit that same id; an empty table gives an archive of no file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Raw payload bytes aimed at for a shard, the most shards (longer ones only roll more files), compressed bytes of a file.
SHARD_BYTES, MOST_SHARDS, FILE_BYTES = 32 << 20, 20_000, 8 << 20
#: Payloads under so many bytes are never revisits.
LEAST_REVISIT = 100
#: Records carry a fixed date (a parameter of the writer), since pages have none.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:kindred:warc")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, seq int, name string, temporary string, bytes long, records long, sha256 string"


def _fs(uri: str):
    return fs.FileSystem.from_uri(uri)


def record_id(page: int | None, digest: str, n: int = 0, url: str | None = None) -> str:
    """``n`` tells records of one page and payload apart, or of one url and payload where there is no page id."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{digest}/{n}' if page is not None or url is None else f'{page}/{digest}/{n}/{url}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page, url, payload: bytes, digest: str, refers, date: str, n: int = 0) -> bytes:
    """One WARC record; ``refers`` is the page whose response a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    uri = f"urn:page:{page}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, digest, n, url)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if refers is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page", refers)]
    if page is not None:
        fields.append(("X-Page", page))
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _head(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, root: str, attempt: str, shard: int, limit: int, date: str):
        self.root, self.attempt, self.shard, self.limit, self.date, self.seq, self.out, self.rows = root, attempt, shard, limit, date, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            system, path = _fs(f"{self.root}/{self.temporary}")
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.size, self.n, self.sum = system.open_output_stream(path, compression=None), 0, 0, hashlib.sha256()
            info = f"software: kindred\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")
        self._put(data)
        self.n += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        z = member(data)
        self.out.write(z)
        self.sum.update(z)
        self.size += len(z)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.seq, self.name, self.temporary, self.size, self.n, self.sum.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def _write(root: str, limit: int, date: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roller, rows, last, n = uuid.uuid4().hex, None, [], None, 0
        for batch in batches:
            for shard, page, url, html, digest, refers in zip(*(batch.column(c) for c in ("shard", "page_id", "url", "html", "digest", "refers")), strict=True):
                shard, page, digest, refers = shard.as_py(), page.as_py(), digest.as_py(), refers.as_py()
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        rows += roller.rows
                    roller = _Roller(root, attempt, shard, limit, date)
                payload = (html.as_py() or "").encode()
                this = (page, digest, url.as_py() if page is None else None)
                n = n + 1 if last == this else 0
                last = this
                if refers == page and (not n or len(payload) < least):
                    refers = None  # the response itself
                elif refers is None and n and page is not None and len(payload) >= least:
                    refers = page
                roller.add(record(page, url.as_py(), payload, digest, refers, date, n))
        if roller:
            roller.close()
            rows += roller.rows
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "seq", "name", "temporary", "bytes", "records", "sha256"]), preserve_index=False, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    return run


def _commit(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _fs(root)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes")), strict=True):
                done = system.get_file_info(f"{base}/{name}")
                if done.type != fs.FileType.File or done.size != size:  # else an earlier attempt at this row renamed it
                    system.move(f"{base}/{temporary}", f"{base}/{name}")
            yield batch

    return run


def write_archive(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``root``; returns the manifest."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    first = scratch.save(
        rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").select("digest", "refers"),
        "responses",
    )
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")).first()
    shards = int(max(1, min(MOST_SHARDS, -(-total["bytes"] // shard_bytes))))
    step = max(1, total["n"] // (64 * shards))
    # Rows without a page id come first, by digest and url; the others by page id and digest.
    key = [
        F.coalesce("page_id", F.lit(-(1 << 63))).alias("k1"),
        F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("k2"),
        F.when(F.col("page_id").isNull(), F.xxhash64("url")).otherwise(F.lit(0)).alias("k3"),
    ]
    drawn = [] if shards == 1 else rows.select(*key).where(f"pmod(xxhash64(k1, k2, k3), {step}) = 0").collect()  # some 64 a shard
    sample = sorted(tuple(r) for r in drawn)
    borders = sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []

    @F.pandas_udf("int")
    def shard_of(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, x) for x in zip(k1, k2, k3, strict=True)], dtype="int32")

    joined = rows.join(scratch.bounded(first, 96), "digest", "left").withColumn("shard", shard_of(*key))
    dealt = joined.select("shard", "page_id", "url", "html", "digest", "refers").repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url")
    staged = scratch.save(dealt.mapInArrow(_write(root, file_bytes, date, least), _MANIFEST), "manifest")
    staged.mapInArrow(_commit(root), _MANIFEST).write.parquet(f"{root}/manifest.parquet")
    system, base = _fs(root)
    if system.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{base}/_temporary")
    return spark.read.schema(staged.schema).parquet(f"{root}/manifest.parquet")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an opened (decompressed) WARC stream."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


def _read(root: str, payloads: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payloads

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _fs(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as f, gzip.GzipFile(fileobj=io.BufferedReader(f), mode="rb") as z:
                    for head, block in records(io.BufferedReader(z)):
                        if head["warc-type"] == "warcinfo":
                            continue
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["warc-block-digest"] or head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a digest in {name} does not hold")
                        page, refers = head.get("x-page"), head.get("x-refers-to-page")
                        rows.append((page and int(page), head["warc-target-uri"], int(head["x-payload-length"]), digest, head["warc-type"], refers and int(refers)) + ((payload.decode() if head["warc-type"] == "response" else None,) if payloads else ()))
                        if len(rows) >= 500:
                            yield out(rows)
                            rows = []
                yield out(rows)

    return run


def read_archive(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the files that the manifest lists; digests are checked while reading."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest.parquet")
    n = manifest.count()
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * payloads
    return manifest.select("name").repartition(max(1, n)).mapInArrow(_read(root, payloads), kinds)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    root = scratch.fresh(spark, "warc")
    write_archive(pages, root)
    return read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
