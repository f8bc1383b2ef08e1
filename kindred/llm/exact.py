"""Exact duplicates by an extendible-hash index on shared files.

The index has three tables in the shared folder:

* ``entries``, the heap. Each task that reads documents combines equal texts among those it holds (at most ``HELD_BYTES`` of
  texts or ``HELD_ROWS`` rows) into one entry: key (63 bits of the text's SHA-256), the normalised text, and the ids of its rows. So a group
  of copies, however large, crosses the network once for each such block.
* ``directory``: the slots of the keys' first bits. It begins with as many bits as the bytes ask for; a bucket with more than
  ``BUCKET_BYTES`` of different texts is split in two by the next bit, the directory doubling as often as the deepest bucket needs. Several
  slots may lead to one bucket. A bucket that no bit can split (one huge text, or keys that are all equal) keeps an overflow chain.
* ``buckets``: owner tasks, each of a range of consecutive slots and thus of keys, read their entries in key order. Under a key they hold
  a chain of different texts; an entry is compared byte by byte with those of its chain and joins the equal one or becomes a new link. An
  owner holds one chain and the numbers of its entries, never a bucket.

Every entry then learns its link's row that stays, and gives its rows their verdict; entries are dealt evenly, so
that the rows of a hot text are spread like any others. A lost task is run again alone: every step reads and writes shared files.

Defined results: a null text is an empty one; texts are equal if they are after lower-casing A-Z; of equal texts the row with
the largest doc_id stays, a null id being the smallest, and of several rows with that id exactly one; null ids have a verdict like others;
no rows give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from . import scratch, text

KEY_BITS = 63
#: Of a block within which a task combines equal texts.
HELD_BYTES, HELD_ROWS = 16 << 20, 100_000
#: Of a bucket's different texts, and of an owner's.
BUCKET_BYTES, OWNER_BYTES = 1 << 20, 16 << 20
_LOWER = bytes(text.LOWER)
_ENTRY = "eid long, key long, sha string, size long, body binary, members array<long>, best long, best_at int"
_VERDICT = "eid long, bucket long, key long, link int, head boolean, stays boolean, keep_id long, group_size long"


def _entries(key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = (TaskContext.get().partitionId() << 33), 0
        held: dict[bytes, list] = {}
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, rows, made
            digests = [hashlib.sha256(body) for body in held]
            best = [max(((i is not None, i or 0, -k) for k, i in enumerate(ids)), default=None) for ids in held.values()]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first + made, first + made + len(held)), pa.int64()), pa.array([int.from_bytes(d.digest()[:8], "big") >> 64 - key_bits << KEY_BITS - key_bits for d in digests], pa.int64()),
                    pa.array([d.hexdigest() for d in digests], pa.string()), pa.array(map(len, held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64())),
                    pa.array([i if there else None for there, i, _ in best], pa.int64()), pa.array([-k for _, _, k in best], pa.int32()),
                ],
                ["eid", "key", "sha", "size", "body", "members", "best", "best_at"],
            )
            made += len(held)
            held, size, rows = {}, 0, 0
            return out

        for batch in batches:
            data, where = text.utf8(batch.column("text"))
            low, ids = data.tobytes().translate(_LOWER), batch.column("doc_id").to_pylist()
            for i, doc_id in enumerate(ids):
                body = low[where[i] : where[i + 1]]
                mine = held.get(body)
                if mine is None:
                    mine = held[body] = []
                    size += len(body)
                mine.append(doc_id)
                rows += 1
                if size >= HELD_BYTES or rows >= HELD_ROWS:
                    yield flush()
        if held:
            yield flush()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a range of keys, in key order: those of one key are put under the link of their text, then given its verdict."""
    names = [c.split()[0] for c in _VERDICT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    key = bucket = None
    chain: list[list] = []  # text, rows, the entry that has the row that stays, its id, entries
    made: list[tuple] = []

    def close() -> None:
        for link, (_, rows, (there, best, minus), eids) in enumerate(chain):
            for k, eid in enumerate(eids):
                made.append((eid, bucket, key, link, k == 0, eid == -minus, best if there else None, rows))

    for batch in batches:
        for of, b, eid, body, many, best in zip(*(batch.column(c).to_pylist() for c in ("key", "bucket", "eid", "body", "many", "best")), strict=True):
            if of != key:
                close()
                key, bucket, chain = of, b, []
            mine = next((x for x in chain if x[0] == body), None)
            if mine is None:
                mine = [body, 0, (False, 0, 1), []]
                chain.append(mine)
            mine[1] += many
            candidate = (best is not None, best or 0, -eid)
            mine[2] = candidate if not mine[3] else max(mine[2], candidate)
            mine[3].append(eid)
        if len(made) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
            made = []
    close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], names)


def directory(loads: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(slot, bucket, bits) of every slot, and the bits of a slot, for keys with their bytes (key, size).

    A bucket is named by its first slot. ``loads`` is read once, into a histogram that is six bits finer than even buckets would need."""
    total = loads.agg(F.sum("size")).first()[0] or 0
    begin = max(0, (total // bucket_bytes).bit_length())
    deepest = min(KEY_BITS, begin + 6)
    fine = scratch.save(loads.groupBy(F.shiftrightunsigned("key", KEY_BITS - deepest).alias("fine")).agg(F.sum("size").alias("size")), "histogram")
    prefix = lambda bits: F.shiftrightunsigned("fine", deepest - bits)
    bits, done, open_ = begin, None, fine
    while True:
        full = open_.groupBy(prefix(bits).alias("prefix")).agg(F.sum("size").alias("load")).where(F.col("load") > bucket_bytes).select("prefix")
        full = scratch.save(full, "overfull")
        last = bits == deepest or full.isEmpty()
        settled = open_ if last else open_.join(full, prefix(bits) == full["prefix"], "left_anti")
        settled = settled.select(F.shiftleft(prefix(bits), deepest - bits).alias("first"), F.lit(bits).alias("bits")).distinct()
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        open_ = scratch.save(open_.join(full, prefix(bits) == full["prefix"], "left_semi"), "split")
        bits += 1  # the directory doubles: every bucket that is still open is split by its next bit
    first = F.shiftrightunsigned("first", deepest - bits)
    slots = done.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {bits} - bits)") - 1)).alias("slot"), first.alias("bucket"), "bits")
    return slots, bits


@dataclass
class Index:
    """Where an index lies, and the bits of a slot of its directory."""

    spark: SparkSession
    path: str
    bits: int

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build(docs: DataFrame, path: str | None = None, key_bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> Index:
    """An index of all texts of ``docs`` (doc_id, text) at ``path`` (a new folder of the shared one). ``key_bits`` under 63 makes keys collide, for tests."""
    spark = docs.sparkSession
    path = path or shared.fresh(spark, "exact-index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_entries(key_bits), _ENTRY).write.option("compression", "zstd").parquet(f"{path}/entries")
    index = Index(spark, path, 0)
    entries = index.read("entries")
    loads = entries.groupBy("key", "sha").agg(F.max("size").alias("size"))
    slots, index.bits = directory(loads, bucket_bytes)
    slots.write.parquet(f"{path}/directory")
    slots = scratch.bounded(index.read("directory"), 32)
    total = entries.agg(F.sum("size")).first()[0] or 0
    owners = int(min(max(1, total // owner_bytes), 1 << index.bits))
    of = F.shiftrightunsigned("key", KEY_BITS - index.bits).alias("slot")
    dealt = entries.select("eid", "key", "body", F.size("members").cast("long").alias("many"), "best", of).join(slots.select("slot", "bucket"), "slot").drop("slot")
    owner = F.floor(F.col("bucket") * owners / F.lit(1 << index.bits)).cast("int")
    ordered = dealt.repartitionById(owners, owner).sortWithinPartitions("key", "eid")
    ordered.mapInArrow(_own, _VERDICT).write.parquet(f"{path}/buckets")
    return index


def verdicts(index: Index) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row that the index was built from."""
    entries, found = index.read("entries").select("eid", "sha", "members", "best_at"), index.read("buckets").select("eid", "stays", "keep_id", "group_size")
    rows = entries.join(found, "eid").select("sha", "best_at", "stays", "keep_id", "group_size", F.posexplode("members").alias("at", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("at") == F.col("best_at"))).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``verdicts`` of an index of ``docs`` that is made for the purpose."""
    return verdicts(build(docs))
