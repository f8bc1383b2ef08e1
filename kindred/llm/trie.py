"""Trie of conversation prefixes: what conversations have in common from their first turn on, as one row for each prefix.

A turn is the digest of its role and text, a conversation the list of its turns' digests. Equal conversations are first made one
sequence with a count. Sequences are hash-partitioned by the digest of their first turn; a bucket of such subtries is built inside
``applyInPandas`` as dictionaries of pointers and summed up in iterative postorder. A subtrie of more than ``LARGEST`` turns is
not given to a task: its top, with as many turns as all its sequences share, becomes a trunk node, its sequences are
partitioned again by the turn that follows, and so on until no subtrie is too large; trunk nodes get their sums from their children,
deepest first, by grouped joins. So no task holds more than a bucket, however hot a first turn is, and one round
splits all large subtries at once. Intermediate tables are written to the shared folder.

The ids of the conversations that end at a node are hashed in order: ids of one range of ``SPAN`` become one row (at most ``SPAN``
ids), and a task that reads the rows of a node in order feeds them to the digest, holding one batch.

Bounds: a conversation is one row of 32 bytes a turn, so a single conversation has to fit in a task. The only tables that are
broadcast are trunk nodes, below a checked size.

Defined results: rows without a conv_id belong to no conversation; null roles and texts are empty; a null turn comes first; rows
of one conversation and turn go by the digest of role and text, repeated rows are turns of their own; conversations without turns
end at the root; no conversations give no nodes; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Turns of a subtrie that is built in one task, and those that a bucket of small subtries has on average.
LARGEST, BUCKET = 10_000, 2_000
#: Width of a range of conv_ids that are hashed as one row.
SPAN = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of rows (conv_id, turn, role, text): the digests of its turns in order, and how many words each has."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    one = F.struct(
        turn.isNotNull().alias("set"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words"),
    )
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.words").alias("words"))


def rebuilt(convs: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin as the first of their block of ids does: the first h turns of conversation c - c % block, then
    the own ones after the first h, where h is crc32(c) % most. Of a conversation that is not there no turns are taken."""
    convs = scratch.save(convs, "conversations")
    base = F.col("conv_id") - F.col("conv_id") % block
    heads = convs.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("__base"), F.slice("path", 1, most - 1).alias("__path"), F.slice("words", 1, most - 1).alias("__words")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = convs.withColumns({"__base": base, "__h": h}).join(heads, "__base", "left")

    def put(own: str, head: str, kind: str):
        taken = F.when(F.col("__h") > 0, F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("__h"))).otherwise(F.array().cast(kind))
        return F.concat(taken, F.slice(own, F.col("__h") + 1, F.size(own)))

    return rows.select("conv_id", put("path", "__path", "array<binary>").alias("path"), put("words", "__words", "array<int>").alias("words"))


def _classes(convs: DataFrame) -> DataFrame:
    """(path, words, n, conv, ends) of each different sequence: its conversations, the smallest of them, and the digest of their ids."""
    marked = convs.withColumn("cls", F.sha2(F.array_join(F.transform("path", F.hex), ""), 256)).withColumn("range", F.floor(F.col("conv_id") / SPAN))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    ranges = marked.groupBy("cls", "range").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), ids.alias("ids"))
    return ranges.repartition("cls").sortWithinPartitions("cls", "range").mapInArrow(_ends, "path array<binary>, words array<int>, n long, conv long, ends string")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one class, in order, as one; it may go on in the next batch."""
    kinds = [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    made: list[list] = [[] for _ in kinds]
    last, held, digest = None, [], hashlib.sha256()

    def close() -> None:
        if held:
            for column, value in zip(made, [*held, digest.hexdigest()], strict=True):
                column.append(value)

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)], ["path", "words", "n", "conv", "ends"])

    for batch in batches:
        for cls, path, words, n, conv, ids in zip(*(batch.column(c).to_pylist() for c in ("cls", "path", "words", "n", "conv", "ids")), strict=True):
            if cls == last:
                held[2], held[3] = held[2] + n, min(held[3], conv)
                digest.update(f",{ids}".encode())
            else:
                close()
                last, held, digest = cls, [path, words, n, conv], hashlib.sha256(ids.encode())
        if made[0]:
            yield batch_of()
            made = [[] for _ in kinds]
    close()
    if made[0]:
        yield batch_of()


def _subtries(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of a bucket. A node is a number; ``below`` holds its pointers by the digest of the turn that follows."""
    tops: dict[str, int] = {}
    below: list[dict[bytes, int]] = []
    parent, depth, words, n, conv, ends = [], [], [], [], [], []

    def node(above: int, at: int, count: int) -> int:
        below.append({})
        for column, value in ((parent, above), (depth, at), (words, count), (n, 0), (conv, None), (ends, EMPTY)):
            column.append(value)
        return len(below) - 1

    over: dict[int, tuple[str, int]] = {}
    for key, parent_key, parent_conv, at_depth, path, counts, many, smallest, digest in zip(
        *(frame[c] for c in ("key", "parent_key", "parent_conv", "depth", "path", "words", "n", "conv", "ends")), strict=True
    ):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, at_depth, counts[0])
            over[at] = parent_key, parent_conv
        for i in range(len(path)):
            if i:
                to = below[at].get(path[i])
                if to is None:
                    to = below[at][path[i]] = node(at, at_depth + i, counts[i])
                at = to
            n[at] += many
            conv[at] = smallest if conv[at] is None else min(conv[at], smallest)
        ends[at] = digest
    leaves, saved = [0] * len(below), [(m - 1) * w for m, w in zip(n, words, strict=True)]
    stack = [(at, False) for at in tops.values()]
    while stack:
        at, done = stack.pop()
        if not done:
            stack.append((at, True))
            stack.extend((to, False) for to in below[at].values())
            continue
        leaves[at] = leaves[at] or 1
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    rows = [
        (conv[i], depth[i], conv[parent[i]] if parent[i] >= 0 else over[i][1], n[i], len(below[i]), leaves[i], saved[i], ends[i], over[i][0] if i in over else None) for i in range(len(below))
    ]
    return pd.DataFrame(rows, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_key"])


def _shared(group: DataFrame) -> DataFrame:
    """Trunk nodes of open subtries: for each key its conversations, and how many turns after it all its sequences share."""
    made = group.groupBy("key", "parent_key", "parent_conv", "depth", "own").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("words", "path").alias("words")
    )
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    common = F.when(F.col("key") == "", 0).when(differ > 0, differ - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int")
    return made.withColumn("common", common).select("key", "parent_key", "parent_conv", "depth", F.concat(F.array("own"), F.slice("words", F.lit(1), F.col("common"))).alias("chain"), "n", "conv", "common")


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of a trunk, from its top to where it branches: they differ in depth, children and what is saved below."""
    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            total = r.saved
            made = []
            for i in reversed(range(len(r.chain))):
                last = i == len(r.chain) - 1
                total += (r.n - 1) * int(r.chain[i])
                made.append((r.conv, r.depth + i, (None if pd.isna(r.parent_conv) else r.parent_conv) if i == 0 else r.conv, r.n, r.n_children if last else 1, r.n_leaves, total, r.ends if last else EMPTY, r.parent_key if i == 0 else None))
            rows += made
        out = pd.DataFrame(rows, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_key"])
        yield out.astype({"parent_conv_id": "Int64"})


def prefix_trie(convs: DataFrame, largest: int = LARGEST, bucket: int = BUCKET) -> DataFrame:
    """One row for each prefix of ``convs`` (conv_id, path, words): conv_id (the smallest member's), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (words that members after the first need not repeat, in the whole subtree) and ends_sha256."""
    spark = convs.sparkSession
    held: list[str] = []
    group = _classes(convs).select(
        F.lit("").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("long").alias("parent_conv"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("own"), "path", "words", "n", "conv", "ends"
    )
    group = scratch.save(group, "sequences", held)
    trunks, ended, nodes = [], [], None
    while True:
        trunk = scratch.save(_shared(group), "trunk", held)
        trunks.append(trunk)
        reached = group.select("key", "path", "words", "n", "conv", "ends").join(scratch.bounded(trunk.select("key", F.col("conv").alias("parent_conv"), F.col("common"), (F.col("depth") + F.col("common") + 1).alias("depth")), 256), "key")
        after = reached.withColumns({c: F.slice(c, F.col("common") + 1, F.size(c)) for c in ("path", "words")})
        following = after.select(
            F.when(F.size("path") > 0, F.sha2(F.concat("key", F.hex(F.get("path", F.lit(0)))), 256)).alias("key"), F.col("key").alias("parent_key"), "parent_conv", "depth", "path", "words", "n", "conv", "ends"
        )
        below = scratch.save(following, "below", held)
        ended.append(below.where("key is null").select(F.col("parent_key").alias("key"), "ends"))
        below = below.where("key is not null")
        sizes = below.groupBy("key").agg(F.sum(F.size("path")).alias("turns"), F.count("*").alias("sequences"))
        large = scratch.save(sizes.where((F.col("turns") > largest) & (F.col("sequences") > 1)).select("key"), "large", held)
        some = not large.isEmpty()
        small = below.join(scratch.bounded(large, 128), "key", "left_anti") if some else below
        turns = small.agg(F.sum(F.size("path"))).first()[0] or 0
        if turns:
            dealt = small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(turns // bucket + 1)))
            made = scratch.save(dealt.groupBy("bucket").applyInPandas(_subtries, f"{_NODE}, parent_key string"), "nodes")
            nodes = made if nodes is None else nodes.unionByName(made)
        if not some:
            break
        rest = below.join(scratch.bounded(large, 128), "key", "left_semi")
        group = rest.select("key", "parent_key", "parent_conv", "depth", F.get("words", F.lit(0)).alias("own"), F.slice("path", F.lit(2), F.size("path")).alias("path"), F.slice("words", F.lit(2), F.size("words")).alias("words"), "n", "conv", "ends")
        group = scratch.save(group, "sequences", held)
    empty = spark.createDataFrame([], f"{_NODE}, parent_key string")
    nodes = empty if nodes is None else nodes
    tops = nodes.where("parent_key is not null")
    for trunk, end in zip(reversed(trunks), reversed(ended), strict=True):
        sums = tops.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        rows = trunk.join(sums, "key", "left").join(end, "key", "left")
        rows = rows.select(
            "parent_key", "parent_conv", "depth", "chain", "n", "conv", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends")
        )
        made = scratch.save(rows.mapInPandas(_chains, f"{_NODE}, parent_key string"), "trunk-nodes")
        nodes = nodes.unionByName(made)
        tops = nodes.where("parent_key is not null")
    scratch.remove(spark, held)
    return nodes.drop("parent_key")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(sequences(conversations)))
