"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A signature needs two permutations of the 32-bit universe only: the first scatters the shingles, the second is shifted
circularly by 0, 1, 2, ... and its minimum over the set is taken at each shift. ``bands`` bands of ``rows``
coordinates are bucket keys; with 30 bands of 5 a pair at the threshold 0.85 shares no band with probability
(1 - 0.85**5)**30, about 2e-8. Every pair that is linked was confirmed on the two full shingle sets.

Equal sets are one class from the start. Classes that share a bucket are not expanded into all pairs: each bucket
compares one hub with its members (a star), and links join components. A compared member is kept as its difference
from the hub, a bitmap and the few shingles that the hub lacks, from which two members are compared exactly without
their sets. Members outside of their hub's component meet pivots first and then all members in other components. So
two classes of one bucket end in one component or have been compared: no link that banding finds is lost for the
components.

Defined results: null, empty and word-less texts have an empty set, link with nothing and stay. Texts of fewer words
than a shingle have the whole sequence as their one shingle. Repeated rows are equal sets, so they are linked. Classes
of different texts whose smallest doc_id is the same are one node. A row with a null doc_id joins the component of an
equal set that has an id; without one it stays by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .text import BASE_2, Prefix, blocks, lists, mix, signed, words

BANDS, ROWS = 30, 5
_C = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1, 0x7FEB352D)]
_S = [np.uint32(x) for x in (16, 13, 15, 17)]


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe."""
    x = (x ^ (x >> _S[2])) * _C[3]
    return x ^ (x >> _S[3])


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, which is shifted circularly; works in place."""
    x ^= x >> _S[0]
    x *= _C[0]
    x ^= x >> _S[1]
    x *= _C[1]
    x ^= x >> _S[0]
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a non-empty set of 64-bit shingle hashes."""
    at = scatter((shingles >> np.uint64(32)).astype(np.uint32))
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 512):
        np.minimum(out, permute(at[None, i : i + 512] - shift).min(axis=1), out=out)
    return out


def shingle_sets(data, offsets, k: int):
    """The sorted distinct shingle hashes of each row of a block."""
    w = words(data, offsets, lower=True)
    h = w.hashes()
    one = Prefix(h)
    n = w.counts()
    first = np.repeat(w.doc[:-1], np.maximum(n - k + 1, n > 0))
    count = np.maximum(n - k + 1, n > 0)
    begun = np.append(0, np.cumsum(count))
    start = first + np.arange(len(first)) - np.repeat(begun[:-1], count)
    end = np.minimum(start + k, np.repeat(w.doc[1:], count))
    keys = one.spans(start, end)
    return [np.unique(keys[begun[i] : begun[i + 1]]) for i in range(len(n))]


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                n = np.asarray([len(s) for s in sets], np.int64)
                keys, d1, d2 = [], np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        sig = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                        x = np.arange(1, bands + 1, dtype=np.uint64)
                        for c in range(rows):
                            x = mix(x + sig[:, c])
                        keys.append(x)
                        d1[i], d2[i] = Prefix(s).sums[-1], Prefix(mix(s), BASE_2).sums[-1]
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "t1", "t2")), pa.array(n), pa.array(signed(d1)), pa.array(signed(d2)), lists(signed(flat), np.where(n > 0, bands, 0), pa.int64())],
                    ["doc_id", "t1", "t2", "n_shingles", "d1", "d2", "keys"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("cls", "hubs", "is_hub")), lists(signed(flat), np.asarray([len(s) for s in sets], np.int64), pa.int64())],
                    ["cls", "hubs", "is_hub", "items"],
                )

    return run


def _compare(percent: int):
    """For each pair of a hub ``a`` and a member ``b``: their common shingles, and ``b`` as its difference from the hub:
    which of the hub's sorted shingles it lacks (bits) and which others it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_hub": [], "n": [], "linked": [], "lacks": [], "others": []}
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                common = np.intersect1d(x, y, assume_unique=True)
                bits = np.zeros(-(-len(x) // 64) * 64, bool)
                bits[: len(x)] = True
                bits[np.searchsorted(x, common)] = False
                out["n_hub"].append(len(x))
                out["n"].append(len(y))
                out["linked"].append(100 * len(common) >= percent * (len(x) + len(y) - len(common)))
                out["lacks"].append(np.packbits(bits).view(np.int64))
                out["others"].append(np.setdiff1d(y, common, assume_unique=True).view(np.int64))
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("of"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["a", "b", "of", *out])

    return run


def _compared(sets: DataFrame, percent: int) -> DataFrame:
    """Each member's set goes to each of its hubs once, and a hub's own set once."""
    members = sets.select(F.explode("hubs").alias("a"), F.col("cls").alias("b"), F.col("items").alias("items_b")).where("a <> b")
    hubs = sets.where("is_hub").select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    both = members.join(hubs, "a").withColumn("of", F.xxhash64("items_a"))
    return both.mapInArrow(_compare(percent), "a long, b long, of long, n_hub int, n int, linked boolean, lacks array<long>, others array<long>")


def _linked(percent: int):
    """Whether members x and y of one hub meet the threshold, exactly: of the hub's shingles they share those that neither
    lacks, and of the others those that both have. The sizes, then the hub's part, are tried first."""
    small, large = "least(x_n, y_n)", "greatest(x_n, y_n)"
    hub = "(n_hub - aggregate(zip_with(x_lacks, y_lacks, (p, q) -> bit_count(p | q)), 0, (s, v) -> s + v))"
    enough = "{common} * " + f"{100 + percent} >= {percent} * (x_n + y_n)"
    return (
        F.expr(f"100 * {small} >= {percent} * {large}")
        & F.expr(enough.format(common=f"({hub} + least(size(x_others), size(y_others)))"))
        & F.expr(enough.format(common=f"({hub} + size(array_intersect(x_others, y_others)))"))
    )


#: A hub's comparisons are dealt into a grid of blocks, each of at most about so many members against as many.
BLOCK_MEMBERS = 512


def _across(members: DataFrame, pivots: DataFrame | None, percent: int) -> DataFrame:
    """Links between members of one hub that are in different components: of each with its hub's pivot, or (without
    pivots) of each that is outside of its hub's component with every other. Both sides are dealt into a grid of blocks, as
    many as the hub's comparisons need, so that no task gets a large hub whole; only links leave the join."""
    tall = F.lit(1) if pivots is not None else F.col("tall")
    deal = lambda n: F.pmod(F.xxhash64("b"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = members.where("comp <> hub_comp").select("a", "of", "n_hub", *[F.col(c).alias(f"x_{c}") for c in ("b", "n", "comp", "lacks", "others")], deal(F.col("wide")).alias("i"), every(tall).alias("j"))
    y = members if pivots is None else members.join(pivots.select("a", F.col("pivot").alias("b")), ["a", "b"])
    y = y.select("a", "of", *[F.col(c).alias(f"y_{c}") for c in ("b", "n", "comp", "hub_comp", "lacks", "others")], deal(tall).alias("j"), every(F.col("wide")).alias("i"))
    once = F.lit(True) if pivots is not None else (F.col("y_comp") == F.col("y_hub_comp")) | (F.col("x_b") < F.col("y_b"))
    met = x.join(y, ["a", "of", "i", "j"]).where((F.col("x_comp") != F.col("y_comp")) & once & _linked(percent))
    return met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()


def components(links: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(cls, comp): the smallest node reachable from each node that has a link. Labels spread over links and then jump to
    their own label, so long chains shorten by halves; every round is a written table."""
    edges = scratch.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", held)
    labels = scratch.save(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("comp")), "labels", held)
    while True:
        near = edges.join(labels.withColumnRenamed("cls", "a"), "a").groupBy(F.col("b").alias("cls")).agg(F.min("comp").alias("near"))
        spread = scratch.save(labels.join(near, "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "spread", held)
        jump = spread.select(F.col("cls").alias("comp"), F.col("comp").alias("next"))
        after = scratch.save(spread.join(jump, "comp", "left").select("cls", "was", F.least(F.col("comp"), F.coalesce("next", "comp")).alias("comp")), "labels", held)
        labels = after.select("cls", "comp")
        if after.where("was <> comp").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id linked to it, directly or not; its own where
    nothing is linked) and kept (doc_id = component_id)."""
    return _grouped(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_duplicates`` with t1 and t2, a 128-bit hash of the text."""
    held: list[str] = []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    signed_docs = scratch.save(hashed.mapInArrow(_signatures(k, bands, rows), "doc_id long, t1 long, t2 long, n_shingles long, d1 long, d2 long, keys array<long>"), "signatures", held)
    # Equal sets are one class, which the smallest doc_id stands for.
    rep = scratch.save(
        signed_docs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("cls"), F.first("keys").alias("keys")), "classes", held
    )
    members = rep.select("cls", F.explode("keys").alias("key"))
    full = scratch.save(members.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).where("n > 1"), "buckets", held)
    members = scratch.save(members.join(full, "key").select("key", "cls", "hub"), "bucketed", held)
    pairs = scratch.save(members.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "pairs", held)
    # Of each member its hubs (at most one a band), and whether it is one.
    asked = pairs.select(F.col("b").alias("cls"), F.col("a").alias("hub")).unionByName(pairs.select(F.col("a").alias("cls"), F.lit(None).cast("long").alias("hub")))
    wanted = scratch.save(asked.groupBy("cls").agg(F.collect_set("hub").alias("hubs"), F.max(F.col("hub").isNull()).alias("is_hub")), "wanted", held)
    sets = texts.join(scratch.bounded(wanted, 48 + 8 * bands).withColumnRenamed("cls", "doc_id"), "doc_id").withColumnRenamed("doc_id", "cls")
    sets = scratch.save(sets.mapInArrow(_sets(k), "cls long, hubs array<long>, is_hub boolean, items array<long>"), "sets", held)
    compared = scratch.save(_compared(sets, percent), "compared", held)
    links = compared.where("linked").select("a", "b").distinct()
    labels = components(links, held)
    seen = 0
    while True:
        # Members of a hub share a bucket with it, though not all with each other: a few more comparisons, none fewer.
        where = lambda c, name: labels.select(F.col("cls").alias(c), F.col("comp").alias(name))  # noqa: B023, E731
        members = compared.drop("linked").join(where("b", "own"), "b", "left").join(where("a", "of_hub"), "a", "left")
        members = members.withColumns({"comp": F.coalesce("own", "b"), "hub_comp": F.coalesce("of_hub", "a")}).drop("own", "of_hub")
        hubs = members.groupBy("a").agg(
            F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("hub_comp")).alias("out"), F.min_by(F.when(F.col("comp") != F.col("hub_comp"), F.col("b")), F.when(F.col("comp") != F.col("hub_comp"), F.xxhash64("b", F.lit(seen)))).alias("pivot")
        )
        hubs = scratch.save(hubs.where("out > 0 and m > 1"), "hubs", held)
        work, outside = hubs.agg(F.coalesce(F.sum(F.col("out") * F.col("m")), F.lit(0)), F.coalesce(F.sum("out"), F.lit(0))).first()
        grid = [F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int").alias(name) for c, name in (("out", "wide"), ("m", "tall"))]
        members = scratch.save(members.join(hubs.select("a", *grid), "a"), "members", held)
        # Groups of close texts that are far from their hub meet by pivots, one a round, as long as these link many.
        last = work <= 32 * outside or seen and linked * 8 < outside
        found = scratch.save(_across(members, None if last else hubs, percent), "links", held)
        linked = found.count()
        if linked:
            links = scratch.save(links.unionByName(found), "links", held)
            labels = components(links, held)
        if last:
            break
        seen += 1
    named = rep.join(labels, "cls", "left").select("d1", "d2", F.coalesce("comp", "cls").alias("comp"))
    named = scratch.save(named, "named", held)
    out = signed_docs.select("doc_id", "t1", "t2", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    out = out.select("doc_id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "grouped")
    scratch.remove(docs.sparkSession, held)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 36) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those with the smallest doc_id of each component. Of repeated rows (equal doc_id
    and text) one stays, as does one of each text of a doc_id that stands for its group; a row without a doc_id goes if its set is that
    of a row that has one."""
    rows = _grouped(docs, k, percent, bands, ROWS)
    text, own = docs["text"].cast("string"), [f"__{uuid.uuid4().hex}" for _ in range(3)]  # no column of docs has such a name
    hashes = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own[0])) & (hashes[0] == F.col(own[1])) & (hashes[1] == F.col(own[2]))
    named = lambda x: scratch.bounded(x.toDF(*own), 32)
    gone = scratch.save(rows.where("not kept").select("doc_id", "t1", "t2").distinct(), "gone")
    again = scratch.save(rows.where("kept").groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    kept = docs.join(named(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    repeated = docs.join(named(again), same, "left_semi").withColumns(dict(zip(own[1:], hashes, strict=True))).dropDuplicates(["doc_id", *own[1:]]).select(*docs.columns)
    return kept.join(named(again), same, "left_anti").unionByName(repeated)
