"""Removal of long word passages that an earlier document already has, over a compacted de Bruijn graph.

The windows of ``window`` words are the edges of a word-level de Bruijn graph. As edges are as many as the words of the
corpus, runs of consecutive edges whose smallest ``anchor``-word k-mer is the same are compacted within their document first
(*segments*, some 7 in 100 words); equal windows have equal smallest k-mers, so they meet under the same anchor:

1. anchors that occur once in the corpus are unrepeated edges and leave at once (count by anchor, join);
2. an anchor under which all occurrences have equal content does not branch: it is one node, with the set of what
   follows and what precedes it in its documents. Where a node has one follower only, and that one it only before it (out-degree
   and in-degree 1, ends of documents and unrepeated neighbours counted), the two are linked; links are compacted into paths
   by joins that double the way to the path's head in every round. A path is one row, and each of its occurrences is one;
3. where an anchor has several contents the graph branches: one source occurrence of each content is read again at its
   coordinates and cut into its windows, whose 128-bit hashes give the first place of each window; runs of windows whose
   places follow each other are put together;
4. each occurrence of a path or of such a run that begins in a document with a smaller doc_id is verified: both spans are read
   at their coordinates, and only if the digests of their words are equal is the span removed. Hashes only propose.

No step lists pairs of documents, and every copy of a passage is one row until its own interval is returned.

Defined results: null texts have no words; texts under ``window`` words lose nothing; rows with equal doc_id do not
remove from each other; a null doc_id neither removes nor is removed from; repeated rows give repeated rows. Rows
are told apart by doc_id and a hash of the text, so one doc_id with several texts is handled row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .text import BASE_2, Prefix, blocks, lists, mix, signed, words

WINDOW = 50
ANCHOR = 25


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have :]) if have < width else m


def _segments(data, offsets, window: int, anchor: int):
    """Row, first window, number of windows, anchor hash and content hash of each segment of a block."""
    w = words(data, offsets)
    n_windows = np.maximum(0, w.counts() - window + 1)
    if not n_windows.sum():
        return None
    h = w.hashes()
    one = Prefix(h)
    total = len(h)
    at = np.arange(total - anchor + 1)
    low = _smallest(one.spans(at, at + anchor), window - anchor + 1)
    rows = np.repeat(np.arange(len(n_windows)), n_windows)
    begun = np.zeros(len(n_windows), np.int64)
    np.cumsum(n_windows[:-1], out=begun[1:])
    local = np.arange(len(rows)) - begun[rows]
    place = w.doc[rows] + local  # of each window's first word in the block
    key = low[place]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(key)))
    ends = place[first] + length + window - 1
    return rows[first], local[first], length, key[first], one.spans(place[first], ends)


def _anchors(window: int, anchor: int, only_key: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi, data, offsets in blocks(text):
                found = _segments(data, offsets, window, anchor)
                if found is None:
                    continue
                rows, first, length, key, content = found
                if only_key:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key))], ["anchor"])
                    continue
                take = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(key)),
                        pa.array(signed(content)),
                        batch.column("doc_id").take(take),
                        batch.column("h").take(take),
                        pa.array(first.astype(np.int32)),
                        pa.array(length.astype(np.int32)),
                    ],
                    ["anchor", "content", "doc_id", "h", "first", "length"],
                )

    return run


def _cut(window: int):
    """Windows of the segments that ``parts`` names, with 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            for lo, hi, data, offsets in blocks(batch.column("text")):
                w = words(data, offsets)
                h = w.hashes()
                one, two = Prefix(h), Prefix(mix(h), BASE_2)
                flat = parts.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), flat.value_lengths().to_numpy(zero_copy_only=False))
                part = flat.flatten()
                anchor, content, first, length = (part.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                which = np.repeat(np.arange(len(row)), length)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
                start = w.doc[row[which]] + first[which] + offset
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(one.spans(start, start + window))),
                        pa.array(signed(two.spans(start, start + window))),
                        pa.array(anchor[which]),
                        pa.array(content[which]),
                        pa.array(offset.astype(np.int32)),
                        *(batch.column(c).slice(lo, hi - lo).take(pa.array(row[which])) for c in ("doc_id", "h")),
                        pa.array((first[which] + offset).astype(np.int32)),
                    ],
                    ["w1", "w2", "anchor", "content", "at", "doc_id", "h", "place"],
                )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of each span that a row asks for (``spans``: first, words, first, words, ...)."""
    for batch in batches:
        for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)):
            w = text.as_py().encode().split()  # bytes split at ASCII white space
            found = [hashlib.blake2b(b" ".join(w[a : a + n]), digest_size=16).digest() for a, n in zip(spans[::2], spans[1::2], strict=True)]
            same = pa.array(np.full(len(found), i))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(same) for c in ("doc_id", "h")), pa.array(spans[::2], pa.int32()), pa.array(spans[1::2], pa.int32()), pa.array(found, pa.binary())], ["doc_id", "h", "first", "words", "digest"]
            )


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged word intervals of a document from its removed spans."""
    for batch in batches:
        outs, counts = [], []
        for found in batch.column("found").to_pylist():
            spans = np.array(sorted((x["first"], x["first"] + x["words"]) for x in found))
            ends = np.maximum.accumulate(spans[:, 1])
            gap = np.flatnonzero(spans[1:, 0] > ends[:-1])
            outs.append(np.stack([spans[np.append(0, gap + 1), 0], ends[np.append(gap, len(ends) - 1)]], 1).ravel())
            counts.append(len(outs[-1]))
        flat = np.concatenate(outs) if outs else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), lists(flat.astype(np.int32), np.asarray(counts, np.int64), pa.int32())], ["doc_id", "h", "cuts"])


def _paths(single: DataFrame, done: list[str]) -> DataFrame:
    """(anchor, source, last, length): the head of each path of unbranched segments, its first occurrence, the largest doc_id that has
    it, and its windows. ``single``: occurrences (anchor, doc_id, h, first, length)."""
    inside = Window.partitionBy("doc_id", "h").orderBy("first")
    after = F.when(F.lead("first").over(inside) == F.col("first") + F.col("length"), F.lead("anchor").over(inside))
    before = F.when(F.lag(F.col("first") + F.col("length")).over(inside) == F.col("first"), F.lag("anchor").over(inside))
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    nodes = single.withColumns({"after": after, "before": before}).groupBy("anchor").agg(
        one("after").alias("after"), one("before").alias("before"), F.min(F.struct("doc_id", "h", "first")).alias("source"), F.max("doc_id").alias("last"), F.first("length").alias("length")
    )
    nodes = scratch.save(nodes, "nodes", done)
    links = nodes.where("after is not null").select("anchor", "after", "length").join(nodes.where("before is not null").select(F.col("anchor").alias("after"), F.col("before").alias("anchor")), ["anchor", "after"])
    up = scratch.save(links.select(F.col("after").alias("anchor"), F.col("anchor").alias("up"), F.col("length").cast("long").alias("way")), "up", done)
    while True:
        more = up.select(F.col("anchor").alias("up"), F.col("up").alias("further"), F.col("way").alias("rest"))
        step = scratch.save(up.join(more, "up", "left").select("anchor", F.coalesce("further", "up").alias("up"), (F.col("way") + F.coalesce("rest", F.lit(0))).alias("way"), F.col("further").isNotNull().alias("moved")), "up", done)
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    whole = up.join(nodes.select("anchor", "length"), "anchor").groupBy(F.col("up").alias("anchor")).agg(F.max(F.col("way") + F.col("length")).alias("whole"))
    heads = nodes.join(up.select("anchor"), "anchor", "left_anti").join(whole, "anchor", "left")
    return scratch.save(heads.select("anchor", "source", "last", F.coalesce("whole", "length").cast("int").alias("length")), "paths", done)


def _branches(texts: DataFrame, tagged: DataFrame, window: int, done: list[str]) -> DataFrame:
    """(anchor, content, at, length, source): runs of windows of a branching segment whose first places follow each other, ``at`` windows from
    its begin; ``source`` is the place of the run's first window."""
    contents = tagged.where("contents > 1").groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "h", "first")).alias("source"), F.first("length").alias("length"))
    parts = scratch.save(
        contents.groupBy("source.doc_id", "source.h").agg(F.collect_list(F.struct("anchor", "content", F.col("source.first").alias("first"), "length")).alias("parts"), F.count("*").alias("n")), "parts", done
    )
    size = int(parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * 48
    side = parts.select("doc_id", "h", "parts")
    reread = texts.join(F.broadcast(side) if size <= 32 << 20 else side, ["doc_id", "h"])
    windows = scratch.save(reread.mapInArrow(_cut(window), "w1 long, w2 long, anchor long, content long, at int, doc_id long, h long, place int"), "windows", done)
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "h", "place")).alias("source"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "source")
    placed = windows.join(scratch.save(first, "shared", done), ["w1", "w2"], "left").select("anchor", "content", "at", F.coalesce("source", F.struct("doc_id", "h", "place")).alias("source")).distinct()
    run = ["anchor", "content", "source.doc_id", "source.h", (F.col("source.place") - F.col("at")).alias("shift")]
    placed = placed.select("at", *run)
    island = F.col("at") - F.row_number().over(Window.partitionBy("anchor", "content", "doc_id", "h", "shift").orderBy("at"))
    runs = placed.withColumn("island", island).groupBy("anchor", "content", "doc_id", "h", "shift", "island").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("length"))
    return runs.select("anchor", "content", "at", "length", F.struct("doc_id", "h", (F.col("shift") + F.col("at")).alias("first")).alias("source"))


_SPAN = ("doc_id", "h", "first", "words", "s_doc", "s_h", "s_first")


def _verified(texts: DataFrame, hits: DataFrame, done: list[str]) -> DataFrame:
    """``hits`` (written; _SPAN: a span and the place of its source) with ``same``: whether both read the same words."""
    asked = hits.select("doc_id", "h", "first", "words").unionByName(hits.select(F.col("s_doc").alias("doc_id"), F.col("s_h").alias("h"), F.col("s_first").alias("first"), "words")).distinct()
    asked = scratch.save(asked.groupBy("doc_id", "h").agg(F.flatten(F.collect_list(F.array("first", "words"))).alias("spans")), "asked", done)
    size = int(asked.agg(F.coalesce(F.sum(F.size("spans") * 4 + 48), F.lit(0))).first()[0])
    read = texts.join(F.broadcast(asked) if size <= 32 << 20 else asked, ["doc_id", "h"])
    digests = read.mapInArrow(_digests, "doc_id long, h long, first int, words int, digest binary").groupBy("doc_id", "h", "first", "words").agg(F.first("digest").alias("digest"))
    digests = scratch.save(digests, "digests", done)
    of_source = digests.toDF("s_doc", "s_h", "s_first", "words", "expected")
    both = hits.join(digests, ["doc_id", "h", "first", "words"]).join(of_source, ["s_doc", "s_h", "s_first", "words"])
    return scratch.save(both.select(*hits.columns, (F.col("digest") == F.col("expected")).alias("same")), "verified", done)


def _proven(texts: DataFrame, hits: DataFrame, done: list[str]) -> DataFrame:
    """The spans (doc_id, h, first, words) of ``hits`` whose words are those of their source. Spans that overlap and whose sources
    overlap alike are read as one; should such a whole differ from its source, its parts are read one by one."""
    key = ["doc_id", "h", "s_doc", "s_h", "shift"]
    order = Window.partitionBy(*key).orderBy("first", "words")
    reach = F.max(F.col("first") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.distinct().withColumn("shift", F.col("first") - F.col("s_first")).withColumn("begins", F.when(F.col("first") <= reach, 0).otherwise(1))
    rows = scratch.save(rows.withColumn("whole", F.sum("begins").over(order)).drop("begins"), "spans", done)
    whole = rows.groupBy(*key, "whole").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("words")).alias("to"))
    whole = whole.select("doc_id", "h", "first", (F.col("to") - F.col("first")).alias("words"), "s_doc", "s_h", (F.col("first") - F.col("shift")).alias("s_first"), "shift", "whole")
    checked = _verified(texts, scratch.save(whole, "whole", done), done)
    proven = checked.where("same").select("doc_id", "h", "first", "words")
    if checked.where("not same").isEmpty():
        return proven
    parts = rows.join(checked.where("not same").select(*key, "whole"), [*key, "whole"], "left_semi").select(*_SPAN)
    return proven.unionByName(_verified(texts, scratch.save(parts, "parts", done), done).where("same").select("doc_id", "h", "first", "words"))


def repeated_intervals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, h, cuts): for each document that loses words, the flat word intervals [from, to) to remove."""
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    spark, early, done, late = docs.sparkSession, [], [], []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("text is not null and doc_id is not null")
    repeated = scratch.save(
        texts.mapInArrow(_anchors(window, anchor, True), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors", early
    )
    occurrences = scratch.save(
        texts.mapInArrow(_anchors(window, anchor, False), "anchor long, content long, doc_id long, h long, first int, length int").join(repeated, "anchor"), "occurrences", early
    )
    fan = occurrences.groupBy("anchor").agg(F.when(F.min("content") == F.max("content"), 1).otherwise(2).alias("contents"))
    tagged = scratch.save(occurrences.join(scratch.save(fan, "fan", early), "anchor"), "tagged", done)
    scratch.remove(spark, early)
    single = tagged.where("contents = 1")
    paths = _paths(single.select("anchor", "doc_id", "h", "first", "length"), early)
    paths = scratch.save(paths.where("last > source.doc_id"), "repeated", done)
    scratch.remove(spark, early)
    runs = scratch.save(_branches(texts, tagged, window, early), "runs", done)
    scratch.remove(spark, early)
    span = lambda first: ["doc_id", "h", first.alias("first"), (F.col("length") + window - 1).alias("words"), F.col("source.doc_id").alias("s_doc"), F.col("source.h").alias("s_h"), F.col("source.first").alias("s_first")]
    hits = single.select("anchor", "doc_id", "h", "first").join(paths, "anchor").where("source.doc_id < doc_id").select(*span(F.col("first")))
    branching = tagged.where("contents > 1").select("anchor", "content", "doc_id", "h", "first").join(runs, ["anchor", "content"]).where("source.doc_id < doc_id")
    hits = scratch.save(hits.unionByName(branching.select(*span(F.col("first") + F.col("at")))), "hits", late)
    scratch.remove(spark, done)
    proven = _proven(texts, hits, late)
    cuts = scratch.save(proven.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "words")).alias("found")).mapInArrow(_intervals, "doc_id long, h long, cuts array<int>"), "cuts")
    scratch.remove(spark, late)
    return cuts


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts = batch.column("text"), batch.column("cuts")
        out = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": []}
        for text, cut in zip(texts, cuts, strict=True):
            kept = (text.as_py() or "").encode().split()  # bytes split at ASCII white space
            n, gone = len(kept), 0
            for a, b in reversed(list(zip((c := cut.as_py() or [])[::2], c[1::2], strict=True))):
                gone += b - a
                del kept[a:b]
            out["n_words"].append(n)
            out["n_removed"].append(gone)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], list(out))


def _with_cuts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """All rows of ``docs``, with their cuts where they have some."""
    size = int(cuts.agg(F.coalesce(F.sum(F.size("cuts") * 4 + 24), F.lit(0))).first()[0])
    side = cuts.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("cuts").alias("__cuts"))
    side = F.broadcast(side) if size <= 32 << 20 else side
    return docs.join(side, (docs["doc_id"].cast("long") == side["__id"]) & (F.xxhash64(docs["text"]) == side["__h"]), "left").drop("__id", "__h")


def substring_digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: words, words removed, and the digest of the kept words joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = repeated_intervals(docs, window, anchor)
    return _with_cuts(docs, cuts).withColumnRenamed("__cuts", "cuts").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs`` with repeated passages taken out; a text that loses words has its kept words joined by one
    space (and n_chars, where there is such a column, counted anew), any other stays as it is."""

    @F.pandas_udf("string")
    def cut(text, cuts):
        def one(t, c):
            kept = t.encode().split()
            for a, b in reversed(list(zip(c[::2], c[1::2], strict=True))):
                del kept[a:b]
            return b" ".join(kept).decode()

        return text.combine(cuts, lambda t, c: t if c is None else one(t, c))

    joined = _with_cuts(docs, repeated_intervals(docs, window, anchor))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(cut("text", "__cuts"))
    out = joined.withColumn("__text", text)
    made = {"text": F.col("__text")} | ({"n_chars": F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(dict(docs.dtypes)["n_chars"]))} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])
