"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows scans each text once.

Texts and benchmark items are normalised to lower-case words. Every run of ``window`` item words (the whole item, if it is
shorter) is a pattern; the automaton's symbols are words, those of the benchmark by number and all others as 0, so that
matches are whole words and give word offsets, which lead back to byte offsets of the original text. The automaton is
built from the benchmark, a query set that does not grow with the corpus. Its size is checked first: up to ``block_bytes`` of
text it is one automaton, and each text is read once, without a shuffle or a join. A larger benchmark is cut into blocks; each
is an automaton and a pass of its own (a worker never holds two), of which only documents with hits come back, are merged by
row and joined to the documents.

Defined results: null or word-less texts have no words and no hits; null or word-less items have no window; repeated
items count once each by item_id; a null item_id is not listed, its windows still hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .text import LOWER, NOT_ALNUM

WINDOW = 10
BLOCK_BYTES = 4 << 20
_TABLE = bytes(0x20 if NOT_ALNUM[LOWER[i]] else int(LOWER[i]) for i in range(256))
SCHEMA = "n_words long, hits array<int>, items array<string>"


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def patterns(items: list[tuple[object, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each window of words, with the items it is from."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = normalised(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            held = found.setdefault(tuple(w[i : i + window]), set())
            if item is not None:
                held.add(str(item))
    return found


class Scanner:
    def __init__(self, found: dict[tuple[bytes, ...], set[str]]):
        self.number = {w: i for i, w in enumerate(sorted({w for key in found for w in key}), 1)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items in found.items():
            self.automaton.add_word(tuple(map(self.number.__getitem__, key)), (len(key), items))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """Words, merged flat word intervals [from, to) that are hit, and the items found."""
        w = normalised(text)
        if not w or not self.number:
            return len(w), [], set()
        of = self.number.get
        spans, items = [], set()
        for end, (n, ids) in self.automaton.iter(tuple([of(x, 0) for x in w])):
            spans.append((end + 1 - n, end + 1))
            items |= ids
        return len(w), _merged(spans), items


def _scan(shared, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            n_words, hits, items = zip(*(scanner.scan(t.as_py()) for t in batch.column("text")), strict=True) if len(batch) else ((), (), ())
            kept = [c for c in batch.schema.names if not only_hits or c != "text"]
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*kept, "n_words", "hits", "items"]
            )
            yield out.filter(pa.array([bool(x) for x in hits], pa.bool_())) if only_hits else out

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of rows without a hit, merged intervals of the others."""
    for batch in batches:
        hits = [_merged([(x[i], x[i + 1]) for x in parts or () for i in range(0, len(x), 2)]) for parts in batch.column("parts").to_pylist()]
        n_words = [n if n is not None else len(normalised(t.as_py())) for n, t in zip(batch.column("n_words").to_pylist(), batch.column("text"), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), batch.column("items")], ["doc_id", "text", "n_words", "hits", "items"]
        )


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator]:
    """How many blocks the benchmark has, and their patterns, broadcast one at a time; blocks go by a hash of the item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    n = max(1, -(-size // block_bytes))

    def each() -> Iterator:
        for k in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield spark.sparkContext.broadcast(patterns([(r[0], r[1]) for r in part.collect()], window))

    return n, each()


_ROW = {"__h": F.xxhash64, "__g": lambda text: F.xxhash64(F.lit(1), text)}


def _found(docs: DataFrame, blocks: Iterator) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with hits: doc_id and a 128-bit hash of the text, the intervals of each block, words and items.
    Each block is a written table, so that its automaton can leave."""
    keyed, kind = docs.where("text is not null").withColumns({c: f("text") for c, f in _ROW.items()}), dict(docs.dtypes)["doc_id"]
    out = None
    for shared in blocks:
        one = scratch.save(keyed.mapInArrow(_scan(shared, True), f"doc_id {kind}, __h long, __g long, {SCHEMA}"), "hits")
        out = one if out is None else out.unionByName(one)
    merged = out.groupBy(F.col("doc_id").alias("__id"), "__h", "__g").agg(F.first("n_words").alias("n_words"), F.collect_set("hits").alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return scratch.save(merged, "found")


def _same(docs: DataFrame):
    return docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h")) & (F.xxhash64(F.lit(1), docs["text"]) == F.col("__g"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and text of every row of ``docs``, its words, the word intervals hit (flat, merged) and the items found."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, {SCHEMA}"
    n, blocks = _blocks(benchmark, window, block_bytes)
    if n == 1:
        return docs.mapInArrow(_scan(next(blocks), False), schema)
    found = _found(docs, blocks)
    joined = docs.join(scratch.bounded(found, 1 << 10), _same(docs), "left")
    return joined.select("doc_id", "text", "n_words", "parts", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_count, schema)


def original_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Hit word intervals as UTF-8 byte ranges [from, to) of the text as it was."""
    flat = np.frombuffer(text.encode().translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([False], flat, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(hits[::2], hits[1::2], strict=True)]


def contamination_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, from_byte, to_byte, passage): every merged hit at its place in the original text."""

    def run(batches):
        for batch in batches:
            rows = [(i, a, b, t.encode()[a:b].decode()) for i, (t, h) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)) if h for a, b in original_spans(t, h)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))],
                ["doc_id", "from_byte", "to_byte", "passage"],
            )

    found = contamination(docs, benchmark, window)
    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, from_byte long, to_byte long, passage string")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    found = contamination(docs, benchmark, window)
    # Of flat intervals a1 b1 a2 b2 ..., the sum of every b less the sum of every a.
    hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not scanner.scan(t.as_py())[1] for t in batch.column("text")], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, as they are."""
    n, blocks = _blocks(benchmark, window, block_bytes)
    if n == 1:
        return docs.mapInArrow(_clean(next(blocks)), docs.schema)
    found = _found(docs.select("doc_id", F.col("text").cast("string").alias("text")), blocks)
    return docs.join(scratch.bounded(found.select("__id", "__h", "__g"), 32), _same(docs), "left_anti")
