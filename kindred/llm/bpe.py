"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A text is cut by the vocabulary's word pattern; each distinct word is merged once per worker: one array holds the part
boundaries and the rank of each adjacent pair, the smallest rank is found by a scan, its boundary is deleted and the
two neighbouring ranks are looked up anew. Words over ``SHORT`` bytes (one run of letters without a space, say) take
the same merges in the same order from a heap over linked parts, so that a long word costs n log n and not n squared.
The vocabulary file is a parameter and is read in each worker.

Defined results: null texts are encoded as empty ones (no tokens); a special token's text in a document is its id, as
the library does by default; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
#: Words remembered by a worker; at most so many, then it forgets them all.
REMEMBERED = 200_000
#: The pattern of words of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BITS, _NONE = 24, 1 << 60
_MASK = (1 << _BITS) - 1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.bytes = {i: raw[t] for t, i in model["vocab"].items()}
        self.byte_id = [0] * 256
        for t, i in model["vocab"].items():
            if len(raw[t]) == 1:
                self.byte_id[raw[t][0]] = i
        #: Of each pair of ids that merges (as one number), its rank and the merged id (as one number, in order of rank).
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[model["vocab"][a] << _BITS | model["vocab"][b]] = rank << _BITS | model["vocab"][a + b]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        rank_of = self.pairs.get
        ranks = [rank_of(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            ids[i] = least & _MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << _BITS | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << _BITS | ids[i + 1], _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if (p := pairs.get(ids[i] << _BITS | ids[i + 1])) is not None:
                heap.append((p, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = merged & _MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (p := pairs.get(ids[a] << _BITS | ids[b])) is not None:
                    heapq.heappush(heap, (p, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            for word in self.words.findall(piece):
                ids = known.get(word)
                if ids is None:
                    ids = tuple(self.merge(word.encode()))
                    if len(word) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                ids = [v.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(ids, pa.list_(pa.int32()))], [*(c for c in part.schema.names if c != "text"), "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [v.decode(x.as_py()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "ids"), pa.array(texts, pa.string())], [*(c for c in part.schema.names if c != "ids"), "text"])

    return run


def encode(docs: DataFrame, vocabulary_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids): the token ids of every whole text."""
    docs = docs.select(key, F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(vocabulary_path), f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode(tokens: DataFrame, vocabulary_path: str, key: str = "doc_id") -> DataFrame:
    """(key, text): the text of every row of token ids."""
    return tokens.select(key, "ids").mapInArrow(_decode(vocabulary_path), f"{key} {dict(tokens.dtypes)[key]}, text string")


def _digest(path: str):
    """Encodes, then decodes the ids, keeping only digests, so that neither list nor text leaves the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                n, digest, back = [], [], []
                for t in part.column("text"):
                    ids = v.encode(t.as_py() or "")
                    n.append(len(ids))
                    digest.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digest(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digest(vocabulary_path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
