"""Language-model scores from a probabilistic suffix tree over words, of whatever depth the texts bear out.

Symbols are the words that training has ``MIN_WORD`` times or more, one class for the other words of each last byte, and
the end of a text. All limits are counts, so that what is learned grows with the corpus. The tree grows level by level: a
context of n + 1 symbols is a candidate if its last n are retained and a symbol follows it twice; it is retained if
its (smoothed) next-symbol distribution diverges from that of its parent suffix by more than its parameters cost: over the n
symbols that follow it, ``sum(log(p / p_parent)) > 0.5 * distinct * log(n)``. Growth ends with the first level that retains none.
Next-symbol distributions are smoothed by absolute discounting into the parent's; next symbols seen under ``MIN_ENTRY`` times
are left to the parent. An entry's parent therefore has that entry too, and a token's score is its base score plus
one term for each level: ``log p / p_parent`` of an entry, or the log of what a retained context leaves over.

How it runs: each distinct text is a row of symbol numbers in a written table. Every position (a symbol, its text's number, the ``DEPTH``
symbols before it) goes to the bucket of the symbol before it, as packed arrays. All positions of a context of one symbol
meet there, so that a bucket grows the whole tree below it, level by level, and gives each position its terms at once; neither entries
nor scores are looked up elsewhere. Of the sums by text, a bucket sends one for each text to the bucket of a share of the texts.

A context of over ``LARGE`` positions (and a share of ``P_HOT``) is too large for a bucket. Its positions are dealt by context and symbol,
which tells the count of each entry; Spark sums of these decide whether it is retained; and its positions go on, with their probability
there, to the contexts that are one symbol longer, which are dealt in the same way. A pair of context and symbol that is as frequent is
counted before, and its positions go anywhere. Positions still in retained contexts after ``DEPTH`` symbols fetch as many more from their texts.

Tasks hold the words with a share of ``P_WORD``, and the frequent contexts and pairs of a level. Results do not depend on either. The base
score is exact for every word, of which 64-bit hashes are compared; frequent contexts are known by 64-bit hashes, texts by 128-bit ones.

Defined results: null and empty texts are one end token; a null doc_id is in training (its remainder is taken as 1);
repeated rows give repeated rows and are counted as often as they occur; with no training text the base formula still
holds (N = 0, V = 0) and equals the score. A context reaches one place beyond a text's first symbol (the start), not further.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .text import BASE_1, BASE_2, blocks, lists, mix, signed, words

P_WORD, P_HOT = 2.5e-7, 2e-7  # shares of what tasks hold, of words, and of contexts at least; results do not depend on them
MIN_WORD = MIN_ENTRY = 2  # what is seen less often is seen once; the count of distinct next symbols relies on it
ALPHA, DISCOUNT = 0.1, 0.7
END = np.uint64(0x9D39247E33776D41)
#: Symbol numbers: 0 to 255 are the classes by last byte, then the end, the start, and the words.
END_ID, START_ID, FIRST_WORD = 256, 257, 258
#: Rows of partial counts that a task holds before it merges them, tokens that it handles at once, positions that it deals at once and that a row has.
HELD, BLOCK, SENT, PACK = 1_000_000, 1 << 17, 1 << 19, 1024
#: Positions for each bucket, sums for each share of the texts, positions from which a context is frequent.
PER_BUCKET, PER_SHARE, LARGE = 400_000, 4_000_000, 750_000
#: Symbols that a position takes along at once (deeper contexts fetch more). Parts of the positions that are dealt one after the other: what is shuffled at once is so much less.
DEPTH, SLICES = 5, 3


class Lookup:
    """Values of 64-bit keys, in an open-addressing table that is read a block at a time."""

    def __init__(self, keys: np.ndarray):
        n = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys = keys.astype(np.uint64)
        self.mask = np.uint64(n - 1)
        self.slot = np.full(n, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = (mix(self.keys) & self.mask).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (n - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at = (mix(keys) & self.mask).astype(np.int64)
        left = None
        while True:
            slot = self.slot[at]
            full = slot >= 0
            hit = full.copy()
            hit[full] = self.keys[slot[full]] == (keys if left is None else keys[left])[full]
            if left is None:
                out[hit] = slot[hit]
                left = np.flatnonzero(full & ~hit)
                at = (at[left] + 1) & int(self.mask)
            else:
                out[left[hit]] = slot[hit]
                more = full & ~hit
                left, at = left[more], (at[more] + 1) & int(self.mask)
            if not len(left):
                return out


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash and last byte of every token of a block (256 for an end), and where each row's tokens begin."""
    w = words(data, offsets, lower=True)
    n = w.counts()
    rows = len(n)
    total = len(w.starts) + rows
    begin = w.doc + np.arange(rows + 1)
    ends = begin[1:] - 1
    inside = np.ones(total, bool)
    inside[ends] = False
    h, last = np.empty(total, np.uint64), np.full(total, 256, np.int64)
    h[inside], h[ends] = w.hashes(), END
    last[inside] = w.data[w.ends - 1]
    return h, last, begin


def _hash(symbol) -> np.ndarray:
    return mix((np.asarray(symbol).astype(np.uint64) + np.uint64(1)) * np.uint64(BASE_1))


def _summed(key: np.ndarray, columns: dict[str, np.ndarray], n: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Rows of equal key as one: ``n`` is added up, the other columns depend on the key."""
    if not len(key):
        return key, columns, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    at = order[first]
    return key[first], {c: x[at] for c, x in columns.items()}, np.add.reduceat(n, first)


class Counter:
    """Partial counts of keys within a task."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, key, columns, n) -> tuple | None:
        """What is to be sent on already, if it is too much to hold."""
        self.parts.append(_summed(key, columns, n))
        self.rows += len(self.parts[-1][0])
        if self.rows > HELD:
            merged = self.all()
            if len(merged[0]) > HELD // 2:
                return merged
            self.parts, self.rows = [merged], len(merged[0])
        return None

    def all(self) -> tuple:
        parts, self.parts, self.rows = self.parts, [], 0
        return _summed(np.concatenate([p[0] for p in parts]), {c: np.concatenate([p[1][c] for p in parts]) for c in parts[0][1]}, np.concatenate([p[2] for p in parts]))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Held:
    """What tasks hold, all of it bounded; a step is sent what it reads."""

    total: float = 0.0
    words: Lookup | None = None  # the frequent words, most frequent first, with their counts: number FIRST_WORD and on
    counts: np.ndarray | None = None
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0))  # base probabilities of the classes, the end, the start and these words
    hot: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.uint64)))  # frequent contexts of the level
    pairs: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.uint64)))  # their frequent pairs with a symbol, and the counts
    pair_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    above: Lookup | None = None  # the frequent contexts of the level above: totals, what they leave over, whether they are retained
    total_of: np.ndarray | None = None
    left_of: np.ndarray | None = None
    retained: np.ndarray | None = None


_loaded: dict[str, Held] = {}


class Shared:
    """``Held`` as a file in the shared folder. A Python worker reads it once and keeps the last one. (A broadcast variable would leave a
    copy on the disk of each executor until the job ends.)"""

    def __init__(self, path: str):
        self.path = path

    @property
    def value(self) -> Held:
        if self.path not in _loaded:
            _loaded.clear()
            system, path = fs.FileSystem.from_uri(self.path)
            with system.open_input_stream(path, compression=None) as f:
                _loaded[self.path] = pickle.load(f)
        return _loaded[self.path]


@contextmanager
def _shared(spark, held: Held):
    """For one step, which ends with a written table: the file goes with it."""
    there = [scratch.fresh(spark, "held")]
    system, path = fs.FileSystem.from_uri(there[0])
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        pickle.dump(held, f, protocol=5)
    try:
        yield Shared(there[0])
    finally:
        scratch.remove(spark, there)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (hash, last byte)."""
    held = Counter()
    out = lambda key, more, n: pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(more["last"].astype(np.int32)), pa.array(n)], ["key", "last", "n"])
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column("text")):
            h, last, _ = tokens(data, offsets)
            if full := held.add(h, {"last": last}, np.ones(len(h), np.int64)):
                yield out(*full)
    if held.parts:
        yield out(*held.all())


def _rare(shared):
    """Words that are not held, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                h, _, begin = tokens(data, offsets)
                far = held.words.find(h) < 0
                k, r = h[far], np.repeat(np.arange(hi - lo), np.diff(begin))[far]
                order = np.lexsort((k, r))
                k, r = k[order], r[order]
                first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))) if len(k) else np.zeros(0, np.int64)
                take = pa.array(r[first])
                yield pa.RecordBatch.from_arrays([pa.array(signed(k[first])), *(batch.column(c).slice(lo, hi - lo).take(take) for c in ("t1", "t2", "times"))], ["key", "t1", "t2", "times"])

    return run


def _packed(symbols: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The symbols of each text as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(symbols.astype(np.int32))])


def _encode(shared):
    """Texts as symbol numbers, with their base scores. ``own``: the words that are not held, their numbers and counts; a word of a training text that
    it does not list is seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, next_id = shared.value, TaskContext.get().partitionId() << 32
        counts = np.append(held.counts, 0)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                h, last, begin = tokens(data, offsets)
                at = held.words.find(h)
                own = batch.column("own").slice(lo, hi - lo)
                of, own = np.diff(own.offsets.to_numpy()), own.flatten()
                keys, ids, ns = (own.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                number, own_n = ids.astype(np.int64), ns.astype(np.int64)
                keys, first = np.unique(keys.astype(np.int64).view(np.uint64), return_index=True)
                ids, ns = ids.astype(np.int64)[first], ns.astype(np.int64)[first]
                far = np.flatnonzero(at < 0)
                place = np.minimum(np.searchsorted(keys, h[far]), max(len(keys) - 1, 0))
                there = keys[place] == h[far] if len(keys) else np.zeros(len(far), bool)
                n, symbol = counts[at], at + FIRST_WORD
                n[far] = np.repeat(batch.column("times").slice(lo, hi - lo).to_numpy() > 0, np.diff(begin))[far]
                n[far[there]], symbol[far[there]] = ns[place[there]], ids[place[there]]
                symbol = np.where((n >= MIN_WORD) & (last != END_ID), symbol, last).astype(np.int32)
                sums = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: B023, E731
                row, numbers, numbered = np.repeat(np.arange(hi - lo), of), number[number >= 0], number >= 0
                order = np.lexsort((numbers, row[numbered]))
                rare = [lists(x[order], np.bincount(row[numbered], minlength=hi - lo), kind) for x, kind in ((numbers, pa.int32()), (own_n[numbered], pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(next_id, next_id + hi - lo)), *(batch.column(c).slice(lo, hi - lo) for c in ("t1", "t2", "times")), _packed(symbol, begin), *rare,
                        pa.array(np.diff(begin)), pa.array(sums((n > 0).astype(np.int64))), pa.array(sums(np.log10((n + ALPHA) / held.total))),
                    ],
                    ["tid", "t1", "t2", "times", "ids", "rare", "rare_n", "n_tokens", "n_known", "base"],
                )
                next_id += hi - lo

    return run


def _longer(parent: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    """Contexts of n symbols, of their last n - 1 and the hash of the n-th back."""
    return parent + back * np.uint64(pow(BASE_2, n, 1 << 64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Symbols and borders of runs of rows of about BLOCK tokens."""
    column = batch.column("ids")
    _, where, data = column.buffers()
    begin = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) // 4 if len(column) else np.zeros(1, np.int64)
    ids = np.frombuffer(data, np.int32, int(begin[-1])) if begin[-1] else np.zeros(0, np.int32)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + BLOCK, "right")) - 1)
        yield ids[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo], slice(lo, hi)
        lo = hi


#: What positions of texts are dealt as: rows of a bucket and a kind, with the columns that it has. ``head`` names them and their widths in bytes;
#: ``data`` has the first byte of all values of a column, then the second one, and so on. Integers are kept as what they are above the least (``base``).
_TYPES = {"tid": np.int64, "t": np.int32, "x": np.int32, "w": np.int64, "m": np.int64, "q": np.float64, "sum": np.float64, "c": np.uint64, "n": np.int64, "k": np.int64, "window": np.int32}
_ROWS = "bucket int, kind int, n int, head binary, base binary, data binary"
SUMS, PLACES, ENTRIES, TOTALS, DEEP, CONTEXTS, KEPT = range(7)

Columns = dict[str, np.ndarray]


def _planes(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The bytes of values, as few for each as they need, and what is to be added to them."""
    base = 0
    if x.dtype.kind == "i":
        base, most = int(x.min()), int(x.max())
        width = (most - base).bit_length() + 7 >> 3
        x = (x - base).astype(np.uint32 if width <= 4 else np.uint64)
    else:
        width = 8 if x.view(np.uint64).any() else 0
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T[:width]), base


def _values(planes: np.ndarray, dtype, base: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of their bytes, of rows of ``n`` values that have a base each."""
    width, size = planes.shape
    raw = np.zeros((size, 4 if width <= 4 else 8), np.uint8)
    raw[:, :width] = planes.T
    if dtype in (np.float64, np.uint64):
        return raw.view(dtype).ravel() if width else np.zeros(size, dtype)
    x = raw.view(np.uint32 if width <= 4 else np.uint64).ravel().astype(dtype)
    x += (base[0] if (base == base[0]).all() else np.repeat(base, n)).astype(dtype)
    return x


def _blobs(kind: int, bucket: np.ndarray, buckets: int, columns: Columns) -> Iterator[pa.RecordBatch]:
    """Rows of at most PACK positions of one bucket each."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable") if buckets > 1 else slice(None)
    size = np.bincount(bucket, minlength=buckets)
    whole, rest = np.divmod(size, PACK)
    rows = whole + (rest > 0)
    counts = np.full(int(rows.sum()), PACK, np.int64)
    counts[np.cumsum(rows)[rest > 0] - 1] = rest[rest > 0]
    of, ends = np.repeat(np.arange(buckets, dtype=np.int32), rows), np.cumsum(counts)
    head, base, made = [], [], []
    for i, (name, dtype) in enumerate(_TYPES.items()):
        if (x := columns.get(name)) is not None:
            for y in x.T if x.ndim > 1 else (x,):
                planes, least = _planes(np.ascontiguousarray(y[order], dtype))
                head += [i, len(planes)]
                base.append(least)
                made.append(planes)
    data, head, base = np.concatenate(made), bytes(head), np.array(base, np.int64).tobytes()
    for i in range(0, len(counts), 128):
        n, end = counts[i : i + 128], ends[i : i + 128]
        packed = pa.array([data[:, b - k : b].tobytes() for k, b in zip(n.tolist(), end.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[i : i + 128]), pa.array(np.full(len(n), kind, np.int32)), pa.array(n.astype(np.int32)), pa.array([head] * len(n), pa.binary()), pa.array([base] * len(n), pa.binary()), packed],
            ["bucket", "kind", "n", "head", "base", "data"],
        )


def _opened(batch: pa.RecordBatch, kind: int) -> Columns | None:
    """The columns of one kind, as far as it has them."""
    rows = pc.equal(batch.column("kind"), kind)
    if not (some := rows.true_count):
        return None
    if some < len(batch):
        batch = batch.filter(rows)
    counts, heads, bases = batch.column("n").to_numpy(), batch.column("head").to_pylist(), batch.column("base").to_pylist()
    _, where, data = batch.column("data").buffers()
    where = np.frombuffer(where, np.int32, some + 1, batch.column("data").offset * 4).tolist()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    alike: dict[bytes, list[int]] = {}
    for i, head in enumerate(heads):
        alike.setdefault(head, []).append(i)
    parts = []
    for head, at in alike.items():
        n = counts[at].astype(np.int64)
        planes = np.concatenate([data[where[i] : where[i + 1]].reshape(-1, k) if where[i] < where[i + 1] else np.zeros((0, k), np.uint8) for i, k in zip(at, n.tolist(), strict=True)], axis=1)
        base = np.frombuffer(b"".join(bases[i] for i in at), np.int64).reshape(len(at), -1)
        found: dict[str, list[np.ndarray]] = {}
        names, done = list(_TYPES), 0
        for j, (of, width) in enumerate(zip(head[::2], head[1::2], strict=True)):
            found.setdefault(names[of], []).append(_values(planes[done : done + width], _TYPES[names[of]], base[:, j], n))
            done += width
        out = {x: y[0] for x, y in found.items() if x != "window"}
        if kind == PLACES:
            out["window"] = np.stack(found["window"]).T if "window" in found else np.zeros((int(n.sum()), 0), np.int32)
        parts.append(out)
    return _joined(parts) if len(parts) > 1 else parts[0]


def _joined(parts: list[Columns]) -> Columns:
    return {x: np.concatenate([p[x] for p in parts]) for x in parts[0]}


def _gathered(parts: Iterator[tuple[int, Columns]]) -> Iterator[tuple[int, Columns]]:
    """Columns of a kind put together to SENT positions."""
    held: dict[int, list[Columns]] = {}
    rows: dict[int, int] = {}
    for kind, columns in parts:
        held.setdefault(kind, []).append(columns)
        rows[kind] = rows.get(kind, 0) + len(columns["tid"])
        if rows[kind] >= SENT:
            yield kind, _joined(held.pop(kind))
            rows[kind] = 0
    for kind, parts in held.items():
        yield kind, _joined(parts)


def _places(batch: pa.RecordBatch, width: int):
    """Runs of texts: their rows, symbols and borders, the text of each symbol, and the symbols with ``width`` places before each text (-1: none)
    and where they are there."""
    for ids, begin, rows in _texts(batch):
        counts = np.diff(begin)
        row = np.repeat(np.arange(len(counts)), counts)
        padded = np.full(len(ids) + len(counts) * width, -1, np.int32)
        padded[begin[:-1] + np.arange(1, len(counts) + 1) * width - 1] = START_ID
        of = np.arange(len(ids)) + (row + 1) * width
        padded[of] = ids
        yield rows, ids, begin, row, padded, of


def _of_texts(part: int, parts: int, width: int):
    """The positions of texts whose last symbol before is of one of some parts, with ``width`` symbols before them, nearest first (-1: none)."""

    def run(held: Held, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Columns]]:
        for batch in batches:
            tids, times, rare, rare_n = batch.column("tid").to_numpy(), batch.column("times").to_numpy(), batch.column("rare"), batch.column("rare_n")
            for rows, ids, begin, row, padded, of in _places(batch, width):
                at = np.flatnonzero(_part(padded[of - 1], parts) == part)
                if not len(at):
                    continue
                row, of, x = row[at], of[at], ids[at]
                window = np.empty((width, len(at)), np.int32)
                for j in range(width):
                    window[j] = padded[of - 1 - j]
                m, far = np.zeros(len(at), np.int64), np.flatnonzero(x >= len(held.symbols))
                if len(far):
                    own = rare.slice(rows.start, rows.stop - rows.start)
                    key = (np.repeat(np.arange(len(begin) - 1), np.diff(own.offsets.to_numpy())) << 32) | own.flatten().to_numpy()
                    m[far] = rare_n.slice(rows.start, rows.stop - rows.start).flatten().to_numpy()[np.searchsorted(key, (row[far] << 32) | x[far])]
                yield PLACES, {"tid": tids[rows][row], "t": (at - begin[row]).astype(np.int32), "x": x, "w": times[rows][row], "m": m, "window": window.T}

    return run


def _part(symbol: np.ndarray, parts: int) -> np.ndarray:
    return _hash(symbol) % np.uint64(parts)


def _symbols(shared):
    """Partial counts of the symbols that tasks hold, and of the starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value.symbols), np.int64)
        for batch in batches:
            for ids, begin, _ in _texts(batch):
                n += np.bincount(ids[ids < len(n)], minlength=len(n))
                n[START_ID] += len(begin) - 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    return run


def _bigrams(shared, frequent: np.ndarray):
    """Partial counts of pairs of two of these symbols (``s``: the symbol before): positions, and training's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counter = shared.value, Counter()
        hot = np.zeros(len(held.symbols) + 1, bool)
        hot[frequent] = True
        out = lambda key, _, n: pa.RecordBatch.from_arrays([pa.array(x) for x in ((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), n[:, 0], n[:, 1])], ["s", "x", "k", "n"])
        for batch in batches:
            times = batch.column("times").to_numpy()
            for rows, ids, _, row, padded, of in _places(batch, 1):
                s = padded[of - 1]
                at = np.flatnonzero(hot[np.minimum(s, len(held.symbols))] & hot[np.minimum(ids, len(held.symbols))])
                if len(at):
                    key = (s[at].astype(np.uint64) << np.uint64(32)) | ids[at].astype(np.uint64)
                    if full := counter.add(key, {}, np.stack([np.ones(len(at), np.int64), times[rows][row[at]]], axis=1)):
                        yield out(*full)
        if counter.parts:
            yield out(*counter.all())

    return run


def _of_places(held: Held, batches: Iterator[pa.RecordBatch], late: bool = False) -> Iterator[tuple[int, Columns]]:
    """Positions of a written table that the frequent contexts ``above`` take on, if there are; ``late``: with the counts there (``k``), of which
    ``_taken`` makes the rest. Sums of those that go no further."""
    for batch in batches:
        if (p := _opened(batch, PLACES)) is None:
            continue
        on = np.ones(len(p["x"]), bool)
        take = lambda p: p
        if held.above is not None:
            on, p["k"], take = held.retained[held.above.find(p["c"])], p.pop("n"), lambda p: _taken(held, p)
        further = on & (p["window"][:, 0] >= 0) if p["window"].shape[1] else on
        for over, made in ((~on, lambda p: p), (on & ~further, take)):
            if over.any() and "sum" in (o := made({x: y[over] for x, y in p.items()})):
                there = o["sum"] != 0
                if there.any():
                    yield SUMS, {"tid": o["tid"][there], "sum": o["sum"][there]}
        if further.any():
            p = {x: y[further] for x, y in p.items()}
            yield PLACES, p if late else take(p)


def _late(held: Held, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Columns]]:
    return _of_places(held, batches, True)


def _taken(held: Held, p: Columns) -> Columns:
    """Positions with their probabilities and terms in the retained contexts ``above``."""
    at, q, k = held.above.find(p["c"]), _base(held, p), p["k"]
    total, left, entry = held.total_of[at], held.left_of[at], k >= MIN_ENTRY
    own = np.where(entry, (k - DISCOUNT) / total + left * q, np.nan)
    return {x: y for x, y in p.items() if x not in ("m", "k")} | {"q": own, "sum": p.get("sum", 0.0) + np.log10(np.where(entry, own / q, left))}


def _contexts(p: Columns, level: int) -> np.ndarray:
    return _longer(p["c"] if "c" in p else np.zeros(len(p["x"]), np.uint64), _hash(p["window"][:, 0]), level)


def _base(held: Held, p: Columns) -> np.ndarray:
    """What the symbols' probabilities were one level above: at first those of the words themselves (``m``: the counts of those that are not held)."""
    if "q" in p:
        return p["q"]
    return np.where(p["x"] < len(held.symbols), held.symbols[np.minimum(p["x"], len(held.symbols) - 1)], (p["m"] + ALPHA) / held.total)


def _often(shared, source, level: int, least: int):
    """Partial counts of positions by context, and by context and symbol. What has under ``least`` of those held at once is left out: these
    counts only decide how positions are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {False: Counter(), True: Counter()}

        def out(pair, key, _, n):
            take = n >= least
            return pa.RecordBatch.from_arrays([pa.array(signed(key[take])), pa.array(np.full(int(take.sum()), pair)), pa.array(n[take])], ["key", "pair", "n"])

        for kind, p in source(shared.value, batches):
            if kind == PLACES:
                c = _contexts(p, level)
                for pair, key in ((False, c), (True, c ^ _hash(p["x"]))):
                    if full := counters[pair].add(key, {}, np.ones(len(key), np.int64)):
                        yield out(pair, *full)
        for pair, counter in counters.items():
            if counter.parts:
                yield out(pair, *counter.all())

    return run


def _weighed(shared, source, level: int):
    """Partial counts in training of the frequent pairs of a context and a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counter = shared.value, Counter()
        out = lambda key, more, n: pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(more["c"])), pa.array(more["q"]), pa.array(n)], ["key", "c", "q", "n"])
        for kind, p in source(held, batches):
            if kind == PLACES:
                c = _contexts(p, level)
                g = c ^ _hash(p["x"])
                at = held.pairs.find(g) >= 0
                if full := counter.add(g[at], {"c": c[at], "q": _base(held, p)[at]}, p["w"][at]):
                    yield out(*full)
        if counter.parts:
            yield out(*counter.all())

    return run


def _deal(shared, source, level: int, buckets: int):
    """Positions to the buckets of their contexts of ``level`` symbols; those of frequent contexts to those of context and symbol, and those of
    frequent pairs, of which the count is known, anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = shared.value, TaskContext.get().partitionId() % buckets
        for kind, p in _gathered(source(held, batches)):
            if kind == SUMS:
                yield from _blobs(SUMS, np.full(len(p["tid"]), own), buckets, p)
                continue
            key, n = _contexts(p, level), np.full(len(p["x"]), -1, np.int64)
            hot = np.flatnonzero(held.hot.find(key) >= 0)
            if len(hot):
                key[hot] ^= _hash(p["x"][hot])
                at = held.pairs.find(key[hot])
                known = hot[at >= 0]
                n[known], key[known] = held.pair_n[at[at >= 0]], mix(p["tid"][known].view(np.uint64)) + p["t"][known].astype(np.uint64)
            yield from _blobs(PLACES, _bucket(mix(key), buckets), buckets, p | {"n": n})

    return run


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the run of each value."""
    new = np.append(True, ordered[1:] != ordered[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _grow(p: Columns, level: int, keep: bool) -> Iterator[tuple[int, Columns]]:
    """The tree below contexts of ``level`` symbols that are in this bucket with all of their positions. Adds the terms to ``p["sum"]`` and
    yields the positions that are still in a retained context when their window ends; and what is retained, if ``keep``."""
    alive, c, q, w, x = np.arange(len(p["x"])), p["c"], p["q"], p["w"], p["x"].astype(np.int64)
    group = np.unique(c, return_inverse=True)[1].astype(np.int64) if c.any() else np.zeros(len(c), np.int64)  # of each that is alive
    width = p["window"].shape[1]
    for j in range(width):
        s = p["window"][alive, j].astype(np.int64)
        on = s >= 0
        alive, key = alive[on], ((group << 32) | s)[on]
        if not len(alive):
            return
        order = np.argsort(key)
        alive = alive[order]
        first, group = _runs(key[order])
        total = np.add.reduceat(w[alive], first)
        on = (total >= MIN_ENTRY)[group]
        alive, group = alive[on], group[on]
        if not len(alive):
            return
        key = (group << 32) | x[alive]
        order = np.argsort(key)
        alive, group = alive[order], group[order]
        first, pair = _runs(key[order])
        n, of = np.add.reduceat(w[alive], first), group[first]
        entry = n >= MIN_ENTRY
        k, g = n[entry], of[entry]
        kinds, rest = np.bincount(g, minlength=len(total)), total - np.bincount(g, k, len(total)).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            # What a context leaves over: the discounts of its entries and the symbols that follow once each (the rest), which its parent tells apart.
            left = (rest + DISCOUNT * kinds) / total
            above = q[alive[first[entry]]]
            own = (k - DISCOUNT) / total[g] + left[g] * above
            gain = np.bincount(g, k * np.log(own / above), len(total)) + rest * np.log(left)
            retained = (kinds > 0) & (gain > 0.5 * (kinds + rest) * np.log(total))
            terms, left_term = np.log10(own / above), np.log10(left)
        p_of, term_of = np.full(len(n), np.nan), left_term[of]
        p_of[entry], term_of[entry] = own, terms
        on = retained[group]
        alive, group, pair = alive[on], group[on], pair[on]
        c[alive] = _longer(c[alive], _hash(p["window"][alive, j]), level + j)
        p["sum"][alive] += term_of[pair]
        q[alive] = p_of[pair]
        if keep and len(alive):
            at, here = np.unique(group, return_index=True)
            yield CONTEXTS, {"c": c[alive[here]], "n": total[at], "sum": left_term[at], "t": np.full(len(at), level + j)}
            at, here = np.unique(pair, return_index=True)
            at, here = at[entry[at]], here[entry[at]]
            yield KEPT, {"c": c[alive[here]] ^ _hash(x[alive[here]]), "n": n[at], "q": p_of[at], "sum": term_of[at]}
    if len(alive):
        yield DEEP, {y: p[y][alive] for y in ("tid", "t", "x", "w", "q", "c", "sum")}
        p["sum"][alive] = 0.0


def _grown(shared, level: int, parts: int, keep: bool):
    """Of a bucket: the sums of terms by text, for ``parts`` shares of the texts; the positions of frequent contexts with the count of their
    symbol there, and of these contexts the entries and the partial totals; the positions that want more symbols before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, got, sums = shared.value, [], []
        for batch in batches:
            if (p := _opened(batch, SUMS)) is not None:
                sums.append((p["tid"], p["sum"]))
            if (p := _opened(batch, PLACES)) is not None:
                got.append(p)
        some = lambda kind, p: _blobs(kind, np.zeros(len(p["c"]), np.int64), 1, p)
        if got:
            p = _joined(got)
            got.clear()
            if "k" in p:
                p = _taken(held, p)
            size, fresh, m = len(p["x"]), "q" not in p, p.get("m")
            p = {"sum": np.zeros(size), "c": np.zeros(size, np.uint64), "q": _base(held, p)} | {x: y for x, y in p.items() if x != "m"}
            c = _contexts(p, level)
            hot = held.hot.find(c) >= 0
            if hot.any():
                own = {x: y[hot] for x, y in p.items()} | {"c": c[hot]}
                own["window"] = own["window"][:, 1:]
                p = {x: y[~hot] for x, y in p.items()}
                free = np.flatnonzero(own["n"] < 0)
                if len(free):
                    g = own["c"][free] ^ _hash(own["x"][free])
                    order = np.argsort(g)
                    free, g = free[order], g[order]
                    first, pair = _runs(g)
                    n = np.add.reduceat(own["w"][free], first)
                    own["n"][free] = n[pair]
                    take = n >= MIN_ENTRY
                    at = free[first[take]]
                    yield from some(ENTRIES, {"c": own["c"][at], "n": n[take], "q": own["q"][at], "tid": signed(g[first[take]])})
                    key, _, n = _summed(own["c"][free], {}, own["w"][free])
                    yield from some(TOTALS, {"c": key, "n": n})
                if fresh:  # their probabilities and terms are those of the words
                    own = {x: y for x, y in own.items() if x not in ("q", "sum")} | {"m": m[hot]}
                order = np.argsort(own["c"], kind="stable")  # which packs them well
                yield from some(PLACES, {x: y[order] for x, y in own.items()})
            p.pop("n")
            for kind, made in _grow(p, level, keep) if len(p["x"]) else ():
                yield from some(kind, made)
            there = p["sum"] != 0
            sums.append((p["tid"][there], p["sum"][there]))
        if sums:
            tid, _, term = _summed(np.concatenate([x[0] for x in sums]).view(np.uint64), {}, np.concatenate([x[1] for x in sums]))
            yield from _blobs(SUMS, _bucket(mix(tid), parts), parts, {"tid": tid.view(np.int64), "sum": term})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each text of a share."""
    got = [p for batch in batches if (p := _opened(batch, SUMS)) is not None]
    if got:
        tid, _, term = _summed(np.concatenate([p["tid"] for p in got]).view(np.uint64), {}, np.concatenate([p["sum"] for p in got]))
        yield pa.RecordBatch.from_arrays([pa.array(signed(tid)), pa.array(term)], ["tid", "term"])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of frequent contexts: all that follows, what follows repeatedly, and the kinds of it."""
    for batch in batches:
        for kind in (ENTRIES, TOTALS):
            if (p := _opened(batch, kind)) is not None:
                c, _, n = _summed(p["c"], {}, p["n"])
                kinds = _summed(p["c"], {}, np.ones(len(p["c"]), np.int64))[2]
                zero = np.zeros(len(c), np.int64)
                made = (zero, n, kinds) if kind == ENTRIES else (n, zero, zero)
                yield pa.RecordBatch.from_arrays([pa.array(signed(c)), *(pa.array(x) for x in made)], ["c", "total", "several", "kinds"])


def _gains(shared):
    """Partial sums of what frequent contexts' entries gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            if (p := _opened(batch, ENTRIES)) is not None:
                at = held.above.find(p["c"])
                own = (p["n"] - DISCOUNT) / held.total_of[at] + held.left_of[at] * p["q"]
                c, _, gain = _summed(p["c"], {}, p["n"] * np.log(own / p["q"]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(c)), pa.array(gain)], ["c", "gain"])

    return run


def _kept(shared):
    """The entries of retained frequent contexts, as the model has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            if (p := _opened(batch, ENTRIES)) is not None:
                at = held.above.find(p["c"])
                own = (p["n"] - DISCOUNT) / held.total_of[at] + held.left_of[at] * p["q"]
                on = held.retained[at]
                yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (p["tid"], p["n"], own, np.log10(own / p["q"]))], ["g", "n", "p", "term"])

    return run


def _listed(kind: int, names: dict[str, str]):
    """The columns of one kind as plain rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (p := _opened(batch, kind)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(signed(p[x]) if x == "c" else p[x]) for x in names], list(names.values()))

    return run


_WANTED = ("t", "x", "w", "q", "c", "sum")


def _wanting(shared, kind: int):
    """Positions that want more symbols before them, a row for each text of a batch. Those of frequent contexts (PLACES) are taken on first; sums
    of those that go no further have no position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        parts = ((DEEP, p) for b in batches if (p := _opened(b, DEEP)) is not None) if kind == DEEP else _of_places(held, batches)
        for of, p in parts:
            if of == SUMS:
                p |= {"t": np.full(len(p["tid"]), -1, np.int32)} | {x: np.zeros(len(p["tid"]), _TYPES[x]) for x in ("x", "w", "q", "c")}
            order = np.argsort(p["tid"], kind="stable")
            tid = p["tid"][order]
            first = _runs(tid)[0]
            ends = np.append(first[1:], len(tid))
            made = [pa.array([p[x][order[a:b]].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in _WANTED]
            yield pa.RecordBatch.from_arrays([pa.array(tid[first]), *made], ["tid", *_WANTED])

    return run


def _refilled(level: int, width: int):
    """These positions with the symbols before them from the ``level``-th back on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for tid, ids, *own in zip(batch.column("tid").to_pylist(), batch.column("ids"), *(batch.column(x).to_pylist() for x in _WANTED), strict=True):
                p = {x: np.frombuffer(y, _TYPES[x]) for x, y in zip(_WANTED, own, strict=True)}
                padded = np.append(np.append(np.frombuffer(ids.as_buffer(), np.int32), -1), START_ID)  # behind the last symbol: none, and at -1 the start
                back = p["t"].astype(np.int64)[:, None] - level - np.arange(width)
                window = np.where(back < -1, -1, padded[np.maximum(back, -1)])
                window[p["t"] < 0] = -1
                parts.append(p | {"tid": np.full(len(p["t"]), tid), "window": window})
            if parts:
                p = _joined(parts)
                yield from _blobs(PLACES, np.zeros(len(p["t"]), np.int64), 1, p)

    return run


@dataclass
class Model:
    n: int  # training tokens
    v: int  # distinct ones
    held: Held  # the symbols
    buckets: int  # that the positions of a part are dealt to
    shares: int  # of the texts, for sums
    large: int  # positions of a frequent context
    texts: DataFrame  # written: tid, t1, t2, times, ids, rare, rare_n (words that are not held), n_tokens, n_known, base of each distinct text
    symbols: DataFrame  # written: id, p of the words that are not held
    contexts: DataFrame | None = None  # written, of all levels: c, total, term, level
    entries: DataFrame | None = None  # g, n, p, term
    offered: tuple[int, ...] = ()  # contexts retained, by length
    tables: list[str] = field(default_factory=list)

    def probabilities(self, context: list[int]) -> dict[int, float]:
        """Of each symbol that there is after a context of symbol numbers, or after its longest retained suffix. To look into small models."""
        p = {i: x for i, x in enumerate(self.held.symbols.tolist()) if x > 0 and i != START_ID} | {r.id: r.p for r in self.symbols.collect()}
        ids, c = np.array(sorted(p)), np.uint64(0)
        for n, back in enumerate(context[::-1][: len(self.offered)], 1):
            c = _longer(np.array([c]), _hash([back]), n)[0]
            left = self.contexts.where(F.col("c") == int(signed(np.array([c]))[0])).first()
            if left is None:
                break
            g = dict(zip(signed(c ^ _hash(ids)).tolist(), ids.tolist(), strict=True))
            own = {g[r.g]: r.p for r in self.entries.where(F.col("g").isin(list(g))).collect()}
            p = {i: own.get(i, 10**left.term * x) for i, x in p.items()}
        return p


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and its 128-bit hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _read(docs: DataFrame) -> Model:
    """Counts words, gives them numbers, and writes every distinct text as numbers with its base score."""
    spark, done = docs.sparkSession, []
    texts = _hashed(docs)
    counts = texts.where(~held_out(F.col("doc_id"))).mapInArrow(_counts, "key long, last int, n long").groupBy("key").agg(F.sum("n").alias("n"), F.first("last").alias("last"))
    counts = scratch.save(counts, "counts", done)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = int(sums[0]), int(sums[1])
    frequent = F.col("n") >= P_WORD * n
    top = counts.where(frequent).orderBy(F.desc("n"), "key").select("key", "n").toArrow()  # at most 1 / P_WORD rows
    held = Held(n + ALPHA * (v + 1), Lookup(top.column(0).to_numpy().view(np.uint64)), top.column(1).to_numpy().astype(np.int64))
    # Words that are not held: numbers by buckets of their hash, from those of the held ones on.
    wide, first = v // 1_000_000 + 1, FIRST_WORD + len(top)
    real = (F.col("n") >= MIN_WORD) & (F.col("last") != END_ID)
    rank = F.expr(f"row_number() over (partition by pmod(xxhash64(key), {wide}) order by key)")
    number = (F.lit(first) + (rank - 1) * wide + F.expr(f"pmod(xxhash64(key), {wide})")).cast("long")
    others = counts.where(~frequent & real).select("key", "n", number.alias("id")).unionByName(counts.where(~frequent & ~real).select("key", "n", F.lit(-1).cast("long").alias("id")))
    others = scratch.save(others, "others", done)
    if (others.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise OverflowError("more repeated words than 31 bits can number")
    classes = counts.where(~real).groupBy("last").agg(F.sum(F.col("n") + ALPHA).alias("m")).collect()  # at most 257 rows
    held.symbols = np.zeros(first)
    for r in classes:
        held.symbols[r["last"]] = r["m"] / held.total
    held.symbols[FIRST_WORD:] = (held.counts + ALPHA) / held.total
    tables: list[str] = []
    symbols = scratch.save(others.where("id >= 0").select("id", ((F.col("n") + ALPHA) / held.total).alias("p")), "symbols", tables)
    with _shared(spark, held) as shared:
        texts = texts.withColumn("times", F.when(held_out(F.col("doc_id")), 0).otherwise(1).cast("long"))
        rare = texts.mapInArrow(_rare(shared), "key long, t1 long, t2 long, times long").join(others, "key").where("times = 0 or n > 1")  # training's words are seen once at least
        rare = rare.groupBy("t1", "t2").agg(F.collect_set(F.struct("key", "id", "n")).alias("own"))
        units = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.sum("times").alias("times"))
        joined = units.join(rare, ["t1", "t2"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<key:bigint,id:bigint,n:bigint>>")))
        made = joined.mapInArrow(_encode(shared), "tid long, t1 long, t2 long, times long, ids binary, rare array<int>, rare_n array<long>, n_tokens long, n_known long, base double")
        encoded = scratch.save(made, "texts", tables)
    scratch.remove(spark, done)
    places, least = int(encoded.agg(F.sum("n_tokens")).first()[0] or 0), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, shares = max(least, -(-places // (SLICES * PER_BUCKET))), max(least, -(-places // PER_SHARE))
    return Model(n, v, Held(held.total, symbols=held.symbols), buckets, shares, max(LARGE, int(P_HOT * places)), encoded, symbols, tables=tables)


_CONTEXT, _ENTRY = "c long, total long, term double, level int", "g long, n long, p double, term double"


def _hottest(model: Model) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Symbols with so many positions that they are frequent contexts, and the pairs of two of them that are as frequent, with their counts in
    training. Words that are not held are rarer."""
    with _shared(model.texts.sparkSession, model.held) as shared:
        counted = model.texts.select("ids").mapInArrow(_symbols(shared), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        hot = counted.where(F.col("n") >= model.large).select("id").toArrow().column(0).to_numpy()  # at most one for each `large` positions
        pairs = {x: np.zeros(0, np.int64) for x in ("s", "x", "n")}
        if len(hot):
            found = model.texts.select("times", "ids").mapInArrow(_bigrams(shared, hot), "s long, x long, k long, n long").groupBy("s", "x").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
            found = found.where(F.col("k") >= model.large).toArrow()  # likewise
            pairs = {x: found.column(x).to_numpy() for x in pairs}
    return hot, pairs


def _counted(spark, held: Held, rows: DataFrame, level: int, least: int) -> tuple[np.ndarray, Columns]:
    """The frequent contexts of a level below the first, and their frequent pairs with their counts in training."""
    with _shared(spark, held) as shared:
        counted = rows.mapInArrow(_often(shared, _late, level, max(1, least >> 12)), "key long, pair boolean, n long").groupBy("key", "pair").agg(F.sum("n").alias("n"))
        often = counted.where(F.col("n") >= least).select("key", "pair").toArrow()  # at most two for each `least` positions
    key, pair = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    known = {x: np.zeros(0, y) for x, y in (("key", np.int64), ("c", np.int64), ("q", np.float64), ("n", np.int64))}
    if pair.any():
        with _shared(spark, replace(held, pairs=Lookup(key[pair]))) as shared:
            found = rows.mapInArrow(_weighed(shared, _of_places, level), "key long, c long, q double, n long").groupBy("key").agg(F.first("c").alias("c"), F.first("q").alias("q"), F.sum("n").alias("n")).toArrow()
        known = {x: found.column(x).to_numpy() for x in known}
    return key[~pair], known


def _tree(model: Model, keep: bool) -> list[DataFrame]:
    """Grows the tree and gives written sums of the terms of texts (tid, term). ``keep``: the model gets what is retained."""
    spark, buckets, tables, sums = model.texts.sparkSession, model.buckets, model.tables, []
    contexts, entries = ([spark.createDataFrame([], x)] for x in (_CONTEXT, _ENTRY))
    deep: dict[int, list[DataFrame]] = {}  # positions that want more symbols before them, by level: all parts' at once
    hot, pairs = _hottest(model)
    texts = model.texts.select("tid", "times", "ids", "rare", "rare_n")
    for part in range(SLICES + 1):
        done: list[str] = []
        work = [(1, DEPTH, texts, _of_texts(part, SLICES, DEPTH), None)] if part < SLICES else []
        while work or (part == SLICES and deep):
            if not work:
                level = min(deep)
                work.append(_refill(model, reduce(DataFrame.unionByName, deep.pop(level)), DEEP, model.held, level, done))
            level, width, rows, source, above = work.pop()
            held = replace(model.held, above=above.above, total_of=above.total_of, left_of=above.left_of, retained=above.retained) if above else model.held
            if part < SLICES and level == 1:
                hot_c = _longer(np.zeros(1, np.uint64), _hash(hot[_part(hot, SLICES) == part]), 1)
                own = {x: y[_part(pairs["s"], SLICES) == part] for x, y in pairs.items()}
                c = _longer(np.zeros(1, np.uint64), _hash(own["s"]), 1)
                known = {"key": signed(c ^ _hash(own["x"])), "c": signed(c), "q": model.held.symbols[own["x"]], "n": own["n"]}
            else:
                hot_c, known = _counted(spark, held, rows, level, model.large)
            held = replace(held, hot=Lookup(hot_c), pairs=Lookup(known["key"].view(np.uint64)), pair_n=known["n"])
            with _shared(spark, held) as shared:
                dealt = rows.mapInArrow(_deal(shared, source, level, buckets), _ROWS).repartitionById(buckets, F.col("bucket"))
                out = scratch.save(dealt.mapInArrow(_grown(shared, level, model.shares, keep), _ROWS), "grown", done)
            del dealt
            scratch.remove(spark, [])  # the shuffle is not read any more
            added = out.where(F.col("kind") == SUMS).repartitionById(model.shares, F.col("bucket")).mapInArrow(_added, "tid long, term double")
            sums.append(scratch.save(added, "sums", tables))
            if keep:
                contexts.append(scratch.save(out.where(F.col("kind") == CONTEXTS).mapInArrow(_listed(CONTEXTS, {"c": "c", "n": "total", "sum": "term", "t": "level"}), _CONTEXT), "contexts", tables))
                entries.append(scratch.save(out.where(F.col("kind") == KEPT).mapInArrow(_listed(KEPT, {"c": "g", "n": "n", "q": "p", "sum": "term"}), _ENTRY), "entries", tables))

            if not (wanting := out.where(F.col("kind") == DEEP)).isEmpty():
                deep.setdefault(level + width, []).append(scratch.save(wanting, "deep", tables))
            if len(hot_c):
                judged = _judged(spark, out, hot_c, known)
                if keep:
                    on = judged.retained
                    made = zip(signed(hot_c[on]).tolist(), judged.total_of[on].astype(int).tolist(), np.log10(judged.left_of[on]).tolist(), [level] * int(on.sum()), strict=True)
                    contexts.append(spark.createDataFrame(list(made), _CONTEXT))
                    with _shared(spark, judged) as shared:
                        entries.append(scratch.save(out.where(F.col("kind") == ENTRIES).mapInArrow(_kept(shared), _ENTRY), "entries", tables))
                    at = judged.above.find(known["c"].view(np.uint64))
                    take = on[at] & (known["n"] >= MIN_ENTRY)
                    own = (known["n"] - DISCOUNT) / judged.total_of[at] + judged.left_of[at] * known["q"]
                    made = zip(*(x[take].tolist() for x in (known["key"], known["n"], own, np.log10(own / known["q"]))), strict=True)
                    entries.append(spark.createDataFrame(list(made), _ENTRY))
                places = out.where(F.col("kind") == PLACES)
                if width == 1:
                    work.append(_refill(model, places, PLACES, judged, level + 1, done))
                elif level > 1 or judged.retained.any():
                    work.append((level + 1, width - 1, places, _late, judged))
        scratch.remove(spark, done)
    if keep:
        union = lambda x: reduce(DataFrame.unionByName, x)
        model.contexts, model.entries = union(contexts), union(entries)
        model.offered = tuple(r["count"] for r in model.contexts.groupBy("level").count().orderBy("level").collect())
    return sums


def _refill(model: Model, rows: DataFrame, kind: int, held: Held, level: int, done: list[str]) -> tuple:
    """What is to be done next for positions that want more symbols before them. A few of them are sent to the texts."""
    few = (rows.where(F.col("kind") == kind).agg(F.sum("n")).first()[0] or 0) * 100 <= 32 << 20
    with _shared(rows.sparkSession, held) as shared:
        wanting = rows.mapInArrow(_wanting(shared, kind), "tid long, " + ", ".join(f"{x} binary" for x in _WANTED))
        wanting = F.broadcast(wanting) if few else wanting
        again = scratch.save(wanting.join(model.texts.select("tid", "ids"), "tid").mapInArrow(_refilled(level, DEPTH), _ROWS), "places", done)
    return level, DEPTH, again, _of_places, None


def _judged(spark, out: DataFrame, hot: np.ndarray, known: Columns) -> Held:
    """Which frequent contexts are retained, and what they leave over. ``known``: their frequent pairs."""
    stats = out.where(F.col("kind").isin(ENTRIES, TOTALS)).mapInArrow(_stats, "c long, total long, several long, kinds long").groupBy("c").agg(*(F.sum(x).alias(x) for x in ("total", "several", "kinds"))).toArrow()  # at most a row for each frequent context
    above = Lookup(hot)
    total, several, kinds, gain = (np.zeros(len(hot)) for _ in range(4))
    at = above.find(stats.column("c").to_numpy().view(np.uint64))
    total[at], several[at], kinds[at] = (stats.column(x).to_numpy() for x in ("total", "several", "kinds"))
    of, entry = above.find(known["c"].view(np.uint64)), known["n"] >= MIN_ENTRY
    np.add.at(total, of, known["n"])
    np.add.at(several, of[entry], known["n"][entry])
    np.add.at(kinds, of[entry], 1)
    rest, total = total - several, np.maximum(total, 1)
    left = np.where(kinds > 0, (rest + DISCOUNT * kinds) / total, 1.0)
    held = Held(above=above, total_of=total, left_of=left)
    with _shared(spark, held) as shared:
        gains = out.where(F.col("kind") == ENTRIES).mapInArrow(_gains(shared), "c long, gain double").groupBy("c").agg(F.sum("gain").alias("gain")).toArrow()
    gain[above.find(gains.column("c").to_numpy().view(np.uint64))] = gains.column("gain").to_numpy()
    n, q, of = known["n"][entry], known["q"][entry], of[entry]
    np.add.at(gain, of, n * np.log(((n - DISCOUNT) / total[of] + left[of] * q) / q))
    held.retained = (kinds > 0) & (gain + rest * np.log(left) > 0.5 * (kinds + rest) * np.log(total))
    return held


def train(docs: DataFrame) -> Model:
    model = _read(docs)
    if model.n:
        _tree(model, keep=True)
    return model


def suffix_tree_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = _read(docs)
    terms = model.texts.select("tid", F.lit(0.0).alias("term"))
    if model.n:
        terms = reduce(DataFrame.unionByName, _tree(model, keep=False))
    terms = terms.groupBy("tid").agg(F.sum("term").alias("terms"))
    scored = model.texts.select("tid", "t1", "t2", "n_tokens", "n_known", "base").join(terms, "tid", "left")
    scored = scratch.save(scored.select("t1", "t2", "n_tokens", "n_known", "base", F.coalesce("terms", F.lit(0.0)).alias("terms")), "scored")
    scratch.remove(docs.sparkSession, model.tables)
    out = _hashed(docs).select("doc_id", "t1", "t2").join(scored, ["t1", "t2"])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("terms")).alias("score")
    )
