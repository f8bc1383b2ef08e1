"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``score = sigmoid(w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2))``: all pairwise interactions in
time linear in the features, by the sum-of-squares identity. Words are hashed to buckets and scaled to unit length;
statistics of the text (shares of symbols, digits, capitals, line ends, punctuation and non-ASCII bytes; word length,
words a line, distinct share) and its metadata (size) are one-hot levels.

Training takes at most ``SAMPLE`` labelled rows (those with the smallest hash of their doc_id: a documented bound), by
iterative parameter mixing: in each round every partition of the sample runs AdaGrad from the same parameters, and the
results are averaged. Scoring is one pass over all texts.

Defined results: null and empty texts have only their level features and a score; labels that are null or neither 0 nor
1 are not learned from; of several labels of one doc_id the largest counts; without any label every score is 0.5;
repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .text import blocks, lists, words

WORD_BUCKETS, LEVELS, FACTORS = 1 << 15, 64, 8
SAMPLE, PARTS, ROUNDS = 20_000, 8, 6
_CLASSES = [b"#*$%&|<>", b"0123456789", bytes(range(0x41, 0x5B)), b"\n", b".,;:!?", b"\"'()[]{}", b" \t", b"/@=_~^\\+-", bytes(range(0x80, 0x100))]
N_STATS = len(_CLASSES) + 4
SIZE = WORD_BUCKETS + N_STATS * LEVELS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of every feature of a block, sorted by row."""
    n_rows = len(offsets) - 1
    w = words(data, offsets, lower=True)
    n = w.counts()
    key = np.repeat(np.arange(n_rows), n) * WORD_BUCKETS + (w.hashes() & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    unique, count = np.unique(key, return_counts=True)
    row, index = unique // WORD_BUCKETS, unique % WORD_BUCKETS
    value = np.sqrt(count)
    value = value / np.sqrt(np.bincount(row, value * value, n_rows))[row]
    size = np.maximum(np.diff(offsets), 1)
    seen = np.zeros(len(data) + 1, np.int64)
    shares = []
    for members in _CLASSES:
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        np.cumsum(table[data], out=seen[1:])
        shares.append((seen[offsets[1:]] - seen[offsets[:-1]], size))
    lines = shares[3][0] + 1
    shares += [(size - shares[6][0], 40 * np.maximum(n, 1)), (n, 400 * lines), (np.bincount(row, minlength=n_rows), np.maximum(n, 1)), (size, 1 << 20)]
    # A share s is level round(5 * log2(1 + 4000 s)), from 0 for none to 60 for all.
    levels = np.stack([np.minimum(LEVELS - 1, np.rint(5 * np.log2(1 + 4000 * a / b))).astype(np.int64) for a, b in shares], 1)
    stat = WORD_BUCKETS + np.arange(N_STATS) * LEVELS + levels
    rows = np.concatenate((row, np.repeat(np.arange(n_rows), N_STATS)))
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate((index, stat.ravel()))[order], np.concatenate((value, np.full(stat.size, 0.5)))[order].astype(np.float32)


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    @classmethod
    def fresh(cls) -> Machine:
        return cls(0.0, np.zeros(SIZE, np.float32), np.random.default_rng(7).normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))

    def margins(self, row: np.ndarray, index: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
        """Every row has features, so that each has its own run."""
        first = np.searchsorted(row, np.arange(n_rows))
        xv = self.v[index] * x[:, None]
        s = np.add.reduceat(xv, first, axis=0)
        q = np.add.reduceat(xv * xv, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[index] * x, first) + 0.5 * (s * s - q).sum(axis=1)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(machine: Machine, examples: list[tuple[int, np.ndarray, np.ndarray]], rate: float = 0.1, decay: float = 1e-5, batch: int = 16) -> Machine:
    """One AdaGrad pass over (label, indices, values)."""
    w0, w, v = machine.w0, machine.w.copy(), machine.v.copy()
    g0, gw, gv = 1.0, np.full(SIZE, 1.0, np.float32), np.full((SIZE, FACTORS), 1.0, np.float32)
    for lo in range(0, len(examples), batch):
        part = examples[lo : lo + batch]
        index, x = np.concatenate([e[1] for e in part]), np.concatenate([e[2] for e in part])
        row = np.repeat(np.arange(len(part)), [len(e[1]) for e in part])
        m = Machine(w0, w, v)
        error = (sigmoid(m.margins(row, index, x, len(part))) - np.asarray([e[0] for e in part])).astype(np.float32)
        first = np.searchsorted(row, np.arange(len(part)))
        xv = v[index] * x[:, None]
        s = np.add.reduceat(xv, first, axis=0)
        e = error[row]
        used, at = np.unique(index, return_inverse=True)
        dw = np.zeros(len(used), np.float32)
        np.add.at(dw, at, e * x)
        dv = np.zeros((len(used), FACTORS), np.float32)
        np.add.at(dv, at, (e * x)[:, None] * (s[row] - xv))
        dw, dv = dw + decay * w[used], dv + decay * v[used]
        gw[used] += dw * dw
        gv[used] += dv * dv
        w[used] -= rate * dw / np.sqrt(gw[used])
        v[used] -= rate * dv / np.sqrt(gv[used])
        g0 += float(error.sum()) ** 2
        w0 -= rate * float(error.sum()) / g0**0.5
    return Machine(w0, w, v)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column("text")):
            row, index, x = features(data, offsets)
            n = np.bincount(row, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), lists(index.astype(np.int32), n, pa.int32()), lists(x, n, pa.float32())], ["part", "doc_id", "label", "index", "x"]
            )


def _round(shared):
    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("doc_id")
        m = learn(shared.value, list(zip(frame["label"], frame["index"], frame["x"], strict=True)))
        return pd.DataFrame({"part": [key[0]], "n": [len(frame)], "w0": [m.w0], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Machine | None:
    """A machine fitted to the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    spark = docs.sparkSession
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = scratch.save(known, "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(scratch.bounded(known, 16), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "label", "t.text")  # at most ``sample`` rows: one for each doc_id
    rows = texts.select(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"), "doc_id", "label", "text")
    rows = scratch.save(rows.mapInArrow(_extract, "part int, doc_id long, label int, index array<int>, x array<float>"), "features")
    if rows.isEmpty():
        return None
    machine = Machine.fresh()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(machine)
        parts = rows.groupBy("part").applyInPandas(_round(shared), "part int, n long, w0 double, w binary, v binary").collect()  # PARTS rows of a fixed size
        parts.sort(key=lambda r: r["part"])
        total = sum(r["n"] for r in parts)
        mean = lambda f: sum(f(r) * (r["n"] / total) for r in parts)  # noqa: B023, E731
        machine = Machine(
            float(mean(lambda r: r["w0"])),
            mean(lambda r: np.frombuffer(r["w"], np.float32)).astype(np.float32),
            mean(lambda r: np.frombuffer(r["v"], np.float32)).astype(np.float32).reshape(SIZE, FACTORS),
        )
        shared.unpersist()
    return machine


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                if machine is None:
                    z = np.zeros(hi - lo)
                else:
                    row, index, x = features(data, offsets)
                    z = machine.margins(row, index, x, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sigmoid(z.astype(np.float64)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(shared), f"doc_id {dict(texts.dtypes)['doc_id']}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
