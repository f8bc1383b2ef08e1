"""The quality classifier step by step, decontamination with an item larger than a block, and the pipeline's edge cases."""

import math
import random

import corpus_pipeline
import numpy as np
import pytest
from kindred.llm import decontam, quality_fm
from kindred.llm.text import BASE_1, blocks
from test_operators import LOWER, WORD, brute_contamination, got

MASK = (1 << 64) - 1


def brute_hash(word):
    x = sum((b + 1) * pow(BASE_1, i, 1 << 64) for i, b in enumerate(word.encode())) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def brute_features(text):
    """Index to value, from the text alone."""
    t, raw = (text or "").translate(LOWER), (text or "").encode()
    words = WORD.findall(t)
    counts = {}
    for w in words:
        k = brute_hash(w) % quality_fm.WORD_BUCKETS
        counts[k] = counts.get(k, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    out = {k: math.sqrt(n) / norm for k, n in counts.items()}
    size = max(1, len(raw))
    of = [sum(b in c for b in raw) for c in quality_fm._CLASSES]
    shares = [(n, size) for n in of] + [(size - of[6], 40 * max(1, len(words))), (len(words), 400 * (of[3] + 1)), (len(counts), max(1, len(words))), (size, 1 << 20)]
    for k, (a, b) in enumerate(shares):
        out[quality_fm.WORD_BUCKETS + k * quality_fm.LEVELS + min(quality_fm.LEVELS - 1, round(5 * math.log2(1 + 4000 * a / b)))] = 0.5
    return out


def brute_margin(m, x):
    z = m.w0 + sum(float(m.w[i]) * v for i, v in x.items())
    items = list(x.items())
    for a in range(len(items)):
        for b in range(a):
            z += float(m.v[items[a][0]] @ m.v[items[b][0]]) * items[a][1] * items[b][1]
    return z


def texts(n=40, seed=4):
    r = random.Random(seed)
    out = [None, "", " \n\t", "Solo", "é 東京 Ü!", "A,B;C 12345 <html> & #tag\n\nline\ttab", "x" * 3000]
    return out + [" ".join(r.choice(("the", "Cat", "sat", "0", "on!", "mat.", "東", "a_b")) + str(r.randrange(9)) for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_features_by_hand():
    import pyarrow as pa

    given = texts()
    for lo, hi, data, offsets in blocks(pa.array(given, pa.string()), 900):
        row, index, x = quality_fm.features(data, offsets)
        for k in range(lo, hi):
            mine = row == k - lo
            want = brute_features(given[k])
            assert dict(zip(index[mine].tolist(), x[mine].tolist(), strict=True)) == pytest.approx(want, abs=1e-6), given[k]


def test_learning_by_hand():
    r = np.random.default_rng(3)
    examples = [(k % 2, np.sort(r.choice(30, 5, replace=False)), r.random(5).astype(np.float32)) for k in range(10)]
    start = quality_fm.Machine.fresh()
    made = quality_fm.learn(start, examples, rate=0.1, decay=1e-3, batch=4)
    w0, w, v = 0.0, start.w.astype(float), start.v.astype(float)
    g0, gw, gv = 1.0, np.ones(30), np.ones((30, quality_fm.FACTORS))
    for lo in range(0, 10, 4):
        errors, dw, dv, used = 0.0, np.zeros(30), np.zeros((30, quality_fm.FACTORS)), set()
        for label, index, x in examples[lo : lo + 4]:
            m = quality_fm.Machine(w0, w, v)
            e = 1 / (1 + math.exp(-brute_margin(m, dict(zip(index.tolist(), x.tolist(), strict=True))))) - label
            errors += e
            for i, a in zip(index, x, strict=True):
                dw[i] += e * a
                for j, b in zip(index, x, strict=True):
                    if i != j:
                        dv[i] += e * a * b * v[j]
                used.add(int(i))
        for i in used:
            dw[i] += 1e-3 * w[i]
            dv[i] += 1e-3 * v[i]
            gw[i] += dw[i] ** 2
            gv[i] += dv[i] ** 2
        for i in used:
            w[i] -= 0.1 * dw[i] / math.sqrt(gw[i])
            v[i] -= 0.1 * dv[i] / np.sqrt(gv[i])
        g0 += errors**2
        w0 -= 0.1 * errors / math.sqrt(g0)
    assert made.w0 == pytest.approx(w0, abs=1e-5)
    assert np.allclose(made.w[:30], w[:30], atol=1e-5) and np.allclose(made.v[:30], v[:30], atol=1e-5) and np.array_equal(made.v[30:], start.v[30:])


def test_scores_by_all_pairs(spark):
    given = texts(60, 8)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(given))], "doc_id long, quality int")
    machine = quality_fm.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    for i, t in enumerate(given):
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-brute_margin(machine, brute_features(t)))), abs=1e-4)
    assert machine.w0 != 0 and max(scores.values()) - min(scores.values()) > 0.01


def test_an_item_larger_than_a_block(spark):
    """An item is never cut: a block is as large as its largest item."""
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    long, short = words(2000), words(14)
    items = [("long", long), ("short", short), ("none", None)]
    w = long.split()
    rows = [(1, " ".join(w[500:530])), (2, words(40)), (3, f"{words(5)} {short} {' '.join(w[:9])}"), (4, " ".join(w[:10])), (5, long), (6, " ".join(w[1990:])), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.contamination(docs, table, 10, 100)
    want = {x[0]: (x[1], x[2]) for x in brute_contamination(rows, items, 10)}
    assert {x.doc_id: (x.n_words, sum(x.hits[1::2]) - sum(x.hits[::2])) for x in found.collect()} == want
    assert got(decontam.drop_contaminated(docs, table, 10, 100), "doc_id") == [(2,), (7,)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(5)
    text = lambda: " ".join(f"w{r.randrange(100_000)}" for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (5, a), (None, a), (None, b), (9, c), (9, d), (None, None), (3, ""), (None, b)]
    spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert got(out, "doc_id") == [(5,), (9,), (9,), (None,)] and out.select("ids_sha256").distinct().count() == 4


def test_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() == 0
