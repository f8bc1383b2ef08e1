"""run() against the stages worked out one by one in plain Python."""

import collections
import math
import random
import re

import corpus_pipeline
import pytest
from kindred.llm import quality_rules
from kindred.llm.queries import vocabulary_path
from test_operators import WORD, brute_contamination, brute_near, brute_substring, corpus, sha


def brute_quality(rows):
    """Kept rows of (doc_id, text, lang, source)."""
    made = []
    for row in rows:
        t = row[1] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        wins = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        again = {s + k for s in range(len(w) - 7) if wins[tuple(w[s : s + 8])] > 1 for k in range(8)}
        chars, same = sum(map(len, w)), len(set(w))
        values = {"marks": 10000 * len(re.findall(r"[!-/:-@\[-`{-~]", t)) // max(1, chars), "sameness": 10000 - math.floor(10000 * math.log(same) / math.log(len(w)) + 1e-6) if len(w) > 1 else 0, "word_length": 1000 * chars // max(1, len(w))}
        made.append((row, len(w), values, len(w) < 20 or 100 * len(again) > 30 * len(w)))

    def bucket(v):
        shift = max(0, v.bit_length() - 7)
        return ((v >> shift) + 1 << shift) - 1, 1 << shift

    def fence(values):
        edges, n = sorted(map(bucket, values)), len(values)
        (q1, _), (q3, width) = (edges[-(-n * q // 4) - 1] for q in (1, 3))
        spread = quality_rules.FENCE * max(q3 - q1, width)
        return q1 - spread, q3 + spread

    groups = collections.defaultdict(list)
    for row, n, values, _ in made:
        if n:
            for level in ((row[2], row[3]), (row[2],), ()):
                for name, v in values.items():
                    groups[level, name].append(v)
    kept = []
    for row, n, values, failed in made:
        inside = not failed
        for name, v in values.items() if n else ():
            level = next(x for x in ((row[2], row[3]), (row[2],), ()) if x == () or len(groups[x, name]) >= quality_rules.LEAST)
            low, high = fence(groups[level, name])
            inside &= v <= high and not (name == "word_length" and v < low)
        if inside:
            kept.append(row)
    return kept


def brute_pipeline(rows, items):
    import tokenizers

    kept = brute_quality(rows)
    comps = brute_near([r[:2] for r in kept], 5, 80)
    kept = [r for r, (i, _, c) in zip(kept, comps, strict=True) if i == c]
    kept = [(r[0], x[4]) for r, x in zip(kept, brute_substring([r[:2] for r in kept], 50), strict=True)]
    kept = [r for r, x in zip(kept, brute_contamination(kept, items, 10), strict=True) if not x[5]]
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.no_padding(), t.no_truncation()
    out = []
    for i, text in kept:
        ids = t.encode(text, add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("tokenizers")
    r = random.Random(9)
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}") for i, t in corpus(11) if i is not None and (i, t) != (7, "another text of the same id")]
    plain = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    rows = list({row[0]: row for row in rows}.values()) + [(1000 + i, plain(80) + (" ###" * 60 if i % 40 == 0 else ""), "en", "s0") for i in range(120)]
    leak = plain(15)
    rows += [(2000 + i, f"{plain(30)} {leak} {plain(30)}", "en", "s1") for i in range(3)]
    items = [(1, leak.upper()), (2, plain(30)), (3, None)]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = brute_pipeline(rows, items)
    assert 100 < len(expected) < len(rows) - 20 and not {x[0] for x in expected} & {2000, 2001, 2002}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out.collect()) == expected


def test_stages_keep_columns(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "benchmark passages", "tokens"]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)), "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 1
