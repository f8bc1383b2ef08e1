"""Each corpus operator against brute force, on a small corpus with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from kindred.llm import bpe, decontam, licenses, minhash, quality_fm, quality_rules, substring, suffix_lm, urlfilter, warc
from kindred.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, content string, row string, keys string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def corpus(seed=5):
    """Invented texts with copies, near copies, shared passages, extremes; doc_ids with gaps."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ka", "lo", "mé", "东", "s'", "Ri") for b in ("na", "to", "ß", "ve", "lu", "x9", "Ø")]
    words = lambda n: [r.choice(vocabulary) + str(r.randrange(40)) for _ in range(n)]
    passage, base = words(70), words(300)
    texts = [" ".join(words(r.randrange(1, 200))) for _ in range(40)]
    texts += [" ".join(words(30) + passage[: r.randrange(45, 71)] + words(30)) for _ in range(12)]
    texts += [" ".join(w if r.random() > p else "edit" + str(r.randrange(10**6)) for w in base) for p in (0.0, 0.01, 0.02, 0.03, 0.05, 0.01, 0.02) for _ in range(3)]
    texts += [" ".join(base)] * 4 + ["one\ttwo\x0bthree\nfour", "", "   \n\t", None, "solo", "SOLO", "two words", " ".join(passage * 12), "the same line here\n" * 30]
    texts += [" ".join(words(9000)), "x" * 20000, "<|endoftext|> a<|endoftext|>b", "　wide space here", "á é \U0001f600 \U0001f469‍\U0001f680"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1]), (None, None), (7, "another text of the same id")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, ("en", "de", None)[(i or 0) % 3], f"s{(i or 0) % 2}", len(t or ""), 1, "c", "r", "k") for i, t in rows]
    return spark.createDataFrame(made, DOCS).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_substring(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept, t if not any(gone) else kept))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(50, 25), (8, 3), (1, 1)])
def test_substring(docs, rows, window, anchor):
    expected = brute_substring(rows, window)
    assert any(x[2] for x in expected)
    digest = got(substring.substring_digest(docs, window, anchor), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert digest == sorted(((i, n, g, sha(k)) for i, n, g, k, _ in expected), key=str)
    cut = substring.remove_repeats(docs, window, anchor)
    assert cut.columns == docs.columns
    assert got(cut, "doc_id", "text") == sorted(((i, t) for i, _, _, _, t in expected), key=str)


def test_substring_random(spark):
    r = random.Random(1)
    for _ in range(3):
        rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(0, 40)))) for i in range(30)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(substring.substring_digest(df, 6, 3), "doc_id", "n_removed", "kept_sha256") == sorted(((i, g, sha(k)) for i, _, g, k, _ in brute_substring(rows, 6)), key=str)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_paths_are_compacted_by_degrees(spark):
    """Documents 1 and 2 read a b c d, document 3 reads b c d and document 4 ends after c: the path bc is unbranched, as is a, as is d."""
    reads = {1: "abcd", 2: "abcd", 3: "bcd", 4: "xbc"}
    rows = [(ord(x), i, i, 10 * k, 10) for i, text in reads.items() for k, x in enumerate(text)]
    rows += [(ord("z"), 9, 9, 500, 7)]
    single = spark.createDataFrame(rows, "anchor long, doc_id long, h long, first int, length int")
    got = {chr(r.anchor): (r.length, r.source.doc_id, r.source.first, r["last"]) for r in substring._paths(single, []).collect()}
    assert got == {"a": (10, 1, 0, 2), "b": (20, 1, 10, 4), "d": (10, 1, 30, 3), "x": (10, 4, 0, 4), "z": (7, 9, 500, 9)}
    long = spark.createDataFrame([(1000 + k, i, i, 5 * k, 5) for i in (3, 8) for k in range(150)], single.schema)
    assert [(r.anchor, r.length, r.source.doc_id) for r in substring._paths(long, []).collect()] == [(1000, 750, 3)]


def shingles(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_near(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    named = sorted({i for i, s in sets if s and i is not None})
    parent = {i: i for i in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    by_set = {}
    for i, s in sets:
        if s and i is not None:
            by_set[s] = min(by_set.get(s, i), i)
    return [(i, len(s), (find(by_set[s]) if s in by_set else i) if s else i) for i, s in sets]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (2, 60)])
def test_near_duplicates(docs, rows, k, percent):
    out = minhash.near_duplicates(docs, k, percent, bands=60, rows=3)
    expected = brute_near([x for x in rows if x != (7, "another text of the same id")], k, percent)
    found = [x for x in got(out, "doc_id", "n_shingles", "component_id", "kept") if x[:2] != (7, len(shingles("another text of the same id", k)))]
    assert found == sorted(((i, n, c, i == c) for i, n, c in expected), key=str)


def test_shipped_setting_loses_no_link(spark):
    """30 bands of 5 at 3 words and 85 %, as the query has them, against every pair of 400 texts that are near each other."""
    r = random.Random(12)
    rows = []
    for g in range(40):
        base = [f"w{r.randrange(9000)}" for _ in range(r.randrange(30, 250))]
        for _ in range(10):
            rows.append((len(rows) * 7 % 4001, " ".join(w if r.random() > 0.012 * (g % 5) else f"e{r.randrange(10**6)}" for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute_near(rows, 3, 85), key=str)
    assert len({x[2] for x in expected}) > 60
    assert got(minhash.near_duplicates(df, k=3, percent=85), "doc_id", "n_shingles", "component_id") == expected


def test_a_large_hub_is_many_blocks(spark, monkeypatch):
    """Texts that share boilerplate but are under the threshold: all meet, in blocks, and no link between outsiders is lost."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    r = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    own = [[f"o{g}x{i}" for i in range(40)] for g in range(30)]
    rows = [(i, " ".join(common + own[i % 30] + ([f"u{i}"] if r.random() < 0.5 else []))) for i in range(90)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, bands=40, rows=1)
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute_near(rows, 1, 90), key=str)


def test_one_of_each_group_stays(spark):
    """Copies without an id, repeated rows, and two texts of one id."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(5, a, "x"), (5, a, "x"), (9, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (7, c, "x"), (7, "another text", "y"), (8, None, "z"), (8, None, "z"), (3, "", "e"), (4, "", "e")]
    left = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, __t1 string"))
    assert left.columns == ["doc_id", "text", "__t1"]
    assert got(left, "doc_id", "text") == sorted([(5, a), (None, b), (7, c), (7, "another text"), (8, None), (3, ""), (4, "")], key=str)


def test_pivots_and_outsiders(spark):
    """Two tight groups that share half of their text: a hub of one meets members of the other."""
    r = random.Random(2)
    common, one, two = ([f"{p}{i}" for i in range(n)] for p, n in (("c", 120), ("o", 60), ("t", 60)))
    rows = [(i, " ".join(common + (one if i % 2 else two) + [f"u{i}{j}" for j in range(r.randrange(4))])) for i in range(60)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, bands=80, rows=2)
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute_near(rows, 1, 90), key=str)


def test_signature_is_circulant():
    import numpy as np

    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64))
    sig = minhash.signature(s, 200)
    at = minhash.scatter((s >> np.uint64(32)).astype(np.uint32))
    assert all(sig[k] == minhash.permute((at - np.uint32(k)).copy()).min() for k in range(200))
    t = np.concatenate((s[:240], s[:60] + np.uint64(1 << 33)))
    assert abs((sig == minhash.signature(np.unique(t), 200)).mean() - len(np.intersect1d(s, t)) / len(np.union1d(s, t))) < 0.12


def test_drop_near_duplicates(docs):
    kept = minhash.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns
    keep = {r.doc_id for r in minhash.near_duplicates(docs, 3, 85, bands=36).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} - {None, 7} == keep - {None, 7}


# --- 9 ---------------------------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = ITEM.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[s : s + window])].add(i)
    lengths, out = {len(k) for k in wins}, []
    for i, t in rows:
        w = ITEM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k] - {None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_contamination(spark, docs, rows, block):
    texts = [t for _, t in rows if t]
    items = [(i, t[: 40 + 20 * i]) for i, t in enumerate(texts[:9])] + [(77, "solo"), (78, "two-WORDS"), (79, None), (80, " .. "), (None, "edit"), (77, "solo"), (5, "here wide")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(brute_contamination(rows, items, 10), key=str)
    rename = decontam.contamination(docs, table, 10, block)
    flat = sorted(((r.doc_id, r.n_words, sum(b - a for a, b in zip(r["hits"][::2], r["hits"][1::2], strict=True)), len(r["items"])) for r in rename.collect()), key=str)
    assert flat == sorted((x[:4] for x in expected), key=str)
    assert got(decontam.contamination_digest(docs, table), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    clean = decontam.drop_contaminated(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in expected)
    for s in decontam.contamination_spans(docs.where("doc_id <> 7 and text is not null"), table).collect():
        text = dict(rows)[s.doc_id].encode()
        assert text[s.from_byte : s.to_byte].decode() == s.passage and decontam.normalised(s.passage)


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_bpe(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.no_padding(), t.no_truncation()
    expected = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got(bpe.bpe_digest(docs, vocabulary_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    back = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    assert got(back, "doc_id", "text") == sorted(((i, x or "") for i, x in rows), key=str)


def test_long_words_merge_alike():
    v = bpe.vocabulary(vocabulary_path())
    r = random.Random(4)
    for n in (1, 2, 40, 64, 300):
        word = "".join(r.choice("aetion hrs") for _ in range(n)).encode()
        ids = [v.byte_id[b] for b in word]
        short, limit = bpe.SHORT, 10**9
        bpe.SHORT = limit
        try:
            assert v.merge(word) == v.merge_long(ids)
        finally:
            bpe.SHORT = short


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_quality_measures(docs, rows):
    expected = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        wins = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        again = {s + k for s in range(len(w) - 7) if wins[tuple(w[s : s + 8])] > 1 for k in range(8)}
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality_rules.quality_digest(docs)
    assert got(out, *columns) == sorted(expected, key=str)
    assert out.where("base_failed and kept").isEmpty()
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


def test_fence_catches_symbols(spark):
    r = random.Random(1)
    make = lambda i: " ".join(f"w{r.randrange(999)}" + ("###" if i == 0 else "") for _ in range(60))
    df = spark.createDataFrame([(i, make(i), "en", f"s{i % 2}") for i in range(120)], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in quality_rules.quality_digest(df).where("not kept").collect()] == [0]


def test_limits_are_the_groups_own(spark):
    """Sources that punctuate, repeat and spell differently have different limits, and the sketch's bucket is the spread of few."""
    r = random.Random(2)
    rows = []
    for s in range(6):
        word = lambda: "w" * r.randrange(1, 4 + s) + str(r.randrange(60 + 40 * s)) + ("," if r.random() < 0.05 * (s + 1) else "")  # noqa: B023, E731
        rows += [(100 * s + i, " ".join(word() for _ in range(r.randrange(60, 200))), "en", f"s{s}") for i in range(80)]
        rows.append((9000 + s, " ".join(word() + "!,;" * 6 for _ in range(60)), "en", f"s{s}"))
    made = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    limits = quality_rules.group_limits(made).collect()
    for name in quality_rules.VALUES:
        assert len({x.high for x in limits if x.measure == name}) == 6
    out = quality_rules.judged(made, quality_rules.thresholds(made)).where("not base_failed and not kept")
    assert {x.doc_id for x in out.collect()} == {9000 + s for s in range(6)}


def test_sketch_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 70000).select(F.col("id").alias("v")).withColumn("b", quality_rules.bucket(F.col("v"))).withColumn("edge", F.expr(quality_rules.UPPER_EDGE))
    assert df.where("edge < v or edge > v * 65 / 64").isEmpty()
    assert df.groupBy("b").agg(F.max("v").alias("m"), F.max("edge").alias("e")).where("m <> e and e < 60000").isEmpty()


# --- 7 ---------------------------------------------------------------------------------------------------------------

URLS = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "ftp://x.net/es/1", "http://net/fr/", "http://com", "http://com/", "http://notcom.org/", "no url", None, "", "://", "http://example.com/enx", "http://mynet/es/", "http://a..net/es/#f", "http://EXAMPLE.com/en/\nfoo", "x?u=http://example.com/en/", "http://example.com#/en/"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fit = [(len(r), r, v) for r, v in urlfilter.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    pages = [(i, u, "other") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], "x"), (0, "http://com/?b", "x"), (0, "http://com/?a", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    out = urlfilter.filter_urls(df, urlfilter.rules_table(spark))
    assert got(out, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *brute_url(u)) for i, u, _ in pages), key=str)
    assert urlfilter.filter_urls(df, urlfilter.rules_table(spark).limit(0)).count() == len(pages)


def test_long_urls(spark):
    """Hosts of 20,000 labels and paths of 100 KB have as many expressions as short ones."""
    long = ["http://" + "a." * 20000 + "net/es/x", "http://" + "b." * 20000 + "example.com/en/" + "y/" * 50000, "http://x.net/fr/" + "z" * 100000 + "?q", "://" + "." * 30000]
    df = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    out = urlfilter.filter_urls(df, urlfilter.rules_table(spark))
    assert got(out, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *brute_url(u)) for i, u in enumerate(long)), key=str)


# --- 1 ---------------------------------------------------------------------------------------------------------------


def pages(spark):
    r = random.Random(3)
    same = "<p>same</p>" * 20
    rows = [(i, f"http://h/{i}", "é" * r.randrange(0, 400) + str(r.random())) for i in range(60)]
    rows += [(i, f"http://s/{i}", same) for i in range(100, 130)] + [(200, None, None), (201, "http://a b\r\nX: y", "tiny"), (202, "u", "tiny"), (None, "n", "null id"), (150, "x", same), (150, "x", same), (100, "y", same), (300, "big", "<b>" * 200000)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_warc(spark, tmp_path):
    rows, df = pages(spark)
    root = f"file://{tmp_path}/a"
    manifest = warc.write_archive(df, root, shard_bytes=30_000, file_bytes=4_000).orderBy("name").collect()
    assert len(manifest) > 4 and sum(m.records for m in manifest) == len(rows)
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")}
    assert set(files) == {m.name for m in manifest} and not (tmp_path / "a/_temporary").exists()
    assert all(hashlib.sha256(files[m.name]).hexdigest() == m.sha256 and len(files[m.name]) == m.bytes for m in manifest)
    back = warc.read_archive(spark, root, payloads=True).collect()
    first = {}
    for i, _, t in rows:
        if t and len(t.encode()) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    expected = collections.Counter()
    seen = set()
    for i, _, t in rows:
        t = t or ""
        response = t not in first or i == first[t] and (i, t) not in seen
        seen.add((i, t))
        expected[i, len(t.encode()), sha(t), "response" if response else "revisit", None if response else first[t]] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected
    assert all(sha(r.payload) == r.payload_digest for r in back if r.record_type == "response")
    again = warc.write_archive(df.repartition(7), f"file://{tmp_path}/b", shard_bytes=30_000, file_bytes=4_000).collect()
    assert {(m.name, m.sha256) for m in again} == {(m.name, m.sha256) for m in manifest}


def test_warc_without_ids_is_many_shards(spark, tmp_path):
    """Rows without an id, and of one id, are dealt by payload; each record has an id of its own; clashing columns do no harm."""
    rows = [(None, f"http://n/{i}", "n" * 200 + str(i), 1, "a") for i in range(120)] + [(None, f"http://e/{i}", None, 1, "a") for i in range(60)]
    rows += [(7, f"http://s/{i}", "s" * 200 + str(i), 1, "a") for i in range(120)] + [(None, "http://e/1", None, 2, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, shard int, digest string").repartition(3)
    root = f"file://{tmp_path}/n"
    manifest = warc.write_archive(df, root, shard_bytes=5_000, file_bytes=1 << 20).collect()
    per = collections.Counter()
    for m in manifest:
        per[m.shard] += m.records
    assert sum(per.values()) == len(rows) and len(per) > 6 and max(per.values()) < 80
    import gzip

    ids = [head["warc-record-id"] for p in (tmp_path / "n").glob("*.warc.gz") for head, _ in warc.records(gzip.open(p, "rb"))]
    assert len(ids) == len(set(ids))
    assert got(warc.read_archive(spark, root), "page_id", "url", "record_type") == sorted(((i, u, "response") for i, u, *_ in rows), key=str)


def test_warc_empty_and_damaged(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(none, f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0
    warc.write_archive(spark.createDataFrame([(1, "u", "payload")], none.schema), f"file://{tmp_path}/d")
    import gzip

    path = next((tmp_path / "d").glob("*.gz"))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"payload\r\n", b"PAYLOAD\r\n")))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"file://{tmp_path}/d").collect()


# --- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("p_word", [suffix_lm.P_WORD, 0.002])
def test_suffix_tree(docs, rows, p_word, monkeypatch):
    monkeypatch.setattr(suffix_lm, "P_WORD", p_word)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    c = collections.Counter(x for i, w in tokens if not held(i) for x in w)
    n, total = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    expected = sorted(((i, held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.1) / total) for x in w), 6)) for i, w in tokens), key=str)
    out = suffix_lm.suffix_tree_scores(docs)
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()), key=str)
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert all(math.isclose(x[5], y[5], abs_tol=1e-4) for x, y in zip(found, expected, strict=True))


def test_suffix_tree_learns_contexts(spark):
    r = random.Random(8)
    after = {w: [f"{w}{k}" for k in "xyz"] for w in "abcdefgh"}
    text = lambda: " ".join(x for w in (r.choice("abcdefgh") for _ in range(60)) for x in (w, r.choice(after[w])))
    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    out = suffix_lm.suffix_tree_scores(df).where("held_out").collect()
    assert sum(r.score for r in out) > 0.7 * sum(r.base_score for r in out)
    model = suffix_lm.train(df)
    for context in ([], [258], [258, 259], [suffix_lm.START_ID]):
        assert 0.97 < sum(model.probabilities(context).values()) < 1.03  # classes without words keep a little mass


def test_suffix_tree_limits_are_counts(spark):
    """What is learned of a passage stays, however much other text there is."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    small = [(i, passage) for i in (1, 2, 3)]
    large = small + [(i, " ".join(f"w{r.randrange(20000)}" for _ in range(300))) for i in range(4, 254)]
    learned = []
    for rows in (small, large):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = {x.doc_id: x for x in suffix_lm.suffix_tree_scores(df).collect()}
        learned.append([out[i].score - out[i].base_score for i in (1, 2, 3)])
    assert all(b > a > 15 for a, b in zip(*learned, strict=True))  # the base scores fall, what follows what is known as before


def test_suffix_tree_growth_ends(spark):
    """Many copies with edits: deeper contexts say no more than shorter ones, though single words that follow differ at every place."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.03 else f"e{r.randrange(10**6)}" for w in base)) for i in range(300)]
    model = suffix_lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 1 <= len(model.offered) <= 4


def test_words_seen_once_are_told_to_held_out_texts_only(spark, monkeypatch):
    """A training text is told which of its words are seen again, a held-out one all that training has, whether tasks hold words or not."""
    r, plain = random.Random(11), suffix_lm._encode
    rows = [(i, " ".join([*(f"w{r.randrange(60)}" for _ in range(12)), f"once{i}", f"once{r.randrange(120)}"])) for i in range(120)]
    rows += [(i, f"both {rows[i % 500][1]}") for k in range(0, 120, 7) for i in (k, k + 500)] + [(None, "null once1 id"), (700, None), (701, ""), (702, "")] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda: sorted((x.doc_id is None, x.doc_id or 0, x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, round(x.score, 9)) for x in suffix_lm.suffix_tree_scores(docs).collect())
    want = scores()
    assert any(x[2] and x[4] < x[3] for x in want) and any(x[2] and x[4] == x[3] for x in want)

    def checked(shared):
        run = plain(shared)

        def told(batches):
            for b in batches:
                for text, times, own in zip(*(b.column(c).to_pylist() for c in ("text", "times", "own")), strict=True):
                    assert not times or text.startswith("both") or all(x["n"] > 1 for x in own), "a word that a training text has once needs not be told"
                yield b

        return lambda batches: run(told(batches))

    monkeypatch.setattr(suffix_lm, "_encode", checked)
    monkeypatch.setattr(suffix_lm, "P_WORD", 0.02)
    assert [tuple(pytest.approx(y, abs=1e-9) if isinstance(y, float) else y for y in x) for x in want] == scores()


@pytest.mark.parametrize("p_hot", [suffix_lm.P_HOT, 0.01])
def test_suffix_tree_is_the_defined_one(spark, docs, rows, p_hot, monkeypatch):
    """Every score against a tree made of dictionaries; held terms and joined ones; depth over two."""
    monkeypatch.setattr(suffix_lm, "P_HOT", p_hot)
    monkeypatch.setattr(suffix_lm, "P_WORD", 0.002)
    r = random.Random(3)
    deep = []  # the third symbol back decides the next one
    for i in range(60):
        w = [r.choice("ab") for _ in range(3)]
        while len(w) < 150:
            w.append(w[-3] if r.random() < 0.95 else r.choice("ab"))
        deep.append((1000 + i, " ".join(w)))
    rows = rows + deep
    df = docs.select("doc_id", "text").union(spark.createDataFrame(deep, "doc_id long, text string"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    count = collections.Counter(x for i, w in tokens if not held(i) for x in w)
    total = sum(count.values()) + 0.1 * (len(count) + 1)
    symbol = lambda x: (256,) if x is None else x if count[x] >= 2 else (x.encode()[-1],)
    base = collections.Counter()
    for x, k in count.items():
        base[symbol(x)] += (k + 0.1) / total
    lists = [(i, [symbol(x) for x in w], w) for i, w in tokens]
    levels, p_above = [], {((), x): p for x, p in base.items()}
    ctx = lambda s, t, n: tuple(([(257,)] + s)[t + 1 - n : t + 1]) if t + 1 >= n else None
    while True:
        n, follow = len(levels) + 1, collections.defaultdict(collections.Counter)
        for i, s, _ in lists:
            for t in range(len(s)) if not held(i) else ():
                c = ctx(s, t, n)
                if c and (n == 1 or c[1:] in levels[-1][0]):
                    follow[c][s[t]] += 1
        left, p = {}, {}
        for c, f in follow.items():
            several, size = {x: k for x, k in f.items() if k >= 2}, sum(f.values())
            if not several:
                continue
            q = {x: p_above[c[1:], x] for x in several}
            over = 1 - sum((k - 0.7) / size for k in several.values())
            own = {x: (k - 0.7) / size + over * q[x] for x, k in several.items()}
            gain = sum(k * math.log(own[x] / q[x] if x in own else over) for x, k in f.items())  # of the log probability of what follows
            if gain > 0.5 * len(f) * math.log(size):
                left[c] = over
                p |= {(c, x): y for x, y in own.items()}
        if not left:
            break
        levels.append((left, p))
        p_above = p
    assert len(levels) >= 3
    expected = []
    for i, s, w in lists:
        score = 0.0
        for t, x in enumerate(s):
            score += math.log10((count[w[t]] + 0.1) / total)
            above = base.get(x)
            for n, (left, p) in enumerate(levels, 1):
                c = ctx(s, t, n)
                if c not in left:
                    break
                score += math.log10(p[c, x] / above) if (c, x) in p else math.log10(left[c])
                above = p.get((c, x))
        expected.append((i, len(s), score))
    found = sorted(((x.doc_id, x.n_tokens, x.score) for x in suffix_lm.suffix_tree_scores(df).collect()), key=lambda x: (str(x[0]), *x[1:]))
    expected.sort(key=lambda x: (str(x[0]), *x[1:]))
    assert all(x[:2] == y[:2] and math.isclose(x[2], y[2], rel_tol=1e-6, abs_tol=1e-4) for x, y in zip(found, expected, strict=True))


@pytest.mark.parametrize("large, depth", [(40, 10), (250_000, 1), (15, 2)])
def test_suffix_tree_however_it_is_dealt(spark, docs, rows, large, depth, monkeypatch):
    """Contexts and pairs too large for a bucket, and contexts longer than what a position takes along: the same tree."""
    monkeypatch.setattr(suffix_lm, "LARGE", large)
    monkeypatch.setattr(suffix_lm, "DEPTH", depth)
    test_suffix_tree_is_the_defined_one(spark, docs, rows, suffix_lm.P_HOT, monkeypatch)


def test_suffix_tree_model_of_large_contexts(spark, monkeypatch):
    """What is retained, and its figures, do not depend on what is too large for a bucket."""
    r = random.Random(12)
    df = spark.createDataFrame([(i, " ".join(r.choice(("a b c", "a b d e", "f a", "b")) for _ in range(40))) for i in range(60)], "doc_id long, text string").cache()
    found = []
    for large, depth in ((250_000, 10), (30, 2)):
        monkeypatch.setattr(suffix_lm, "LARGE", large)
        monkeypatch.setattr(suffix_lm, "DEPTH", depth)
        m = suffix_lm.train(df)
        found.append((m.offered, sorted((x.c, x.total, x.level, round(x.term, 9)) for x in m.contexts.collect()), sorted((x.g, x.n, round(x.p, 9), round(x.term, 9)) for x in m.entries.collect())))
    assert found[0] == found[1] and len(found[0][0]) >= 2


def test_suffix_tree_sums_by_text(spark, monkeypatch):
    """No table has a row for each text and bucket: at most one of each text for each part."""
    monkeypatch.setattr(suffix_lm, "P_HOT", 1.0)
    r, made, save = random.Random(4), {}, suffix_lm.scratch.save
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(60)}" for _ in range(300)) + " a b c d" * 30) for i in range(50)], "doc_id long, text string")

    def counted(df, name, held=None):
        out = save(df, name, held)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(suffix_lm.scratch, "save", counted)
    assert any(x.score > x.base_score + 1 for x in suffix_lm.suffix_tree_scores(df).collect())
    sums = [n for name, counts in made.items() if name in ("terms", "sums") for n in counts]
    assert sums and max(sums) <= 50


def test_suffix_tree_positions_are_small():
    """A position is dealt in as few bytes as its values need (80 before, in arrays of whole numbers), and read as it was."""
    r, n = np.random.default_rng(7), 5000
    p = {
        "tid": (3 << 32) + np.sort(r.integers(0, 500, n)), "t": r.integers(-1, 600, n).astype(np.int32), "x": r.integers(0, 500_000, n).astype(np.int32), "w": r.integers(0, 2, n),
        "m": np.zeros(n, np.int64), "n": np.full(n, -1), "q": r.random(n), "c": r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2), "window": r.integers(-1, 500_000, (n, suffix_lm.DEPTH)).astype(np.int32),
    }
    bucket = r.integers(0, 3, n)
    dealt = {x: y for x, y in p.items() if x not in ("q", "c")}
    for columns, most in ((dealt, 30), (p, 50)):
        rows = list(suffix_lm._blobs(suffix_lm.PLACES, bucket, 3, columns))
        assert sum(x.nbytes for x in rows) < most * n
        order = np.argsort(bucket, kind="stable")
        found = suffix_lm._joined([suffix_lm._opened(x, suffix_lm.PLACES) for x in rows])
        assert found.keys() == columns.keys() and all((found[x] == y[order]).all() and found[x].dtype == y.dtype for x, y in columns.items())


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_quality_machine(spark, docs):
    r = random.Random(6)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) + ("" if i % 2 else "##") for _ in range(r.randrange(20, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1, None), (None, 1), (2, 5)], "doc_id long, quality int")
    out = quality_fm.quality_scores(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.predicted == r.doc_id % 2 for r in out if r.held_out) / sum(r.held_out for r in out) > 0.95
    nothing = quality_fm.quality_scores(docs, labels.limit(0)).collect()
    assert len(nothing) == docs.count() and {(r.score, r.predicted) for r in nothing} == {(0.5, 1)}


def test_machine_learns_from_odd_texts(spark):
    """Null, empty, very long and repeated texts, and a doc_id with many rows, among what is learned from."""
    r = random.Random(8)
    good = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(60))
    bad = lambda: " ".join("###" + str(r.randrange(9)) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)] + [(400, None), (401, ""), (402, "x " * 200000), (403, " \n ")] + [(404, good()) for _ in range(50)] + [(1, good())] * 3 + [(None, good())]
    marks = [(i, i % 2) for i in range(300)] + [(i, 0) for i in range(400, 404)] + [(404, 1), (404, 1), (None, 1), (500, None), (5, 7)]
    out = quality_fm.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    held = [(x.predicted, x.doc_id % 2) for x in out if x.held_out and x.doc_id is not None and 1 < x.doc_id < 300]
    assert held and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert [x.held_out for x in out if x.doc_id is None] == [False]


def test_sum_of_squares_identity():
    import numpy as np

    g = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, g.normal(size=quality_fm.SIZE), g.normal(size=(quality_fm.SIZE, quality_fm.FACTORS)))
    index, x = g.integers(0, quality_fm.SIZE, 9), g.normal(size=9)
    pairs = sum((m.v[index[i]] @ m.v[index[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(9), 2))
    assert m.margins(np.zeros(9, int), index, x, 1)[0] == pytest.approx(0.3 + m.w[index] @ x + pairs)


# --- 5 ---------------------------------------------------------------------------------------------------------------


def dice(a, b):
    a, b = licenses.bigrams(a.encode()), licenses.bigrams(b.encode())
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses(spark, docs):
    texts = ["Some words.\nReleased under the MIT license!\nMore words", "licensed under the apache license version 2.0", "Licensed maybe under something.", "", None, "x " * 50, licenses.TEMPLATES[9][1], "Some words. Licensed under CC BY-NC 4.0. More."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [out[i].licenses for i in range(8)] == ["MIT", "Apache-2.0", "", "", "", "", "MIT", "CC-BY-NC-4.0"]
    held = licenses.Templates(licenses.TEMPLATES)
    for t in texts:
        found = dict(held.near((t or "").encode(), 0.5))
        for name in {n for n, _ in licenses.TEMPLATES}:
            best = max(dice(t or "", x) for n, x in licenses.TEMPLATES if n == name)
            assert (name in found) == (best >= 0.5)
    assert licenses.license_scan(docs).count() == docs.count()


def test_licenses_across_lines_and_within_sentences(spark):
    t = [x for _, x in licenses.TEMPLATES]
    isc = re.sub(r"(.{50,72}) ", r"\1\n", t[8])
    texts = [
        "A long document, not about this.\n" + t[0].replace("GNU ", "GNU\n") + "\nMore of it.", "Many words stand before.\n" + isc + "\nand many after it.",
        "The helper library in this folder was released under the MIT License by its authors in 2020.", "Before. " + re.sub(r"(.{50,72}) ", r"\1\n", dict(licenses.TEMPLATES)["BSD-2-Clause"]) + " After.",
        "under the " * 2000, "the license under version of this work " * 500,
        "Before.\n" + [x for n, x in licenses.TEMPLATES if n == "GPL-3.0"][1].replace("software", "program", 9) + "\nAfter.",
    ]
    out = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i].licenses for i in range(7)] == ["GPL-3.0", "ISC", "MIT", "BSD-2-Clause,BSD-3-Clause", "", "", "GPL-3.0"]
    assert all(out[i].best_dice == 1 for i in range(4))


def test_license_windows_against_all():
    r = random.Random(4)
    held = licenses.Templates([("A", "a b c a d"), ("B", "b b a"), ("C", "c")])
    for threshold in (0.5, 0.8):
        for _ in range(150):
            w = [r.choice("abcd") for _ in range(r.randrange(0, 14))]
            best = {}
            for i, j in itertools.combinations(range(len(w) + 1), 2):
                for name, text in (("A", "a b c a d"), ("B", "b b a"), ("C", "c")):
                    d = dice(" ".join(w[i:j]), text)
                    if d >= threshold:
                        best[name] = max(best.get(name, 0), d)
            assert [x[:2] for x in held.scan(" ".join(w), threshold)] == sorted(best.items())


# --- all -------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        minhash.near_duplicates(none), minhash.drop_near_duplicates(none), bpe.bpe_digest(none, vocabulary_path()), quality_fm.quality_scores(none, labels), licenses.license_scan(none),
        substring.substring_digest(none), substring.remove_repeats(none), suffix_lm.suffix_tree_scores(none), decontam.contamination_digest(none, bench), decontam.drop_contaminated(none, bench),
        quality_rules.quality_digest(none), quality_rules.keep_good(none), urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string"), urlfilter.rules_table(spark)),
    ]
    assert all(df.count() == 0 for df in made)


def test_no_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination_digest(docs, bench).where("contaminated").isEmpty()
