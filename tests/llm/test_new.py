"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, clashing columns and hot groups."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from kindred.llm import exact, fim, trie
from test_operators import LOWER, WORD, corpus, docs, empty, got, rows, sha  # noqa: F401

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, path string, words string, n long"


# --- 11 --------------------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text, percent=100, spm=50, seed="7", unit=r"[^\n]*\n|[^\n]+"):
    t = text or ""
    units = re.findall(unit, t)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or any(s in t for s in fim.SENTINELS) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, t
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(units), form, len(pre), len(mid), out


@pytest.fixture(scope="module")
def lined(spark, rows):  # noqa: F811
    r = random.Random(3)
    more = [(1000 + i, "".join(r.choice(["é", "a", "\n", "\r", " ", "\U0001f600", "<", "S>", ">"]) for _ in range(r.randrange(60)))) for i in range(150)]
    more += [(2000, "a <S> b\nc"), (2001, "\n" * 5000), (2002, "x" * 300_000 + "\n" + "y" * 300_000), (2003, "x\x00y\nz"), (-5, "one\ntwo\nthree"), (-5, "one\ntwo\nthree")]
    every = rows + more
    return every, spark.createDataFrame([(i, t, "e", "s", 1, 1, "c", "r", "k") for i, t in every], "doc_id long, text string, lang string, source string, n_chars long, h long, key string, output string, batch string").repartition(3).cache()


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (60, 0), (0, 50)])
def test_fill_in_middle(lined, percent, spm):
    every, df = lined
    expected = [brute_fim(*row, percent=percent, spm=spm) for row in every]
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    made = fim.fill_in_middle(df, percent=percent, spm_percent=spm)
    assert got(made, *names) == sorted(expected, key=str)
    assert got(fim.restored(made), "doc_id", "text") == sorted(((i, t or "") for i, t in every), key=str)
    digests = [(*x[:5], sha(x[5]), sha(t or "")) for x, (_, t) in zip(expected, every, strict=True)]
    assert got(fim.fim_digest(df, percent=percent, spm_percent=spm), *names[:5], "output_sha256", "restored_sha256") == sorted(digests, key=str)
    if percent == 100 and spm:
        assert {x[2] for x in expected} == {"plain", "psm", "spm"}


def test_fim_units_runs_and_sentinels(spark, lined, monkeypatch):
    every, df = lined
    monkeypatch.setattr(fim, "RUN_BYTES", 50)
    made = fim.fill_in_middle(df, unit=r"(?s).", seed="x")
    assert got(made, "doc_id", "n", "output") == sorted(((x[0], x[1], x[5]) for x in (brute_fim(*row, seed="x", unit=r"(?s).") for row in every)), key=str)
    for wrong in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("", "a", "b"), ("aba", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError, match="overlap"):
            fim.fill_in_middle(df, sentinels=wrong)
    assert fim.fim_digest(empty(spark)).count() == 0 and fim.restored(fim.fill_in_middle(empty(spark))).count() == 0


# --- 12 --------------------------------------------------------------------------------------------------------------


def brute_sequences(table):
    """conv_id to its turns (role, text), rebuilt."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
    return {c: own.get(base(c), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def brute_trie(sequences):
    members = collections.defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ids) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return [
        (min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(p)))) for p, ids in members.items()
    ]


def talk(seed=2):
    """Conversations with shared beginnings, equal ones, one first turn that a third has, long ones, nulls, ties and gaps."""
    r = random.Random(seed)
    lines = [None, "", "hello there", "hello\tthere", "one two  three", "é 東 \U0001f600", "same words again and again"]
    out = []
    for c in [*range(-45, 45), *range(200, 330, 3)]:
        n = r.choice((0, 1, 2, 2, 3, 4, 5, 6))
        turns = [("system", "the first turn that many have")] * (r.random() < 0.4) + [(r.choice(("user", "assistant", None)), r.choice(lines)) for _ in range(n)]
        out += [(c, None if k == 0 and r.random() < 0.2 else k, *x) for k, x in enumerate(turns)]
    for c in (1003, 1004, 1005, 1024, 1043):
        out += [(c, k, "user", f"step {k}") for k in range(40 + c % 3)]
    for c in range(2000, 2600):
        out += [(c, k, "user", x) for k, x in enumerate(("copied", "copied too", "end"))]
    out += [(None, 0, "user", "no conversation"), (5, 1, "user", "tie b"), (5, 1, "user", "tie a"), (5, 1, "user", "tie a"), (7, None, None, None)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def talks(spark):
    made = talk()
    return made, spark.createDataFrame([(*x, "k", "p", "w", 1) for x in made], CONVERSATIONS).repartition(5).cache()


@pytest.mark.parametrize(("largest", "bucket"), [(10_000, 2_000), (100, 30), (1, 1)])
def test_prefix_trie(talks, largest, bucket):
    made, df = talks
    expected = brute_trie(brute_sequences(made))
    assert max(x[1] for x in expected) > 38 and any(x[3] > 500 and x[6] for x in expected)
    nodes = trie.prefix_trie(trie.rebuilt(trie.sequences(df)), largest, bucket)
    assert got(nodes, *NODE) == sorted(expected, key=str)


def test_trie_of_ids_in_many_ranges(spark, talks, monkeypatch):
    made, df = talks
    monkeypatch.setattr(trie, "SPAN", 7)
    assert got(trie.conversation_trie(df), *NODE) == sorted(brute_trie(brute_sequences(made)), key=str)


def test_nested_and_turnless_conversations(spark):
    """A log that saved a conversation after each turn; one whose only turn is replaced by those of a missing conversation; none at all."""
    paths = {c: [("user", f"t{k}") for k in range(c)] for c in range(24)}
    rows = [(c, [bytes.fromhex(sha(x[1])) for x in turns], [1] * len(turns)) for c, turns in paths.items()]
    df = spark.createDataFrame(rows, "conv_id long, path array<binary>, words array<int>")
    for largest in (10_000, 150):
        assert got(trie.prefix_trie(df, largest, 100), *NODE) == sorted(brute_trie(paths), key=str)
    alone = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    one = spark.createDataFrame([(alone, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert got(trie.conversation_trie(one), *NODE) == [(alone, 0, None, 1, 0, 1, 0, sha(str(alone)))]
    assert trie.conversation_trie(one.where("conv_id < 0")).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------------------


def brute_exact(every):
    groups = collections.defaultdict(list)
    for i, t in every:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep, stays = max(ids, key=lambda i: (i is not None, i or 0)), True
        for i in ids:
            kept, stays = (i == keep and stays), (stays and i != keep)
            out.append((i, keep, len(ids), kept, sha(t)))
    return out


VERDICT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.fixture(scope="module")
def copies(spark, rows):  # noqa: F811
    r = random.Random(9)
    more = [(r.choice((None, *range(-50, 5000))), r.choice(("Hot Text of many", "hot text of MANY", "hot text of many"))) for _ in range(700)]
    more += [(i, t) for i in range(6000, 6300) for t in [f"text {i % 90} {'É' if i % 2 else 'é'}"]] + [(None, "Only Nulls"), (None, "only nulls"), (9000, ""), (9001, None), (9001, None)]
    every = rows + more
    return every, spark.createDataFrame([(i, t, 1, "b", 2, "s") for i, t in every], "doc_id long, text string, key long, bucket string, size long, sha string").repartition(6).cache()


@pytest.mark.parametrize(("bits", "bucket", "owner"), [(63, 1 << 20, 16 << 20), (63, 900, 2000), (2, 500, 900), (0, 1 << 20, 1 << 20)])
def test_exact_duplicates(copies, bits, bucket, owner):
    """With few key bits keys collide and chains grow; with small buckets the directory doubles."""
    every, df = copies
    index = exact.build(df, key_bits=bits, bucket_bytes=bucket, owner_bytes=owner)
    assert got(exact.verdicts(index), *VERDICT) == sorted(brute_exact(every), key=str)
    buckets = index.read("buckets")
    heads = buckets.where("head").count()
    assert heads == len({x[4] for x in brute_exact(every)})
    assert buckets.groupBy("key").agg({"link": "max"}).toPandas().iloc[:, 1].max() == (0 if bits == 63 else pytest.approx(heads, rel=0.9))


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    r = random.Random(4)
    keys = [r.randrange(1 << 63) for _ in range(400)] + [(5 << 58) + k for k in range(60)] + [77] * 30
    loads = spark.createDataFrame([(k, 10) for k in keys], "key long, size long")
    slots, bits = exact.directory(loads, 200)
    slots = [r.asDict() for r in slots.collect()]
    assert sorted(x["slot"] for x in slots) == sorted(set(x["slot"] for x in slots))
    of = {x["slot"]: x for x in slots}
    load, deepest = collections.Counter(), max(x["bits"] for x in slots)
    for k in keys:
        load[of[k >> 63 - bits]["bucket"]] += 10
    assert deepest == bits and len({x["bits"] for x in slots}) > 1
    for bucket, n in load.items():
        mine = [x for x in slots if x["bucket"] == bucket]
        assert len(mine) == 1 << bits - mine[0]["bits"] and (n <= 200 or mine[0]["bits"] == bits)


def test_entries_flush_and_no_rows(spark, copies, monkeypatch):
    every, df = copies
    monkeypatch.setattr(exact, "HELD_BYTES", 300)
    monkeypatch.setattr(exact, "HELD_ROWS", 5)
    assert got(exact.exact_duplicates(df), *VERDICT) == sorted(brute_exact(every), key=str)
    assert exact.exact_duplicates(empty(spark)).count() == 0
    digest = hashlib.sha256(b"").hexdigest()
    assert got(exact.exact_duplicates(spark.createDataFrame([(None, None)], "doc_id long, text string")), *VERDICT) == [(None, None, 1, True, digest)]
