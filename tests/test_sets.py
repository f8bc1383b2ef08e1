"""Joins of sets, sessions and outliers against brute force."""

import collections
import datetime
import itertools
import random
import statistics

import pytest
from dealt import records_dealt
from kindred.operators import outliers, setjoin, similarity
from pyspark.sql import functions as F


def skewed(seed=1, n=150):
    """Sets with an element that all have, some that a third has, near copies, equal sets, single and empty ones."""
    r = random.Random(seed)
    sets = {}
    for i in range(n):
        own = {"the"} | {f"w{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randrange(1, 40))} | ({"third"} if r.random() < 0.33 else set())
        sets[i] = own
    for i in range(n, n + 60):
        base = set(sets[r.randrange(n)])
        for _ in range(r.randrange(4)):
            base ^= {f"w{r.randrange(70)}"}
        sets[i] = base or {"the"}
    sets[1000], sets[1001], sets[1002] = {"the"}, {"only"}, {"the", "third"}
    return sets


def facts(spark, sets):
    rows = [(i, e) for i, s in sets.items() for e in s]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame([*rows, rows[0], (None, "the"), (5, None)], "id long, element string")


@pytest.mark.parametrize("least", [0.2, 0.26, 0.5, 0.7, 0.9, 1.0])
@pytest.mark.parametrize("block", [2048, 20])
def test_similar_sets_loses_none(spark, least, block):
    sets = skewed()
    got = {(r.a, r.b): (r.common, round(r.similarity, 9)) for r in setjoin.similar_sets(facts(spark, sets), least, block).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n / len(sets[a] | sets[b]) >= least:
            want[a, b] = n, round(n / len(sets[a] | sets[b]), 9)
    assert got == want and want


def test_filters_prune_and_blocks_meet_once(spark):
    sets = setjoin.sets_of(facts(spark, skewed(2, 300)))
    every = 363 * 362 // 2
    for least, most in ((0.5, 0.35), (0.8, 0.03)):
        one, many = setjoin.candidates(sets, least), setjoin.candidates(sets, least, 10)
        rows = {(r.a, r.b) for r in one.collect()}
        assert one.count() == len(rows) <= most * every and {(r.a, r.b) for r in many.collect()} == rows and many.count() == len(rows)
    with pytest.raises(ValueError, match="least"):
        setjoin.candidates(sets, 0)


def history(spark, rows):
    return spark.createDataFrame(rows, "user_id string, artist_id string, t string").select("user_id", "artist_id", F.col("t").cast("timestamp").alias("ts"))


def test_heavy_sessions_are_dealt_into_blocks(spark):
    r = random.Random(8)
    rows = [("u", f"a{k}", "2024-01-01 00:00:00") for k in range(40)] + [("v", f"a{r.randrange(60)}", f"2024-01-0{1 + k // 30} 0{k % 9}:00:00") for k in range(90)] + [(None, "a1", "2024-01-01 00:00:00"), (None, "a2", "2024-01-01 00:10:00"), ("", "a1", "2024-01-01 00:00:00"), ("w", None, "2024-01-01 00:00:00"), ("w", "a1", "2024-01-01 00:00:00")]
    df = history(spark, rows)
    sessions = collections.defaultdict(set)
    for x in similarity.sessions(df).collect():
        if x.artist_id:
            sessions[x.user_id, x.session].add(x.artist_id)
    want = collections.Counter(p for s in sessions.values() for p in itertools.combinations(sorted(s), 2))
    assert want["a1", "a2"] >= 2
    for block in (256, 7, 1):
        assert {(x.a, x.b): x.n_sessions for x in similarity.session_pairs(df, block=block).collect()} == dict(want)


def test_sessions_go_on_over_midnight(spark):
    r = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(r.choice(("u", "v", None)), f"a{r.randrange(5)}", str(start + datetime.timedelta(seconds=r.randrange(5 * 86_400) // 60 * 60))) for _ in range(900)]
    df = history(spark, rows)
    want = collections.Counter()
    for user in ("u", "v", None):
        own, session, last = sorted((t, a) for u, a, t in rows if u == user), 0, None
        for t, a in own:
            now = datetime.datetime.fromisoformat(t)
            session += last is None or (now - last).total_seconds() > 30 * 60
            last = now
            want[user, a, t, session] += 1
    assert collections.Counter((x.user_id, x.artist_id, str(x.ts), x.session) for x in similarity.sessions(df).collect()) == want
    kept = similarity.without_bursts(df, 600)
    assert kept.columns == df.columns
    expected = 0
    for user in ("u", "v", None):
        own = sorted((t, a) for u, a, t in rows if u == user)
        expected += sum(k == 0 or (datetime.datetime.fromisoformat(own[k][0]) - datetime.datetime.fromisoformat(own[k - 1][0])).total_seconds() >= 600 for k in range(len(own)))
    assert kept.count() == expected


def test_sessions_deal_listens_once(spark):
    """Listens are dealt by day and not again by every step that follows; there are few days. Listens without a time or a user are sessions too."""
    rows = [(f"u{k % 3}" if k % 4 else None, f"a{k % 5}", f"2024-01-{1 + k % 2:02} {k % 24:02}:{k % 60:02}:00") for k in range(1200)] + [("u0", "a1", None), ("u0", "a2", None), (None, None, None)]
    out = similarity.sessions(history(spark, rows), 90)
    got = out.collect()
    assert len(got) == len(rows) and {x.session for x in got if x.ts is None and x.user_id} == {1, 2}
    assert records_dealt(out) < 1500  # before, 2,454: all listens by every step
    kept = similarity.without_bursts(history(spark, rows), 60)
    assert {(x.user_id, x.artist_id) for x in kept.collect() if x.ts is None} == {("u0", "a1"), ("u0", "a2"), (None, None)}
    assert records_dealt(kept) < 1500


def test_light_sessions_are_dealt_once_for_both_sides(spark):
    rows = [(f"u{k % 40}", f"a{k % 7}", f"2024-01-01 {k // 40 % 3 * 8:02}:00:00") for k in range(700)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = similarity.session_pairs(history(spark, rows))
        got = {(x.a, x.b): x.n_sessions for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    heard = {(u, t, a) for u, a, t in rows}
    want = collections.Counter((a, b) for u, t, a in heard for v, s, b in heard if (u, t) == (v, s) and a < b)
    assert got == dict(want)
    assert records_dealt(out, "session") == len(heard)  # before, twice


def test_outliers_by_exact_medians(spark):
    r = random.Random(7)
    plays = {(u, d): r.choice((1, 2, 2, 3, 4)) for u in ("u", "v", None, "few") for d in range(1, 5 if u == "few" else 20 + (u == "v"))}
    plays["u", 3], plays["v", 9], plays[None, 4], plays["few", 2] = 60, 25, 40, 80
    rows = [(u, f"a{k % 3}", f"2024-01-{d:02d} 10:00:{k % 60:02d}") for (u, d), n in plays.items() for k in range(n)]
    df = history(spark, rows)
    days = collections.defaultdict(list)
    for (u, _), n in plays.items():
        days[u].append(n)
    for x in outliers.usual(outliers.plays_per_day(df)).collect():
        own = days[x.user_id]
        median = statistics.median_low(own)
        assert (x.n_days, x.median, x.deviation) == (len(own), median, statistics.median_low([abs(n - median) for n in own]))
    gone = {(x.user_id, x.day.day) for x in outliers.outlier_days(outliers.plays_per_day(df)).collect()}
    assert gone == {("u", 3), (None, 4)}
    kept = outliers.without_outliers(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 100
    assert outliers.without_outliers(df.limit(0)).count() == 0
