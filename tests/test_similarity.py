import math

import pytest
from dealt import records_dealt
from kindred import config
from kindred.operators import evaluation, governance, ranking, search, similarity
from kindred.plans import recommend
from kindred.sources import shared
from pyspark.sql import functions as F

LISTENS = "user_id string, artist_id string, ts timestamp"


def listens(spark, rows):
    return spark.createDataFrame(rows, "user_id string, artist_id string, t string").select("user_id", "artist_id", F.col("t").cast("timestamp").alias("ts"))


def plays(spark, counts):
    return listens(spark, [(u, a, f"2024-01-{1 + i % 28:02d} 0{i // 28}:00:00") for (u, a), n in counts.items() for i in range(n)])


def test_cosine_and_shrinkage(spark):
    w = similarity.user_weights(plays(spark, {("u", "a"): 3, ("u", "b"): 1, ("v", "a"): 30, ("v", "b"): 30, ("x", "a"): 1}))
    row = similarity.cosine_pairs(w).first()
    dot = math.log1p(3) * math.log1p(1) + math.log1p(20) ** 2
    norms = math.sqrt(math.log1p(3) ** 2 + math.log1p(20) ** 2 + math.log1p(1) ** 2) * math.sqrt(math.log1p(1) ** 2 + math.log1p(20) ** 2)
    assert (row.a, row.b, row.n_common) == ("a", "b", 2)
    assert row.cosine == pytest.approx(dot / norms) and row.behavior == pytest.approx(row.cosine * 2 / 22)
    assert similarity.published(similarity.cosine_pairs(w)).isEmpty()


def test_user_cap_bounds_pairs(spark):
    w = spark.createDataFrame([("u", f"a{i:03d}", 1, float(i)) for i in range(100)], "user_id string, artist_id string, plays int, weight double")
    assert similarity.pair_sums(w, user_cap=10).count() == 45


def test_bursts_and_sessions(spark):
    rows = listens(spark, [("u", "a", "2024-01-01 00:00:00"), ("u", "b", "2024-01-01 00:00:05"), ("u", "c", "2024-01-01 00:20:00"), ("u", "d", "2024-01-01 02:00:00")])
    assert similarity.without_bursts(rows).count() == 3
    assert {(r.a, r.b) for r in similarity.session_pairs(rows).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_jaccard_cases(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (None, ["a"])], "x array<string>, y array<string>")
    got = [r[0] for r in rows.select(similarity.jaccard(F.col("x"), F.col("y"))).collect()]
    assert got[0] == pytest.approx(1 / 3) and got[1:] == [None, None]


def test_blend_confidence_and_fallback(spark):
    behavior = spark.createDataFrame([("a", "b", 60, 0.5), ("a", "c", 60, 0.5), ("a", "d", 10, 0.5), ("a", "e", 20, 0.1)], "a string, b string, n_common long, behavior double")
    metadata = spark.createDataFrame([("a", "b", 0.4), ("a", "d", 0.1), ("x", "y", 0.9)], "a string, b string, metadata double")
    relation = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, relation double")
    got = {(r.a, r.b): r for r in similarity.blended(behavior, metadata, relation).collect()}
    assert got["a", "b"].score == pytest.approx(0.8 * 0.5 + 0.15 * 0.4 + 0.05)
    assert {k: r.confidence for k, r in got.items()} == {("a", "b"): "high", ("a", "c"): "medium", ("a", "d"): "low", ("a", "e"): "medium", ("x", "y"): "low"}
    assert [k for k, r in got.items() if r.is_fallback] == [("x", "y")]
    edges = similarity.both_ways(similarity.blended(behavior, metadata, relation))
    assert edges.count() == 2 * len(got) and similarity.evidence(edges.where("source = 'a' and target = 'b'")).count() == 3


def test_genre_pairs_lose_none(spark):
    import random

    r = random.Random(4)
    sets = {i: {f"g{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randrange(1, 9))} for i in range(120)}
    facts = spark.createDataFrame([(i, g) for i, s in sets.items() for g in s] * 2 + [(7, None)], "artist_id long, genre string")
    for least in (0.3, 0.5, 1.0):
        expected = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= least * len(x | y)}
        got = {(x.a, x.b): x.metadata for x in similarity.genre_pairs(facts, least).collect()}
        assert got == pytest.approx(expected) and len(got) > 5


def test_session_cap(spark):
    rows = spark.createDataFrame([("u", f"a{i:02d}", "2024-01-01 00:00:00") for i in range(40)], "user_id string, artist_id string, t string").select("user_id", "artist_id", F.col("t").cast("timestamp").alias("ts"))
    assert similarity.session_pairs(rows, cap=10).count() == 45


def test_factors_tell_tastes_apart(spark):
    """Two crowds that hear other artists: a factor's nearest others are of its own crowd."""
    import random

    import numpy as np

    r = random.Random(1)
    rows = [(u, 20 * (u % 2) + a, 1, r.uniform(0.7, 3)) for u in range(80) for a in r.sample(range(20), 8)]
    found = similarity.als_factors(spark.createDataFrame(rows, "user_id long, artist_id long, plays int, weight double"), rank=4).collect()
    f = {x.artist_id: np.array(x.factors) / np.linalg.norm(x.factors) for x in found}
    assert len(f) == 40
    same = [float(f[a] @ f[b]) for a in f for b in f if a < b and a // 20 == b // 20]
    other = [float(f[a] @ f[b]) for a in f for b in f if a < b and a // 20 != b // 20]
    assert sum(same) / len(same) > 0.6 and sum(other) / len(other) < 0.3


def test_relation_weights(spark):
    rows = spark.createDataFrame([("b", "a", "direct"), ("a", "b", "side_project"), ("a", "c", "label"), ("a", "a", "direct")], "artist_1 string, artist_2 string, kind string")
    assert [tuple(r) for r in similarity.relation_pairs(rows).collect()] == [("a", "b", 0.8)]


EDGES = [("s1", "x", 0.9), ("s1", "y", 0.5), ("s2", "y", 0.5), ("s2", "z", 0.8), ("s1", "s2", 1.0), ("x", "z", 0.9), ("z", "x", 0.9), ("x", "y", 0.0)]


def test_modes(spark):
    edges = spark.createDataFrame(EDGES, "source string, target string, score double")
    seeds = spark.createDataFrame([("q", "s1", 1.0), ("q", "s2", 3.0)], "request_id string, seed_id string, w double")
    found = ranking.candidates(seeds, edges)
    fit = {r.candidate: (r.fit, r.lowest) for r in found.collect()}
    assert set(fit) == {"x", "y", "z"}
    assert fit["x"] == (pytest.approx(0.6 * 0.9 + 0.4 * 0.9 / 4), 0.0) and fit["y"] == (pytest.approx(0.5), 0.5)
    assert [r.candidate for r in ranking.near(found).orderBy("rank").collect()] == ["z", "x", "y"]
    assert ranking.bridge(found).where("rank = 1").first().candidate == "y"
    picked = [r.candidate for r in ranking.adventure(found, edges).orderBy("rank").collect()]
    assert picked == ["z", "x", "y"] or picked == ["z", "y", "x"]
    greedy = ranking.adventure(found, edges, r=config.Ranking(mmr_alpha=1.0)).orderBy("rank")
    assert [r.candidate for r in greedy.collect()] == ["z", "x", "y"]
    said = spark.createDataFrame([("q", "z", "known"), ("q", "x", "interested")], "request_id string, artist_id string, action string")
    more, known = ranking.apply_feedback(seeds, said)
    assert more.count() == 3 and {r.candidate for r in ranking.candidates(more, edges, known).collect()} == {"y"}


def test_requests_are_dealt_by_their_candidates(spark, monkeypatch, capsys):
    """Few seeds have many candidates: tasks are as many as those need, and rows are those of a plain loop."""
    import random
    import re

    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    r = random.Random(7)
    scores = {(a, b): round(r.random(), 3) for a in range(20) for b in range(40) if r.random() < 0.7}
    seeds = {q: {a: float(r.randrange(1, 5)) for a in r.sample(range(22), 3)} for q in range(30)}
    known = [(q, r.randrange(40)) for q in range(30) for _ in range(3)] * 2 + [(99, 1)]
    found = ranking.candidates(
        spark.createDataFrame([(q, a, w) for q, own in seeds.items() for a, w in own.items()] + [(None, 1, 1.0)], "request_id int, seed_id long, w double"),
        spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "source long, target long, score double"),
        spark.createDataFrame(known, "request_id long, artist_id long"),
    )
    want = {}
    for q, own in seeds.items():
        for b in set(range(40)) - set(own) - {x for k, x in known if k == q}:
            met = {a: scores[a, b] for a in own if (a, b) in scores}
            if met:
                fit = 0.6 * max(met.values()) + 0.4 * sum(own[a] * s for a, s in met.items()) / sum(own.values())
                want[q, b] = fit, min(met.values()) if len(met) == 3 else 0.0
    got = {(x.request_id, x.candidate): (x.fit, x.lowest) for x in found.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and dict(found.dtypes)["request_id"] == "int"
    found.explain()
    dealt = [int(x) for x in re.findall(r"hashpartitioning\(request_id[^,]*, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)]
    assert set(dealt) == {23} and len(dealt) >= 2  # 91 seeds of 50 edges at most


def test_candidates_are_made_where_requests_are(spark, monkeypatch):
    """Edges that fit are sent to the requests, and nothing that they meet is dealt; beyond that the same comes out. Null ids are seeds that meet
    nothing, requests that are left out, and a candidate like any other."""
    edges = spark.createDataFrame([(a, b, (a * 7 + b) % 10 / 10) for a in range(8) for b in range(30)] + [(1, None, 0.5), (2, None, 0.7), (None, 3, 0.9)], "source long, target long, score double")
    seeds = [(q, (q + k) % 9, float(k + 1)) for q in range(20) for k in range(3)] + [(3, None, 2.0), (None, 1, 1.0), (4, 4, 1.0)]
    seeds = spark.createDataFrame(seeds, "request_id int, seed_id long, w double")
    known = spark.createDataFrame([(q, q % 5) for q in range(25)] * 2 + [(1, None), (None, 2)], "request_id long, artist_id long")
    rows = lambda df: sorted((x.request_id, x.candidate is None, x.candidate or 0, round(x.fit, 9), x.lowest, x.level) for x in df.collect())
    sent = ranking.candidates(seeds, edges, known)
    got = rows(sent)
    assert records_dealt(sent) <= 63 + 63 + 52  # seeds, and what is left out; before, 30 edges of each seed too
    monkeypatch.setattr(ranking, "EDGE_BYTES", 1 << 40)
    assert rows(ranking.candidates(seeds, edges, known)) == got
    assert {q for q, null, *_ in got if null} == {q for q in range(20) if {(q + k) % 9 for k in range(3)} & {1, 2}} - {1} and all(q is not None for q, *_ in got)


def test_mmr_against_plain_loop(spark):
    import random

    r = random.Random(3)
    names = [f"c{i}" for i in range(30)]
    score = {(a, b): r.random() for a in names for b in names if a < b}
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()] + [(b, a, s) for (a, b), s in score.items()] + [("s", n, r.random()) for n in names], "source string, target string, score double")
    found = ranking.candidates(spark.createDataFrame([(1, "s", 1.0)], "request_id int, seed_id string, w double"), edges)
    fit, picked = {x.candidate: x.fit for x in found.collect()}, []
    while len(picked) < 10:
        left = sorted(set(names) - set(picked))
        picked.append(max(left, key=lambda c: 0.7 * fit[c] - 0.3 * max((score[min(c, p), max(c, p)] for p in picked), default=0)))
    assert [x.candidate for x in ranking.adventure(found, edges).orderBy("rank").collect()] == picked


def test_adventure_likes_what_few_know(spark):
    edges = spark.createDataFrame([("s", "star", 0.9), ("s", "rare", 0.88)], "source string, target string, score double")
    found = ranking.candidates(spark.createDataFrame([(1, "s", 1.0)], "request_id int, seed_id string, w double"), edges)
    popularity = spark.createDataFrame([("star", 1.0), ("rare", 0.1)], "artist_id string, share double")
    first = lambda **k: ranking.adventure(found, edges, **k).where("rank = 1").first().candidate
    assert first() == "star" and first(popularity=popularity) == "rare"


def test_edges_are_not_published_with_listeners(spark, tmp_path):
    with pytest.raises(ValueError, match="user_id"):
        recommend.publish_edges(spark.createDataFrame([(1, 2)], "source_artist_id int, user_id int"), str(tmp_path / "x"), "v1", [])


def test_metrics(spark):
    shown = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "c", 1)], "user_id string, artist_id string, rank int")
    truth = spark.createDataFrame([("u", "b"), ("u", "z"), ("w", "a")], "user_id string, artist_id string")
    assert evaluation.recall_at(shown, truth).first()["recall"] == pytest.approx(0.25)
    ideal = 1 + 1 / math.log2(3)
    assert evaluation.ndcg_at(shown, truth).first()["ndcg"] == pytest.approx((1 / math.log2(3)) / ideal / 2)
    pop = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1), ("d", 1), ("e", 1)], "artist_id string, listeners long")
    assert {r.artist_id for r in evaluation.long_tail(pop).collect()} == {"b", "c", "d", "e"}
    expected = spark.createDataFrame([("m", "x|y"), ("n", "z")], "artist_name string, expected_similar string")
    hits = spark.createDataFrame([("m", "y", 3), ("n", "z", 11)], "artist string, neighbour string, rank int")
    assert evaluation.plausible_hit_rate(hits, evaluation.expected_neighbours(expected)).first()["hit_rate"] == 0.5


def test_governance(spark):
    ledger = spark.createDataFrame([("mb", "name", "yes", "CC0"), ("mb", "tags", "no", "NC"), ("lb", "user", "processing_only", "CC0")], "source string, field string, use_in_mvp string, license_class string")
    fields = ledger.select("source", "field")
    assert {r.field for r in governance.refused_fields(fields, ledger).collect()} == {"tags", "user"}
    assert governance.private_columns(spark.createDataFrame([(1, 2)], "artist_id int, user_id int")) == ["user_id"]
    stats = governance.load_quality(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), ["a", "b"])
    assert governance.gate(stats, {"b": 0.6}).isEmpty() and not governance.gate(stats, {"b": 0.4}).isEmpty() and not governance.gate(stats, {}, min_rows=3).isEmpty()


def test_search_loses_none(spark):
    import random

    r = random.Random(6)
    names = ["".join(r.choice("abc d") for _ in range(r.randrange(1, 9))) for _ in range(80)]
    grams = lambda t: {("  " + t.replace(" ", "") + " ")[i : i + 3] for i in range(max(1, len(t.replace(" ", "")) + 1))}
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "artist_id long, name string")
    got = {(x.q, x.artist_id): x.similarity for x in search.search(rows.selectExpr("name as q"), search.index(rows), limit=1000).collect()}
    expected = {(q, i): len(grams(q) & grams(n)) / len(grams(q) | grams(n)) for q in names for i, n in enumerate(names) if len(grams(q) & grams(n)) >= 0.3 * len(grams(q) | grams(n))}
    assert got == pytest.approx(expected)


def test_search(spark):
    names = spark.createDataFrame([(1, "Number Girl"), (2, "NUMBER GIRLS!"), (3, "Cero")], "artist_id int, name string")
    got = search.search(spark.createDataFrame([("numbr girl",)], "q string"), search.index(names)).orderBy("rank").collect()
    assert [r.artist_id for r in got] == [1, 2]


def test_build_edges_and_serve(spark):
    rows = listens(spark, [(f"u{u}", a, f"2024-01-0{d} 0{h}:00:00") for u in range(6) for h, a in enumerate("abc") for d in (1, 2, 3)])
    genres = spark.createDataFrame([("a", "rock"), ("b", "rock"), ("c", "pop"), ("d", "pop")], "artist_id string, genre string")
    relations = spark.createDataFrame([("c", "d", "collaboration")], "artist_1 string, artist_2 string, kind string")
    edges = recommend.build_edges(rows, genres, relations, "v1", config.Similarity(min_common=5)).cache()
    by = {(r.source_artist_id, r.target_artist_id): r for r in edges.collect()}
    assert by["a", "b"].metadata_score == 1.0 and by["c", "d"].is_fallback and not by["a", "c"].is_fallback
    assert by["a", "b"].total_score == by["b", "a"].total_score and "genre overlap 100 %" in by["a", "b"].explanation
    assert governance.private_columns(edges) == []
    seeds = spark.createDataFrame([("q", "a", 1.0)], "request_id string, seed_id string, w double")
    for mode in ("near", "bridge", "adventure"):
        assert {r.candidate for r in recommend.recommend(seeds, edges, mode).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        recommend.recommend(seeds, edges, "other")
    assert recommend.neighbours("c", edges).first().target_artist_id in ("a", "b")
