import itertools
import math
import random

import numpy as np
import pytest
from kindred.operators import similarity
from kindred.plans import compare
from pyspark.sql import functions as F


def crowds(spark, seed=1):
    """Two crowds that hear other artists, with times and plays."""
    r = random.Random(seed)
    rows = [(u, 20 * (u % 2) + a, f"2024-01-{1 + r.randrange(20):02d} {r.randrange(24):02d}:00:00") for u in range(60) for a in r.sample(range(20), 9) for _ in range(r.randrange(1, 4))]
    return spark.createDataFrame(rows, "user_id long, artist_id long, t string").select("user_id", "artist_id", F.col("t").cast("timestamp").alias("ts"))


def test_factor_edges_are_cosines_of_factors(spark):
    weights = similarity.user_weights(crowds(spark))
    factors = {x.artist_id: np.array(x.factors) for x in similarity.als_factors(weights, rank=4).collect()}
    edges = {(x.source, x.target): x.score for x in compare.factor_edges(weights, rank=4).collect()}
    assert {a // 20 == b // 20 for a, b in edges} == {True} and len(edges) > 300
    for (a, b), score in edges.items():
        assert score == pytest.approx(float(factors[a] @ factors[b] / np.linalg.norm(factors[a]) / np.linalg.norm(factors[b])), abs=1e-6) and edges[b, a] == score


def test_session_edges(spark):
    listens = crowds(spark, 2)
    heard = {}
    for x in similarity.sessions(listens, 60).collect():
        heard.setdefault((x.user_id, x.session), set()).add(x.artist_id)
    n, pairs = {}, {}
    for s in heard.values():
        for a in s:
            n[a] = n.get(a, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            pairs[p] = pairs.get(p, 0) + 1
    got = {(x.source, x.target): x.score for x in compare.session_edges(listens, 60).collect()}
    assert got == {(a, b): pytest.approx(m / math.sqrt(n[x] * n[y]), abs=1e-8) for (x, y), m in pairs.items() for a, b in ((x, y), (y, x))}


def test_session_edges_number_sessions_once(spark, monkeypatch):
    calls, plain = [], similarity.sessions
    monkeypatch.setattr(similarity, "sessions", lambda *a: calls.append(a) or plain(*a))
    assert compare.session_edges(crowds(spark, 4), 60).count() > 0 and len(calls) == 1


def test_report_tells_models_apart(spark):
    """What a user hears next is of the own crowd: edges within crowds find it, edges between them do not."""
    weights = similarity.user_weights(crowds(spark, 3))
    known = {(x.user_id, x.artist_id) for x in weights.collect()}
    truth = spark.createDataFrame([(u, 20 * (u % 2) + a) for u in range(60) for a in range(20) if (u, 20 * (u % 2) + a) not in known], "user_id long, artist_id long")
    good = compare.cosine_edges(weights)
    bad = good.withColumn("target", (F.col("target") + 20) % 40)
    rows = {x.model: x for x in compare.report({"good": good, "bad": bad, "factors": compare.factor_edges(weights, rank=4)}, weights, truth).collect()}
    assert rows["good"].recall > 0.8 and rows["factors"].recall > 0.8 and rows["bad"].recall == 0 == rows["bad"].ndcg and rows["good"].users == 60
    shown = compare.lists(good, weights)
    assert not {(x.user_id, x.artist_id) for x in shown.collect()} & known and shown.groupBy("user_id").count().where("count > 10").isEmpty()
