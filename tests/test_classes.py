"""Blends that are counted or listed by different genre sets, and cells that read their blocks themselves."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from kindred import queries
from kindred.operators import evaluation, setjoin, similarity
from kindred.sources import shared
from pyspark.sql import functions as F

LEAST = 0.3


@pytest.fixture(scope="module")
def blend(spark):
    """(given pairs, genre sets) with many copies of a few sets."""
    r = random.Random(3)
    kinds = [frozenset(r.sample("abcdefghij", r.randrange(2, 6))) for _ in range(9)]
    own = {i: kinds[r.randrange(9)] for i in range(60)}
    given = [(a, b, r.choice((None, 30, 70)), r.choice((None, 1.0))) for a, b in itertools.combinations(range(0, 66, 3), 2) if r.random() < 0.3]
    jaccard = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b]) if a in own and b in own else None
    rows = [(a, b, n, None if n is None else n / 100, jaccard(a, b), w) for a, b, n, w in given if n or w]
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "artist_id long, genres array<string>")
    return shared.save(spark.createDataFrame(rows, "a long, b long, n_common long, behavior double, metadata double, relation double"), "given"), sets, rows, jaccard


def want(rows, jaccard):
    seen = {(a, b) for a, b, *_ in rows}
    alone = [(a, b, jaccard(a, b)) for a, b in itertools.combinations(range(60), 2) if (a, b) not in seen and jaccard(a, b) >= LEAST]
    return alone


def test_pairs_are_counted_without_a_list(spark, blend):
    given, sets, rows, jaccard = blend
    got = similarity.blended_counts(given, *similarity.genre_classes(sets, LEAST), LEAST).groupBy("confidence", "is_fallback", F.round("metadata", 9).alias("m")).agg(F.sum("pairs").alias("n"))
    alone = spark.createDataFrame([(a, b, None, None, m, None) for a, b, m in want(rows, jaccard)], given.schema)
    every = similarity.scored(given.unionByName(alone)).groupBy("confidence", "is_fallback", F.round("metadata", 9).alias("m")).agg(F.count("*").alias("n"))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, every.collect()))


def test_pairs_are_listed_by_many_tasks(spark, blend, monkeypatch):
    given, sets, rows, jaccard = blend
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    of = lambda rows: rows.select("a", "b", F.round("score", 9).alias("score"), "is_fallback", "confidence", similarity.explanation().alias("explanation"))
    got = similarity.genres_alone(given, *similarity.genre_classes(sets, LEAST), of)
    assert sorted((r.a, r.b, r.score) for r in got.collect()) == [(a, b, round(0.15 * m + 1e-12, 9)) for a, b, m in want(rows, jaccard)]
    assert got.rdd.getNumPartitions() >= 5
    assert {(r.is_fallback, r.confidence) for r in got.collect()} == {(True, "low")} and all("genre overlap" in r.explanation for r in got.collect())


def test_counted_results(spark):
    rows = spark.createDataFrame([("low", True, 3), ("low", False, 1), ("high", None, 5), ("high", True, 1)], "confidence string, correct boolean, pairs long")
    assert {tuple(r) for r in evaluation.by_confidence(rows, "pairs").collect()} == {("low", 4, 0.75), ("high", 6, 1.0)}


def test_pairs_with_listeners_need_no_join_of_sets(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "similar_classes", lambda *a, **k: pytest.fail("genre sets are compared"))
    out = queries.QUERIES["blended_similarity"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["a", "b", "score", "confidence"] and out.count() >= 0


@pytest.mark.parametrize("tile", [64, 1 << 22])
@pytest.mark.parametrize("sides", ["same", "apart"])
def test_products_of_matrices_find_what_prefixes_find(monkeypatch, tile, sides):
    r = np.random.default_rng(5)
    sets = sorted((np.unique(r.integers(0, 60, r.integers(20, 90))) for _ in range(150)), key=len)
    left = np.ones(len(sets), bool) if sides == "same" else np.arange(len(sets)) < 70
    table = pa.table({"packed": setjoin._packed(pa.array(sets, pa.list_(pa.int32()))), "size": pa.array([len(s) for s in sets], pa.int32()), "left": left, "right": np.ones(len(sets), bool) if sides == "same" else ~left})
    found = {}
    for cheap in (0, 1 << 40):
        monkeypatch.setattr(setjoin, "CHEAP", cheap)
        monkeypatch.setattr(setjoin, "TILE", 64 * tile)
        rows = [tuple(map(int, x)) for some in setjoin._meet(table, 0.4, True) for x in zip(*some)]
        found[cheap] = {tuple(sorted((a, b))): n for a, b, n in rows}
        assert len(found[cheap]) == len(rows)
    assert found[0] == found[1 << 40] and len(found[0]) > 100
    assert {k for k in found[0]} == {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (sides == "same" or left[i] != left[j]) and 1.4 * len(np.intersect1d(sets[i], sets[j])) >= 0.4 * (len(sets[i]) + len(sets[j])) - 1e-9}


def test_cells_read_blocks_and_send_nothing(spark, monkeypatch):
    words = F.transform(F.sequence(F.lit(0), F.col("id") % 30), lambda k: ((F.col("id") * 7 + k * k) % 90).cast("string"))
    sets = setjoin.sets_of(spark.range(200).select("id", F.explode(words).alias("element")))
    met = setjoin._met(sets, 0.3, 40, True)
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, met.collect()))
    monkeypatch.setattr(setjoin, "_arrow_reads", lambda uri: False)
    assert sorted(map(tuple, setjoin._met(sets, 0.3, 40, True).collect())) == rows and len(rows) > 100


def test_blocks_are_even_in_elements(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "ELEMENTS", 400)
    ids = spark.range(300).select("id", F.explode(F.sequence(F.lit(1), F.when(F.col("id") < 280, 5).otherwise(100))).alias("element"))
    dealt, cells, files = setjoin._blocks(setjoin.sets_of(ids), 0.5, 1000, [])
    sums = [r.n for r in dealt.groupBy("block").agg(F.sum("size").alias("n")).collect()]
    assert sum(sums) == 280 * 5 + 20 * 100 and max(sums) <= 900 and len(files) == len(sums) and all(len(f) == 1 for f in files.values())
