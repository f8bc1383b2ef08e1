"""Pairs of similar sets that are compared where they meet, and the blend with pairs that only genres bring up."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from kindred import queries
from kindred.operators import setjoin, similarity
from pyspark.sql import functions as F


def test_copies_are_compared_once(spark):
    """Sets of the same elements are one class, whose members are all paired in the result."""
    sets = {i: set("abcd") for i in range(30)} | {100 + i: set("abce") for i in range(20)} | {200: set("xyz"), 201: set("xyzw")}
    facts = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, element string")
    pairs, members = setjoin.similar_classes(setjoin._gathered(facts), 0.5)
    assert {(r.a, r.b, r.common) for r in pairs.collect()} == {(0, 100, 3), (200, 201, 3)}
    assert {r.id: r.of for r in members.collect()} == {i: 0 if i < 30 else 100 if i < 200 else i for i in sets}
    got = {(r.a, r.b): (r.common, r.similarity) for r in setjoin.similar_sets(facts, 0.5).collect()}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted(sets), 2)}
    assert got == {k: v for k, v in want.items() if v[1] >= 0.5}


def test_rows_of_one_id_are_one_set_and_hashes_may_collide(spark, monkeypatch):
    sets = spark.createDataFrame([(1, ["a", "b", "a", None]), (1, ["c"]), (2, ["a", "b", "c"]), (3, []), (None, ["a"]), (4, ["d", "e"]), (5, ["d", "f"])], "id long, words array<string>")
    assert [tuple(r) for r in setjoin.similar_sets(sets, 0.9).collect()] == [(1, 2, 3, 1.0)]
    monkeypatch.setattr(setjoin, "FREQUENT", 0)
    monkeypatch.setattr(setjoin, "_parts", lambda w, bits: F.lit(7).cast("long"))  # all alike
    assert {tuple(r)[:3] for r in setjoin.similar_sets(sets, 0.3).collect()} == {(1, 2, 3), (4, 5, 1)}


def test_what_is_sent_does_not_grow_with_prefixes(spark):
    """A set goes to its cells whole, once for each, however many of its elements others have."""
    sets = setjoin.sets_of(spark.range(60).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: (F.col("id") + k * 3) % 400)).alias("element")))
    assert setjoin._cells(sets, 0.5, 100).count() == 60
    assert setjoin._cells(sets, 0.5, 20).count() <= 60 * 4


@pytest.mark.parametrize("words", [30, 3000])
@pytest.mark.parametrize("meet", [1, 1 << 20])
def test_cells_by_brute_force(monkeypatch, words, meet):
    monkeypatch.setattr(setjoin, "MEET", meet)
    r = np.random.default_rng(words)
    sets = [np.unique(r.zipf(1.3, r.integers(1, 40)) % words) for _ in range(60)]
    sets += [np.unique(np.append(s, r.integers(0, words, 2))) for s in sets[:40]]
    packed = setjoin._packed(pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32())))
    assert setjoin._unpacked(packed, np.array([len(s) for s in sets])).tolist() == np.concatenate(sets).tolist()
    table = pa.table({"packed": packed, "size": pa.array([len(s) for s in sets], pa.int32()), "left": pa.array([True] * len(sets)), "right": pa.array([True] * len(sets))})
    got = {tuple(sorted((int(a), int(b)))): int(c) for found in setjoin._meet(table, 0.4, True) for a, b, c in zip(*found)}
    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.combinations(range(len(sets)), 2)}
    assert got == {(i, j): c for (i, j), c in common.items() if c >= 0.4 * (len(sets[i]) + len(sets[j]) - c)} and len(got) > 30


def test_near_pairs_are_fallback_edges(spark):
    behavior = spark.createDataFrame([(1, 2, 60, 0.5)], "a long, b long, n_common long, behavior double")
    metadata = spark.createDataFrame([(1, 2, 0.4)], "a long, b long, metadata double")
    relation = spark.createDataFrame([(1, 3, 1.0)], "a long, b long, relation double")
    near = spark.createDataFrame([(1, 2, 0.4), (2, 3, 0.6)], "a long, b long, metadata double")
    got = {(r.a, r.b): (round(r.score, 9), r.is_fallback, r.confidence) for r in similarity.blended(behavior, metadata, relation, near=near).collect()}
    assert got == {(1, 2): (0.46, False, "high"), (1, 3): (0.05, True, "low"), (2, 3): (0.09, True, "low")}


def test_scores_are_rounded_once(spark):
    behavior = spark.createDataFrame([(1, 2, 60, 0.1234564996 / 0.8)], "a long, b long, n_common long, behavior double")
    none = spark.createDataFrame([], "a long, b long, metadata double")
    score = similarity.blended(behavior, none, none.withColumnRenamed("metadata", "relation"), places=None).select(F.round("score", 6)).first()[0]
    assert score == 0.123456


@pytest.mark.parametrize("name", ["blended_similarity", "fallback_pairs", "confidence_class", "edge_evidence", "explanations", "accuracy_by_confidence"])
def test_blend_has_pairs_that_only_genres_bring_up(name):
    assert "UNION SELECT a, b FROM near" in queries.SQL[name] and "n_common >= 45" not in queries.SQL[name]
