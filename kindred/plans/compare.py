"""Models of similarity held against each other: the same listens before a date, the same users, the same measures after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import evaluation, ranking, similarity
from ..sources import shared

S = config.Similarity()


def cosine_edges(weights: DataFrame, s: config.Similarity = S) -> DataFrame:
    """Directed edges (source, target, score) by shrunk cosine over users."""
    pairs = similarity.cosine_pairs(weights, s.user_cap, s.shrinkage)
    return _best(pairs.select("a", "b", F.col("behavior").alias("score")), s)


def session_edges(listens: DataFrame, minutes: int = S.session_minutes, s: config.Similarity = S) -> DataFrame:
    """Directed edges by cosine over sessions: those that both artists are in, over the root of the product of those of each."""
    heard = similarity.heard_in_sessions(listens, minutes)
    pairs = similarity.session_pairs(listens, minutes, heard=heard)
    each = heard.groupBy("artist_id").agg(F.count("*").alias("n"))
    of = lambda x: each.select(F.col("artist_id").alias(x), F.col("n").alias(f"n_{x}"))
    return _best(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("n_sessions") / F.sqrt(F.col("n_a") * F.col("n_b"))).alias("score")), s)


def factor_edges(weights: DataFrame, s: config.Similarity = S, **als) -> DataFrame:
    """Directed edges by the cosine of latent factors, of the artists that some user has in common: never of all with all."""
    factors = shared.save(similarity.als_factors(weights, **als).select("artist_id", F.transform("factors", lambda x: x.cast("double")).alias("f")), "factors")
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda t, x: t + x * x))
    unit = factors.withColumn("norm", norm).where("norm > 0").select("artist_id", F.transform("f", lambda x: x / F.col("norm")).alias("f"))
    pairs = similarity.pair_sums(weights, s.user_cap).select("a", "b")
    of = lambda x: unit.select(F.col("artist_id").alias(x), F.col("f").alias(f"f{x}"))
    product = F.aggregate(F.zip_with("fa", "fb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return _best(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", product.alias("score")).where("score > 0"), s)


def _best(pairs: DataFrame, s: config.Similarity) -> DataFrame:
    edges = similarity.both_ways(pairs.withColumn("score", F.round("score", 9)))
    return shared.save(similarity.top_edges(edges, "score", s.top_k).select("source", "target", "score"), "edges")


def lists(edges: DataFrame, weights: DataFrame, n: int = 10, s: config.Similarity = S) -> DataFrame:
    """(user_id, artist_id, rank): the ``n`` best artists for each user, near the heaviest that the user knows, none of them known."""
    own = similarity.capped_users(weights, s.user_cap)
    seeds = own.select(F.col("user_id").alias("request_id"), F.col("artist_id").alias("seed_id"), F.col("weight").alias("w"))
    found = ranking.candidates(seeds, edges, weights.select(F.col("user_id").alias("request_id"), "artist_id"))
    top = ranking.near(found.withColumn("fit", F.round("fit", 7)), n)
    return top.select(F.col("request_id").alias("user_id"), F.col("candidate").alias("artist_id"), "rank")


def report(models: dict[str, DataFrame], weights: DataFrame, truth: DataFrame, n: int = 10, s: config.Similarity = S) -> DataFrame:
    """(model, users, recall, ndcg, artists, shown, coverage): a row for each model (edges), by what users of ``truth`` (user_id, artist_id) came to hear."""
    rows = []
    for name, edges in models.items():
        made = shared.save(lists(edges, weights, n, s), "lists")
        measures = evaluation.recall_at(made, truth, n).join(evaluation.ndcg_at(made, truth, n).select("ndcg")).join(evaluation.catalog_coverage(made, weights, n))  # one row each
        rows.append(measures.select(F.lit(name).alias("model"), "users", "recall", "ndcg", "artists", "shown", "coverage"))
    return reduce(DataFrame.unionByName, rows)
