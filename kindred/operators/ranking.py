"""Recommendations for a request of several seed artists, in three modes.

``seeds``: (request_id, seed_id, w); ``edges``: (source, target, score, ...) already cut to the best of each source, so a
request has at most seeds times top_k candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..sources import shared

R = config.Ranking()
#: Of an edge in memory, by which is decided whether edges are sent to every task.
EDGE_BYTES = 64


def candidates(seeds: DataFrame, edges: DataFrame, known: DataFrame | None = None, r: config.Ranking = R) -> DataFrame:
    """(request_id, candidate, fit, lowest, best_confidence): the fit is 0.6 of the best score over seeds plus 0.4 of their weighted
    mean; a seed without an edge to the candidate counts 0. Seeds and ``known`` (request_id, artist_id) are left out.

    Requests are dealt to as many tasks as their seeds times the edges of a seed need: few seeds are many candidates, which one task
    would else make. Edges that fit are sent to where requests are, so that candidates are made and added up there; beyond that seeds
    are sent to the edges, and what they meet goes back to its request."""
    whole = Window.partitionBy("request_id")
    seeds = shared.save(seeds.select("request_id", "seed_id", "w", F.count("*").over(whole).alias("n_seeds"), F.sum("w").over(whole).alias("w_sum")), "seeds")
    dealt = shared.tasks(seeds.count() * config.Similarity.top_k)
    gone = seeds.select("request_id", F.col("seed_id").alias("candidate"))
    if known is not None:
        gone = gone.unionByName(known.select("request_id", F.col("artist_id").alias("candidate")))
    gone = gone.select(F.col("request_id").cast(dict(seeds.dtypes)["request_id"]), F.col("candidate").cast(dict(edges.dtypes)["target"]), F.lit(True).alias("gone"))
    rows = seeds.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True).where("request_id is not null").repartition(dealt, "request_id")
    level = F.expr("case confidence when 'high' then 3 when 'medium' then 2 else 1 end") if "confidence" in edges.columns else F.lit(1)
    looked = edges.select("source", "target", "score", level.alias("level"))
    if (sent := shared.bounded(looked, EDGE_BYTES)) is not looked:
        rows = rows.join(sent, F.col("seed_id") == F.col("source"), "left").where("gone or source is not null").withColumn("candidate", F.when(F.col("gone"), F.col("candidate")).otherwise(F.col("target")))
    else:
        met = rows.where("not gone").drop("candidate").join(looked, F.col("seed_id") == F.col("source")).withColumnRenamed("target", "candidate")
        rows = met.unionByName(rows.where("gone"), allowMissingColumns=True).repartition(dealt, "request_id")
    grouped = rows.groupBy("request_id", "candidate").agg(
        F.max("score").alias("best"), F.sum(F.col("w") * F.col("score")).alias("ws"), F.min("score").alias("least"), F.count_if(~F.col("gone")).alias("n"), F.max("level").alias("level"),
        F.max("n_seeds").alias("n_seeds"), F.max("w_sum").alias("w_sum"), F.max("gone").alias("gone"),
    )
    return grouped.where("not gone").select(
        "request_id",
        "candidate",
        (r.best * F.col("best") + r.mean * F.col("ws") / F.col("w_sum")).alias("fit"),
        F.when(F.col("n") < F.col("n_seeds"), F.lit(0.0)).otherwise(F.col("least")).alias("lowest"),
        "level",
    )


def apply_feedback(seeds: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds with every artist marked "interested" added (weight 1), and those to leave out ("known", "not_for_me").
    ``feedback``: (request_id, artist_id, action)."""
    more = feedback.where("action = 'interested'").select("request_id", F.col("artist_id").alias("seed_id"), F.lit(1.0).alias("w"))
    return seeds.unionByName(more.join(seeds, ["request_id", "seed_id"], "left_anti").distinct()), feedback.where("action in ('known', 'not_for_me')").select("request_id", "artist_id").distinct()


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def near(found: DataFrame, n: int = R.results) -> DataFrame:
    """By fit, then by confidence."""
    return _first(found, n, F.desc("fit"), F.desc("level"), "candidate")


def bridge(found: DataFrame, n: int = R.results) -> DataFrame:
    """By the lowest similarity to any seed."""
    return _first(found, n, F.desc("lowest"), F.desc("fit"), "candidate")


def adventure(found: DataFrame, edges: DataFrame, n: int = R.results, r: config.Ranking = R, popularity: DataFrame | None = None) -> DataFrame:
    """Greedy maximal marginal relevance: each pick maximises alpha * fit - (1 - alpha) * (similarity to those picked).

    Only the ``r.candidates`` best of a request are weighed; each takes its own edges along (already cut to the best of each
    source), so a request is one small group and its candidates are made once. ``popularity`` (artist_id, share in
    0..1) lowers the fit of popular artists by its share times ``r.popularity_penalty``."""
    pool = _first(found, r.candidates, F.desc("fit"), F.desc("level"), "candidate").drop("rank")
    if popularity is not None:
        pool = pool.join(popularity.select(F.col("artist_id").alias("candidate"), "share"), "candidate", "left").withColumn("fit", F.col("fit") - r.popularity_penalty * F.coalesce("share", F.lit(0.0))).drop("share")
    nearby = edges.groupBy(F.col("source").alias("candidate")).agg(F.collect_list(F.struct("target", "score")).alias("e"))
    rows = pool.join(nearby, "candidate", "left").select("request_id", "candidate", "fit", F.col("e.target").alias("targets"), F.col("e.score").alias("scores"))
    kinds = dict(rows.dtypes)
    alpha = r.mmr_alpha

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("candidate", kind="stable").reset_index(drop=True)
        size, fit = len(frame), frame["fit"].to_numpy()
        known = frame[frame["targets"].notna()]
        between = np.zeros((size, size))
        if len(known):
            row = np.repeat(known.index.to_numpy(), known["targets"].map(len).to_numpy())
            column = pd.Index(frame["candidate"]).get_indexer(np.concatenate(known["targets"].tolist()))
            among = column >= 0
            between[row[among], column[among]] = np.concatenate(known["scores"].tolist())[among]
            between = np.maximum(between, between.T)
        closest, left, out = np.zeros(size), np.ones(size, bool), []
        while left.any() and len(out) < n:
            worth = np.where(left, alpha * fit - (1 - alpha) * closest, -np.inf)
            best = int(worth.argmax())
            out.append((frame["request_id"][0], frame["candidate"][best], len(out) + 1, fit[best], worth[best]))
            left[best] = False
            closest = np.maximum(closest, between[best])
        return pd.DataFrame(out, columns=["request_id", "candidate", "rank", "fit", "mmr"])

    return rows.groupBy("request_id").applyInPandas(pick, f"request_id {kinds['request_id']}, candidate {kinds['candidate']}, rank int, fit double, mmr double")


def local_graph(edges: DataFrame, centers: DataFrame, nodes: int = 50, per_node: int = 8) -> DataFrame:
    """(center, source, target, score): around each center (``centers``: artist_id) at most ``nodes`` nodes, and of each of
    them the best ``per_node`` edges that stay among them."""
    best = lambda rows, by, n: rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "target"))).where(F.col("__r") <= n).drop("__r")
    around = best(centers.select(F.col("artist_id").alias("source")).join(edges.select("source", "target", "score"), "source"), ["source"], nodes - 1)
    members = around.select(F.col("source").alias("center"), F.col("target").alias("node")).unionByName(centers.select(F.col("artist_id").alias("center"), F.col("artist_id").alias("node")))
    inner = members.withColumnRenamed("node", "source").join(edges.select("source", "target", "score"), "source").join(members.withColumnRenamed("node", "target"), ["center", "target"])
    return best(inner, ["center", "source"], per_node).select("center", "source", "target", "score")
