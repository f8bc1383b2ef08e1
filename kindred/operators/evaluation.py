"""Offline metrics on a time split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_split(listens: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (user_id, artist_id) before ``cut``, and those first heard from then on."""
    pairs = listens.where("user_id is not null and artist_id is not null").groupBy("user_id", "artist_id").agg(F.min("ts").alias("first"))
    at = F.lit(cut).cast(dict(listens.dtypes)["ts"])
    return pairs.where(F.col("first") < at).select("user_id", "artist_id"), pairs.where(F.col("first") >= at).select("user_id", "artist_id")


def hits(recommended: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Per user with truth: hits among the first k of (user_id, artist_id, rank), size of the truth, DCG and ideal DCG."""
    top = recommended.where(F.col("rank") <= k)
    found = top.join(truth, ["user_id", "artist_id"]).groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return truth.groupBy("user_id").agg(F.count("*").alias("n_truth")).join(found, "user_id", "left").select("user_id", "n_truth", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"), ideal.alias("ideal"))


def recall_at(recommended: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return hits(recommended, truth, k).agg(F.count("*").alias("users"), F.avg(F.col("hits") / F.col("n_truth")).alias("recall"))


def ndcg_at(recommended: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return hits(recommended, truth, k).agg(F.count("*").alias("users"), F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def catalog_coverage(recommended: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Share of the catalog (artist_id) that is recommended to anyone."""
    shown = recommended.where(F.col("rank") <= k).select("artist_id").distinct()
    return catalog.select("artist_id").distinct().join(shown.withColumn("shown", F.lit(1)), "artist_id", "left").agg(F.count("*").alias("artists"), F.count("shown").alias("shown"), (F.count("shown") / F.count("*")).alias("coverage"))


def long_tail(popularity: DataFrame, share: float = 0.8) -> DataFrame:
    """The ``share`` of artists with the fewest listeners, from (artist_id, listeners). Listener counts are few values, so
    whole classes are inside or outside by a cumulative count; only the class at the border is ranked, by artist_id."""
    counts = popularity.groupBy("listeners").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("listeners"))
    every = F.sum("n").over(Window.partitionBy())
    border = counts.select("listeners", (F.floor(F.lit(share) * every) - upto + F.col("n")).alias("room"), "n").where("room > 0")
    inside = popularity.join(border.where("room >= n").select("listeners"), "listeners", "left_semi")
    split = popularity.join(border.where("room < n").select("listeners", "room"), "listeners")
    first = F.row_number().over(Window.partitionBy("listeners").orderBy("artist_id"))
    return inside.select("artist_id", "listeners").unionByName(split.withColumn("__r", first).where(F.col("__r") <= F.col("room")).select("artist_id", "listeners"))


def long_tail_coverage(recommended: DataFrame, popularity: DataFrame, share: float = 0.8, k: int = 10) -> DataFrame:
    """Share of recommendations that are long-tail artists."""
    tail = long_tail(popularity, share).select("artist_id", F.lit(1).alias("tail"))
    return recommended.where(F.col("rank") <= k).join(tail, "artist_id", "left").agg(F.count("*").alias("shown"), F.count("tail").alias("in_tail"), (F.count("tail") / F.count("*")).alias("share"))


def intra_list_diversity(recommended: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Mean over lists of the mean of 1 - similarity over their pairs; artists without an edge have similarity 0."""
    top = recommended.where(F.col("rank") <= k).select("user_id", "artist_id")
    pairs = top.withColumnRenamed("artist_id", "source").join(top.withColumnRenamed("artist_id", "target"), "user_id").where("source < target")
    return pairs.join(edges.select("source", "target", "score"), ["source", "target"], "left").groupBy("user_id").agg(F.avg(1 - F.coalesce("score", F.lit(0.0))).alias("d")).agg(F.count("*").alias("lists"), F.avg("d").alias("diversity"))


def popularity_bias(recommended: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """Mean listeners of what is recommended, against the catalog's mean."""
    shown = recommended.where(F.col("rank") <= k).join(popularity, "artist_id").agg(F.avg("listeners").alias("recommended"))
    return shown.join(F.broadcast(popularity.agg(F.avg("listeners").alias("catalog")))).withColumn("ratio", F.col("recommended") / F.col("catalog"))


def plausible_hit_rate(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Share of artists with an expected neighbour among their first k: (artist, neighbour, rank) against (artist, expected)."""
    hit = results.where(F.col("rank") <= k).join(expected.withColumnRenamed("expected", "neighbour"), ["artist", "neighbour"]).select("artist").distinct().withColumn("hit", F.lit(1))
    return expected.select("artist").distinct().join(hit, "artist", "left").agg(F.count("*").alias("artists"), (F.count("hit") / F.count("*")).alias("hit_rate"))


def expected_neighbours(artists: DataFrame) -> DataFrame:
    """(artist, expected) from the list's bar-separated column."""
    return artists.select(F.col("artist_name").alias("artist"), F.explode(F.split("expected_similar", r"\|")).alias("expected")).where("expected <> ''")


def by_confidence(results: DataFrame, count: str | None = None) -> DataFrame:
    """Accuracy of (confidence, correct) in each class; a row stands for as many results as the column ``count`` says, if there is one."""
    n = F.lit(1) if count is None else F.col(count)
    right = F.sum(F.col("correct").cast("double") * n) / F.sum(F.when(F.col("correct").isNotNull(), n))
    return results.groupBy("confidence").agg(F.sum(n).alias("n"), right.alias("accuracy"))
