"""Two versions of the edges, compared by what they say of a named set of artists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(edges: DataFrame, artists: DataFrame, k: int, score: str = "score") -> DataFrame:
    """(source, target, rank) of the ``k`` best neighbours of ``artists`` (artist_id); ties go by target."""
    own = edges.join(F.broadcast(artists.select(F.col("artist_id").alias("source")).distinct()), "source", "left_semi")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(score), "target"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("source", "target", "rank")


def compared(staged: DataFrame, current: DataFrame, artists: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    """artist_id, n_staged, n_current, n_common, rank_overlap, mean_shift of each of ``artists`` (artist_id; as many as a person names).

    Edges are (source, target, score). The neighbours of both versions meet in a full join. ``rank_overlap`` is the share of
    neighbours that the first d places of both have in common, averaged over d up to the longer list, so that a change at
    the top counts most; it is null where neither version has neighbours, and 0 where one has none. ``mean_shift`` is the mean
    difference of the places of common neighbours."""
    new, old = ranked(staged, artists, k, score).withColumnRenamed("rank", "__new"), ranked(current, artists, k, score).withColumnRenamed("rank", "__old")
    lower = F.greatest("__new", "__old")
    both = new.join(old, ["source", "target"], "full").withColumn("__both", F.when(F.col("__new").isNotNull() & F.col("__old").isNotNull(), lower))
    sums = both.groupBy("source").agg(
        F.count("__new").alias("n_staged"), F.count("__old").alias("n_current"), F.count("__both").alias("n_common"), F.avg(F.abs(F.col("__new") - F.col("__old"))).alias("mean_shift"),
        F.sort_array(F.collect_list("__both")).alias("__places"),
    )
    longest = F.greatest("n_staged", "n_current")
    agreed = F.transform(F.sequence(F.lit(1), longest.cast("int")), lambda d: F.size(F.filter("__places", lambda p: p <= d)) / d)
    overlap = F.aggregate(agreed, F.lit(0.0), lambda a, b: a + b) / longest
    named = artists.select("artist_id").distinct().join(sums.withColumnRenamed("source", "artist_id"), "artist_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_staged", "n_current", "n_common")]
    return named.select("artist_id", *counts, F.when(longest > 0, overlap).alias("rank_overlap"), "mean_shift")


def drifted(report: DataFrame, least: float = 0.5) -> DataFrame:
    """Of ``compared``, the artists whose neighbours changed too much: known in the current version, and under ``least`` now. An
    artist that the current version does not know has nothing to drift from."""
    return report.where((F.col("n_current") > 0) & (F.col("rank_overlap") < least))
