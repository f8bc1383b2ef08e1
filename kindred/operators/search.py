"""Name search that tolerates spelling, by trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal, normalize_name, trigrams


LEAST = 0.3


def index(names: DataFrame, least: float = LEAST) -> DataFrame:
    """(artist_id, name, grams, gram) of (artist_id, name): each name under its rarest grams, as many as a name that is
    ``least`` similar cannot all lack. To be written once and reused."""
    rows = names.withColumn("__plain", normalize_name("name")).withColumn("grams", trigrams(F.col("__plain"))).select("artist_id", "name", "grams")
    held = rows.select("artist_id", "name", F.explode("grams").alias("gram"))
    common = held.groupBy("gram").agg(F.count("*").alias("artists"))
    ranked = held.join(common, "gram").groupBy("artist_id", "name").agg(F.array_sort(F.collect_list(F.struct("artists", "gram"))).alias("g"))
    return ranked.select("artist_id", "name", F.col("g.gram").alias("grams"), F.explode(_rarest("g.gram", least)).alias("gram"))


def _rarest(grams: str, least: float) -> Column:
    return F.slice(grams, F.lit(1), (F.size(grams) - F.ceil(least * F.size(grams) - 1e-9) + 1).cast("int"))


def search(queries: DataFrame, gram_index: DataFrame, limit: int = 5, least: float = LEAST) -> DataFrame:
    """For each query (q) the ``limit`` best (artist_id, name, similarity): trigram Jaccard, ties by name and id. Queries meet
    names on the names' rarest trigrams only, then by size, then by all their grams; an artist's best name counts. ``least``
    is that of the index or more."""
    plain = queries.select("q").distinct().withColumn("__plain", normalize_name("q")).withColumn("q_grams", trigrams(F.col("__plain")))
    asked = plain.select("q", "q_grams", F.explode("q_grams").alias("gram"))
    met = asked.join(gram_index.select("gram", "artist_id", "name", "grams"), "gram")
    met = met.where(F.least(F.size("grams"), F.size("q_grams")) >= least * F.greatest(F.size("grams"), F.size("q_grams")) - 1e-9).dropDuplicates(["q", "artist_id", "name"])
    common = F.size(F.array_intersect("q_grams", "grams"))
    scored = met.withColumn("similarity", common / (F.size("q_grams") + F.size("grams") - common)).where(F.col("similarity") >= least)
    own = F.row_number().over(Window.partitionBy("q", "artist_id").orderBy(F.desc("similarity"), "name"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "name", "artist_id"))
    return scored.withColumn("__own", own).where("__own = 1").withColumn("rank", rank).where(F.col("rank") <= limit).select("q", "artist_id", "name", "similarity", "rank")


def lookup(q: str, stored: DataFrame, limit: int = 5, least: float = LEAST) -> DataFrame:
    """``search`` for one query, over an index that is stored in buckets of its grams: only the buckets of the query's own grams are
    read, and names are compared where they are read."""
    padded = f"  {normal(q)} "
    grams = list(dict.fromkeys(padded[i : i + 3] for i in range(max(1, len(padded) - 2))))
    size, n = F.size("grams"), F.lit(len(grams))
    common = F.size(F.array_intersect("grams", F.array(*map(F.lit, grams))))
    met = stored.where(F.col("gram").isin(*grams)).where(F.least(size, n) >= least * F.greatest(size, n) - 1e-9)
    scored = met.select("artist_id", "name", (common / (n + size - common)).alias("similarity")).where(F.col("similarity") >= least)
    own = scored.groupBy("artist_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "name")).alias("own"))
    order = ("own.less", "own.name", "artist_id")
    top = own.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of ``limit`` rows
    return top.select(F.lit(q).alias("q"), "artist_id", "own.name", (-F.col("own.less")).alias("similarity"), "rank")


def era_overlaps(begin: Column, end: Column, first: int, last: int) -> Column:
    """Whether the years of activity meet [first, last]; a missing begin is unknown (no match), a missing end is today."""
    return F.coalesce((begin <= last) & (F.coalesce(end, F.lit(9999)) >= first), F.lit(False))


def in_scope(artists: DataFrame, areas: list[str] | None = None, era: tuple[int, int] | None = None) -> DataFrame:
    """Artists (area_code, begin_year, end_year) of the areas and the era that a search asks for."""
    out = artists if areas is None else artists.where(F.col("area_code").isin(areas))
    return out if era is None else out.where(era_overlaps(F.col("begin_year"), F.col("end_year"), *era))
