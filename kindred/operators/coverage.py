"""Enrichment joins, knowledge-base counts, and the coverage summary with its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import casefold, last_part, safe_int, strip
from ..sources import shared
from .snapshots import newest_lines

#: Knowledge-base properties (fixed values): id, genre, the two of country, the two of start.
ID, GENRE, COUNTRY, START = "P434", ("P136",), ("P27", "P495"), ("P571", "P2031")
#: Tasks that the facts of one id are dealt to.
SHARES = 16


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Listener statistics by resolved id, of several the newest; rows without an id, or whose id has no snapshot row, keep nulls."""
    wanted = newest_lines(stats, "mbid", "listenbrainz_error" if "listenbrainz_error" in stats.columns else None).withColumnRenamed("mbid", "__mbid")
    return rows.join(wanted, (rows["resolved_mbid"] == F.col("__mbid")) & (rows["resolved_mbid"] != ""), "left").drop("__mbid")


def knowledge_base(ids: DataFrame, triples: DataFrame) -> DataFrame:
    """Per id (of ``ids``: mbid): one item (the smallest) and distinct counts of genres, countries and starts over all
    items that carry the id. Each property is counted on its own, so that none multiplies another. Steps have as many tasks as
    rows need; an id that very many items carry is dealt to SHARES tasks. Items are not dealt with the facts to be counted: the
    smallest is found where the items of an id are, which keeps those without facts too."""
    kind = F.when(F.col("property") == ID, "item").when(F.col("property").isin(*GENRE), "genre").when(F.col("property").isin(*COUNTRY), "country").when(F.col("property").isin(*START), "start")
    told = triples.select(F.col("subject").alias("item"), kind.alias("kind"), "object").where("kind is not null")
    size = told.agg(F.count_if(F.col("kind") == "item").alias("items"), F.count("*").alias("facts"), F.approx_count_distinct("item").alias("of")).first()
    n, met = shared.tasks(size["facts"]), shared.tasks(size["items"] * size["facts"] / max(1, size["of"]))
    wanted = ids.select("mbid").where("mbid <> ''").distinct().repartition(n, "mbid")
    items = told.where("kind = 'item' and item is not null").select(F.col("object").alias("mbid"), "item").repartition(n, "mbid").join(wanted, "mbid")
    smallest = items.groupBy("mbid").agg(F.min("item").alias("item"))
    facts = told.where("kind <> 'item'").repartition(n, "item").distinct()
    pairs = items.repartition(n, "item").distinct().join(facts, "item").select("mbid", "kind", "object", F.pmod(F.xxhash64("kind", "object"), F.lit(SHARES)).alias("share"))
    distinct = pairs.repartition(met, "mbid", "share").distinct()
    counts = distinct.groupBy("mbid").agg(*[F.count_if(F.col("kind") == name).alias(name) for name in ("genre", "country", "start")])
    seen = smallest.join(counts, "mbid", "left").na.fill(0, ["genre", "country", "start"])
    return seen.select("mbid", last_part(F.col("item")).alias("wikidata_item"), *[F.col(c).alias(f"wikidata_{c}_count") for c in ("genre", "country", "start")])


def with_knowledge(rows: DataFrame, kb: DataFrame, error: str | None = None) -> DataFrame:
    """Counts by resolved id, of several the newest; an error of the whole batch is put on every row."""
    joined = rows.join(newest_lines(kb, "mbid").withColumnRenamed("mbid", "__mbid"), rows["resolved_mbid"] == F.col("__mbid"), "left").drop("__mbid")
    return joined.withColumn("wikidata_error", F.lit(error).cast("string"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts, rates to four places, and the verdict. An empty list is an error."""
    said = casefold(strip(F.coalesce("manual_identity_status", F.lit(""))))
    counted = rows.withColumn("__said", said).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("resolution_status").isin("auto_resolved", "manual_review")).alias("resolved"),
        F.count_if(F.col("resolution_status") == "auto_resolved").alias("auto"),
        F.count_if(F.coalesce("listenbrainz_has_data", F.lit(False))).alias("data"),
        F.count_if(safe_int(F.col("wikidata_genre_count")) > 0).alias("genre"),
        F.count_if(F.col("__said") == "confirmed").alias("confirmed"),
        F.count_if(F.col("__said") == "incorrect").alias("incorrect"),
    )
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("no rows to summarize")).cast("long")).otherwise(F.col("n"))
    rate = lambda c: F.bround(F.col(c) / F.col("n"), 4)
    return (
        counted.withColumn("n", n)
        .select(
            F.col("n").alias("artist_count"),
            rate("resolved").alias("musicbrainz_candidate_rate"),
            rate("auto").alias("musicbrainz_auto_resolution_rate"),
            rate("data").alias("listenbrainz_data_rate"),
            rate("genre").alias("wikidata_genre_rate"),
            F.col("confirmed").alias("identity_confirmed_count"),
            F.col("incorrect").alias("identity_incorrect_count"),
            (F.col("n") - F.col("confirmed") - F.col("incorrect")).alias("identity_pending_count"),
        )
        .withColumn("go_no_go", verdict())
    )


def verdict():
    enough, data = F.col("musicbrainz_candidate_rate") >= config.CANDIDATE_RATE, F.col("listenbrainz_data_rate") >= config.DATA_RATE
    pending, wrong = F.col("identity_pending_count") > 0, F.col("identity_incorrect_count")
    return F.struct(
        enough.alias("musicbrainz_90_percent"),
        data.alias("listenbrainz_70_percent"),
        F.when(~pending, wrong == 0).alias("same_name_zero_errors"),
        F.when(pending, "PENDING_MANUAL_IDENTITY_REVIEW").when(enough & data & (wrong == 0), "GO").otherwise("NO_GO_OR_REDUCE_SCOPE").alias("decision"),
    )


def union_rows(*frames: DataFrame) -> DataFrame:
    """The rows of all frames under the union of their columns, in the order in which columns are first seen; null where a
    frame lacks one."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def group_sizes(rows: DataFrame, column: str) -> DataFrame:
    """Rows in each group; null is a group."""
    return rows.groupBy(column).agg(F.count("*").alias("artists"))


def present(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that the frame has."""
    return rows.select(*[c for c in columns if c in rows.columns])
