"""Candidate scoring, ranking and classification of artist names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import casefold, hint_match, normalize_name, normalize_names, parse_optional_bool, safe_int, strip
from .snapshots import newest_lines

RESOLVED = (
    "resolution_status", "resolved_mbid", "resolved_name", "resolved_country", "resolved_type", "resolved_ended", "resolved_disambiguation",
    "resolver_score", "score_gap", "candidate_count", "top_candidates", "resolution_note",
)


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def candidate_names(candidate: Column) -> Column:
    """The name and the aliases that are not empty."""
    aliases = F.transform(F.coalesce(candidate["aliases"], F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    return F.filter(F.concat(F.array(candidate["name"]), aliases), lambda n: n.isNotNull() & (n != ""))


def score_columns(candidate: Column) -> dict[str, Column]:
    """Match flags and the total of a candidate, over the list's columns in the same row. Totals lie in 0..100.

    An empty expectation matches everything; a missing candidate value matches only an empty one."""
    country, kind = F.upper(strip(_text(F.col("expected_country")))), casefold(strip(_text(F.col("expected_type"))))
    ended = parse_optional_bool(F.col("expected_ended").cast("string"))
    hint = _text(F.col("disambiguation_hint"))
    comment = _text(candidate["disambiguation"])
    flags = {
        "exact_name": F.array_contains(normalize_names(candidate_names(candidate)), normalize_name(_text(F.col("artist_name")))),
        "country_match": (country == "") | F.coalesce(candidate["country"] == country, F.lit(False)),
        "type_match": (kind == "") | (casefold(strip(F.coalesce(candidate["type"], F.lit("none")))) == kind),
        "ended_match": ended.isNull() | candidate["life-span"]["ended"].eqNullSafe(ended),
        "hint_match": hint_match(hint, comment),
    }
    points = dict(zip(flags, (config.EXACT_NAME, config.COUNTRY, config.TYPE, config.ENDED, config.HINT), strict=True))
    total = F.greatest(F.lit(0), F.least(F.lit(100), safe_int(candidate["score"]))).cast("double") * F.lit(config.API_SHARE)
    for name, n in points.items():
        total = total + F.when(F.col(name), F.lit(float(n))).otherwise(F.lit(0.0))
    return flags | {"total": total}


def score_candidates(artists: DataFrame, searches: DataFrame) -> DataFrame:
    """One row for each artist and candidate (``pos``: place in the search result) of the first ``config.CANDIDATE_LIMIT``, with
    flags and total; an artist without candidates has one row with a null candidate. Of several searches for a name the newest counts."""
    found = newest_lines(searches, "artist_name", "error").select(F.col("artist_name").alias("__name"), F.slice("artists", 1, config.CANDIDATE_LIMIT).alias("artists"), F.col("error").alias("search_error"))
    rows = artists.join(found, artists["artist_name"] == F.col("__name"), "left").drop("__name")
    rows = rows.select(*artists.columns, "search_error", F.posexplode_outer("artists").alias("pos", "candidate"))
    made = score_columns(F.col("candidate"))
    total = made.pop("total")
    return rows.withColumns(made).withColumn("total", total)


def compact(candidate: Column, total: Column) -> Column:
    return F.struct(
        _text(candidate["id"]).alias("mbid"),
        _text(candidate["name"]).alias("name"),
        _text(candidate["disambiguation"]).alias("disambiguation"),
        _text(candidate["country"]).alias("country"),
        _text(candidate["type"]).alias("type"),
        candidate["life-span"]["ended"].alias("ended"),
        safe_int(candidate["score"]).alias("api_score"),
        F.bround(total, 2).alias("resolver_score"),
    )


def strong_match(best: Column, gap: Column) -> Column:
    """``ended`` and ``hint`` add to the total but are no conditions of their own."""
    return (best["total"] >= config.STRONG_TOTAL) & best["exact_name"] & best["country_match"] & best["type_match"] & (gap >= config.STRONG_GAP)


def resolve(artists: DataFrame, searches: DataFrame) -> DataFrame:
    """``artists`` with the columns RESOLVED. Candidates rank by total, then by their place in the search result; the gap
    is to the runner-up, or to 0 where there is none. The best id is given for manual reviews too."""
    scored = score_candidates(artists, searches).where("candidate is not null")
    rank = Window.partitionBy("artist_name").orderBy(F.desc("total"), F.asc("pos"))
    ranked = scored.withColumn("rank", F.row_number().over(rank))
    flags = ("total", "exact_name", "country_match", "type_match")
    best = ranked.groupBy("artist_name").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("candidate.id", "candidate.name", "candidate.country", "candidate.type", F.col("candidate.life-span.ended").alias("ended"), "candidate.disambiguation", *flags))).alias("best"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("total"))), F.lit(0.0)).alias("second"),
        F.count("*").cast("int").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= config.TOP_CANDIDATES, F.struct("rank", compact(F.col("candidate"), F.col("total")).alias("c"))))).alias("top"),
    ).withColumnRenamed("artist_name", "__name")
    errors = newest_lines(searches, "artist_name", "error").select(F.col("artist_name").alias("__asked"), F.col("error").alias("search_error"))
    joined = artists.join(best, artists["artist_name"] == F.col("__name"), "left").join(errors, artists["artist_name"] == F.col("__asked"), "left")
    b, failed, empty = F.col("best"), F.col("search_error").isNotNull(), F.col("best").isNull()
    gap = b["total"] - F.col("second")
    auto = strong_match(b, gap) & (F.coalesce(F.col("category"), F.lit("")) != config.FORCED_REVIEW)
    status = F.when(failed, "request_error").when(empty, "not_found").when(auto, "auto_resolved").otherwise("manual_review")
    note = (
        F.when(failed, F.col("search_error"))
        .when(empty, config.NO_CANDIDATES)
        .when(auto, "")
        .otherwise(config.CONFIRM)
    )
    found = lambda c: F.when(~failed, c)
    columns = [
        status,
        F.when(failed | empty, "").otherwise(_text(b["id"])),
        *[found(b[c]) for c in ("name", "country", "type", "ended", "disambiguation")],
        found(F.bround(b["total"], 2)),
        found(F.bround(gap, 2)),
        found(F.coalesce("n", F.lit(0))),
        found(F.coalesce(F.to_json(F.transform("top", lambda t: t["c"]), {"ignoreNullFields": "false"}), F.lit("[]"))),
        note,
    ]
    return joined.select(*[artists[c] for c in artists.columns], *[c.alias(name) for c, name in zip(columns, RESOLVED, strict=True)])
