"""Snapshot readers. All inputs are files that Spark reads; nothing calls a remote service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions.text import normalize_name
from . import archives
from .redirects import redirected  # noqa: F401


def validation_list(spark: SparkSession, path: str, expected_rows: int | None = config.VALIDATION_ROWS) -> DataFrame:
    """The artist list, all strings with null cells as empty ones; checked for its row count and unique names."""
    rows = spark.read.schema(schemas.VALIDATION).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.na.fill("")
    check_list(rows, expected_rows, path)
    return rows


def check_list(rows: DataFrame, expected_rows: int | None, path: str = "the list") -> None:
    """Raises ValueError (messages are fixed values) unless there are ``expected_rows`` rows, whose names differ after normalisation."""
    n, names = rows.agg(F.count("*"), F.countDistinct(normalize_name("artist_name"))).first()
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"Expected exactly {expected_rows} validation artists, found {n} in {path}")
    if names != n:
        raise ValueError("Validation artist names must be unique after Unicode normalization")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).option("header", True).csv(path)


def searches(spark: SparkSession, path: str) -> DataFrame:
    """Candidate snapshot: JSON lines, one for each searched name."""
    return spark.read.schema(schemas.SEARCH).json(path)


def listener_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics by artist id. Of the listeners only their number leaves this scan; a missing payload is a zero row."""
    raw = spark.read.schema(schemas.STATS).json(path)
    from ..functions.text import safe_int

    total = safe_int(F.col("payload.total_listen_count"))
    failed = F.col("error").isNotNull()
    known = lambda c: F.when(~failed, c)
    return raw.select(
        "mbid",
        F.when(failed, F.lit(False)).otherwise(total > 0).alias("listenbrainz_has_data"),
        known(total).alias("total_listen_count"),
        known(F.greatest(F.coalesce(F.size("payload.listeners"), F.lit(0)), F.lit(0))).alias("top_listener_count"),
        known(F.coalesce("payload.last_updated", F.when(F.col("payload").isNotNull(), F.lit("")))).alias("listenbrainz_last_updated"),
        F.col("error").alias("listenbrainz_error"),
        "fetched_at",
    )


def triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIPLES).json(path)


def listens(spark: SparkSession, path: str, salt: str) -> DataFrame:
    """Listens (JSON lines, or an archive of such) with the user id replaced at the scan by a salted hash; the salt is the caller's and is not stored."""
    raw = archives.json_lines(spark, path, schemas.LISTENS, "*listens*")
    return raw.select(pseudonym(F.col("user_identifier"), salt).alias("user_id"), "recording_mbid", F.col("listen_timestamp").alias("ts"))


def pseudonym(user: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), user.cast("string")), 256)


def with_artists(plays: DataFrame, canonical: DataFrame) -> DataFrame:
    """Listens with the artist of their recording; listens without one leave."""
    return plays.join(canonical, "recording_mbid").drop("recording_mbid").withColumnRenamed("artist_mbid", "artist_id")


def newest(registry: DataFrame) -> DataFrame:
    """The registry row of every source's newest snapshot."""
    return registry.groupBy("source_name").agg(F.max_by(F.struct(*registry.columns), "snapshot_date").alias("r")).select("r.*")


def latest(registry: DataFrame, source: str) -> DataFrame:
    """The registry row of a source's newest snapshot."""
    return newest(registry.where(F.col("source_name") == source))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRY).json(path)


def canonical(spark: SparkSession, path: str) -> DataFrame:
    """Recording to artist, for ``with_artists``."""
    return spark.read.schema(schemas.CANONICAL).parquet(path)


def newest_path(found: DataFrame, source: str) -> str:
    """Where the newest snapshot of a source lies; LookupError if the registry has none."""
    row = latest(found, source).select("path").first()
    if row is None:
        raise LookupError(f"no snapshot of {source} is registered")
    return row["path"]


#: What the name of a dump says: its date, and whether it is whole.
_NAMED = r"(\d{4})-?(\d{2})-?(\d{2})"
_PARTIAL = r"(?i)incremental|daily|delta"


def listed(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Registry rows of the dumps that lie in a folder, by their names (a date in each); the newest is found without a schedule."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    date = F.concat_ws("-", *[F.regexp_extract(name, _NAMED, k) for k in (1, 2, 3)])
    return files.select(F.lit(source).alias("source_name"), F.to_date(F.when(F.regexp_like(name, F.lit(_NAMED)), date)).alias("snapshot_date"), "path").where("snapshot_date is not null")


def whole(found: DataFrame) -> DataFrame:
    """Registry rows less increments: those lack what was deleted since the last full dump, and are no base to build on."""
    return found.where(~F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(_PARTIAL)))


def base_path(found: DataFrame, source: str) -> str:
    """Where the newest full dump of a source lies; LookupError if there are increments only, or nothing."""
    try:
        return newest_path(whole(found), source)
    except LookupError:
        if found.where(F.col("source_name") == source).isEmpty():
            raise
        raise LookupError(f"of {source} there are increments only, which are no base") from None


def listen_dump(spark: SparkSession, found: DataFrame, source: str, salt: str) -> DataFrame:
    """``listens`` of the newest full dump of a source."""
    return listens(spark, base_path(found, source), salt)


def dump(spark: SparkSession, found: DataFrame, source: str) -> DataFrame:
    """The newest catalogue dump of a source (JSON lines, or an archive with a member of artists), found by the registry, as artists."""
    raw = archives.json_lines(spark, newest_path(found, source), schemas.DUMP, "*artist*")
    year = lambda c: F.regexp_extract(F.col(c), r"^(\d{4})", 1).try_cast("int")
    return raw.where("id is not null").select(
        F.col("id").alias("artist_id"), F.col("name").alias("canonical_name"), F.col("sort-name").alias("sort_name"), F.col("type").alias("artist_type"), F.col("country").alias("area_code"),
        year("life-span.begin").alias("begin_year"), year("life-span.end").alias("end_year"), F.col("life-span.ended").alias("ended"), F.filter(F.col("aliases.name"), lambda x: x.isNotNull()).alias("aliases"),
    )


def dump_names(artists: DataFrame) -> DataFrame:
    """(artist_id, name): names and aliases of ``dump``, for the search index."""
    every = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return artists.select("artist_id", F.explode(every).alias("name")).where("name is not null and name <> ''")


def artifact_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``path``, to be held against the registry; for files of up to 2 GB, which
    a row holds whole. ``digests.tree_digests`` takes files of any size."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def missing(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that a cache table does not hold yet: these are to be fetched."""
    return keys.select(key).where(F.col(key) != "").distinct().join(cache.select(key), key, "left_anti")


def cache_key(name: Column) -> Column:
    """Key of a search in the cache: a digest of the name as it was written."""
    return F.sha2(name, 256)
