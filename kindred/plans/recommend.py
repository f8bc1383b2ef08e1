"""The batch build of edges, and the queries behind each endpoint."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import drift, governance, outliers, ranking, search, similarity
from ..sources import clustered, shared, writers


def build_edges(listens: DataFrame, genres: DataFrame, relations: DataFrame, version: str, s: config.Similarity = config.Similarity()) -> DataFrame:  # noqa: B008
    """artist_edges from listens (user_id, artist_id, ts), genres (artist_id, genre) and relations (artist_1, artist_2, kind).

    Genre overlap is computed for pairs that behaviour or a relation brings up; the best ``top_k`` edges of each artist are
    kept, fallback edges ranked apart from others."""
    usual = outliers.without_outliers(similarity.without_bursts(listens), s.outlier_width, s.outlier_floor, s.outlier_days)
    weights = similarity.popular_enough(similarity.user_weights(usual, s.play_cap), s.min_listeners)
    behavior = shared.save(similarity.published(similarity.cosine_pairs(weights, s.user_cap, s.shrinkage), s.min_common).drop("cosine"), "behavior")
    relation = similarity.relation_pairs(relations)
    pairs = behavior.select("a", "b").unionByName(relation.select("a", "b")).distinct()
    metadata = similarity.genre_similarity(pairs, similarity.genre_sets(genres)).where("metadata is not null")
    edges = similarity.both_ways(similarity.blended(behavior, metadata, relation, s))
    best = similarity.top_edges(edges, "score", s.top_k, ["is_fallback"])
    return best.select(
        F.col("source").alias("source_artist_id"),
        F.col("target").alias("target_artist_id"),
        F.col("score").alias("total_score"),
        F.col("behavior").alias("behavior_score"),
        F.col("metadata").alias("metadata_score"),
        F.col("relation").alias("relation_score"),
        "confidence",
        similarity.listener_bucket(F.col("n_common")).alias("common_listener_bucket"),
        "is_fallback",
        similarity.explanation().alias("explanation"),
        F.lit(version).alias("model_version"),
    )


#: Where each kind of evidence comes from (fixed values).
EVIDENCE_SOURCES = {"behavior": "ListenBrainz", "metadata": "Wikidata", "relation": "MusicBrainz"}


def publish_edges(
    edges: DataFrame, root: str, version: str, sources: list[str], representatives: DataFrame | None = None, least_overlap: float = 0.5,
    ledger: DataFrame | None = None, origins: dict[str, str] | None = None,
) -> None:
    """Publish artist_edges; refused if a column belongs to single listeners, or comes from a field that the ``ledger`` does not allow, or if
    the neighbours of one of ``representatives`` (artist_id) are under ``least_overlap`` like those of the version that is served now."""
    if named := governance.private_columns(edges):
        raise ValueError(f"not to be served: {', '.join(named)}")
    checks = None
    if representatives is not None and writers.has_current(root, edges.sparkSession):
        served = directed(writers.read_current(root, "artist_edges", edges.sparkSession))
        checks = {"representative artists": lambda staged: drift.drifted(drift.compared(directed(staged["artist_edges"]), served, representatives), least_overlap)}
    tables = {"artist_edges": edges}
    if {"behavior_score", "metadata_score", "relation_score", "model_version"} <= set(edges.columns):
        tables["edge_evidence"] = edge_evidence(edges)
    layouts = {"artist_edges": EDGE_LAYOUT} if set(EDGE_LAYOUT.sort) <= set(edges.columns) else None
    writers.publish(tables, root, version, sources, checks, ledger, origins, layouts)


def edge_evidence(edges: DataFrame, names: dict[str, str] = EVIDENCE_SOURCES) -> DataFrame:
    """(edge_id, evidence_type, evidence_value, source_name) of served edges: a row for each part that a score is made of, and where
    it comes from. An edge's id is a digest of its ends and the model's version, so that it can be worked out from the edge."""
    rows = edges.select(edge_id().alias("edge_id"), *[F.col(f"{c}_score").alias(c) for c in names]).unpivot(["edge_id"], list(names), "evidence_type", "evidence_value")
    of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.where("evidence_value is not null").withColumn("source_name", F.element_at(of, F.col("evidence_type")))


def edge_id() -> Column:
    return F.sha2(F.concat_ws("/", F.col("source_artist_id").cast("string"), F.col("target_artist_id").cast("string"), "model_version"), 256)


def popularity(weights: DataFrame) -> DataFrame:
    """(artist_id, share): listeners of each artist over those of the most heard one."""
    heard = weights.groupBy("artist_id").agg(F.count("*").alias("n"))
    return heard.join(F.broadcast(heard.agg(F.max("n").alias("most")))).select("artist_id", (F.col("n") / F.col("most")).alias("share"))


def directed(edges: DataFrame) -> DataFrame:
    """Served edges in the shape that ranking takes; fallback edges stay out."""
    return edges.where("not is_fallback").select(F.col("source_artist_id").alias("source"), F.col("target_artist_id").alias("target"), F.col("total_score").alias("score"), "confidence")


#: How served tables lie in their folders: a search reads the buckets of its grams, an artist's page the bucket of the artist.
INDEX_LAYOUT, EDGE_LAYOUT = clustered.Layout("gram"), clustered.Layout("source_artist_id", sort=("is_fallback", "total_score"))


def publish_index(names: DataFrame, root: str, version: str, sources: list[str], layout: clustered.Layout = INDEX_LAYOUT) -> None:
    """Publish the search index of names and aliases (artist_id, name), for ``find_artists``."""
    writers.publish({"search_index": search.index(names)}, root, version, sources, layouts={"search_index": layout})


def find_artists(root: str, queries: DataFrame) -> DataFrame:
    """Artist search of many queries (q) over the index that is published under ``root``, which is not shuffled."""
    return search.search(queries, writers.read_current(root, "search_index", queries.sparkSession))


def find_artist(root: str, q: str, spark: SparkSession, limit: int = 5) -> DataFrame:
    """Artist search of one query over the published index."""
    return search.lookup(q, writers.read_current(root, "search_index", spark), limit)


def artist(mbid: str, artists: DataFrame, aliases: DataFrame, links: DataFrame, facts: DataFrame) -> DataFrame:
    """One artist with its aliases, links and facts as arrays; each table has ``artist_id``."""
    out = artists.where(F.col("artist_id") == mbid)
    for name, rows in (("aliases", aliases), ("links", links), ("facts", facts)):
        own = rows.where(F.col("artist_id") == mbid).groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "artist_id"]))).alias(name))
        out = out.join(own, "artist_id", "left")
    return out


def neighbours(mbid: str, edges: DataFrame, k: int = 50) -> DataFrame:
    own = edges.where(F.col("source_artist_id") == mbid)
    return own.orderBy("is_fallback", F.desc("total_score"), "target_artist_id").limit(k)


def recommend(seeds: DataFrame, edges: DataFrame, mode: str = "near", feedback: DataFrame | None = None, n: int = 10, popularity: DataFrame | None = None) -> DataFrame:
    """Recommendations of (request_id, seed_id, w) in mode near, bridge or adventure; ``popularity`` (artist_id, share in 0..1) lets
    adventure favour what few know."""
    known = None
    if feedback is not None:
        seeds, known = ranking.apply_feedback(seeds, feedback)
    served = directed(edges)
    found = ranking.candidates(seeds, served, known)
    if mode == "near":
        return ranking.near(found, n)
    if mode == "bridge":
        return ranking.bridge(found, n)
    if mode == "adventure":
        return ranking.adventure(found, served, n, popularity=popularity)
    raise ValueError(f"no such mode: {mode}")


def save_feedback(rows: DataFrame, path: str) -> None:
    """Append validated feedback (schemas.FEEDBACK)."""
    rows.where("action in ('known', 'interested', 'not_for_me') and artist_id is not null").write.mode("append").parquet(path)


def map_around(center: str, edges: DataFrame, coordinates: DataFrame) -> DataFrame:
    """The local graph of an artist with the stored coordinates (artist_id, x, y) of both ends of each edge, the centre included."""
    served = directed(edges)
    at = served.sparkSession.createDataFrame([(center,)], "artist_id string").select(F.col("artist_id").cast(dict(served.dtypes)["source"]))
    graph = ranking.local_graph(served, at)
    for end in ("source", "target"):
        graph = graph.join(coordinates.select(F.col("artist_id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y")), end, "left")
    return graph.select("center", "source", "target", "score", "source_x", "source_y", "target_x", "target_y")


def data_version(root: str, registry: DataFrame) -> DataFrame:
    return registry.withColumn("data_version", F.lit(writers.current_version(root, registry.sparkSession)))


def methodology() -> dict:
    """The constants in force."""
    return {"similarity": asdict(config.Similarity()), "ranking": asdict(config.Ranking()), "relations": config.RELATIONS}
