"""Artist similarity from listens, genres and relations, with confidence and evidence.

Pairs are made only of artists that one user (or one session) has in common, never of all artists. A user contributes at
most ``user_cap`` artists, which bounds the pairs of a user by ``user_cap ** 2 / 2`` whatever they listen to, and the
pair sums are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..sources import shared
from . import setjoin

S = config.Similarity()


#: Seconds of a user's history that are ordered together.
CHUNK = 86_400
#: Order within a day: first the end of the day before.
IN_DAY = ("__own", "ts", "artist_id")


def with_gap(listens: DataFrame) -> DataFrame:
    """Listens (user_id, artist_id, ts) with ``gap``, the seconds since the user's last listen (null for the first), and their ``__day``
    (user_id, chunk), within which they are dealt and lie by ``IN_DAY``.

    Listens are ordered by ts and artist within a day, behind a row that tells the end of the user's last day; of such ends
    there is one for each day. So no task orders a whole history, however long it is. Days are structs, which are equal where
    their nulls are: what is done by day needs listens to be dealt only once."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    day = F.struct("user_id", F.floor(F.col("__s") / CHUNK).alias("chunk"))
    rows = listens.withColumn("__s", seconds).withColumn("__day", day).withColumn("__own", F.lit(1)).drop("user_id")
    following = F.lead("__day.chunk").over(Window.partitionBy("__day.user_id").orderBy("__day.chunk"))
    ends = rows.groupBy("__day").agg(F.max("__s").alias("__s")).withColumn("__next", following).where("__next is not null")
    ends = ends.select(F.struct(F.col("__day.user_id").alias("user_id"), F.col("__next").alias("chunk")).alias("__day"), "__s", F.lit(0).alias("__own"))
    last = F.lag("__s").over(Window.partitionBy("__day").orderBy(*IN_DAY))
    told = rows.unionByName(ends, allowMissingColumns=True).withColumn("gap", F.col("__s") - last).where("__own = 1")
    return told.withColumn("user_id", F.col("__day.user_id")).select(*listens.columns, "__day", "__own", "gap")


def without_bursts(listens: DataFrame, seconds: int = 30) -> DataFrame:
    """Listens (user_id, artist_id, ts) less those that follow the user's last one by under ``seconds``."""
    return with_gap(listens).where(F.col("gap").isNull() | (F.col("gap") >= seconds)).select(*listens.columns)


def user_weights(listens: DataFrame, play_cap: int = S.play_cap, by_day: bool = False) -> DataFrame:
    """(user_id, artist_id, plays, weight): capped plays, or listening days, as log(1 + x)."""
    measure = F.countDistinct(F.to_date("ts")) if by_day else F.count("*")
    counted = listens.where("user_id is not null and artist_id is not null").groupBy("user_id", "artist_id").agg(F.least(measure, F.lit(play_cap)).alias("plays"))
    return counted.withColumn("weight", F.log1p("plays"))


def listeners(weights: DataFrame) -> DataFrame:
    """Listeners and L2 norm of each artist; ``weights`` has one row for each user and artist."""
    return weights.groupBy("artist_id").agg(F.count("*").alias("listeners"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def popular_enough(weights: DataFrame, min_listeners: int = S.min_listeners) -> DataFrame:
    enough = weights.groupBy("artist_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_listeners).select("artist_id")
    return weights.join(enough, "artist_id", "left_semi")


def capped_users(weights: DataFrame, user_cap: int = S.user_cap) -> DataFrame:
    """The ``user_cap`` heaviest artists of each user (part of the definition of pair counts)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "artist_id"))
    return weights.withColumn("__rank", rank).where(F.col("__rank") <= user_cap).drop("__rank")


def pair_sums(weights: DataFrame, user_cap: int = S.user_cap) -> DataFrame:
    """(a, b, n_common, dot) for a < b that share a user."""
    own = capped_users(weights, user_cap)
    one = own.select("user_id", F.col("artist_id").alias("a"), F.col("weight").alias("wa"))
    two = own.select("user_id", F.col("artist_id").alias("b"), F.col("weight").alias("wb"))
    return one.join(two, "user_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"), F.sum(F.col("wa") * F.col("wb")).alias("dot"))


def cosine_pairs(weights: DataFrame, user_cap: int = S.user_cap, shrinkage: float = S.shrinkage) -> DataFrame:
    """Cosine over all listeners of either artist, and its value shrunk by n / (n + lambda)."""
    norms = listeners(weights)
    pairs = pair_sums(weights, user_cap)
    pairs = pairs.join(norms.select(F.col("artist_id").alias("a"), F.col("norm").alias("norm_a")), "a").join(norms.select(F.col("artist_id").alias("b"), F.col("norm").alias("norm_b")), "b")
    cosine = F.when((F.col("norm_a") > 0) & (F.col("norm_b") > 0), F.least(F.lit(1.0), F.col("dot") / (F.col("norm_a") * F.col("norm_b")))).otherwise(0.0)
    return pairs.withColumn("cosine", cosine).withColumn("behavior", F.col("cosine") * F.col("n_common") / (F.col("n_common") + F.lit(float(shrinkage)))).select("a", "b", "n_common", "cosine", "behavior")


def published(pairs: DataFrame, min_common: int = S.min_common) -> DataFrame:
    """Pairs with enough common listeners to be shown (a privacy floor)."""
    return pairs.where(F.col("n_common") >= min_common)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Undirected pairs as directed edges (source, target)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), *rest).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"), *rest))


def top_edges(edges: DataFrame, score: str, k: int = S.top_k, apart: list[str] = []) -> DataFrame:  # noqa: B006
    """The k best targets of each source (and of each value of the columns ``apart``); ties by target."""
    rank = F.row_number().over(Window.partitionBy("source", *apart).orderBy(F.desc(score), "target"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def genre_sets(facts: DataFrame) -> DataFrame:
    """(artist_id, genres) from (artist_id, genre)."""
    return facts.where("genre is not null").groupBy("artist_id").agg(F.collect_set("genre").alias("genres"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if both are empty or either is unknown."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull() & (union > 0), F.size(F.array_intersect(a, b)) / union)


def genre_pairs(facts: DataFrame, least: float = S.enough_metadata) -> DataFrame:
    """(a, b, metadata): the Jaccard of the genre sets of two artists of (artist_id, genre) or (artist_id, genres), where it is ``least`` or more."""
    sets = F.col("genres").alias("words") if "genres" in facts.columns else F.col("genre").alias("element")
    pairs = setjoin.similar_sets(facts.select(F.col("artist_id").alias("id"), sets), least)
    return pairs.select("a", "b", F.col("similarity").alias("metadata"))


def genre_classes(facts: DataFrame, least: float = S.enough_metadata) -> tuple[DataFrame, DataFrame]:
    """``genre_pairs`` as pairs (a, b, metadata) of different genre sets and of sets that several artists have, with the artists (id, of) of each:
    what ``setjoin.listed`` and ``setjoin.counted`` take. Pairs are found while they are read, not written."""
    sets = F.col("genres").alias("words") if "genres" in facts.columns else F.col("genre").alias("element")
    facts = facts.select(F.col("artist_id").alias("id"), sets)
    pairs, members = setjoin.similar_classes(facts if "words" in facts.columns else setjoin._gathered(facts), least, written=False)
    return setjoin.with_equal(pairs, members).select("a", "b", F.col("similarity").alias("metadata")), members


def genre_similarity(pairs: DataFrame, sets: DataFrame, known: bool = False) -> DataFrame:
    """``pairs`` (a, b) with the Jaccard of their genre sets; if ``known``, those alone whose artists both have one."""
    how = "inner" if known else "left"
    rows = pairs.join(sets.select(F.col("artist_id").alias("a"), F.col("genres").alias("ga")), "a", how).join(sets.select(F.col("artist_id").alias("b"), F.col("genres").alias("gb")), "b", how)
    return rows.withColumn("metadata", jaccard(F.col("ga"), F.col("gb"))).drop("ga", "gb")


def relation_pairs(relations: DataFrame, weights: dict[str, float] = config.RELATIONS) -> DataFrame:
    """The strongest relation of each pair, from (artist_1, artist_2, kind); unknown kinds are no evidence."""
    kinds = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = relations.where("artist_1 <> artist_2").select(F.least("artist_1", "artist_2").alias("a"), F.greatest("artist_1", "artist_2").alias("b"), F.try_element_at(kinds, F.col("kind")).alias("w"))
    return rows.where("w is not null").groupBy("a", "b").agg(F.max("w").alias("relation"))


def confidence(s: config.Similarity = S) -> Column:
    """high: many common listeners and several kinds of evidence; medium: enough listeners or metadata; else low."""
    n = F.coalesce("n_common", F.lit(0))
    kinds = sum((F.col(c).isNotNull().cast("int") for c in ("behavior", "metadata", "relation")), F.lit(0))
    listened = F.col("behavior").isNotNull()
    return (
        F.when(listened & (n >= s.high_common) & (kinds >= 2), "high")
        .when(listened & ((n >= s.medium_common) | (F.coalesce("metadata", F.lit(0.0)) >= s.enough_metadata)), "medium")
        .otherwise("low")
    )


def blended(behavior: DataFrame, metadata: DataFrame, relation: DataFrame, s: config.Similarity = S, places: int | None = 9, near: DataFrame | None = None) -> DataFrame:
    """Blend of the three parts for each pair, to nine places, so that ties are ties in whatever order sums were made (``places`` None: as
    it is, for those who round it themselves). A missing part counts 0 and is not made up for; pairs without behaviour are a class of
    their own (``is_fallback``), to be ranked apart. Pairs of ``near`` (a, b, metadata) that nothing else brings up are such pairs too: of
    them there may be very many, so that they are looked up among the others and not joined with them."""
    rows = behavior.join(metadata, ["a", "b"], "full").join(relation, ["a", "b"], "full")
    if near is not None:
        rows = shared.save(rows, "given")
        alone = near.join(shared.bounded(rows.select("a", "b"), 64), ["a", "b"], "left_anti")
        rows = rows.unionByName(alone.select("a", "b", "metadata"), allowMissingColumns=True)
    return scored(rows, s, places)


def scored(rows: DataFrame, s: config.Similarity = S, places: int | None = 9) -> DataFrame:
    """Pairs (n_common, behavior, metadata, relation) with ``score``, ``is_fallback`` and ``confidence``."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = s.behavior * part("behavior") + s.metadata * part("metadata") + s.relation * part("relation")
    rows = rows.withColumn("score", score if places is None else F.round(score, places))
    return rows.withColumn("is_fallback", F.col("behavior").isNull()).withColumn("confidence", confidence(s))


def _only_genres(rows: DataFrame, s: config.Similarity, places: int | None) -> DataFrame:
    none = {"n_common": F.lit(None).cast("long"), "behavior": F.lit(None).cast("double"), "relation": F.lit(None).cast("double")}
    return scored(rows.withColumns(none), s, places)


def genres_alone(given: DataFrame, classes: DataFrame, artists: DataFrame, of: Callable[[DataFrame], DataFrame], s: config.Similarity = S, places: int | None = 9) -> DataFrame:
    """``of`` (rows to rows, whose ends are a, b) of the blended pairs that only close genres bring up (``genre_classes``), less the written pairs
    ``given``. It is worked out for each two genre sets, not for each two artists; pairs are looked up among the given ones and not shuffled."""
    rows = setjoin.listed(of(_only_genres(classes, s, places)), artists)
    return rows.join(shared.bounded(given.select("a", "b"), 64), ["a", "b"], "left_anti")


def blended_counts(given: DataFrame, classes: DataFrame, artists: DataFrame, least: float, s: config.Similarity = S) -> DataFrame:
    """(metadata, confidence, is_fallback, pairs): how many pairs are blended, without a list of those that only genres bring up. The written
    ``given`` pairs that are as close (``least``, as that of ``genre_classes``) are counted with them and then taken off."""
    near = setjoin.counted(classes, artists).select("metadata", "pairs")
    off = given.where(F.col("metadata") >= least - 1e-12).select("metadata", F.lit(-1).cast("long").alias("pairs"))
    alone = near.groupBy("metadata").agg(F.sum("pairs").alias("pairs")).unionByName(off).groupBy("metadata").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
    columns = ["metadata", "confidence", "is_fallback", "pairs"]
    return scored(given, s).withColumn("pairs", F.lit(1).cast("long")).select(*columns).unionByName(_only_genres(alone, s, None).select(*columns))


def listener_bucket(n: Column) -> Column:
    """Counts are shown as ranges only."""
    return F.when(n.isNull(), "none").when(n < 20, "<20").when(n < 50, "20-49").when(n < 100, "50-99").when(n < 500, "100-499").otherwise("500+")


def evidence(edges: DataFrame) -> DataFrame:
    """(source, target, evidence_type, evidence_value): one row for each part that an edge has."""
    return edges.unpivot(["source", "target"], ["behavior", "metadata", "relation"], "evidence_type", "evidence_value").where("evidence_value is not null")


def explanation() -> Column:
    """A sentence from the evidence that is stored, and from no other."""
    return F.concat_ws(
        "; ",
        F.when(F.col("behavior").isNotNull(), F.concat(F.lit("common listeners: "), listener_bucket(F.col("n_common")))),
        F.when(F.col("metadata") > 0, F.concat(F.lit("genre overlap "), F.format_number(100 * F.col("metadata"), 0), F.lit(" %"))),
        F.when(F.col("relation").isNotNull(), F.lit("related by membership or collaboration")),
        F.when(F.col("is_fallback"), F.lit("no listening data")),
    )


def sessions(listens: DataFrame, minutes: int = S.session_minutes) -> DataFrame:
    """Listens with ``session``: it grows by one after a pause of over ``minutes`` minutes. Sessions are numbered within a day, and
    the days of a user, of which there is one row each, are then added up."""
    rows = with_gap(listens).withColumn("__new", F.when(F.col("gap").isNull() | (F.col("gap") > 60 * minutes), 1).otherwise(0))
    days = rows.groupBy("__day").agg(F.sum("__new").alias("__n"))
    earlier = Window.partitionBy("__day.user_id").orderBy("__day.chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = days.select(F.col("__day").alias("__d"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__day").orderBy(*IN_DAY).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("__within", F.sum("__new").over(within)).join(base, F.col("__day") == F.col("__d"))
    return joined.withColumn("session", F.col("__base") + F.col("__within")).select(*listens.columns, "session")


def heard_in_sessions(listens: DataFrame, minutes: int = S.session_minutes, cap: int | None = None) -> DataFrame:
    """(user_id, session, artist_id), written: the artists of each session. ``cap`` keeps the most heard ones of a session only."""
    heard = sessions(listens, minutes).groupBy("user_id", "session", "artist_id").agg(F.count("*").alias("n")).where("artist_id is not null")
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("user_id", "session").orderBy(F.desc("n"), "artist_id"))
        heard = heard.withColumn("__r", rank).where(F.col("__r") <= cap)
    return shared.save(heard.select("user_id", "session", "artist_id"), "heard")


def session_pairs(listens: DataFrame, minutes: int = S.session_minutes, cap: int | None = None, block: int = 256, heard: DataFrame | None = None) -> DataFrame:
    """(a, b, n_sessions): pairs of artists heard in one session, every pair of every session. ``heard``: ``heard_in_sessions`` of the listens, for
    those who have it.

    A session of more than ``block`` artists is dealt at random into blocks of about that many, and each two blocks (and each
    with itself) are a key of their own: every pair meets once, and no task holds such a session. The others are dealt as they are,
    once for both sides of the join. ``cap`` keeps the most heard artists of a session only, for those who want the bound more than the pairs."""
    heard = heard_in_sessions(listens, minutes, cap) if heard is None else heard
    heavy = heard.groupBy(F.col("user_id").alias("__u"), F.col("session").alias("__s")).agg(F.ceil(F.count("*") / block).cast("int").alias("__of")).where("__of > 1")
    heavy = shared.bounded(shared.save(heavy, "heavy"), 64)
    same = F.equal_null("user_id", "__u") & (F.col("session") == F.col("__s"))
    key = [F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("__user"), F.col("user_id").isNull().alias("__null"), "session"]
    whole = heard.join(heavy, same, "left_anti").select(*key, "artist_id")
    of = lambda x: whole.withColumnRenamed("artist_id", x)
    met = of("__x").join(of("__y"), ["__user", "__null", "session"]).where("__x < __y")
    dealt = heard.join(heavy, same).withColumn("__own", F.pmod(F.xxhash64("artist_id"), F.col("__of")).cast("int"))
    one = dealt.select(*key, F.col("artist_id").alias("__x"), F.col("__own").alias("__i"), F.explode(F.sequence(F.col("__own"), F.col("__of") - 1)).alias("__j"))
    two = dealt.select(*key, F.col("artist_id").alias("__y"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("__i"), F.col("__own").alias("__j"))
    blocks = one.join(two, ["__user", "__null", "session", "__i", "__j"]).where((F.col("__i") < F.col("__j")) | (F.col("__x") < F.col("__y")))
    met = met.select("__x", "__y").unionByName(blocks.select("__x", "__y"))
    return met.groupBy(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b")).agg(F.count("*").alias("n_sessions"))


def als_factors(weights: DataFrame, rank: int = 8, iterations: int = 5, seed: int = 42) -> DataFrame:
    """Implicit-feedback factors of the artists (integer ids): (artist_id, factors)."""
    from pyspark.ml.recommendation import ALS

    als = ALS(userCol="user_id", itemCol="artist_id", ratingCol="weight", implicitPrefs=True, rank=rank, maxIter=iterations, seed=seed)
    fitted = als.fit(weights.select(F.col("user_id").cast("int"), F.col("artist_id").cast("int"), F.col("weight").cast("float")))
    return fitted.itemFactors.select(F.col("id").cast("long").alias("artist_id"), F.col("features").alias("factors"))
