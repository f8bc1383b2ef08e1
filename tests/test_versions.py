"""Redirect chains, drift between versions, lineage of columns, repeated snapshot lines."""

import random

import pytest
from kindred.operators import drift, lineage
from kindred.plans import recommend
from kindred.sources import readers, redirects, shared, writers
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "source string, field string, use_in_mvp string, license_class string, purpose string, notes string"


# --- redirects -------------------------------------------------------------------------------------------------------


def follow(pairs):
    to = dict(pairs)
    out = {}
    for a in to:
        at, n = a, 0
        while at in to:
            at, n = to[at], n + 1
        out[a] = at, n
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 8, 17])
def test_chains_end_at_the_live_id(spark, length):
    pairs = [(k, k + 1) for k in range(length)] + [(100 + k, length // 2) for k in range(20)]
    df = spark.createDataFrame(pairs, "old_id long, new_id long")
    assert {r.old_id: (r.live_id, r.hops) for r in redirects.live_ids(df).collect()} == follow(pairs)


def test_chains_of_a_random_forest(spark):
    r = random.Random(3)
    pairs = [(k, r.randrange(k)) for k in range(1, 300) if r.random() < 0.9]
    df = spark.createDataFrame([*pairs, pairs[0], (None, 3), (5000, None)], "old_id long, new_id long")
    assert {x.old_id: (x.live_id, x.hops) for x in redirects.live_ids(df).collect()} == follow(pairs)
    rows = spark.createDataFrame([(k, k) for k in (None, *range(320))], "artist_id long, was long")
    want = {k: follow(pairs).get(k, (k, 0))[0] for k in (None, *range(320))}
    out = readers.redirected(rows, df)
    assert out.columns == rows.columns and {x.was: x.artist_id for x in out.collect()} == want
    assert redirects.live_ids(df.where("old_id < 0")).count() == 0


def test_large_tables_of_redirects_are_merged_and_not_broadcast(spark, monkeypatch, capsys):
    pairs = [(k, k + 1) for k in range(300) if k % 7]
    df, rows = spark.createDataFrame(pairs, "old_id long, new_id long"), spark.createDataFrame([(k,) for k in (None, *range(310))], "artist_id long").withColumn("was", F.col("artist_id"))
    want = {k: follow(pairs).get(k, (k, 0)) for k in (None, *range(310))}
    for sent, plan in ((1 << 20, "BroadcastHashJoin"), (64, "SortMergeJoin")):
        monkeypatch.setattr(redirects, "SENT", sent)
        out = readers.redirected(rows, df, hops="hops")
        assert {x.was: (x.artist_id, x.hops) for x in out.collect()} == want
        capsys.readouterr()
        out.explain()
        said = capsys.readouterr().out
        assert plan in said and (plan == "BroadcastHashJoin" or "Broadcast" not in said)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_circles_are_named(spark, size):
    pairs = [(f"c{k}", f"c{(k + 1) % size}") for k in range(size)] + [(f"t{k}", f"t{k + 1}" if k < 5 else "c0") for k in range(6)] + [("x", "y")]
    with pytest.raises(redirects.RedirectCycle) as e:
        redirects.live_ids(spark.createDataFrame(pairs, "old_id string, new_id string"))
    assert e.value.ids == sorted(f"c{k}" for k in range(size))


# --- drift -----------------------------------------------------------------------------------------------------------


def edges(spark, lists):
    rows = [(a, b, 1 - k / 100) for a, targets in lists.items() for k, b in enumerate(targets)]
    return spark.createDataFrame(rows, "source string, target string, score double")


def brute_overlap(new, old):
    n = max(len(new), len(old))
    return sum(len(set(new[:d]) & set(old[:d])) / d for d in range(1, n + 1)) / n if n else None


def test_overlap_of_versions(spark):
    r = random.Random(5)
    staged, current = {}, {}
    for k in range(12):
        current[f"a{k}"] = r.sample("bcdefghijklmnopq", r.randrange(1, 12))
        staged[f"a{k}"] = current[f"a{k}"] if k < 2 else r.sample("bcdefghijklmnopq", r.randrange(1, 12))
    del staged["a3"], current["a4"]
    named = spark.createDataFrame([(a,) for a in [*(f"a{k}" for k in range(12)), "nobody", "a1"]], "artist_id string")
    report = {x.artist_id: x for x in drift.compared(edges(spark, staged), edges(spark, current), named, k=10).collect()}
    assert len(report) == 13
    for a, x in report.items():
        new, old = staged.get(a, [])[:10], current.get(a, [])[:10]
        assert (x.n_staged, x.n_current, x.n_common) == (len(new), len(old), len(set(new) & set(old)))
        assert x.rank_overlap == (None if not new and not old else pytest.approx(brute_overlap(new, old)))
        both = [abs(new.index(t) - old.index(t)) for t in set(new) & set(old)]
        assert x.mean_shift == (pytest.approx(sum(both) / len(both)) if both else None)
    gone = {x.artist_id for x in drift.drifted(drift.compared(edges(spark, staged), edges(spark, current), named), 0.5).collect()}
    assert gone == {a for a in report if current.get(a) and brute_overlap(staged.get(a, [])[:10], current[a][:10]) < 0.5} and "a3" in gone and "a4" not in gone and "a0" not in gone


def served(spark, lists):
    df = edges(spark, lists).select(F.col("source").alias("source_artist_id"), F.col("target").alias("target_artist_id"), F.col("score").alias("total_score"))
    return df.withColumns({"is_fallback": F.lit(False), "confidence": F.lit("high"), "model_version": F.lit("v")})


def test_publishing_stops_at_drift(spark, tmp_path):
    root, named = str(tmp_path / "store"), spark.createDataFrame([("a",), ("b",)], "artist_id string")
    first = {"a": list("bcdef"), "b": list("cdefg"), "z": list("abc")}
    recommend.publish_edges(served(spark, first), root, "v1", ["dump"], representatives=named)
    recommend.publish_edges(served(spark, first | {"a": list("bcdfe"), "z": list("xyw")}), root, "v2", ["dump"], representatives=named)
    with pytest.raises(ValueError, match="representative artists"):
        recommend.publish_edges(served(spark, first | {"b": list("vwxyz")}), root, "v3", ["dump"], representatives=named)
    with pytest.raises(ValueError, match="representative artists"):
        recommend.publish_edges(served(spark, {"a": list("bcdef")}), root, "v4", ["dump"], representatives=named)
    assert writers.current_version(root, spark) == "v2"


# --- lineage ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sources")
    spark.createDataFrame([("m1", "Name", "rock"), ("m2", "Other", "pop")], "artist_mbid string, artist_name string, tags string").write.parquet(f"{place}/catalogue/artists")
    spark.createDataFrame([("u1", "m1", 5), ("u2", "m2", 7)], "user_identifier string, artist_mbid string, seconds int").write.parquet(f"{place}/listens")
    origins = {f"{place}/catalogue": "Catalogue", f"{place}/listens": "Listens"}
    terms = [("Catalogue", "artist_mbid", "yes", "CC0"), ("Catalogue", "artist_name", "yes", "CC0"), ("Catalogue", "tags", "no", "CC0"), ("Listens", "user_identifier", "processing_only", "CC0"), ("Listens", "artist_mbid", "yes", "mixed"), ("Listens", "seconds", "processing_only", "CC0")]
    ledger = spark.createDataFrame([(*t, "", "") for t in terms], LEDGER)
    return spark.read.parquet(f"{place}/catalogue/artists"), spark.read.parquet(f"{place}/listens"), origins, ledger


def of(found):
    out = {}
    for column, source, field, summed in found:
        out.setdefault(column, set()).add((source, field, summed))
    return out


def test_lineage_through_everything(spark, tables):
    artists, listens, origins, _ = tables
    user, name, mbid, seconds = ("Listens", "user_identifier", False), ("Catalogue", "artist_name", False), ("Catalogue", "artist_mbid", False), ("Listens", "seconds", False)
    track = lambda df: of(lineage.uses(df, origins))
    assert track(listens.select(F.col("user_identifier").alias("artist_name"))) == {"artist_name": {user}}
    joined = artists.join(listens.withColumnRenamed("artist_mbid", "m"), F.col("artist_mbid") == F.col("m"))
    got = track(joined.select(F.concat("artist_name", F.upper("user_identifier")).alias("x"), F.when(F.col("seconds") > 3, F.lit("a")).otherwise(F.col("artist_mbid")).alias("y"), F.lit(1).alias("z")))
    assert got == {"x": {name, user}, "y": {seconds, mbid}}
    sums = listens.groupBy("user_identifier").agg(F.sum("seconds").alias("s"), F.count("*").alias("n"), F.countDistinct("artist_mbid").alias("d"), F.max("seconds").alias("m"), F.collect_list("seconds").alias("l"))
    assert track(sums) == {"user_identifier": {user}, "s": {("Listens", "seconds", True)}, "d": {("Listens", "artist_mbid", True)}, "m": {seconds}, "l": {seconds}}
    assert track(listens.groupBy("artist_mbid").agg((F.sum("seconds") / F.max("seconds")).alias("r")).select("r")) == {"r": {seconds}}
    from pyspark.sql import Window

    before = listens.withColumn("before", F.lag("user_identifier").over(Window.partitionBy("artist_mbid").orderBy("seconds")))
    assert user in track(before.select("before"))["before"]
    union = artists.select(F.col("artist_name").alias("v")).unionByName(listens.select(F.col("user_identifier").alias("v")))
    assert track(union.select(F.lower("v").alias("w"))) == {"w": {name, user}}
    assert track(listens.select(F.explode(F.split("user_identifier", "")).alias("e"))) == {"e": {user}}
    assert track(listens.alias("a").join(listens.alias("b"), F.col("a.artist_mbid") == F.col("b.artist_mbid")).select(F.col("b.user_identifier").alias("q"))) == {"q": {user}}
    assert track(listens.rollup("user_identifier").agg(F.count("*").alias("n")).select("user_identifier")) == {"user_identifier": {user}}
    hidden = listens.mapInPandas(lambda it: it, "user_identifier string, artist_mbid string, seconds int").select(F.col("seconds").alias("k"))
    assert user in track(hidden)["k"]
    artists.createOrReplaceTempView("artists_v")
    listens.createOrReplaceTempView("listens_v")
    sql = "with t as (select user_identifier as who, seconds from listens_v) select (select max(artist_name) from artists_v) as a, who, exists(select 1 from artists_v) as e from t where seconds > 1"
    got = track(spark.sql(sql))
    assert got["who"] == {user} and got["a"] == {name}
    assert track(spark.range(3).select((F.col("id") + 1).alias("i"))) == {}
    assert track(spark.createDataFrame([("s",)], T.StructType([T.StructField("c", T.StringType())]))) == {"c": {("", "c", False)}}
    saved = shared.save(listens.select(F.col("user_identifier").alias("name"), F.length("artist_mbid").alias("n")), "tables")
    assert track(saved.select(F.col("name").alias("sort_name"))) == {"sort_name": {user}}


def test_publish_walks_columns_back(spark, tables, tmp_path):
    artists, listens, origins, ledger = tables
    root = str(tmp_path / "store")
    joined = artists.join(listens.select(F.col("artist_mbid").alias("m"), F.col("user_identifier").alias("sort_name"), "seconds"), F.col("artist_mbid") == F.col("m"))
    for columns, why in (
        ([F.upper("sort_name").alias("artist_name")], r"artist_name: Listens.user_identifier \(for processing only\)"),
        ([F.col("tags").alias("aliases")], r"aliases: Catalogue.tags \(not to be used\)"),
        ([F.col("m").alias("artist_mbid")], r"Listens.artist_mbid \(licence\)"),
    ):
        with pytest.raises(PermissionError, match=why):
            writers.publish({"t": joined.select(*columns)}, root, "v1", ["x"], ledger=ledger, origins=origins)
    with pytest.raises(PermissionError, match="not to be used"):
        writers.publish({"t": joined.groupBy("artist_mbid").agg(F.count("tags").alias("n"))}, root, "v1", ["x"], ledger=ledger, origins=origins)
    with pytest.raises(PermissionError, match="not in the ledger"):
        writers.publish({"t": artists}, root, "v1", ["x"], ledger=ledger, origins={})
    assert not writers.has_current(root, spark)
    good = joined.groupBy("artist_mbid", "artist_name").agg(F.sum("seconds").alias("seconds"), F.countDistinct("sort_name").alias("listeners_n"))
    writers.publish({"t": good}, root, "v1", ["x"], ledger=ledger, origins=origins)
    assert writers.read_current(root, "t", spark).count() == 2
