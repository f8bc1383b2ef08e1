"""Versions, buckets and digests of what is published."""

import hashlib
import re

import pytest
from kindred.operators import ranking
from kindred.plans import recommend
from kindred.sources import clustered, digests, versions, writers
from pyspark.sql import functions as F


def table(spark, n=10):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("k"))


# --- versions --------------------------------------------------------------------------------------------------------


def test_of_two_publishers_on_one_base_one_fails(spark, tmp_path):
    root = str(tmp_path / "store")
    assert versions.last(root, spark) == (0, None) and not writers.has_current(root, spark)
    with pytest.raises(LookupError):
        writers.current_version(root, spark)
    writers.publish({"t": table(spark, 3)}, root, "v1", ["x"])

    def meanwhile(staged):
        writers.publish({"t": table(spark, 5)}, root, "fast", ["x"])
        assert writers.read_current(root, "t", spark).count() == 5
        return staged["t"].limit(0)

    with pytest.raises(versions.ConcurrentPublish):
        writers.publish({"t": table(spark, 7)}, root, "slow", ["x"], checks={"hook": meanwhile})
    assert writers.current_version(root, spark) == "fast" and writers.read_current(root, "t", spark).count() == 5
    writers.publish({"t": table(spark, 7)}, root, "again", ["x"])
    writers.roll_back(root, "v1", spark)
    assert writers.read_current(root, "t", spark).count() == 3
    assert [versions.entry(root, k, spark)["data_version"] for k in range(1, 5)] == ["v1", "fast", "again", "v1"]
    with pytest.raises(versions.ConcurrentPublish):
        versions.append(root, 3, {"data_version": "late"}, spark)
    with pytest.raises(Exception, match="(?i)path|exist"):
        writers.roll_back(root, "missing", spark)


def test_a_refused_version_leaves_no_entry(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="gate"):
        writers.publish({"t": table(spark)}, root, "v1", ["x"], checks={"gate": table(spark)})
    assert versions.last(root, spark) == (0, None)


# --- buckets ---------------------------------------------------------------------------------------------------------


@pytest.fixture(autouse=True)
def shown(spark):
    """A scan that prunes buckets says so only if it also keeps them apart."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_a_lookup_reads_its_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"), F.concat(F.lit("x"), F.col("id")).alias("strange name"))
    clustered.write(rows, path, clustered.Layout("k", 16, ("v",)))
    assert clustered.is_clustered(path, spark) and spark.read.parquet(path).count() == 1000
    stored = clustered.read(path, spark)
    assert stored.columns == rows.columns
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan(stored.where("k = 7")))
    assert {r.v for r in stored.where("k = 7").collect()} == set(range(7, 1000, 100))
    assert clustered.read(path, spark).where("k in (1, 2)").count() == 20


def test_published_index_and_edges(spark, tmp_path):
    root = str(tmp_path / "store")
    names = spark.createDataFrame([(k, f"{a} {b}") for k, (a, b) in enumerate((a, b) for a in ("Mono", "Polar", "Deep", "Ümlaut") for b in ("Sea", "Forest", "City Lights", "東京"))], "artist_id long, name string")
    recommend.publish_index(names, root, "v1", ["dump"])
    for q, best in (("mono forrest", "Mono Forest"), ("Deep City Light", "Deep City Lights"), ("ümlaut 東京", "Ümlaut 東京")):
        rows, asked = recommend.find_artist(root, q, spark).orderBy("rank").collect(), spark.createDataFrame([(q,)], "q string")
        assert rows[0]["name"] == best and rows == recommend.find_artists(root, asked).orderBy("rank").collect()
    assert recommend.find_artist(root, "", spark).count() == 0
    index = writers.read_current(root, "search_index", spark)
    few = plan(index.where(F.col("gram").isin("mon", "ono")))
    assert int(re.search(r"SelectedBucketsCount: (\d+) out of 64", few)[1]) <= 2

    rows = [(s, t, 1 - abs(s - t) / 100, 0.5, None if s % 2 else 0.25, None, "high", "20-49", False, "", "v1") for s in range(40) for t in range(40) if s != t]
    names = "source_artist_id long, target_artist_id long, total_score double, behavior_score double, metadata_score double, relation_score double, confidence string, common_listener_bucket string, is_fallback boolean, explanation string, model_version string"
    edges = spark.createDataFrame(rows, names)
    recommend.publish_edges(edges, root, "v2", ["dump"])
    stored = writers.read_current(root, "artist_edges", spark)
    one = recommend.neighbours(7, stored, 5)
    assert "SelectedBucketsCount: 1 out of 64" in plan(one) and [r.target_artist_id for r in one.collect()] == [6, 8, 5, 9, 4]
    evidence = writers.read_current(root, "edge_evidence", spark)
    want = {(hashlib.sha256(f"{s}/{t}/v1".encode()).hexdigest(), kind, v, name) for s, t, _, b, m, *_ in rows for kind, v, name in (("behavior", b, "ListenBrainz"), ("metadata", m, "Wikidata")) if v is not None}
    assert {tuple(r) for r in evidence.select("edge_id", "evidence_type", "evidence_value", "source_name").collect()} == want

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeds = spark.createDataFrame([(1, 3, 1.0), (1, 5, 2.0)], "request_id int, seed_id long, w double")
        served = recommend.directed(stored)
        met = seeds.join(served, seeds["seed_id"] == served["source"])
        met.collect()
        text = plan(met)
        scan = text[: text.index("SelectedBucketsCount")]
        assert "Bucketed: true" in text and scan.count("hashpartitioning(seed_id") <= 1 and "hashpartitioning(source" not in text
        assert ranking.near(ranking.candidates(seeds, served)).count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


# --- digests ---------------------------------------------------------------------------------------------------------


def brute_tree(data, leaf):
    leaves = [hashlib.sha256(b"\x00" + data[k : k + leaf]).digest() for k in range(0, max(1, len(data)), leaf)]
    return len(leaves), hashlib.sha256(b"\x01" + b"".join(leaves)).hexdigest()


def test_tree_digest_of_small_files(spark, tmp_path):
    files = {"empty": b"", "one": b"x", "even": b"ab" * 50, "odd name é": bytes(range(256)) * 3, "sub/deep": b"q" * 101}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for leaf in (100, 7):
        got = {r.bytes: (r.leaves, r.digest) for r in digests.tree_digests(spark, str(tmp_path), leaf).collect()}
        assert got == {len(d): brute_tree(d, leaf) for d in files.values() if d}


def test_tree_digest_of_a_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file: 2.2 GB of zeros with marks near its ends; the digest does not depend on how many tasks read it."""
    path, size, leaf = tmp_path / "dump.tar", 2_200_000_123, 256 << 20
    with path.open("wb") as f:
        f.write(b"begin")
        f.seek(size - 3)
        f.write(b"end")
    leaves = []
    for k in range(0, size, leaf):
        n = min(leaf, size - k)
        h = hashlib.sha256(b"\x00")
        zeros = bytes(1 << 20)
        head, tail = (b"begin" if k == 0 else b""), (b"end" if k + n == size else b"")
        h.update(head)
        left = n - len(head) - len(tail)
        while left:
            h.update(zeros[: min(left, 1 << 20)])
            left -= min(left, 1 << 20)
        h.update(tail)
        leaves.append(h.digest())
    want = len(leaves), hashlib.sha256(b"\x01" + b"".join(leaves)).hexdigest()
    for at_once in (3, 16):
        r = digests.tree_digests(spark, str(path), leaf, at_once).first()
        assert (r.bytes, r.leaves, r.digest) == (size, *want)
