import hashlib
import json
import random
import re

import pytest
from dealt import records_dealt
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred import schemas
from kindred.operators import coverage, resolve
from kindred.plans import validate
from kindred.sources import readers, shared, writers

#: An expectation and two namesakes, of which one fits.
MONO = {"artist_name": "MONO", "expected_country": "JP", "expected_type": "Group", "expected_ended": "false", "disambiguation_hint": "Japanese post-rock band"}
RIGHT = {"id": "r", "name": "MONO", "score": "100", "country": "JP", "type": "Group", "life-span": {"ended": False}, "disambiguation": "Japanese post-rock band", "aliases": []}
WRONG = {"id": "w", "name": "Mono", "score": "100", "country": "GB", "type": "Group", "life-span": {"ended": True}, "disambiguation": "British electronic duo", "aliases": []}


def artists(spark, *rows):
    names = [c.split()[0] for c in schemas.VALIDATION.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, "") for n in names) for r in rows], schemas.VALIDATION)


def searches(spark, **found):
    lines = [json.dumps({"artist_name": k, **({"error": v} if isinstance(v, str) else {"artists": v})}) for k, v in found.items()]
    return spark.read.schema(schemas.SEARCH).json(spark.sparkContext.parallelize(lines))


def resolved(spark, row, found):
    return resolve.resolve(artists(spark, row), searches(spark, **({row["artist_name"]: found} if found is not None else {"other": []}))).first()


def test_right_artist_beats_namesake(spark):
    scored = {r["candidate"]["id"]: r["total"] for r in resolve.score_candidates(artists(spark, MONO), searches(spark, MONO=[WRONG, RIGHT])).collect()}
    assert scored == {"r": 100.0, "w": 78.0}
    row = resolved(spark, MONO, [WRONG, RIGHT])
    assert (row.resolution_status, row.resolved_mbid, row.resolver_score, row.score_gap, row.candidate_count, row.resolution_note) == ("auto_resolved", "r", 100.0, 22.0, 2, "")
    top = json.loads(row.top_candidates)
    assert [x["mbid"] for x in top] == ["r", "w"] and top[0]["ended"] is False and top[0]["api_score"] == 100


def test_no_candidates(spark):
    for found in (None, []):
        row = resolved(spark, MONO, found)
        assert (row.resolution_status, row.resolved_mbid, row.candidate_count, row.top_candidates) == ("not_found", "", 0, "[]")


def test_single_candidate_gap_is_total(spark):
    assert resolved(spark, MONO, [RIGHT]).score_gap == 100.0


def test_ties_keep_input_order(spark):
    row = resolved(spark, MONO, [RIGHT | {"id": "first"}, RIGHT | {"id": "second"}])
    assert (row.resolved_mbid, row.score_gap, row.resolution_status) == ("first", 0.0, "manual_review")


def test_ambiguous_category_is_reviewed(spark):
    assert resolved(spark, MONO | {"category": "ambiguous_name"}, [RIGHT]).resolution_status == "manual_review"


def test_missing_values(spark):
    row = resolved(spark, MONO, [{"id": "n", "name": "mono", "score": "x", "aliases": None}])
    assert row.resolver_score == 30.0 and row.resolved_mbid == "n"
    blank = dict.fromkeys(MONO, "") | {"artist_name": "MONO"}
    assert resolved(spark, blank, [{"id": "n", "name": "else", "score": "200", "aliases": [{"name": "Ｍｏｎｏ"}]}]).resolver_score == 100.0


def test_request_error(spark):
    row = resolved(spark, MONO, "timeout")
    assert (row.resolution_status, row.resolution_note, row.resolved_mbid, row.candidate_count) == ("request_error", "timeout", "", None)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 250), st.sampled_from(["JP", "GB", None]), st.sampled_from([True, False, None])), min_size=1, max_size=6))
def test_scores_are_bounded(spark, rows):
    found = [{"id": str(i), "name": "x", "score": str(s), "country": c, "life-span": {"ended": e}, "aliases": []} for i, (s, c, e) in enumerate(rows)]
    totals = [r.total for r in resolve.score_candidates(artists(spark, MONO), searches(spark, MONO=found)).collect()]
    assert len(totals) == min(5, len(rows)) and all(0 <= t <= 100 for t in totals)


def rows(spark, resolved, data, incorrect, pending, n=10):
    made = [("auto_resolved" if i < resolved else "not_found", i < data, 1, "" if i < pending else " Incorrect" if i < pending + incorrect else "CONFIRMED") for i in range(n)]
    return spark.createDataFrame(made, "resolution_status string, listenbrainz_has_data boolean, wikidata_genre_count int, manual_identity_status string")


@pytest.mark.parametrize(
    ("args", "decision", "zero"),
    [
        ((10, 10, 0, 1), "PENDING_MANUAL_IDENTITY_REVIEW", None),
        ((9, 7, 0, 0), "GO", True),
        ((9, 7, 1, 0), "NO_GO_OR_REDUCE_SCOPE", False),
        ((8, 10, 0, 0), "NO_GO_OR_REDUCE_SCOPE", True),
        ((10, 6, 0, 0), "NO_GO_OR_REDUCE_SCOPE", True),
    ],
)
def test_verdict(spark, args, decision, zero):
    v = coverage.summary(rows(spark, *args)).first()["go_no_go"]
    assert (v["decision"], v["same_name_zero_errors"]) == (decision, zero)


def test_rates_are_half_even(spark):
    assert coverage.summary(rows(spark, 1, 0, 0, 0, n=32)).first()["musicbrainz_candidate_rate"] == 0.0312


def test_empty_list_is_an_error(spark):
    with pytest.raises(Exception, match="no rows"):
        coverage.summary(rows(spark, 0, 0, 0, 0, n=0)).collect()


def test_knowledge_base(spark):
    triples = [("http://kb/Q2", "P434", "m"), ("http://kb/Q1", "P434", "m"), ("http://kb/Q1", "P136", "g1"), ("http://kb/Q2", "P136", "g1"), ("http://kb/Q2", "P136", "g2"), ("http://kb/Q1", "P27", "c"), ("http://kb/Q1", "P495", "c"), ("http://kb/Q3", "P434", "n")]
    ids = spark.createDataFrame([("m",), ("m",), ("",), ("n",), ("unknown",)], "mbid string")
    got = {r.mbid: r for r in coverage.knowledge_base(ids, spark.createDataFrame(triples, schemas.TRIPLES)).collect()}
    assert set(got) == {"m", "n"}
    assert (got["m"].wikidata_item, got["m"].wikidata_genre_count, got["m"].wikidata_country_count, got["m"].wikidata_start_count) == ("Q1", 2, 1, 0)
    assert got["n"].wikidata_genre_count == 0


def test_knowledge_base_has_tasks_by_rows(spark, monkeypatch, capsys):
    """Joins and distinct facts have as many tasks as rows need, not the session's four; a hub, repeated lines and items without facts count."""
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    r = random.Random(5)
    said = [(f"k/Q{i}", "P434", f"m{r.randrange(20)}") for i in range(150)] + [(f"k/Q{i}", "P434", "hub") for i in range(0, 150, 2)]
    said += [(f"k/Q{r.randrange(140)}", r.choice(["P136", "P27", "P495", "P571", "P31"]), f"o{r.randrange(30)}") for _ in range(600)]
    triples = spark.createDataFrame(said + said[:40], schemas.TRIPLES)
    out = coverage.knowledge_base(spark.createDataFrame([(f"m{k}",) for k in range(15)] + [("hub",), (None,)], "mbid string"), triples)
    want = {}
    for q, p, m in said:
        if p == "P434" and (m == "hub" or int(m[1:]) < 15):
            own = want.setdefault(m, [set(), set(), set(), set()])
            own[0].add(q)
            for i, kinds in enumerate((["P136"], ["P27", "P495"], ["P571"]), 1):
                own[i] |= {o for s, k, o in said if s == q and k in kinds}
    assert {x[0]: x[1:] for x in out.collect()} == {m: (min(q).rpartition("/")[2], *map(len, rest)) for m, (q, *rest) in want.items()}
    out.explain()
    dealt = [int(x) for x in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)]
    assert len(dealt) >= 4 and min(dealt) >= 16


def test_knowledge_base_deals_facts_alone(spark, monkeypatch):
    """Of (id, item) pairs only the facts go on to the ids' tasks, no row for the item itself; odd rows count as ever: an object that is null is a
    value, subjects, properties and ids that are null or empty say nothing, repeated rows count once."""
    monkeypatch.setattr(shared, "TASK_ROWS", 20)
    said = [(f"k/Q{i:02}", "P434", f"m{i % 5}") for i in range(40)] + [(f"k/Q{i:02}", "P136", f"g{i % 7}") for i in range(0, 40, 2)]
    odd = [("k/Q00", "P27", None), ("k/Q05", "P27", None), (None, "P434", "alone"), (None, "P136", "g"), ("k/Q01", None, "x"), ("k/Q01", "P434", ""), ("k/Q01", "P434", None), ("k/Q09", "P434", "bare")]
    triples = spark.createDataFrame(said + odd + said[:30], schemas.TRIPLES)
    ids = spark.createDataFrame([(f"m{k}",) for k in range(5)] + [("alone",), ("bare",), ("",), (None,), ("m1",)], "mbid string")
    out = coverage.knowledge_base(ids, triples)
    got = {r.mbid: tuple(r)[1:] for r in out.collect()}
    genres = {f"m{k}": len({i % 7 for i in range(k, 40, 5) if i % 2 == 0}) for k in range(5)}
    assert got == {m: (f"Q0{m[1:]}", n, int(m == "m0"), 0) for m, n in genres.items()} | {"bare": ("Q09", 0, 0, 0)}
    assert records_dealt(out, "share") == 20 + 2  # a genre of every other item and two countries; before, the items too


def test_validation_end_to_end(spark, tmp_path):
    header = ",".join(c.split()[0] for c in schemas.VALIDATION.split(", "))
    (tmp_path / "artists.csv").write_text(f"{header}\nMONO,A|B,plain,JP,Group,false,Japanese post-rock band,confirmed,note\nIVE,C,plain,KR,Group,,,confirmed\n", encoding="utf-8")
    (tmp_path / "searches.json").write_text("".join(json.dumps(x) + "\n" for x in [{"artist_name": "MONO", "artists": [WRONG, RIGHT]}, {"artist_name": "IVE", "artists": [{"id": "i", "name": "IVE", "score": "99", "country": "KR", "type": "Group"}]}]))
    (tmp_path / "stats.json").write_text("".join(json.dumps(x) + "\n" for x in [{"mbid": "r", "payload": {"total_listen_count": "12", "listeners": [{"user_name": "someone", "listen_count": 3}], "last_updated": "1"}}, {"mbid": "i"}]))
    (tmp_path / "triples.json").write_text("".join(json.dumps(dict(zip(("subject", "property", "object"), t, strict=True))) + "\n" for t in [("k/Q9", "P434", "r"), ("k/Q9", "P136", "g")]))
    found, summary = validate.run_validation(spark, *(str(tmp_path / f) for f in ("artists.csv", "searches.json", "stats.json", "triples.json")), str(tmp_path / "reports"), expected_rows=2)
    by = {r.artist_name: r for r in found.collect()}
    assert (by["MONO"].total_listen_count, by["MONO"].top_listener_count, by["MONO"].wikidata_genre_count) == (12, 1, 1)
    assert (by["IVE"].listenbrainz_has_data, by["IVE"].total_listen_count, by["IVE"].wikidata_item) == (False, 0, None)
    assert "someone" not in str(found.collect())
    assert summary["go_no_go"]["decision"] == "NO_GO_OR_REDUCE_SCOPE" and summary["listenbrainz_data_rate"] == 0.5
    assert json.loads((tmp_path / "reports/coverage_summary.json").read_text())["artist_count"] == 2
    assert "| 50.0% | 70% | no |" in (tmp_path / "reports/coverage_summary.md").read_text()
    assert spark.read.option("header", True).csv(str(tmp_path / "reports/artist_coverage.csv")).count() == 2


def test_list_checks(spark, tmp_path):
    header = ",".join(c.split()[0] for c in schemas.VALIDATION.split(", "))
    (tmp_path / "a.csv").write_text(f"{header}\nBOØWY,,,,,,,,\nＢＯøＷＹ!,,,,,,,,\n", encoding="utf-8")
    with pytest.raises(ValueError, match="exactly 50"):
        readers.validation_list(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError, match="unique"):
        readers.validation_list(spark, str(tmp_path / "a.csv"), None)


def test_only_the_first_five_candidates_count(spark):
    row = resolved(spark, MONO, [WRONG | {"id": str(i)} for i in range(5)] + [RIGHT])
    assert row.candidate_count == 5 and row.resolved_mbid == "0"


def test_ragged_csv(spark, tmp_path):
    one = spark.createDataFrame([("a", 1)], "name string, n int")
    two = spark.createDataFrame([(["x"], "b")], "tags array<string>, name string")
    writers.write_csv(one, str(tmp_path / "r.csv"), two)
    lines = sorted(line for p in (tmp_path / "r.csv").glob("part-*") for line in p.read_text().splitlines())
    assert lines == ["a,1,", 'b,,"[""x""]"', "name,n,tags"]


def test_dump_and_checksums(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"id": "m", "name": "MONO", "life-span": {"begin": "1999-01", "ended": False}, "aliases": [{"name": "モノ"}, {"name": None}]}) + "\n")
    (tmp_path / "r.json").write_text(json.dumps({"source_name": "catalogue", "snapshot_date": "2024-01-01", "path": str(tmp_path / "d.json")}) + "\n")
    found = readers.registry(spark, str(tmp_path / "r.json"))
    artists = readers.dump(spark, found, "catalogue")
    assert {tuple(r) for r in readers.dump_names(artists).collect()} == {("m", "MONO"), ("m", "モノ")} and artists.first().begin_year == 1999
    with pytest.raises(LookupError):
        readers.dump(spark, found, "listens")
    rows = {r.path.rsplit("/", 1)[1]: r.sha256 for r in readers.artifact_checksums(spark, str(tmp_path)).collect()}
    assert rows["d.json"] == hashlib.sha256((tmp_path / "d.json").read_bytes()).hexdigest()
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert writers.checksum(a) == writers.checksum(a.select("s", "i").orderBy("i", ascending=False).repartition(2)) != writers.checksum(a.na.fill("y"))


def test_shared_folder_is_asked_for(spark, monkeypatch):
    """Without a folder that all see, a cluster gets an error, threads of one machine get a folder of it."""
    from types import SimpleNamespace

    unset = SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None)
    for master, fine in (("local[4]", True), ("local-cluster[2,1,900]", False), ("yarn", False), ("spark://h:7077", False)):
        session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert shared.root(session).startswith("file://")
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                shared.root(session)


def test_publish_and_roll_back(spark, tmp_path):
    root = str(tmp_path / "store")
    writers.publish({"artists": spark.range(3)}, root, "v1", ["dump"])
    assert writers.current_version(root, spark) == "v1"
    with pytest.raises(ValueError, match="gate"):
        writers.publish({"artists": spark.range(2)}, root, "v2", ["dump"], {"rows": spark.range(1)})
    assert writers.read_current(root, "artists", spark).count() == 3
    writers.publish({"artists": spark.range(5)}, root, "v3", ["dump"])
    assert writers.read_current(root, "artists", spark).count() == 5
    writers.roll_back(root, "v1", spark)
    assert writers.read_current(root, "artists", spark).count() == 3


def test_cache_and_redirects(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("",), ("a",)], "k string")
    assert [r[0] for r in readers.missing(keys, spark.createDataFrame([("b",)], "k string"), "k").collect()] == ["a"]
    moved = readers.redirected(spark.createDataFrame([("x",), ("y",)], "artist_id string"), spark.createDataFrame([("x", "z")], "old_id string, new_id string"))
    assert sorted(r[0] for r in moved.collect()) == ["y", "z"]
    registry = spark.createDataFrame([("mb", "2024-01-01", "p1"), ("mb", "2024-03-01", "p2"), ("lb", "2025-01-01", "q")], "source_name string, snapshot_date string, path string")
    assert readers.latest(registry, "mb").first()["path"] == "p2"


def test_repeated_lines_count_once(spark):
    """Snapshots are appended to: one row for each artist, from the newest line; of equal ones, from one that did not fail."""
    lines = [
        {"artist_name": "MONO", "artists": [WRONG], "fetched_at": "2024-01-01T00:00:00Z"}, {"artist_name": "MONO", "artists": [WRONG, RIGHT], "fetched_at": "2024-03-01T00:00:00Z"},
        {"artist_name": "MONO", "artists": [WRONG, RIGHT], "fetched_at": "2024-03-01T00:00:00Z"}, {"artist_name": "MONO", "error": "timeout", "fetched_at": "2024-02-01T00:00:00Z"},
    ]
    found = spark.read.schema(schemas.SEARCH).json(spark.sparkContext.parallelize([json.dumps(x) for x in lines], 3))
    rows = resolve.resolve(artists(spark, MONO), found).collect()
    assert [(r.resolution_status, r.resolved_mbid, r.candidate_count, r.score_gap) for r in rows] == [("auto_resolved", "r", 2, 22.0)]
    assert resolve.resolve(artists(spark, MONO), found.drop("fetched_at").where("error is not null or size(artists) = 2")).first().resolution_status == "auto_resolved"
    stats = spark.createDataFrame([("r", True, 5, "2024-01-01"), ("r", True, 9, "2024-02-01"), ("r", True, 9, "2024-02-01"), ("x", True, 1, None)], "mbid string, listenbrainz_has_data boolean, total_listen_count long, t string").selectExpr("*", "cast(t as timestamp) as fetched_at").drop("t")
    done = coverage.with_stats(resolve.resolve(artists(spark, MONO), found), stats).collect()
    assert [(r.total_listen_count, "fetched_at" in r) for r in done] == [(9, False)]
    kb = spark.createDataFrame([("r", "Q1", 3), ("r", "Q1", 3)], "mbid string, wikidata_item string, wikidata_genre_count long")
    assert coverage.with_knowledge(resolve.resolve(artists(spark, MONO), found), kb).count() == 1


def test_present_takes_what_is_there(spark):
    row = spark.createDataFrame([("a", 1, "x")], "artist_name string, candidate_count int, hidden string")
    assert coverage.present(row, ["candidate_count", "missing", "artist_name"]).columns == ["candidate_count", "artist_name"]
    assert coverage.present(row, ["missing"]).columns == []
