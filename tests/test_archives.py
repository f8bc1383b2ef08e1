"""Dumps as they come: tar archives, compressed or not, found by registry or by name."""

import gzip
import io
import json
import lzma
import random
import tarfile

import pytest
import zstandard
from kindred.sources import archives, readers
from pyspark.sql import functions as F


def text(seed, n):
    r = random.Random(seed)
    lines = ["".join(r.choice("abc é東 ") for _ in range(r.choice((0, 1, 5, 40, 300)))) for _ in range(n)]
    return lines


def tarred(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        tar.addfile(_folder("dump"))
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def _folder(name):
    info = tarfile.TarInfo(name)
    info.type = tarfile.DIRTYPE
    return info


MEMBERS = {"dump/a.txt": text(1, 200), "dump/b.txt": ["x", "", "yé"], "dump/empty.txt": [], "other/c.json": text(3, 50)}


def data(lines, end="\n", last=True):
    return (end.join(lines) + (end if last and lines else "")).encode()


@pytest.mark.parametrize("kind", ["plain", "gz", "bz2", "xz", "zst"])
@pytest.mark.parametrize("split", [1 << 27, 997, 64])
def test_lines_of_members(spark, tmp_path, kind, split):
    made = {name: data(lines, last=name != "dump/b.txt") for name, lines in MEMBERS.items()}
    path = tmp_path / ("x.tar" if kind == "plain" else f"x.tar.{kind}")
    if kind == "zst":
        tarred(tmp_path / "x.tar", made)
        path.write_bytes(zstandard.ZstdCompressor().compress((tmp_path / "x.tar").read_bytes()))
    else:
        tarred(path, made, "w" if kind == "plain" else f"w:{kind}")
    df = archives.lines(spark, str(path), split=split)
    got = {name: [r.value for r in df.where(F.col("member") == name).orderBy("at").collect()] for name in MEMBERS}
    assert got == MEMBERS
    assert archives.lines(spark, str(path), "other/*", split).count() == 50
    assert df.rdd.getNumPartitions() == (3 if kind != "plain" else sum(-(-len(x) // split) for x in made.values()))


def test_single_compressed_file(spark, tmp_path):
    (tmp_path / "x.jsonl.xz").write_bytes(lzma.compress(data(MEMBERS["dump/a.txt"])))
    (tmp_path / "y.jsonl.gz").write_bytes(gzip.compress(data(["a", "b"], "\r\n")))
    assert [r.value for r in archives.lines(spark, f"file://{tmp_path}/x.jsonl.xz").orderBy("at").collect()] == MEMBERS["dump/a.txt"]
    assert [(r.member, r.at, r.value) for r in archives.lines(spark, str(tmp_path / "y.jsonl.gz")).collect()] == [("y.jsonl.gz", 0, "a"), ("y.jsonl.gz", 3, "b")]


def test_dumps_by_registry_and_by_name(spark, tmp_path):
    artist = lambda i, name: json.dumps({"id": i, "name": name, "aliases": [{"name": f"{name}!"}], "life-span": {"begin": "1999-02"}, "tags": ["left out"]})
    tarred(tmp_path / "artists-20240201.tar.xz", {"LICENSE": b"text", "mbdump/artist": data([artist("m1", "Mono"), artist("m2", "Polar"), "no json"])}, "w:xz")
    tarred(tmp_path / "artists-20240101.tar.xz", {"mbdump/artist": data([artist("old", "Old")])}, "w:xz")
    heard = [json.dumps({"user_identifier": f"u{k % 3}", "recording_mbid": f"r{k}", "listen_timestamp": f"2024-01-01T00:00:{k:02d}Z"}) for k in range(30)]
    tarred(tmp_path / "listens-20240301-full.tar", {"d/listens/1.listens": data(heard[:20]), "d/listens/2.listens": data(heard[20:]), "d/README": b"nothing"})
    tarred(tmp_path / "listens-20240302-incremental.tar", {"d/listens/1.listens": data(heard[:1])})
    found = readers.listed(spark, str(tmp_path), "catalogue").where("path like '%artists%'").unionByName(readers.listed(spark, str(tmp_path), "listens").where("path like '%listens-%'"))
    assert found.count() == 4
    artists = readers.dump(spark, found, "catalogue")
    assert {(r.artist_id, r.begin_year) for r in artists.collect()} == {("m1", 1999), ("m2", 1999)}
    assert {(r.artist_id, r.name) for r in readers.dump_names(artists).collect()} == {("m1", "Mono"), ("m1", "Mono!"), ("m2", "Polar"), ("m2", "Polar!")}
    plays = readers.listen_dump(spark, found, "listens", "salt")
    assert plays.count() == 30 and plays.select("user_id").distinct().count() == 3 and not plays.where("user_id like 'u%'").count() and plays.where("ts is null").isEmpty()
    with pytest.raises(LookupError, match="increments only"):
        readers.base_path(found.where("path like '%incremental%'"), "listens")
    with pytest.raises(LookupError, match="no snapshot"):
        readers.base_path(found, "nothing")
