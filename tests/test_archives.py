import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from logquarry.operators import kind as kd
from logquarry.sources import archives as ar
from logquarry.sources import tables as tb


def tar_bytes(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    files = {"./var/log/pan/a.log": b"one\r\ntwo\n\nfour", "bin/x.dat": b"ab\0cd\n", "tmp/cli/t.txt": b"> show\n"}
    (folder / "fw.tgz").write_bytes(tar_bytes(files))
    (folder / "plain.tar").write_bytes(tar_bytes({"PanGPS.log": b"a\n", "PanGPS.1.log": b"b\n"}, "w"))
    noise = bytes((i * 7919 >> 3) % 251 + 1 for i in range(400000))
    cut = tar_bytes({"first.log": b"kept 1\nkept 2\n", "second.log": noise})
    (folder / "cut.tgz").write_bytes(cut[: len(cut) // 2])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("dir\\app.log", "z1\nz2\n")
        archive.writestr("dir/app.log.1", "z3\n")
    (folder / "named.tgz").write_bytes(out.getvalue())
    (folder / "bad.zip").write_bytes(b"not an archive at all")
    rows = ar.unpack(spark, str(folder))
    target = str(tmp_path_factory.mktemp("tables") / "records")
    rows.write.parquet(target)
    return spark.read.parquet(target)


def names(records):
    return {r.file_id: r.filename for r in ar.archives(records).collect()}


def test_lines_and_entries(records):
    ids = names(records)
    lines = sorted((ids[r.file_id], r.entry_ord, r.path, r.line_no, r.text) for r in ar.lines(records).collect() if r.path != "second.log")
    assert lines == [
        ("cut.tgz", 0, "first.log", 1, "kept 1"),
        ("cut.tgz", 0, "first.log", 2, "kept 2"),
        ("fw.tgz", 0, "var/log/pan/a.log", 1, "one"),
        ("fw.tgz", 0, "var/log/pan/a.log", 2, "two"),
        ("fw.tgz", 0, "var/log/pan/a.log", 3, ""),
        ("fw.tgz", 0, "var/log/pan/a.log", 4, "four"),
        ("fw.tgz", 2, "tmp/cli/t.txt", 1, "> show"),
        ("named.tgz", 0, "dir/app.log", 1, "z1"),
        ("named.tgz", 0, "dir/app.log", 2, "z2"),
        ("named.tgz", 1, "dir/app.log.1", 1, "z3"),
        ("plain.tar", 0, "PanGPS.log", 1, "a"),
        ("plain.tar", 1, "PanGPS.1.log", 1, "b"),
    ]
    found = {(ids[r.file_id], r.path): (r.size, r.is_binary) for r in ar.entries(records).collect()}
    assert found["fw.tgz", "bin/x.dat"] == (6, True)
    assert found["fw.tgz", "var/log/pan/a.log"] == (14, False)


def test_status_and_registry(records):
    status = {r.filename: r.status for r in tb.registry(ar.archives(records)).collect()}
    assert status == {"fw.tgz": "parsed", "plain.tar": "parsed", "cut.tgz": "parsed", "named.tgz": "parsed", "bad.zip": "failed"}


def test_listing_and_folders(records):
    rows = ar.entries(records)
    assert [r.path for r in ar.listing(rows, "dir").collect()] == ["dir/app.log", "dir/app.log.1"]
    assert {r.folder for r in ar.folders(rows).collect()} == {"var", "bin", "tmp", "dir"}
    assert {r.folder for r in ar.folders(rows, "var/log").collect()} == {"pan"}
    assert [r.path for r in ar.listing(rows, "", "APP.LOG.1").collect()] == ["dir/app.log.1"]
    assert ar.read_entry(ar.lines(records), "tmp/cli/t.txt").count() == 1


def test_kinds(records):
    ids = names(records)
    kinds = kd.detect_kind(ar.entries(records))
    got = {ids[r.file_id]: (r.kind, r.kind_markers, r.firewall_hits, r.agent_hits) for r in kinds.collect()}
    assert got["fw.tgz"] == ("firewall", ["var/log/pan/a.log", "tmp/cli/t.txt"], 2, None)
    assert got["plain.tar"][0] == "gp-agent" and got["plain.tar"][3] == 1
    assert got["named.tgz"] == ("gp-agent", ["dir/app.log", "dir/app.log.1"], 0, 0)
    labels = kinds.select(kd.kind_label(F.col("kind")).alias("l")).distinct()
    assert {r.l for r in labels.collect()} == {"Firewall tech-support", "GlobalProtect agent"}
    kept = kd.for_kinds(ar.lines(records), kinds, kd.FIREWALL_PASS_KINDS)
    assert {ids[r.file_id] for r in kept.select("file_id").distinct().collect()} == {"fw.tgz"}


def test_save_replaces_one_archive(spark, tmp_path):
    folder = str(tmp_path / "t")
    tb.save(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file_id string, v int"), folder, ("v",))
    tb.save(spark.createDataFrame([("a", 9)], "file_id string, v int"), folder, ("v",))
    assert sorted((r.file_id, r.v) for r in tb.load(spark, folder).collect()) == [("a", 9), ("b", 3)]


def test_generations(spark, tmp_path):
    folder, shape = str(tmp_path / "g"), "file_id string, v int"

    def table(*rows):
        return spark.createDataFrame(list(rows), shape)

    def seen():
        return sorted(((r.file_id, r.v) for r in tb.current(spark, folder).collect()), key=str)

    with pytest.raises(FileNotFoundError):
        tb.current(spark, folder)
    first = table(("a", 1), ("a", 2), ("b", 3), ("c", None), ("c", None))
    assert tb.commit(first, first, folder, ("v",)) == 1
    assert seen() == [("a", 1), ("a", 2), ("b", 3), ("c", None), ("c", None)]
    # a is parsed again to nothing, b to another row; d is not named
    assert tb.commit(table(("b", 4), ("d", 5)), table(("a", 0), ("b", 0), (None, 0)), folder, ("v",)) == 2
    assert seen() == [("b", 4), ("c", None), ("c", None)]
    # rows of a writer that died before its manifest
    table(("c", 9)).write.parquet(f"{folder}/{tb.ROWS}/set=dead")
    assert seen() == [("b", 4), ("c", None), ("c", None)]
    assert tb.commit(table(), table(("b", 0), ("c", 0)), folder) == 3
    assert seen() == []
