"""Cases that once went wrong."""

import io
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logquarry.functions.matching import phrase, term
from logquarry.functions.text import fold, folded, groups, valid_regex
from logquarry.operators import configtree as ct
from logquarry.operators import search as se
from logquarry.operators import structure as st
from logquarry.operators.ordered import shared_folder
from logquarry.sources import archives as ar
from logquarry.sources.xmlnodes import xml_nodes
from tests.helpers import line_table

KELVIN, LONG_S = "K", "ſ"


def test_folding_survives_the_optimizer(spark):
    words = [KELVIN + "elvin", "Straße", "mi" + LONG_S + "s", "ΟΔΥΣΣΕΥΣ", "ıİ"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [folded(w) for w in words]
    assert rows[0].f == "kelvin" and rows[2].f == "miss"


def test_gate_and_trigrams_keep_every_hit(spark):
    lines = line_table(spark, {"a": f"zero {KELVIN}elvin", "b": "absolute KELVIN", "c": "nothing here", "d": f"mi{LONG_S}s"})
    for condition in (phrase("kelvin"), term("kelvin"), phrase(KELVIN + "elvin"), term("miss"), phrase("mi" + LONG_S + "s")):
        plain = {r.path for r in lines.where(condition.on(F.col("text"))).collect()}
        assert {r.path for r in se.match_lines(lines, condition).collect()} == plain
        for grams in (se.trigrams(lines), se.trigrams(lines, se.needed_trigrams(condition))):
            found = se.candidates(lines, *se.split_common(grams, 100), condition)
            assert plain <= {r.path for r in found.collect()}
    assert {r.path for r in se.match_lines(lines, phrase("kelvin")).collect()} == {"a", "b"}


def test_one_path_in_two_entries(spark):
    first = line_table(spark, {"a.log": "w\nx one\ny"})
    second = line_table(spark, {"a.log": "p\nq hit\nr"}).withColumn("entry_ord", F.lit(1))
    lines = first.unionByName(second)
    hits = se.match_lines(lines, phrase("hit"))
    got = [(r.entry_ord, r.line_no, r.text) for r in se.context_lines(hits, lines, 1, 1).orderBy("line_no").collect()]
    assert got == [(1, 1, "p"), (1, 3, "r")]
    stamped = lines.withColumn("text", F.when((F.col("entry_ord") == 0) & (F.col("line_no") == 1), "2024-01-02 03:04:05 begin").otherwise(F.col("text")))
    times = {(r.entry_ord, r.line): r.ts_text for r in st.structure_monitor(stamped).collect()}
    assert times[0, 3] == "2024/01/02 03:04:05" and times[1, 3] == ""


def test_documents_of_one_path_stay_apart(spark):
    one = line_table(spark, {"c.xml": "<config>\n<a>1</a>\n</config>"})
    two = line_table(spark, {"c.xml": "<config>\n<b>2</b>\n</config>"}).withColumn("entry_ord", F.lit(1))
    tags = {(r.entry_ord, r.tag, r.text) for r in xml_nodes(one.unionByName(two)).collect()}
    assert tags == {(0, "config", ""), (0, "a", "1"), (1, "config", ""), (1, "b", "2")}


def test_separator_byte_does_not_shift_groups(spark):
    rows = spark.createDataFrame([("a=x\u0001y b=z",), ("a=1 b=2",)], "t string")
    got = [list(r[0]) for r in rows.select(groups(F.col("t"), r"^a=(.*) b=(.*)$", 2)).collect()]
    assert got == [["x\u0001y", "z"], ["1", "2"]]


def test_patterns_are_judged_by_the_engine_that_runs_them(spark):
    assert valid_regex("[[a]") == "\\[\\[a\\]" and valid_regex("a++b") == "a++b"


class Failing(io.BytesIO):
    def __init__(self, data, reads):
        super().__init__(data)
        self.reads = reads

    def read(self, *size):
        self.reads -= 1
        if self.reads < 0:
            raise OSError("the store is away")
        return super().read(*size)


def test_read_errors_fail_the_task():
    with pytest.raises(OSError, match="away"):
        list(ar.lines_of(Failing(b"a\nb", 1), []))
    with pytest.raises(OSError, match="away"):
        list(ar.members(Failing(b"\x1f\x8b\x08" + b"x" * 600, 1), []))


def test_damage_is_told(tmp_path):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as out:
        for name in ("a.log", "b.log"):
            data = "".join(f"{name} {i * 7919 % 10007}\n" for i in range(20000)).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    cut = tmp_path / "cut.tgz"
    cut.write_bytes(whole.getvalue()[: len(whole.getvalue()) * 2 // 3])
    batch = pd.DataFrame({"path": [cut.as_uri()], "length": [1], "modificationTime": [pd.Timestamp(0)]})
    rows = pd.concat(ar._unpack(iter([batch])))
    last = rows[rows.path.isna()].iloc[0]
    assert last.error and (rows.line_no.notna()).sum() >= 20000


def test_long_lines_are_joined_once():
    assert [len(x) for x in ar.lines_of(io.BytesIO(b"x" * (3 << 20) + b"\ny"), [])] == [3 << 20, 1]


def test_sections_without_listed_columns(spark):
    text = "<config><decryption><rules><entry name='d1'><action>no</action><from><member>z</member></from></entry></rules></decryption></config>"
    nodes = xml_nodes(line_table(spark, {"c.xml": text}))
    rows = ct.section_table(nodes, "decryption").collect()
    assert [(r.name, r.fields) for r in rows] == [("d1", {"action": "no", "from": "z"})]


def test_root_is_sought_beyond_comments(spark):
    text = "<?xml version='1.0'?>\n<!-- <licenses>\n <a> -->" + "\n" * 5000 + "<config>\n</config>"
    assert [r.root for r in ct.root_tags(line_table(spark, {"c.xml": text})).collect()] == ["config"]


def test_shared_folder_is_the_sessions(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder == shared_folder(spark)
