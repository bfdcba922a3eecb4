"""Line structuring, search, field filters and pruning."""

import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from logquarry.functions.linefields import field, leading_number, message_fields
from logquarry.functions.matching import phrase, term
from logquarry.functions.text import clip, field_number, sanitise, trim_zeros
from logquarry.functions.timestamps import line_timestamp, parse_time_parameter
from logquarry.operators import search as se
from logquarry.operators import structure as st
from tests.helpers import line_table, samples


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("text")).alias("x")).collect()]


def test_text_helpers(spark):
    assert column(spark, ["  Log Rate (MB) ", "a__B", "é!"], sanitise) == ["log_rate_mb", "a_b", ""]
    assert column(spark, ["78%", "42ms", "10.1.1.2", "-3.", "x"], field_number) == [78.0, 42.0, None, -3.0, None]
    assert [leading_number(x) for x in ("78%", "10.1.1.2", "x", "5")] == [78.0, None, None, 5.0]
    assert column(spark, ["1.50", "2", "0.001", "100"], lambda c: trim_zeros(c.cast("double"))) == ["1.5", "2", "0", "100"]
    assert column(spark, ["abc\r", "x" * 12], lambda c: clip(c, 10)) == ["abc", "x" * 10 + "…"]
    stamps = column(spark, ["a 2026/01/02T03:04:05 b", "Feb  3 04:05:06 x", "2026-02-31 00:00:00", ""], lambda c: line_timestamp(c, 2024))
    assert stamps == [datetime(2026, 1, 2, 3, 4, 5), datetime(2024, 2, 3, 4, 5, 6), None, None]
    assert parse_time_parameter("2026-01-02T03:04") == datetime(2026, 1, 2, 3, 4)
    assert parse_time_parameter("2026-01-02T03:04:05+02:00") == datetime(2026, 1, 2, 1, 4, 5)
    assert parse_time_parameter("soon") is None


def test_message_fields(spark):
    lines = [
        "2026/06/09 11:00:00 high system disk 78% full",
        "Jun  9 11:00:00 host kernel: oops",
        "11:00:00,123 warn x.y 5",
        "plain  words here",
        "2026-06-09T11:00:00Z info 9lives go",
        "2026/06/09 11:00:00",
    ]
    assert column(spark, lines, message_fields) == [
        ["disk", "78%", "full"],
        ["host", "kernel:", "oops"],
        ["x.y", "5"],
        ["plain", "words", "here"],
        ["9lives", "go"],
        [],
    ]
    assert column(spark, ["2026/06/09 11:00:00 a| b ||c"], lambda c: message_fields(c, "|")) == [["a", "b", "", "c"]]
    rule = field(2).compare(">", 70) & field(0).matches("DISK") | field(1).compare("==", "PLAIN")
    assert column(spark, lines, rule.on) == [True, False, False, True, False, False]
    assert column(spark, lines, field(9).compare("!=", 3).on) == [False] * 6
    assert column(spark, lines, field(3).not_matches("oops").on) == [True, False, False, True, False, False]


AGENT = """head without stamp
08/18/2026 10:00:00:123 [Info ]: started08/18/2026 10:00:01:456 [Error]: glued

  more text
(P12-T34)Debug( 567): 08/18/26 10:00:02:789 traced
 (P1-T2)Info 08/18/26 10:00:03:111 (  12): captive"""


def test_agent_formats(spark):
    rows = st.structure(line_table(spark, {"a.log": AGENT}))
    got = [tuple(r) for r in rows.orderBy("line", "part_no").select("line", "part_no", "ts_text", "label", "msg").collect()]
    assert got == [
        (1, 0, "", "", "head without stamp"),
        (2, 0, "2026-08-18 10:00:00.123", "Info", "started"),
        (2, 1, "2026-08-18 10:00:01.456", "Error", "glued"),
        (4, 0, "2026-08-18 10:00:01.456", "Error", "  more text"),
        (5, 0, "2026-08-18 10:00:02.789", "Debug", "P12-T34 traced"),
        (6, 0, "2026-08-18 10:00:03.111", "Info", "P1-T2 captive"),
    ]
    cut = st.structure_agent(line_table(spark, {"a.log": AGENT}), datetime(2026, 8, 18, 10, 0, 2), None)
    assert samples(cut, "line") == [("5",), ("6",)]


def test_search_context_filter_and_blocks(spark):
    text = "\n".join(["alpha 1", "error 2", "beta 3", "error 4", "gamma 5", "x", "x", "x", "ERROR 9"])
    lines = line_table(spark, {"a.log": text, "b.log": "nothing\nerror 1"})
    found = se.search(lines, term("err.r"), 1, 1, field(2).compare(">", 2))
    rows = {(r.path, r.line_no): (r.filtered, [c.line_no for c in r.context or []]) for r in found.collect()}
    assert rows == {("a.log", 2): (True, [3]), ("a.log", 4): (False, [3, 5]), ("a.log", 9): (False, [])}
    blocks = {(r.path, r.line_no): r.block for r in se.blocks(se.search(lines, phrase("ERROR"), 1, 1)).collect()}
    assert blocks == {("a.log", 2): 1, ("a.log", 4): 1, ("a.log", 9): 2, ("b.log", 2): 1}
    assert se.search(lines, phrase("error"), file_cap=1).count() == 2
    assert se.context_size(50, 7) == 30 and se.context_size(2, 99) == 99


def test_kelvin_sign_and_invalid_pattern(spark):
    assert column(spark, ["10 K", "x"], phrase("10 k").on) == [True, False]
    assert column(spark, ["a(b", "ab"], term("a(b").on) == [True, False]


def test_pruning_never_loses_a_hit(spark):
    rng = random.Random(11)
    words = ["disk", "error", "Kernel", "link", "DOWN", "über", "port", "ab", "straße"]
    files = {f"f{i}.log": "\n".join(" ".join(rng.choices(words, k=4)) for _ in range(3)) for i in range(25)}
    lines = line_table(spark, files).cache()
    grams, common = se.split_common(se.trigrams(lines), 15)
    grams, common = grams.cache(), common.cache()
    for condition in (
        phrase("disk error"),
        (phrase("kernel") & phrase("link down")) | phrase("über port"),
        phrase("STRASSE") | term("straße"),
        phrase("ab ab") & ~phrase("disk"),
        term("er+or") | phrase("port port"),
        ~phrase("error"),
    ):
        full = samples(se.match_lines(lines, condition), "path", "line_no")
        pruned = se.match_lines(lines, condition, candidates=se.candidates(lines, grams, common, condition))
        assert samples(pruned, "path", "line_no") == full, condition
    assert re.compile("x")
