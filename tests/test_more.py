"""Application names, config-size risk, log files of kernel messages and tables of the command line."""

from pyspark.sql import functions as F

from logquarry.operators import appstats as ap
from logquarry.operators import cli
from logquarry.operators import memory as me
from tests.helpers import line_table, samples


def test_app_names_prefer_current_content(spark):
    files = {
        "opt/pancfg/updates/oldcontent/global.xml": '<entry name="old" id="15"/>',
        "opt/pancfg/updates/curcontent/x/global.xml": '<entry id="7" name="later"/> <entry name="web" id="15"/>\n'
        '<entry name="again" id="15"/><entry name="seven" id="7"/>',
    }
    names = ap.app_names(line_table(spark, files))
    assert samples(names, "app_id", "name") == [("15", "web"), ("7", "later")]
    rows = spark.createDataFrame([("f", 15), ("f", 99)], "file_id string, app_id int")
    assert samples(ap.label_apps(rows, names), "app_id", "app") == [("15", "web"), ("99", "app-99")]
    tiers = line_table(spark, files).select(ap.content_source(F.col("path")).alias("s")).distinct()
    assert samples(tiers, "s") == [("curcontent",), ("oldcontent",)]


def test_config_size_risk(spark):
    columns = "file_id string, name string, ts timestamp_ntz, value double, entry_ord int, line_no int, emit_ord int"
    counters = spark.createDataFrame(
        [("a", "mp__memory__mem_total", None, 4e6, 0, 1, 0), ("b", "mp__top__mem_total", None, 16000.0, 0, 1, 0)], columns
    ).withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    entries = spark.createDataFrame(
        [("a", "x/mergesp.xml", 30 << 20), ("a", "y/MERGESP.xml", 5), ("b", "x/mergesp.xml", 30 << 20)], "file_id string, path string, size long"
    )
    planes = spark.createDataFrame([("a", "mp"), ("b", "mp"), ("c", "mp")], "file_id string, plane string")
    got = samples(me.config_size_risk(planes, entries, counters), "file_id", "severity", "title")
    assert got == [("a", "high", "Config size"), ("b", "medium", "Config size")]


def test_oom_events_of_kernel_logs(spark):
    files = {
        "var/log/messages": "Jun  9 10:00:00 fw a.out invoked oom-killer: x\nquiet\nJun  9 10:00:01 Killed process 12 (devsrvr) score 900\nout of memory: Kill process 7 (x)",
        "big.log": "p invoked oom-killer",
    }
    entries = spark.createDataFrame(
        [("f", 0, "var/log/messages", 100), ("f", 1, "big.log", 0)], "file_id string, entry_ord int, path string, size long"
    )
    events = me.oom_events(me.kernel_lines(line_table(spark, files), entries), 2026)
    rows = {(str(r.ts), r.invoked_by, r.killed, r.killed_pid, r.score) for r in events.collect()}
    assert rows == {("2026-06-09 10:00:00", "a.out", "devsrvr", "12", "900"), ("None", None, "x", "7", None)}
    first = me.first_oom(events).collect()[0]
    assert first.ooms == 2 and first["first"]["killed"] == "x"


def test_command_body_from_first_file_with_output(spark):
    files = {
        "tmp/cli/a.txt": "> show running application statistics\n> show clock\nnow",
        "tmp/cli/b.txt": "> show running application statistics\nVsys: 1\napp one two   1 2 3 4 5\nTotal 9 8 7 6 5\n> other\nlate 1 2 3 4 5",
    }
    apps, totals = cli.application_table(cli.command_body(line_table(spark, files), cli.APP_STATS_COMMAND))
    assert samples(apps, "vsys", "app", "sessions", "threats") == [("1", "app one two", "1.0", "5.0")]
    assert samples(totals, "reported_sessions", "reported_bytes") == [("9.0", "7.0")]
