"""Whole jobs and single evaluations that findings of round 3 asked for."""

from __future__ import annotations

import datetime

import duckdb

from __spark_entry__ import oracle_sql, queries
from logquarry.operators import agent as ag
from logquarry.operators import counters as co
from logquarry.operators import portals as po
from tests.oracle import shape, spark_rows


def _events(spark, folder, numbers):
    start = datetime.datetime(2024, 1, 5)
    rows = [(e, start + datetime.timedelta(seconds=10 * e), e % 9, ("click", "view", "error")[e % 3], e * 1.5, "{}") for e in numbers]
    columns = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/events.parquet")


def _suppliers(spark, folder):
    rows = [(k, f"Supplier#{k}", 1, 1.0) for k in range(1, 20)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")


def _duck(sql, folder):
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(sql)
    return shape([d[0] for d in cursor.description], cursor.fetchall())


def test_every_twelfth_event_is_an_application_block(spark, tmp_path):
    """events 19, 31, 43 have no block when only every twentieth event has one."""
    folder = str(tmp_path)
    _events(spark, folder, (19, 28, 31, 37, 43, 55))
    _suppliers(spark, folder)
    rows = spark_rows(spark, queries()["app_table_from_series"], folder)
    assert rows == _duck(oracle_sql()["app_table_from_series"], folder)
    assert len(rows[1]) > 2


def test_attempt_steps_are_not_repeated(spark):
    """F5, F7, F8, F10, F12: the steps read settled tables, so no plan holds the log text's patterns more than once."""
    day = datetime.datetime(2024, 1, 5)
    messages = ("SSO starts", "Load the SAML Browser now", "Gateway Login starts to x", "portal status is Connected.", "SSO starts")
    rows = [("h", 0, n, day + datetime.timedelta(seconds=9 * n), "Info", m) for n, m in enumerate(messages)]
    events = spark.createDataFrame(rows, "file_id string, entry_ord int, line_no long, ts timestamp_ntz, severity string, msg string")
    starts = ag.attempt_starts(events)
    assert "RLIKE" not in starts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.line_no for r in starts.collect()) == [0, 4]


def test_counter_lines_are_settled_before_headers_are_carried(spark):
    """the text is built and trimmed once, not once for each side of the join that carries headers."""
    rows = [("f", 0, "dp-monitor.log", 1, "2024-01-05 00:00:00.0 -0700  --- memory"), ("f", 0, "dp-monitor.log", 2, "Swap 1 0 2")]
    lines = spark.createDataFrame(rows, "file_id string, entry_ord int, path string, line_no long, text string")
    found = co.blocks(lines)
    assert "trim(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.clean for r in found.collect()] == ["Swap 1 0 2"]
    values = {(r.name, r.value, r.emit_ord) for r in co.extract_counters(lines).collect()}
    assert values == {("dp__memory__swap_free", 1.0, 0), ("dp__memory__swap_min", 0.0, 1), ("dp__memory__swap_total", 2.0, 2)}


def test_portal_lines_are_matched_once(spark, monkeypatch):
    """the table that is written last reads the patterns' results, not the patterns."""
    plans, settle = [], po.settle
    monkeypatch.setattr(po, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    text = "(P1-T2)Debug( 10): 01/05/24 00:00:01:123 Portal login completed with address p1.example.com."
    lines = spark.createDataFrame([("h", 0, "logs/PanGPS.log", 1, text)], "file_id string, entry_ord int, path string, line_no long, text string")
    rows = po.portal_lines(lines)
    assert "rlike" not in plans[-1].lower()
    assert [(r.current, r.signed_in) for r in rows.collect()] == [("p1.example.com", True)]
