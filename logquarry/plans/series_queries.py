"""Counter catalogue, lookup, selection, differences, alignment and nearest samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logquarry.operators import series as se
from logquarry.plans.views import table, view, with_views

NAMES = ["mp__evt__click_0", "mp__evt__click_1", "mp__evt__error_2"]


def counter_catalog(spark, sf_dir):
    return se.catalogue(view(spark, sf_dir, "counters"))


def counter_lookup(spark, sf_dir):
    return se.lookup(se.catalogue(view(spark, sf_dir, "counters")), "EVT__*_3", ">", 150.0)


def series_range(spark, sf_dir):
    rows = view(spark, sf_dir, "counters")
    return se.select_series(rows, [*NAMES, "mp__absent"], datetime(2024, 1, 5), datetime(2024, 1, 20)).select(
        "file_id", "name", "ts", "value"
    )


def counter_delta(spark, sf_dir):
    rows = se.differences(view(spark, sf_dir, "counters"))
    return rows.select("file_id", "name", "line_no", "ts", F.round("delta", 6).alias("delta"))


def counter_rate(spark, sf_dir):
    rows = se.differences(view(spark, sf_dir, "counters"))
    return rows.select("file_id", "name", "line_no", "ts", F.round("rate", 6).alias("rate"))


def series_align(spark, sf_dir):
    return se.align(view(spark, sf_dir, "counters"), NAMES)


def nearest_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    probes = orders.select(
        F.concat(F.lit("bundle"), F.col("o_custkey") % 2).alias("file_id"),
        F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("name"),
        F.col("o_orderkey").alias("probe_id"),
        F.timestamp_add(
            "SECOND", F.col("o_orderkey") * 7919 % 2592000, F.lit("2024-01-01").cast("timestamp_ntz")
        ).alias("ts"),
    )
    found = se.nearest_samples(view(spark, sf_dir, "counters"), probes)
    return found.select("file_id", "name", "probe_id", "ts", "sample_ts", "value")


def latest_values(spark, sf_dir):
    return se.latest(view(spark, sf_dir, "counters"))


def merged_marks(spark, sf_dir):
    marks = view(spark, sf_dir, "metrics").select("ts", "name", "value", F.col("line_no").alias("ord"))
    return se.merge_marks(marks).select("ts", "name", "ord", "value")


QUERIES = {
    "counter_catalog": counter_catalog,
    "counter_lookup": counter_lookup,
    "series_range": series_range,
    "counter_delta": counter_delta,
    "counter_rate": counter_rate,
    "series_align": series_align,
    "nearest_sample": nearest_sample,
    "latest_values": latest_values,
    "merged_marks": merged_marks,
}
CATALOG = "WITH cat AS (SELECT file_id, name, count(*) AS points, min(value) AS min, max(value) AS max FROM v_counters GROUP BY ALL)"
LAGGED = """WITH l AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM v_counters
            WINDOW w AS (PARTITION BY file_id, name ORDER BY ts, line_no))"""
ORACLE = {
    "counter_catalog": with_views(CATALOG + " SELECT * FROM cat", "counters"),
    "counter_lookup": with_views(
        CATALOG + " SELECT * FROM cat WHERE regexp_matches(name, '(?i)EVT__.*_3') AND max > 150", "counters"
    ),
    "series_range": with_views(
        """SELECT file_id, name, ts, value FROM v_counters
           WHERE name IN ('mp__evt__click_0', 'mp__evt__click_1', 'mp__evt__error_2')
             AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
           UNION ALL SELECT NULL, 'mp__absent', NULL, NULL""",
        "counters",
    ),
    "counter_delta": with_views(
        LAGGED + " SELECT file_id, name, line_no, ts, round(value - pv, 6) AS delta FROM l WHERE pt IS NOT NULL",
        "counters",
    ),
    "counter_rate": with_views(
        LAGGED
        + """ SELECT file_id, name, line_no, ts, round(CASE WHEN ts > pt THEN
              (value - pv) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) ELSE 0 END, 6) AS rate FROM l WHERE pt IS NOT NULL""",
        "counters",
    ),
    "series_align": with_views(
        "SELECT file_id, ts, "
        + ", ".join(f"arg_max(value, line_no) FILTER (name = '{n}') AS {n}" for n in NAMES)
        + " FROM v_counters WHERE name IN ("
        + ", ".join(f"'{n}'" for n in NAMES)
        + ") GROUP BY ALL",
        "counters",
    ),
    "nearest_sample": with_views(
        """WITH pr AS (SELECT concat('bundle', o_custkey % 2) AS file_id,
             CASE o_orderkey % 3 WHEN 0 THEN 'mp__evt__click_0' WHEN 1 THEN 'mp__evt__click_1'
                                 ELSE 'mp__evt__error_2' END AS name, o_orderkey AS probe_id,
             TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) AS ts FROM orders),
           b AS (SELECT pr.*, c.ts AS bt, c.value AS bv FROM pr ASOF LEFT JOIN v_counters c
                 ON pr.file_id = c.file_id AND pr.name = c.name AND pr.ts > c.ts),
           f AS (SELECT b.*, c.ts AS ft, c.value AS fv FROM b ASOF LEFT JOIN v_counters c
                 ON b.file_id = c.file_id AND b.name = c.name AND b.ts <= c.ts)
           SELECT file_id, name, probe_id::VARCHAR AS probe_id, ts,
             CASE WHEN ft IS NULL OR (bt IS NOT NULL AND epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts))
                  THEN bt ELSE ft END AS sample_ts,
             CASE WHEN ft IS NULL OR (bt IS NOT NULL AND epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts))
                  THEN bv ELSE fv END AS value
           FROM f WHERE bt IS NOT NULL OR ft IS NOT NULL""",
        "counters",
    ),
    "latest_values": with_views(
        "SELECT file_id, name, max(ts) AS ts, arg_max(value, (ts, line_no)) AS value FROM v_counters GROUP BY ALL",
        "counters",
    ),
    "merged_marks": with_views(
        """SELECT ts, name, min(line_no) AS ord, arg_min(value, line_no) AS value FROM v_metrics
           GROUP BY ts, name""",
        "metrics",
    ),
}
